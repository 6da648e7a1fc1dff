"""Group summaries, set comparisons and reshaping."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorewatch.functions.rules import one_if, other_segment_verdict
from scorewatch.operators.joins import with_lookup
from scorewatch.operators.ordered import quantiles


SKETCH_BITS = 14  # of a distinct-count sketch: a standard error of some 0.8 %


def account_sketches(account: str, label: str) -> list[Column]:
    """Mergeable sketches of the distinct accounts and of those with label 1."""
    held = F.col(account).cast("string")
    return [
        F.hll_sketch_agg(held, SKETCH_BITS).alias("__accounts"),
        F.hll_sketch_agg(F.when(F.col(label) == 1, held), SKETCH_BITS).alias("__bads"),
    ]


def united_sketches() -> list[Column]:
    return [F.hll_union_agg(c).alias(c) for c in ("__accounts", "__bads")]


def with_estimates(df: DataFrame, bad: str = "bad_count") -> DataFrame:
    """Replace the sketches by estimated counts; groups without any account drop out."""
    counts = {"distinct_accounts": "__accounts", bad: "__bads"}
    estimated = df.withColumns({name: F.hll_sketch_estimate(c) for name, c in counts.items()})
    return estimated.drop("__accounts", "__bads").where(F.col("distinct_accounts") > 0)


def account_summary(df: DataFrame, keys: Sequence[str], account: str, label: str, approx: bool = False) -> DataFrame:
    """Distinct accounts and distinct accounts with label 1; `approx` estimates them from sketches.

    The exact counts shuffle one row per account, the estimates one sketch per group and task.
    """
    if approx:
        return with_estimates(df.groupBy(*keys).agg(*account_sketches(account, label)), "bad_accounts")
    bad = F.max(F.when(F.col(label) == 1, 1).otherwise(0)).alias("__bad")
    per_account = df.where(F.col(account).isNotNull()).groupBy(*keys, account).agg(bad)
    return per_account.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("distinct_accounts"), F.sum("__bad").alias("bad_accounts")
    )


def split_summary(df: DataFrame, selection: str, account: str, date: str) -> DataFrame:
    """Rows and first and last date per selection."""
    return df.groupBy(selection).agg(
        F.count(account).alias(f"{account}_count"),
        F.min(date).alias(f"{date}_min"),
        F.max(date).alias(f"{date}_max"),
    )


def value_shares(df: DataFrame, keys: Sequence[str], value: str, drop_null: bool = True) -> DataFrame:
    """Share of each value within its group."""
    rows = df.where(F.col(value).isNotNull()) if drop_null else df
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return counts.withColumn("share", F.try_divide(F.col("n").cast("double"), total))


def category_overlap(train: DataFrame, test: DataFrame, feature: str) -> DataFrame:
    """Counts of categories in train, in test, in both and in one only (nulls ignored)."""
    def present(df: DataFrame, side: str) -> DataFrame:
        return df.where(F.col(feature).isNotNull()).select(F.col(feature).alias("c"), F.lit(side).alias("side")).distinct()

    sides = present(train, "train").unionByName(present(test, "test")).groupBy("c").agg(
        F.max((F.col("side") == "train").cast("int")).alias("a"),
        F.max((F.col("side") == "test").cast("int")).alias("b"),
    )
    a, b = F.col("a"), F.col("b")
    return sides.agg(
        F.coalesce(F.sum(a), F.lit(0)).alias("train_categories_count"),
        F.coalesce(F.sum(b), F.lit(0)).alias("test_categories_count"),
        F.coalesce(F.sum(a * b), F.lit(0)).alias("common_categories_count"),
        F.coalesce(F.sum(b * (1 - a)), F.lit(0)).alias("categories_only_in_test_count"),
        F.coalesce(F.sum(a * (1 - b)), F.lit(0)).alias("categories_only_in_train_count"),
    ).withColumn("feature", F.lit(feature))


def unmatched_categories(train: DataFrame, test: DataFrame, feature: str) -> DataFrame:
    """The categories found on one side only, with that side's name."""
    a = train.where(F.col(feature).isNotNull()).select(feature).distinct()
    b = test.where(F.col(feature).isNotNull()).select(feature).distinct()
    return (
        a.subtract(b).withColumn("only_in", F.lit("train"))
        .unionByName(b.subtract(a).withColumn("only_in", F.lit("test")))
    )


def range_statistics(df: DataFrame, account: str, segment: str, month: str) -> DataFrame:
    """Null counts of account, segment and month, and the first and last month."""
    def nulls(c: str):
        return F.count(F.when(F.col(c).isNull(), 1)).alias(f"{c}_nulls")

    return df.agg(
        nulls(account), nulls(segment), nulls(month), F.min(month).alias("first_month"), F.max(month).alias("last_month")
    )


def unbiased_skewness(column: str):
    n = F.count(column).cast("double")
    return F.when(n > 2, F.skewness(column) * F.sqrt(n * (n - 1)) / (n - 2))


def unbiased_kurtosis(column: str):
    n = F.count(column).cast("double")
    return F.when(
        n > 3,
        (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(column) + 6),
    )


def score_statistics(df: DataFrame, scores: Sequence[str]) -> DataFrame:
    """Min, max, mean, median, deviation, quartiles, skewness and kurtosis per score."""
    long = df.select(
        F.inline(F.array(*[F.struct(F.lit(s).alias("score_name"), F.col(s).cast("double").alias("value")) for s in scores]))
    ).where(F.col("value").isNotNull())
    moments = long.groupBy("score_name").agg(
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        F.stddev("value").alias("std"),
        unbiased_skewness("value").alias("skewness"),
        unbiased_kurtosis("value").alias("kurtosis"),
    )
    q = quantiles(long, ["score_name"], "value", [0.25, 0.5, 0.75])
    return moments.join(q, "score_name", "inner").select(
        "score_name", "min", "max", "mean", F.get("quantiles", F.lit(1)).alias("median"), "std",
        F.get("quantiles", F.lit(0)).alias("q1"), F.get("quantiles", F.lit(2)).alias("q3"), "skewness", "kurtosis",
    )


def flag_rollup(df: DataFrame, account: str, main: Sequence[str], side: Sequence[str]) -> DataFrame:
    """Sum of each flag per account and 1 where only side flags occur."""
    sums = df.groupBy(account).agg(*[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in (*main, *side)])
    add = lambda names: reduce(lambda x, y: x + y, [F.col(c) for c in names])
    return sums.withColumn("flag_other_segment_granted", other_segment_verdict(add(main), add(side)))


def max_flag(df: DataFrame, keys: Sequence[str], flag: str, name: str) -> DataFrame:
    """Largest flag per key; text that is not a number counts as 0."""
    return df.groupBy(*keys).agg(F.max(F.coalesce(F.col(flag).try_cast("int"), F.lit(0))).alias(name))


def range_label(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Text `MAX_CL-<max>-MIN_CL-<min>` per key."""
    return df.groupBy(*keys).agg(
        F.concat(
            F.lit("MAX_CL-"), F.max(value).cast("string"), F.lit("-MIN_CL-"), F.min(value).cast("string")
        ).alias(name)
    )


def user_types(
    loans: DataFrame,
    customer: str,
    loan: str,
    submitted: str,
    disbursed: str,
    per_loan: bool = False,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Smallest user-type label per customer (or loan) from the order of applications and payouts.

    Only the first application and the first payout of a customer matter, so both come from
    one grouped minimum and no customer's loans have to be sorted or met in one task. Loans are
    unique; `ties` decide between equal times.
    """
    columns = [F.col(t) for t in ties]
    first = loans.where(F.col(customer).isNotNull()).groupBy(customer).agg(
        F.min(F.struct(F.col(submitted), *columns)).alias("__first_application"),
        F.min(F.when(F.col(disbursed).isNotNull(), F.struct(F.col(disbursed), *columns))).alias("__first_payout"),
    )
    own_application = F.struct(F.col(submitted), *columns)
    own_payout = F.struct(F.col(disbursed), *columns)
    placed = with_lookup(loans, first, [customer]).withColumns(
        {
            "__application": F.when(own_application.eqNullSafe(F.col("__first_application")), 1).otherwise(2),
            "__payout": F.when(
                F.col(disbursed).isNotNull(),
                F.when(own_payout.eqNullSafe(F.col("__first_payout")), 1).otherwise(2),
            ),
        }
    )
    applied = F.col(submitted).isNotNull() & (F.col("__application") >= 1)
    # User-type labels, ordered so that the smallest one wins.
    label = (
        F.when(F.col(loan).isNull(), "4_Never_start_loan_appln")
        .when(F.col(submitted).isNull() & (F.col("__application") <= 1), "4_Never_start_loan_appln")
        .when(applied & F.col("__payout").isNull(), "3_Applied_Not_Disbursed")
        .when(applied & (F.col("__payout") == 1), "2_New Applicant")
        .when(applied & (F.col("__payout") > 1), "1_Repeat Applicant")
        .otherwise("5_others")
    )
    keys = [customer, loan] if per_loan else [customer]
    return placed.withColumn("__label", label).groupBy(*keys).agg(F.min("__label").alias("user_type"))


def stacked(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_union(frames: Sequence[DataFrame]) -> DataFrame:
    return stacked(frames).distinct()


def column_differences(left: DataFrame, right: DataFrame) -> dict[str, list[str]]:
    """Columns found on one side only."""
    return {
        "only_left": [c for c in left.columns if c not in right.columns],
        "only_right": [c for c in right.columns if c not in left.columns],
    }


def pivoted(
    df: DataFrame, rows: Sequence[str], column: str, value: str, values: Sequence | None = None
) -> DataFrame:
    """One column per value of `column`; pass `values` to spare the pass that finds them.

    The values become column names, so the driver has to know them; their number is not limited.
    """
    if values is None:
        values = [r[0] for r in df.select(column).distinct().orderBy(column).collect()]
    return df.groupBy(*rows).pivot(column, list(values)).agg(F.first(value, True))


def pivoted_by_rank(df: DataFrame, rows: Sequence[str], rank: str, values: Sequence[str], most: int = 3) -> DataFrame:
    """Several value columns per rank."""
    return df.groupBy(*rows).agg(
        *[
            F.first(F.when(F.col(rank) == i, F.col(v)), True).alias(f"{v}_{i}")
            for v in values
            for i in range(1, most + 1)
        ]
    )


def with_one_if(df: DataFrame, **tests) -> DataFrame:
    return df.withColumns({name: one_if(test) for name, test in tests.items()})
