"""Expected and actual bin shares side by side, and the index built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorewatch.functions.stability import ZeroPolicy, adjusted, policy_named, term
from scorewatch.operators.ordered import join_null_safe
from scorewatch.session import materialise

ALL = "__all"  # one value: the key of groups without columns


def compare_bins(
    counts: DataFrame,
    groups: Sequence[str],
    period: str,
    policy: str | ZeroPolicy,
    bin_column: str = "Bin",
    denominator: str = "all",
    attributes: Sequence[str] = (),
    written: bool = False,
) -> DataFrame:
    """One row per (groups, period, bin) with the baseline's and the period's share.

    `counts` holds (groups, period, bin, n); baseline rows have a null period, and rows of a
    period are unique per bin. Both sides come from this one frame, so its source is read
    once (`written`: they are a written table already). A null bin counts in the denominators when `denominator` is 'all' and is left out
    otherwise. Groups without baseline rows drop out.

    Adds e_n, a_n, e_total, a_total, raw shares e_share and a_share (null when the bin is
    absent on that side), adjusted shares e and a, and the bin's term.
    """
    policy = policy_named(policy)
    groups, attributes = list(groups), list(attributes)
    if denominator == "binned":
        # The rows stay, so that a period without any binned row still shows up as empty.
        counts = counts.withColumn("n", F.when(F.col(bin_column).isNotNull(), F.col("n")))
    elif denominator != "all":
        raise ValueError(f"unknown denominator {denominator!r}")

    # Counts are as many as the bins of all periods; written once, they serve all that follows.
    counts = (counts if written else materialise(counts)).select("*", F.lit(0).alias(ALL))
    keys = [ALL, *groups]
    baseline = F.col(period).isNull()
    per_bin = counts.groupBy(*keys, bin_column).agg(
        F.sum(F.when(baseline, F.col("n"))).alias("e_n"),
        F.map_from_entries(F.collect_list(F.when(~baseline, F.struct(period, "n")))).alias("__periods"),
        *[F.max(c).alias(c) for c in attributes],
    )
    totals = counts.where(baseline).groupBy(*keys).agg(F.sum("n").alias("e_total")).where(F.col("e_total").isNotNull())
    periods = counts.where(~baseline).groupBy(*keys, period).agg(F.sum("n").alias("a_total"))
    grid = join_null_safe(periods, totals, keys, "inner")
    within = Window.partitionBy(*groups, period)
    shares = (
        join_null_safe(per_bin.where(F.col(bin_column).isNotNull()), grid, keys, "inner")
        .withColumn("a_n", F.col("__periods")[F.col(period)])
        .drop("__periods", ALL)
        .where(F.col("e_n").isNotNull() | F.col("a_n").isNotNull())
        .withColumn("e_share", F.try_divide(F.col("e_n").cast("double"), F.col("e_total")))
        .withColumn("a_share", F.try_divide(F.col("a_n").cast("double"), F.col("a_total")))
        .withColumn("e", adjusted(F.col("e_share"), policy))
        .withColumn("a", adjusted(F.col("a_share"), policy))
    )
    if policy.renormalise:
        shares = shares.withColumns(
            {side: F.try_divide(F.col(side), F.sum(side).over(within)) for side in ("e", "a")}
        )
    return shares.withColumn("term", term(F.col("e"), F.col("a"), policy.on_zero))


def with_baseline_copy(df: DataFrame, period: str, is_baseline: Column) -> DataFrame:
    """Rows of a baseline period twice: as that period and, with a null period, as the baseline."""
    own = F.array(F.col(period))
    both = F.array(F.col(period), F.lit(None).cast(df.schema[period].dataType))
    rest = [c for c in df.columns if c != period]
    return df.select(*rest, F.explode(F.when(is_baseline, both).otherwise(own)).alias(period))


def index_of(shares: DataFrame, keys: Sequence[str], name: str, extra: Sequence[Column] = ()) -> DataFrame:
    """Sum the terms per key."""
    return shares.groupBy(*keys).agg(F.sum("term").alias(name), *extra)


HOME = "__home"  # by which accounts are dealt


def per_account(df: DataFrame, columns: Sequence[str], account: str) -> DataFrame:
    """HOME, `account` and `__seen`, the different combinations of `columns` it has, as structs.

    One shuffle of the rows as they are: copies for segments are made afterwards, next to the
    account, so they neither travel nor meet in a hash table. Rows without an account are dealt
    by their columns.
    """
    columns = list(dict.fromkeys(columns))
    home = F.when(F.col(account).isNotNull(), F.xxhash64(account)).otherwise(F.xxhash64(F.lit(0), *columns))
    return df.select(*columns, account, home.alias(HOME)).repartition(HOME).groupBy(HOME, account).agg(F.collect_set(F.struct(F.lit(0).alias("__one"), *columns)).alias("__seen"))


def distinct_accounts(df: DataFrame, keys: Sequence[str], account: str, name: str) -> DataFrame:
    """Exact distinct accounts per key: one shuffle by account, then counts."""
    seen = per_account(df, keys, account).select(account, F.explode("__seen").alias("__key"))
    return seen.select(account, *[F.col("__key")[k].alias(k) for k in keys]).groupBy(*keys).agg(F.count(account).alias(name))


def segment_accounts(
    df: DataFrame, segments: Sequence[str], keys: Sequence[str], account: str, name: str,
    overall: tuple[str, str] = ("Overall", "All"),
    pooled: tuple[str, str] | None = None,
) -> DataFrame:
    """Distinct accounts per one-at-a-time segment and key; `pooled`: a key and the value that stands for all of its values."""
    def copies(seen: Column) -> Column:
        made = []
        for everyone in (False, True) if pooled else (False,):
            shown = [(F.lit(pooled[1]) if everyone and k == pooled[0] else seen[k]).alias(k) for k in keys]
            for c, v in [overall, *((c, seen[c].cast("string")) for c in segments)]:
                value = F.lit(v) if isinstance(v, str) else v
                made.append(F.struct(F.lit(c).alias("Segment_Column"), value.alias("Segment_Value"), *shown))
        return F.array(*made)

    # An account counts once per segment and key, however many of its rows fall there.
    seen = per_account(df, [*segments, *keys], account)
    each = F.array_distinct(F.flatten(F.transform("__seen", copies)))
    rows = seen.select(account, F.explode(each).alias("__copy")).select(account, "__copy.*").where(F.col("Segment_Value").isNotNull())
    return rows.groupBy("Segment_Column", "Segment_Value", *keys).agg(F.count(account).alias(name))
