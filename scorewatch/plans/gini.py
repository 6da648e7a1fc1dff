"""Rank-ordering power: Gini and AUC by segment and period, deciles, ROC points.

Scores are first collapsed to one row per distinct score and group with its goods and bads;
the ranking itself is a running total over those rows (see `operators.ordered`), so ties are
exact and no group has to fit into one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorewatch.functions.dates import month_start, period_end, week_start
from scorewatch.functions.text import number_or_null
from scorewatch.operators.aggregates import account_sketches, pivoted, united_sketches, with_estimates
from scorewatch.operators.joins import outer_on, with_lookup
from scorewatch.operators.ordered import join_null_safe, numbered, running_totals
from scorewatch.operators.ranksums import Grouping, account_counts, combined, decile_sums, rank_sums
from scorewatch.operators.segments import (
    LEVELS,
    all_combinations,
    grouped_by_sets,
    one_at_a_time,
)
from scorewatch.session import materialise

ACCOUNT = "digitalLoanAccountId"
METHODS = ("auc", "cumulative", "trapezoid", "hybrid")


def scored_outcomes(df: DataFrame, score: str, label: str) -> DataFrame:
    """Numeric score and label; rows lacking either are dropped."""
    return df.withColumns(
        {score: number_or_null(F.col(score)), label: number_or_null(F.col(label))}
    ).where(F.col(score).isNotNull() & F.col(label).isNotNull())


def collapse(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """One row per (keys, score) with rows `n` and bads `bad`."""
    return df.groupBy(*keys, score).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("bad")
    )


def gini_of_counts(counts: DataFrame, keys: Sequence[str], score: str, method: str = "auc") -> DataFrame:
    """Gini per group from (keys, score, n, bad): keys, n, bad, good, gini.

    A score may have several rows in a group; they are added up before the running totals.

    auc: 2 * AUC - 1, null for one class or fewer than two rows
    cumulative: 1 - 2 * sum of cumulative bads / (n * bads), ties averaged
    trapezoid: area under cumulative bads over cumulative goods from the lowest score, 0 for one class
    hybrid: auc when all scores lie in [0, 1], else trapezoid with null for one class
    """
    if method not in METHODS:
        raise ValueError(f"unknown Gini method {method!r}")
    rows = counts.withColumn("good", F.col("n") - F.col("bad"))
    merged = rows.groupBy(*keys, score).agg(*[F.sum(c).alias(c) for c in ("n", "bad", "good")])
    ranked = running_totals(merged, keys, [score], ["good", "bad"], totals=False)
    n, bad = (F.col(c).cast("double") for c in ("n", "bad"))
    good = F.col("good").cast("double")
    goods_below = F.col("cum_good").cast("double") - good
    # Each row of a tie stands at the average of the tie's positions.
    if method == "cumulative":
        bads_below = F.col("cum_bad").cast("double") - bad
        cumulated = n * bads_below + bad * (n + F.lit(1.0)) / F.lit(2.0)
    else:
        cumulated = F.lit(None).cast("double")
    sums = ranked.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum("bad").alias("bad"),
        F.sum("good").alias("good"),
        F.sum(bad * (goods_below + good / F.lit(2.0))).alias("__area"),
        F.sum(cumulated).alias("__cumulated"),
        F.min(score).alias("__low"),
        F.max(score).alias("__high"),
    )
    return _gini_of_sums(sums.withColumnsRenamed({"__area": "area", "__cumulated": "cumulated", "__low": "low", "__high": "high"}), method)


def _gini_of_sums(sums: DataFrame, method: str) -> DataFrame:
    """Add the Gini to one row per group with n, bad, good, area, cumulated, low and high, and drop the last four."""
    both = (F.col("bad") > 0) & (F.col("good") > 0)
    product = F.col("bad").cast("double") * F.col("good").cast("double")
    auc = F.when(both, F.lit(2.0) * F.try_divide(F.col("area"), product) - F.lit(1.0))
    if method == "auc":
        gini = auc
    elif method == "cumulative":
        size = F.col("n").cast("double") * F.col("bad").cast("double")
        gini = F.when(
            (F.col("n") >= 2) & (F.col("bad") > 0),
            F.lit(1.0) - F.lit(2.0) * F.try_divide(F.col("cumulated"), size),
        )
    elif method == "trapezoid":
        gini = F.coalesce(-auc, F.lit(0.0))
    else:
        gini = F.when((F.col("low") >= 0) & (F.col("high") <= 1), auc).otherwise(-auc)
    return sums.withColumn("gini", gini).drop("area", "cumulated", "low", "high")


def gini_by_groupings(counts: DataFrame, groupings: Sequence[Grouping], score: str, method: str = "auc") -> DataFrame:
    """Gini of every group of every grouping: `__set`, the group columns, n, bad, good, gini.

    As `gini_of_counts` on a copy of `counts` per grouping, without the copies.
    """
    if method not in METHODS:
        raise ValueError(f"unknown Gini method {method!r}")
    keys = ["__set", *dict.fromkeys(c for g in groupings for c in g.columns)]
    return _gini_of_sums(combined(rank_sums(counts, groupings, score), keys), method)


def gini_by(
    df: DataFrame, keys: Sequence[str], score: str, label: str, method: str = "auc"
) -> DataFrame:
    """Gini of one score per group."""
    return gini_of_counts(collapse(scored_outcomes(df, score, label), keys, score, label), keys, score, method)


def explode_periods(df: DataFrame, periods: Mapping[str, Column]) -> DataFrame:
    """Copies of each row per period kind, with `period` and `start_date`."""
    entries = [
        F.struct(F.lit(name).alias("period"), start.alias("start_date")) for name, start in periods.items()
    ]
    return df.select("*", F.inline(F.array(*entries))).where(F.col("start_date").isNotNull())


# --- periodic cube ---------------------------------------------------------------------------


def gini_cube(
    df: DataFrame,
    score: str,
    label: str,
    outcome: str,
    dims: Sequence[tuple[str, str]] = (),
    date: str = "disbursementdate",
    account: str | None = ACCOUNT,
    min_week: int = 10,
    min_month: int = 20,
    drop_small: bool = False,
    max_depth: int | None = None,
    method: str = "auc",
    model_name: str | None = None,
    approx_accounts: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(fact, dimension): weekly and monthly Gini for every combination of segment values.

    `dims` are (name in segment_type, column), any number of them. Groups below the minimum get
    a null Gini, or are left out together with null results when `drop_small` is set; minima
    of 0 let all groups pass. `approx_accounts` estimates distinct accounts from sketches made
    once per finest group and united per segment, instead of copying every account.
    """
    columns = [c for _, c in dims]
    rows = scored_outcomes(df.where(F.col(date).isNotNull()), score, label).withColumns(
        {"__week": week_start(F.col(date)), "__month": month_start(F.col(date))}
    )
    periods = {"Week": F.col("__week"), "Month": F.col("__month")}
    sets = all_combinations(columns, max_depth)
    when = ["period", "start_date"]

    counts = collapse(rows, [*columns, "__week", "__month"], score, label)
    keys = ["set_id", *columns, *when]
    groupings, numbers = [], []
    for chosen in sets:
        inactive = sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in chosen)
        for period, start in (("Week", "__week"), ("Month", "__month")):
            groupings.append(Grouping((*chosen, start)))
            numbers.append((inactive, period))
    set_ids, names = (F.array(*[F.lit(x) for x in side]) for side in zip(*numbers))

    def named(found: DataFrame, values: Sequence[str]) -> DataFrame:
        start = F.coalesce("__week", "__month").alias("start_date")
        return found.select(F.get(set_ids, F.col("__set")).alias("set_id"), *columns, F.get(names, F.col("__set")).alias("period"), start, *values)

    ginis = named(gini_by_groupings(counts, groupings, score, method).withColumnRenamed("gini", "gini_value"), ["n", "gini_value"])

    frames = [ginis]
    if account and approx_accounts:
        sketches = rows.groupBy(*columns, "__week", "__month").agg(*account_sketches(account, label))
        seen = grouped_by_sets(explode_periods(sketches, periods), sets, columns, when, united_sketches())
        frames.append(with_estimates(seen).select(*keys, "distinct_accounts", "bad_count"))
    elif account:
        bad = F.max(F.when(F.col(label) == 1, 1).otherwise(0))
        people = rows.where(F.col(account).isNotNull()).groupBy(*columns, "__week", "__month", account).agg(bad.alias("__bad"))
        frames.append(named(account_counts(people, groupings, account, "__bad"), ["distinct_accounts", "bad_count"]))
    fact = outer_on(frames, keys).where(F.col("n").isNotNull())
    if not account:
        none = F.lit(None).cast("long")
        fact = fact.withColumns({"distinct_accounts": none, "bad_count": F.lit(0).cast("long")})
    least = F.when(F.col("period") == "Week", F.lit(min_week)).otherwise(F.lit(min_month))
    fact = fact.withColumn("gini_value", F.when(F.col("n") >= least, F.col("gini_value")))
    if drop_small:
        fact = fact.where(F.col("gini_value").isNotNull())
    parts = [F.concat(F.lit(f"{name}_"), F.col(c).cast("string")) for name, c in dims]
    joined = F.concat_ws("_", *parts) if parts else F.lit("")
    fact = materialise(
        fact.withColumns(
            {
                "end_date": period_end(F.col("start_date"), F.col("period")),
                "Model_Name": F.lit(model_name or score),
                "bad_rate": F.lit(outcome),
                "segment_type": F.when(joined == "", F.lit("Overall")).otherwise(joined),
            }
        )
    )
    names = ["Model_Name", "bad_rate", "segment_type", *columns]
    if not columns:
        with_id = fact.withColumn("segment_id", F.lit(0).cast("long"))
        return _cube_tables(with_id, with_id.select("segment_id", *names).distinct(), names)
    dimension = numbered(
        fact.select("set_id", *names).distinct().withColumn("__inactive", -F.bit_count("set_id")),
        ["__inactive", "set_id", *columns],
        "segment_id",
        start=0,
    )
    with_id = join_null_safe(
        fact, dimension.select("set_id", *columns, "segment_id"), ["set_id", *columns], "left"
    )
    return _cube_tables(with_id, dimension, names)


def _cube_tables(fact: DataFrame, dimension: DataFrame, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both tables with their published columns."""
    return (
        fact.select(
            "segment_id", "start_date", "end_date", "period", "gini_value", "distinct_accounts", "bad_count", *names
        ),
        dimension.select("segment_id", *names),
    )


def published(tables: Sequence[DataFrame], model: str, product: str, dims: Sequence[str]) -> list[DataFrame]:
    """Display name and product on each table, 'Overall' for inactive dimensions."""
    return [
        t.withColumns({"Model_display_name": F.lit(model), "Product_Category": F.lit(product)}).fillna(
            "Overall", subset=[d for d in dims if d in t.columns]
        )
        for t in tables
    ]


def periodic_gini(
    df: DataFrame,
    score: str,
    label: str,
    outcome: str,
    date: str = "disbursementdate",
    method: str = "auc",
    min_week: int = 10,
    min_month: int = 20,
    version: str = "1.1.0",
) -> DataFrame:
    """Weekly and monthly Gini of the whole frame; the trapezoid method has no minimum."""
    least = (1, 1) if method == "trapezoid" else (min_week, min_month)
    fact, _ = gini_cube(
        df, score, label, outcome, (), date, None, *least, method=method
    )
    return fact.select(
        "start_date", "end_date", "period", F.col("gini_value").alias("gini"), "Model_Name",
        F.lit(version).alias("version"), "bad_rate",
    )


def wide_gini(fact: DataFrame, keys: Sequence[str] = ("start_date", "end_date", "period")) -> DataFrame:
    """One Gini column per segment, one row per period."""
    return pivoted(fact, keys, "segment_type", "gini_value")


# --- named periods, several scores -----------------------------------------------------------


def named_period_gini(
    df: DataFrame,
    date: str,
    label: str,
    scores: Sequence[str],
    periods: Sequence[tuple[str, str, str]],
    reverse: Sequence[str] = (),
    digits: int | None = None,
) -> DataFrame:
    """Gini of each score per named period (periods may overlap) on rows having all scores.

    Scores in `reverse` have their sign changed. Periods without rows stay with size 0.
    """
    rows = df
    for s in scores:
        rows = rows.withColumn(s, number_or_null(F.col(s)))
    rows = rows.where(F.col(label).isNotNull())
    for s in scores:
        rows = rows.where(F.col(s).isNotNull())
    day = F.to_date(F.col(date))
    matches = F.array_compact(
        F.array(
            *[
                F.when(day.between(F.lit(start).cast("date"), F.lit(end).cast("date")), F.lit(name))
                for name, start, end in periods
            ]
        )
    )
    values = F.array(
        *[
            F.struct(F.lit(s).alias("score_name"), (-F.col(s) if s in reverse else F.col(s)).alias("value"))
            for s in scores
        ]
    )
    long = rows.select(label, matches.alias("__periods"), F.inline(values)).where(F.size("__periods") > 0)
    # Scores are collapsed before they are copied to each period they belong to.
    counts = collapse(long, ["__periods", "score_name"], "value", label)
    found = gini_of_counts(
        counts.withColumn("Period", F.explode("__periods")).drop("__periods"), ["Period", "score_name"], "value"
    )
    def shown(c: Column) -> Column:
        return c if digits is None else F.round(c, digits)

    per_score = [
        shown(F.max(F.when(F.col("score_name") == s, F.col("gini")))).alias(f"{s}_gini") for s in scores
    ]
    wide = found.groupBy("Period").agg(*per_score, F.max("n").alias("sample_size"))
    named = df.sparkSession.createDataFrame(list(periods), "Period string, __s string, __e string").select(
        "Period", F.col("__s").cast("date").alias("Start_Date"), F.col("__e").cast("date").alias("End_Date")
    )
    return named.join(wide, "Period", "left").withColumn("sample_size", F.coalesce("sample_size", F.lit(0).cast("long")))


def _row_mean(values: Sequence[Column]) -> Column:
    total, count = F.lit(0.0), F.lit(0)
    for v in values:
        total = total + F.coalesce(v, F.lit(0.0))
        count = count + v.isNotNull().cast("int")
    return F.try_divide(total, count)


def _row_median(values: Sequence[Column]) -> Column:
    known = F.array_sort(F.array_compact(F.array(*values)))
    size = F.size(known)
    low = F.get(known, F.floor((size - 1) / F.lit(2.0)).cast("int"))
    high = F.get(known, F.floor(size / F.lit(2.0)).cast("int"))
    return (low + high) / F.lit(2.0)


COMBINATIONS = ("mean", "median", "max", "min", "weighted")


def with_combined_scores(
    df: DataFrame, scores: Sequence[str], label: str, keys: Sequence[str] = (), methods: Sequence[str] = COMBINATIONS
) -> DataFrame:
    """Add `combined_<method>`: scores scaled to [0, 1] per group, then combined per row.

    weighted: weights are max(gini, 0) + 1 of each score in the group.
    """
    scores, keys = list(scores), list(keys)
    spans = [F.min(s).alias(f"__lo_{s}") for s in scores] + [F.max(s).alias(f"__hi_{s}") for s in scores]
    facts = df.groupBy(*keys).agg(*spans)
    if "weighted" in methods:
        values = F.array(*[F.struct(F.lit(s).alias("score_name"), F.col(s).cast("double").alias("value")) for s in scores])
        long = df.select(*keys, label, F.inline(values))
        ginis = gini_by(long, [*keys, "score_name"], "value", label)
        weights = ginis.groupBy(*keys).agg(
            *[
                F.max(F.when(F.col("score_name") == s, F.greatest(F.coalesce("gini", F.lit(0.0)), F.lit(0.0)) + 1)).alias(f"__w_{s}")
                for s in scores
            ]
        )
        facts = outer_on([facts, weights], keys)
    if keys:
        joined = with_lookup(df, facts, keys)
    else:
        added = [c for c in facts.columns]
        joined = df.withColumn("__f", facts.select(F.struct(*added)).scalar()).select("*", "__f.*").drop("__f")
    scaled = {}
    for s in scores:
        low, high = F.col(f"__lo_{s}").cast("double"), F.col(f"__hi_{s}").cast("double")
        scaled[s] = F.when(high > low, (F.col(s) - low) / (high - low)).otherwise(F.lit(0.0))
    joined = joined.withColumns({f"__v_{s}": v for s, v in scaled.items()})
    values = [F.col(f"__v_{s}") for s in scores]
    made = {}
    if "mean" in methods:
        made["combined_mean"] = _row_mean(values)
    if "median" in methods:
        made["combined_median"] = _row_median(values)
    if "max" in methods:
        made["combined_max"] = F.greatest(*values) if len(values) > 1 else values[0]
    if "min" in methods:
        made["combined_min"] = F.least(*values) if len(values) > 1 else values[0]
    if "weighted" in methods:
        total, weight_sum = F.lit(0.0), F.lit(0.0)
        for s in scores:
            weight_sum = weight_sum + F.col(f"__w_{s}")
        for s in scores:
            total = total + F.coalesce(F.col(f"__v_{s}"), F.lit(0.0)) * (F.col(f"__w_{s}") / weight_sum)
        made["combined_weighted"] = total
    helpers = [c for c in joined.columns if c.startswith(("__lo_", "__hi_", "__w_", "__v_"))]
    return joined.withColumns(made).drop(*helpers)


def combined_gini(
    df: DataFrame, scores: Sequence[str], label: str, keys: Sequence[str] = (), methods: Sequence[str] = COMBINATIONS
) -> DataFrame:
    """Gini of each combination method per group: keys, method, gini."""
    made = with_combined_scores(df, scores, label, keys, methods)
    values = F.array(
        *[F.struct(F.lit(m).alias("method"), F.col(f"combined_{m}").alias("value")) for m in methods]
    )
    long = made.select(*keys, label, F.inline(values))
    return gini_by(long, [*keys, "method"], "value", label).select(*keys, "method", "gini")


def bad_metrics(df: DataFrame, keys: Sequence[str], target: str, maturity: str) -> DataFrame:
    """count_bad = sum of target / maturity, and its percentage of the rows."""
    count = F.sum(F.try_divide(F.col(target).cast("double"), F.col(maturity).cast("double")))
    return df.groupBy(*keys).agg(
        count.alias("count_bad"), (count / F.count(F.lit(1)) * 100).alias("pct_bad")
    )


def gini_summary(
    df: DataFrame, scores: Sequence[str], groups: Sequence[str], label: str, maturity: str
) -> DataFrame:
    """Per value of each group column: size, Gini and AUC per score, combined Gini, bad metrics.

    Groups with one class only are left out.
    """
    rows = one_at_a_time(
        df.select(*groups, label, maturity, *[F.col(s).cast("double").alias(s) for s in scores]), groups, None
    )
    keys = ["Segment_Column", "Segment_Value"]
    values = F.array(*[F.struct(F.lit(s).alias("score_name"), F.col(s).alias("value")) for s in scores])
    long = rows.select(*keys, label, F.inline(values))
    ginis = gini_by(long, [*keys, "score_name"], "value", label)
    per_score = []
    for s in scores:
        g = F.max(F.when(F.col("score_name") == s, F.col("gini")))
        per_score += [g.alias(f"{s}_Gini"), ((g + 1) / F.lit(2.0)).alias(f"{s}_AUC")]
    sizes = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("Sample_Size"), F.countDistinct(label).alias("__classes")
    )
    combined = combined_gini(rows, scores, label, keys, ["mean"]).select(*keys, F.col("gini").alias("Combined_Gini"))
    bads = bad_metrics(rows, keys, label, maturity).withColumnsRenamed(
        {"count_bad": "Count_Bad", "pct_bad": "Pct_Bad"}
    )
    return (
        outer_on([sizes, ginis.groupBy(*keys).agg(*per_score), combined, bads], keys)
        .where(F.col("__classes") > 1)
        .drop("__classes")
    )


# --- deciles, ROC, dashboard -----------------------------------------------------------------


def with_deciles(df: DataFrame, keys: Sequence[str], score: str, ties: Sequence[str]) -> DataFrame:
    """Decile by rank within each group, 1 = highest scores; equal scores are split by `ties`."""
    ones = df.withColumn("__one", F.lit(1).cast("long"))
    ranked = running_totals(ones, keys, [score, *ties], ["__one"])
    rank, size = F.col("cum___one"), F.col("all___one")
    step = F.ceil(F.try_divide((rank - 1) * F.lit(10.0), size - 1))
    ascending = F.greatest(F.coalesce(step, F.lit(1).cast("long")), F.lit(1).cast("long"))
    return ranked.withColumn("decile", (F.lit(11) - ascending).cast("int")).drop("__one", "cum___one", "all___one")


def decile_gains(
    df: DataFrame, keys: Sequence[str], score: str, label: str, ties: Sequence[str] = (ACCOUNT,)
) -> DataFrame:
    """Gain table: counts, shares and cumulative shares of records, bads and goods per decile."""
    placed = with_deciles(df, keys, score, [*ties, label])
    per_decile = placed.groupBy(*keys, "decile").agg(
        F.min(score).alias("score_min"),
        F.max(score).alias("score_max"),
        F.avg(score).alias("score_avg"),
        F.count(F.lit(1)).alias("records_in_decile"),
        F.sum(F.col(label).cast("long")).alias("bads_in_decile"),
    )
    return _gains(per_decile, keys)


def _gains(per_decile: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Goods, totals, shares and cumulative shares from the records and bads of each decile."""
    per_decile = per_decile.withColumn("goods_in_decile", F.col("records_in_decile") - F.col("bads_in_decile"))
    group = Window.partitionBy(*keys)
    upto = group.orderBy("decile").rowsBetween(Window.unboundedPreceding, 0)
    added: dict[str, Column] = {}
    for what in ("records", "bads", "goods"):
        own = F.col(f"{what}_in_decile")
        total, running = F.sum(own).over(group), F.sum(own).over(upto)
        added[f"total_{what}"] = total
        added[f"cum_{what}"] = running
        added[f"pct_{what}"] = F.coalesce(F.try_divide(own * F.lit(100.0), total), F.lit(0.0))
        added[f"cum_pct_{what}"] = F.coalesce(F.try_divide(running * F.lit(100.0), total), F.lit(0.0))
    added["bad_rate_decile"] = F.try_divide(F.col("bads_in_decile") * F.lit(100.0), F.col("records_in_decile"))
    return per_decile.withColumns(added)


def roc_points(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """False and true positive rate at every distinct score, from the highest down."""
    counts = collapse(scored_outcomes(df, score, label), keys, score, label)
    rows = counts.withColumn("good", F.col("n") - F.col("bad"))
    ranked = running_totals(rows, keys, [score], ["good", "bad"], descending=True)
    return ranked.select(
        *keys,
        F.col(score).alias("threshold"),
        F.try_divide(F.col("cum_good").cast("double"), F.col("all_good")).alias("fpr"),
        F.try_divide(F.col("cum_bad").cast("double"), F.col("all_bad")).alias("tpr"),
    )


DASHBOARD_DIMS = ("modelDisplayName", "modelVersionId", "trenchCategory", "new_loan_type", "loan_product_type")


def _dashboard_groupings(df: DataFrame, date: str, known_trenches: Sequence[str] | None) -> tuple[DataFrame, list[Grouping], list[Column]]:
    """`df` with months and weeks, a grouping per level and period, and the columns that name a group."""
    isin = F.lit(True) if known_trenches is None else F.col(DASHBOARD_DIMS[2]).isin(*known_trenches)
    timed = df.withColumns(
        {"__month": F.date_format(date, "yyyy-MM"), "__week": week_start(F.col(date)).cast("string"), "__known_trench": isin}
    )
    groupings, names = [], []
    for level, active in LEVELS.items():
        where = "__known_trench" if level == "Model_Level" else None
        for time, column in (("Overall", ()), ("Month", ("__month",)), ("Week", ("__week",))):
            groupings.append(Grouping((*(DASHBOARD_DIMS[i] for i in active), *column), where))
            names.append((level, time))
    levels, times = (F.array(*[F.lit(x) for x in side]) for side in zip(*names))
    shown = [
        F.get(levels, F.col("__set")).alias("segment_type"),
        # A column that a level does not use is null in all its groups.
        *[F.coalesce(F.col(c).cast("string"), F.lit("All")).alias(c) for c in DASHBOARD_DIMS],
        F.get(times, F.col("__set")).alias("time_type"),
        F.coalesce("__month", "__week", F.lit("Overall")).alias("time_period"),
    ]
    return timed, groupings, shown


def dashboard_metrics(
    df: DataFrame,
    score: str,
    label: str,
    date: str = "disbursementdate",
    known_trenches: Sequence[str] | None = ("Trench 1", "Trench 2", "Trench 3"),
) -> DataFrame:
    """AUC, Gini and bad rate per hierarchical segment for all time, months and weeks."""
    rows = scored_outcomes(df, score, label).withColumn(date, F.to_date(date))
    counts = collapse(rows, [*DASHBOARD_DIMS, date], score, label)
    timed, groupings, shown = _dashboard_groupings(counts, date, known_trenches)
    found = gini_by_groupings(timed, groupings, score)
    return found.select(
        *shown,
        ((F.col("gini") + 1) / F.lit(2.0)).alias("auc"),
        "gini",
        F.col("n").alias("record_count"),
        F.col("bad").alias("bad_count"),
        F.col("good").alias("good_count"),
        F.try_divide(F.col("bad") * F.lit(100.0), F.col("n")).alias("bad_rate_pct"),
    )


def dashboard_deciles(
    df: DataFrame,
    score: str,
    label: str,
    date: str = "disbursementdate",
    account: str = ACCOUNT,
    known_trenches: Sequence[str] | None = ("Trench 1", "Trench 2", "Trench 3"),
) -> DataFrame:
    """Gain tables for the segments and periods of `dashboard_metrics`; no row is copied per segment."""
    rows = scored_outcomes(df, score, label).withColumn(date, F.to_date(date))
    texts = rows.withColumns({c: F.col(c).cast("string") for c in DASHBOARD_DIMS})
    timed, groupings, shown = _dashboard_groupings(texts, date, known_trenches)
    per_decile = decile_sums(timed, groupings, score, account, label).select(
        *shown, "decile",
        F.col("low").alias("score_min"), F.col("high").alias("score_max"),
        F.try_divide("total", F.col("n")).alias("score_avg"),
        F.col("n").alias("records_in_decile"), F.col("bad").alias("bads_in_decile"),
    )
    return _gains(per_decile, ["segment_type", *DASHBOARD_DIMS, "time_type", "time_period"])


def dashboard_segments(metrics: DataFrame) -> DataFrame:
    """Segment dimension with name and id."""
    keys = ["segment_type", *DASHBOARD_DIMS]
    name = F.concat_ws(
        "_",
        *[F.col(c) for c in DASHBOARD_DIMS[:3]],
        *[F.when(F.col(c) != "All", F.col(c)) for c in DASHBOARD_DIMS[3:]],
    )
    return numbered(metrics.select(*keys).distinct().withColumn("segment_name", name), keys, "segment_id")
