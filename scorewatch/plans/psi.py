"""Population stability: scores and features against a baseline, by period and segment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorewatch.functions import bins as B
from scorewatch.functions.dates import month_label
from scorewatch.functions.stability import ZeroPolicy, band
from scorewatch.functions.text import number_or_null
from scorewatch.operators import binning
from scorewatch.operators.ordered import numbered, quantiles, quantiles_of_counts
from scorewatch.operators.ranksums import Grouping, quantiles_by_grouping
from scorewatch.operators.segments import copied_to_sets, one_at_a_time, prefixes, subset_labels
from scorewatch.operators.shares import (
    HOME,
    compare_bins,
    distinct_accounts,
    index_of,
    per_account,
    segment_accounts,
    with_baseline_copy,
)
from scorewatch.session import broadcast_checked, materialise

ACCOUNT, MONTH, SELECTION = "digitalLoanAccountId", "Application_month", "Data_selection"
SEGMENT = ["Segment_Column", "Segment_Value"]


def clean_scores(df: DataFrame, score: str) -> DataFrame:
    """Numeric score; rows without one are dropped."""
    return df.withColumn(score, number_or_null(F.col(score))).where(F.col(score).isNotNull())


# --- score PSI -----------------------------------------------------------------------------


def waterfall_score_psi(
    df: DataFrame,
    score: str,
    segments: Sequence[str],
    account: str = ACCOUNT,
    month: str = MONTH,
    selection: str = SELECTION,
    train: str = "Train",
    test: str = "Test",
    num_bins: int = 10,
    policy: str | ZeroPolicy = "absent_1e-10",
) -> DataFrame:
    """Score PSI per prefix of the segment columns, each segment with its own train bins.

    A 'Training' row per segment carries the last train month of the whole frame; segments
    without scored rows on both sides are left out. Inactive segment columns read 'NA'.
    """
    segments = list(segments)
    rows = clean_scores(df.where(F.col(selection).isin(train, test)), score)
    shown = [c for c in (month, selection, score, account) if c not in segments]
    # Written once, without what is not needed: counts, edges, accounts and the last month each read the rows.
    rows = materialise(rows.select(*[F.col(c).cast("string").alias(c) for c in segments], *shown))
    rows = rows.withColumn("__period", F.when(F.col(selection) == test, F.col(month)))
    sets = prefixes(segments) if segments else [[]]
    numbers = [sum(1 << (len(segments) - 1 - i) for i, c in enumerate(segments) if c not in chosen) for chosen in sets]
    keys = ["set_id", *segments]

    trained = rows.where(F.col(selection) == train).groupBy(*segments, score).agg(F.count(F.lit(1)).alias("n"))
    steps = [i / num_bins for i in range(num_bins + 1)]
    found = quantiles_by_grouping(trained, [Grouping(tuple(chosen)) for chosen in sets], score, steps)
    found = _labelled(found.withColumn("set_id", F.get(F.array(*map(F.lit, numbers)), F.col("__set"))), segments)
    edges = broadcast_checked(found.select(*keys, F.array_sort(F.array_distinct("quantiles")).alias("edges")))
    # A row is copied to its segments in the task that reads it, and counted there.
    by_set = _labelled(copied_to_sets(rows.select(*segments, "__period", score), sets, segments), segments)
    placed = (
        by_set.join(edges, keys, "inner")
        .withColumn("Bin", B.right_closed(F.col(score), F.col("edges"), num_bins + 1))
        .groupBy(*keys, "__period", "Bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    monthly = index_of(
        compare_bins(placed, keys, "__period", policy), [*keys, "__period"], "psivalues"
    )

    def copies(seen: Column) -> Column:
        made = []
        for number, chosen in zip(numbers, sets):
            known = F.lit(True)
            for c in chosen:
                known = known & seen[c].isNotNull()
            values = [(seen[c] if c in chosen else F.lit("NA")).alias(c) for c in segments]
            made.append(F.when(known, F.struct(F.lit(number).alias("set_id"), *values, *[seen[c].alias(c) for c in (selection, "__period")])))
        return F.array_compact(F.array(*made))

    # An account counts once per segment and month, however many of its rows fall there.
    seen = per_account(rows, [*segments, selection, "__period"], account)
    each = F.array_distinct(F.flatten(F.transform("__seen", copies)))
    people = seen.select(account, F.explode(each).alias("__copy")).select(account, "__copy.*")
    accounts = people.groupBy(*keys, selection, "__period").agg(F.count(account).alias("account_count"))
    month_rows = monthly.join(
        accounts.where(F.col(selection) == test).drop(selection), [*keys, "__period"], "left"
    ).select(
        F.col("__period").alias("Month"), F.lit("Monthly").alias("DateCategory"), "psivalues", "account_count", *segments
    )
    last = rows.where(F.col(selection) == train).agg(F.max(month))
    training = (
        accounts.where(F.col(selection) == train)
        .join(monthly.select(*keys).distinct(), keys, "left_semi")
        .select(
            last.scalar().alias("Month"),
            F.lit("Training").alias("DateCategory"),
            F.lit(0.0).alias("psivalues"),
            "account_count",
            *segments,
        )
    )
    return training.unionByName(month_rows).withColumn("scorename", F.lit(score))


def _labelled(grouped: DataFrame, segments: Sequence[str]) -> DataFrame:
    """'NA' in the inactive segment columns; active ones hold no nulls here."""
    return grouped.withColumns(
        {c: F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in segments}
    )


def monthly_score_psi(
    df: DataFrame,
    score: str,
    account: str = ACCOUNT,
    month: str = MONTH,
    selection: str = SELECTION,
    train: str = "Train",
    test: str = "Test",
    policy: str | ZeroPolicy = "unprotected",
    num_bins: int = 10,
) -> DataFrame:
    """Score PSI per test month with bins from all train rows, plus a Training row."""
    rows = clean_scores(df.where(F.col(selection).isin(train, test)), score)
    trained = rows.where(F.col(selection) == train)
    spec = quantiles(trained, [], score, [i / num_bins for i in range(num_bins + 1)]).select(
        F.array_sort(F.array_distinct("quantiles"))
    )
    placed = (
        rows.withColumn("__edges", spec.scalar())
        .withColumn("Bin", B.right_closed(F.col(score), F.col("__edges"), num_bins + 1))
        .withColumn("__period", F.when(F.col(selection) == test, F.col(month)))
        .groupBy("__period", "Bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    values = index_of(compare_bins(placed, [], "__period", policy), ["__period"], "psivalues")
    flagged = rows.withColumn("__period", F.when(F.col(selection) == test, F.col(month)))
    accounts = distinct_accounts(flagged, [selection, "__period"], account, "account_count")
    monthly = values.join(
        accounts.where(F.col(selection) == test), "__period", "left"
    ).select(F.col("__period").alias("Month"), F.lit("Monthly").alias("DateCategory"), "psivalues", "account_count")
    last = trained.agg(F.max(month))
    training = accounts.where(F.col(selection) == train).select(
        last.scalar().alias("Month"), F.lit("Training").alias("DateCategory"), F.lit(0.0).alias("psivalues"), "account_count"
    )
    return training.unionByName(monthly).withColumn("scorename", F.lit(score))


# --- feature PSI ---------------------------------------------------------------------------


INSIDE = "__inside"


def _read_once(df: DataFrame, columns: Sequence[str], within: Column | None = None) -> tuple[DataFrame, Column | None]:
    """The named columns that `df` has, written once for the passes that follow, and `within` on them.

    Types, edges, counts and accounts each read the rows; a population of several tables would
    be joined and shuffled for each of them.
    """
    shown = [c for c in dict.fromkeys(columns) if c in df.columns]
    if within is None:
        return materialise(df.select(*shown)), None
    return materialise(df.select(*shown, within.alias(INSIDE))), F.col(INSIDE)


def _feature_counts(
    df: DataFrame,
    features: Sequence[str],
    segments: Sequence[str],
    keys: Sequence[str],
    month: str,
    selection: str,
    train: str,
    types: Mapping[str, str] | None,
    policy: str,
    top: int,
    include_train_in_month: bool,
    within: Column | None,
    method: str,
    pooled: tuple[str, str] | None = None,
) -> DataFrame:
    """Bin counts per segment, key, feature and month; the baseline has a null month.

    Bins come from all train rows of a key; `within` restricts the counted rows afterwards.
    The rows are counted over all segment columns first, so the segment copies are small.
    """
    kinds = dict(types) if types is not None else binning.feature_types(df, features)
    kinds = {f: kinds[f] for f in features if f in kinds}
    flagged = df.withColumn("__train", F.coalesce(F.col(selection) == train, F.lit(False)))
    keep = list(dict.fromkeys([*keys, *segments, month, "__train"]))
    train_long = binning.long_features(flagged.where(F.col(selection) == train), kinds, keep)
    counted = flagged if within is None else flagged.where(within)
    what = ["Feature", "Feature_Type", "Bin"]
    counts = binning.feature_bin_counts(
        binning.long_features(counted, kinds, keep), train_long, kinds, keep, keys, policy, top, method, pooled=pooled
    )
    shared = [c for c in segments if c in keys]
    copies = counts.withColumns({f"__k_{c}": F.col(c) for c in shared})
    by_segment = one_at_a_time(copies, segments).withColumnsRenamed({f"__k_{c}": c for c in shared})
    dated = by_segment.where(F.col("__train") | F.col(month).isNotNull())
    if include_train_in_month:
        tested = df.where(~F.coalesce(F.col(selection) == train, F.lit(False))).select(month).distinct()
        inside = dated.where(F.col("__train")).join(tested, month, "left_semi")
        dated = with_null_period(dated, month).unionByName(inside)
    else:
        dated = with_null_period(dated, month)
    return dated.groupBy(*SEGMENT, *keys, month, *what).agg(
        F.sum("n").alias("n"), F.first("Bin_Min", True).alias("Bin_Min"), F.first("Bin_Max", True).alias("Bin_Max")
    )


def with_null_period(df: DataFrame, month: str) -> DataFrame:
    """Train rows get a null month: they are the baseline and belong to no period."""
    return df.withColumn(month, F.when(~F.col("__train"), F.col(month)))


def _with_account_counts(
    result: DataFrame,
    df: DataFrame,
    segments: Sequence[str],
    keys: Sequence[str],
    account: str,
    month: str,
    selection: str,
    train: str,
    include_train_in_month: bool,
    within: Column | None,
    pooled: tuple[str, str] | None = None,
) -> DataFrame:
    """Distinct accounts of the baseline and of each month, per segment, from one pass."""
    rows = df if within is None else df.where(within)
    is_train = F.coalesce(F.col(selection) == train, F.lit(False))
    named = {c: f"__k_{c}" for c in segments if c in keys}
    none = F.lit(None).cast("string")
    as_train = F.array(none, F.col(month)) if include_train_in_month else F.array(none)
    rows = rows.where(is_train | F.col(month).isNotNull()).withColumns(
        {
            **{named[c]: F.col(c) for c in named},
            "__period": F.explode(F.when(is_train, as_train).otherwise(F.array(F.col(month)))),
        }
    )
    inner = [named.get(k, k) for k in keys]
    counts = segment_accounts(rows, segments, [*inner, "__period"], account, "__accounts", pooled=pooled)
    counts = counts.withColumnsRenamed({v: k for k, v in named.items()})
    # All periods of a segment next to its baseline count.
    base = F.max(F.when(F.col("__period").isNull(), F.col("__accounts"))).over(
        Window.partitionBy(*SEGMENT, *keys)
    )
    sized = counts.withColumn("Base_Count", base).where(F.col("__period").isNotNull())
    sized = sized.withColumnsRenamed({"__period": month, "__accounts": "Actual_Count"})
    return result.join(sized, [*SEGMENT, *keys, month], "left")


def feature_psi(
    df: DataFrame,
    features: Sequence[str],
    segments: Sequence[str] = (),
    keys: Sequence[str] = (),
    account: str = ACCOUNT,
    month: str = MONTH,
    selection: str = SELECTION,
    train: str = "Train",
    types: Mapping[str, str] | None = None,
    bin_policy: str = "ladder",
    top: int = 6,
    policy: str | ZeroPolicy = "zero_1e-4_renormalised",
    include_train_in_month: bool = False,
    within: Column | None = None,
    method: str = "exact",
    pooled: tuple[str, str] | None = None,
    typing: str = "few_integers",
) -> DataFrame:
    """PSI of each feature per month against the train rows, overall and per segment value.

    Bins are common to all segments of a key. Expected and actual percentages are the mean
    share of a non-empty bin. `pooled`: a key and a value of it that stands for all its rows.
    `typing`: the rule for features without `types`.
    """
    df, within = _read_once(df, [*features, *segments, *keys, account, month, selection], within)
    types = binning.feature_types(df, features, typing) if types is None else types
    counts = _feature_counts(
        df, features, segments, keys, month, selection, train, types, bin_policy, top,
        include_train_in_month, within, method, pooled,
    )
    groups = [*SEGMENT, *keys, "Feature", "Feature_Type"]
    shares = compare_bins(counts, groups, month, policy)
    filled = lambda side: F.count(F.when(F.col(f"{side}_n") > 0, 1))
    values = index_of(
        shares,
        [*groups, month],
        "PSI",
        [
            F.try_divide(F.lit(100.0), filled("e")).alias("Expected_Percentage"),
            F.try_divide(F.lit(100.0), filled("a")).alias("Actual_Percentage"),
        ],
    )
    counted = _with_account_counts(
        values, df, segments, keys, account, month, selection, train, include_train_in_month, within, pooled
    )
    return _named_months(counted, month)


def _named_months(df: DataFrame, month: str) -> DataFrame:
    return (
        df.withColumn("Current_Month", F.col(month))
        .withColumnRenamed(month, "Month")
        .withColumn("Base_Month", F.lit("Train"))
    )


def feature_bin_psi(
    df: DataFrame,
    features: Sequence[str],
    segments: Sequence[str] = (),
    keys: Sequence[str] = (),
    account: str = ACCOUNT,
    month: str = MONTH,
    selection: str = SELECTION,
    train: str = "Train",
    types: Mapping[str, str] | None = None,
    bin_policy: str = "ladder",
    top: int = 6,
    include_train_in_month: bool = False,
    within: Column | None = None,
    method: str = "exact",
) -> DataFrame:
    """The parts of `feature_psi` per bin, with bounds; empty bins count as 1e-4 unscaled."""
    df, within = _read_once(df, [*features, *segments, *keys, account, month, selection], within)
    counts = _feature_counts(
        df, features, segments, keys, month, selection, train, types, bin_policy, top,
        include_train_in_month, within, method,
    )
    groups = [*SEGMENT, *keys, "Feature", "Feature_Type"]
    no_scaling = ZeroPolicy(absent=1e-4, zero=1e-4)
    shares = compare_bins(counts, groups, month, no_scaling, attributes=["Bin_Min", "Bin_Max"])
    bins = shares.select(
        *groups,
        month,
        "Bin",
        F.coalesce(B.range_text(F.col("Bin_Min"), F.col("Bin_Max")), F.col("Bin")).alias("Bin_Range"),
        "Bin_Min",
        "Bin_Max",
        (F.coalesce("e_share", F.lit(0.0)) * 100).alias("Base_Percentage"),
        (F.coalesce("a_share", F.lit(0.0)) * 100).alias("Actual_Percentage"),
        F.col("term").alias("Bin_PSI"),
    )
    counted = _with_account_counts(
        bins, df, segments, keys, account, month, selection, train, include_train_in_month, within
    )
    return _named_months(counted, month)


def psi_by_version(
    df: DataFrame, score: str, features: Sequence[str], segments: Sequence[str] = (),
    version: str = "modelVersionId", by_bin: bool = False, **options,
) -> DataFrame:
    """Feature and score PSI with bins per model version; versions need train and test rows."""
    make = feature_bin_psi if by_bin else feature_psi
    result = make(df, [score, *features], segments, keys=[version], **options)
    return result.withColumn(
        "Feature_Category", F.when(F.col("Feature") == score, "Score").otherwise("Expanded_Feature")
    )


def psi_by_config(
    df: DataFrame, features: Sequence[str], segments: Sequence[str] = (),
    model: str = "modelDisplayName", version: str = "modelVersionId", trench: str = "trenchCategory",
    **options,
) -> DataFrame:
    """PSI per (model, version, trench) and per (model, version, 'ALL'), with a shift label."""
    own = F.coalesce(F.nullif(F.col(trench), F.lit("")), F.lit("ALL"))
    rows = df.withColumn("config_trench", own)
    settings = {"bin_policy": "deciles", "top": 10, "policy": "floor_1e-10_renormalised", "typing": "at_most_integers"} | options
    keys = [model, version, "config_trench"]
    result = feature_psi(rows, features, segments, keys=keys, pooled=("config_trench", "ALL"), **settings)
    return result.withColumn("PSI_Interpretation", band(F.col("PSI"), "shift"))


def psi_within(
    df: DataFrame, features: Sequence[str], definition: Mapping[str, object], **options
) -> DataFrame:
    """PSI for rows matching a segment definition (value or list per column); bins from all train rows."""
    test = F.lit(True)
    for column, wanted in definition.items():
        values = list(wanted) if isinstance(wanted, (list, tuple, set)) else [wanted]
        test = test & F.col(column).isin(*values)
    return feature_psi(df, features, within=F.coalesce(test, F.lit(False)), **options).drop(*SEGMENT)


def psi_report(
    df: DataFrame,
    score: str,
    features: Sequence[str],
    further: Sequence[str] = ("loan_product_type", "new_loan_type", "osType"),
    version: str = "modelVersionId",
    trench: str = "trenchCategory",
    account: str = ACCOUNT,
    month: str = MONTH,
    selection: str = SELECTION,
    train: str = "Train",
    types: Mapping[str, str] | None = None,
    bin_policy: str = "ladder",
    top: int = 6,
    policy: str | ZeroPolicy = "zero_1e-4_renormalised",
    method: str = "exact",
) -> DataFrame:
    """PSI for every subset of trenches per version: the score, then all features per further segment."""
    every = list(dict.fromkeys([score, *features]))
    df, _ = _read_once(df, [*every, version, trench, *further, account, month, selection])
    kinds = dict(types) if types is not None else binning.feature_types(df, every)
    flagged = df.withColumn("__train", F.coalesce(F.col(selection) == train, F.lit(False)))
    keep = [version, trench, *further, month, "__train"]
    long = binning.long_features(flagged, kinds, keep)
    counts = binning.feature_bin_counts(
        long, long.where("__train"), kinds, keep, (), bin_policy, top, method
    ).drop("Bin_Min", "Bin_Max")

    subsets = subset_labels(df, version, trench)
    subset = f"{trench}_set"

    def spread(rows: DataFrame) -> DataFrame:
        joined = rows.join(subsets, [version, trench], "inner").drop(trench)
        return one_at_a_time(joined, further)

    level_keys = [*SEGMENT, version, subset]
    groups = [*level_keys, "Feature", "Feature_Type"]
    by_level = spread(counts).where((F.col("Segment_Column") != "Overall") | (F.col("Feature") == score))
    by_level = by_level.where((F.col("Segment_Column") == "Overall") | F.col("Feature").isin(*features))
    dated = with_null_period(by_level.where(F.col("__train") | F.col(month).isNotNull()), month)
    level_counts = dated.groupBy(*groups, month, "Bin").agg(F.sum("n").alias("n"))
    shares = compare_bins(level_counts, groups, month, policy)
    values = index_of(
        shares,
        [*groups, month],
        "PSI",
        [
            F.try_divide(F.lit(100.0), F.count("e_n")).alias("Expected_Percentage"),
            F.try_divide(F.lit(100.0), F.count("a_n")).alias("Actual_Percentage"),
        ],
    )
    sized = _subset_accounts(with_null_period(flagged, month), further, version, trench, month, account, subsets).withColumn(
        "Base_Count",
        F.max(F.when(F.col(month).isNull(), F.col("Actual_Count"))).over(Window.partitionBy(*level_keys)),
    )
    full = values.join(sized.where(F.col(month).isNotNull()), [*level_keys, month], "left")
    names = F.concat(
        F.lit("Model_"), F.col(version).cast("string"), F.lit("_Trench_"), F.regexp_replace(subset, ",", "_"),
        F.when(F.col("Segment_Column") == "Overall", F.lit("")).otherwise(
            F.concat(F.lit("_"), F.col("Segment_Column"), F.lit("_"), F.col("Segment_Value"))
        ),
    )
    full = full.withColumn("Segment_Name", names)
    order = F.array_position(F.array(F.lit("Overall"), *[F.lit(c) for c in further]), F.col("Segment_Column"))
    ids = numbered(
        full.withColumn("__level", order).select("__level", *level_keys).distinct(),
        ["__level", version, subset, "Segment_Value"],
        "Segment_ID",
        start=0,
    ).drop("__level")
    return _named_months(full.join(ids, level_keys, "left"), month)


def _subset_accounts(
    df: DataFrame, segments: Sequence[str], version: str, trench: str, month: str, account: str, subsets: DataFrame
) -> DataFrame:
    """Distinct accounts per segment, version, subset of trenches and month, in Actual_Count.

    An account belongs to a subset if one of its trenches does. So accounts are counted by the
    set of their trenches, and only these counts are copied to the subsets that meet the set.
    """
    def copies(seen: Column) -> Column:
        pairs = [("Overall", F.lit("All")), *((c, seen[c].cast("string")) for c in segments)]
        rest = [seen[c].alias(c) for c in (version, month)]
        return F.array(*[
            F.struct(F.lit(c).alias("Segment_Column"), v.alias("Segment_Value"), *rest, seen[trench].cast("string").alias("__trench")) for c, v in pairs
        ])

    keys = [*SEGMENT, version, month]
    seen = per_account(df.where(F.col(trench).isNotNull()), [version, trench, *segments, month], account)
    each = F.array_distinct(F.flatten(F.transform("__seen", copies)))
    rows = seen.select(HOME, account, F.explode(each).alias("__copy")).select(HOME, account, "__copy.*").where(F.col("Segment_Value").isNotNull())
    # All rows of an account share a task already.
    sets = rows.groupBy(HOME, account, *keys).agg(F.array_sort(F.collect_set("__trench")).alias("__set"))
    counts = sets.groupBy(*keys, "__set").agg(F.count(account).alias("__n"))
    subset = f"{trench}_set"
    members = counts.withColumn(trench, F.explode("__set")).join(subsets, [version, trench], "inner")
    met = members.select(*keys, subset, "__set", "__n").distinct()
    return met.groupBy(*SEGMENT, version, subset, month).agg(F.sum("__n").alias("Actual_Count"))


# --- other baselines -------------------------------------------------------------------------


def first_period_psi(
    df: DataFrame,
    model: str,
    score: str,
    when: str,
    account: str = ACCOUNT,
    policy: str | ZeroPolicy = "zero_1e-4_renormalised",
) -> DataFrame:
    """Monthly PSI against each model's first month, with sample statistics."""
    rows = clean_scores(df, score).withColumn("month", month_label(F.col(when))).where(F.col("month").isNotNull())
    spec = broadcast_checked(binning.first_period_edges(rows, model, score, "month"))
    placed = rows.join(spec, model, "inner").withColumn("Bin", B.right_closed(F.col(score), F.col("edges")))
    counts = placed.groupBy(model, "baseline", "month", "Bin").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("edges") - 1).alias("bins")
    )
    all_bins = counts.groupBy(model).agg(F.max("bins").alias("bins")).select(
        model, F.explode(F.sequence(F.lit(1), F.col("bins"))).alias("Bin")
    )
    # Bins that the baseline leaves empty take part with a zero share.
    empty = all_bins.select(model, F.lit(None).cast("string").alias("month"), "Bin", F.lit(0).cast("long").alias("n"))
    own = with_baseline_copy(counts, "month", F.col("month") == F.col("baseline"))
    both = own.select(model, "month", "Bin", "n").unionByName(empty)
    shares = compare_bins(both, [model], "month", policy)
    values = index_of(shares, [model, "month"], "PSI").withColumn("PSI", F.round("PSI", 6))
    stats = placed.groupBy(model, "month").agg(
        F.max("baseline").alias("baseline_month"),
        F.count(F.lit(1)).alias("sample_size"),
        F.min(score).alias("prediction_min"),
        F.max(score).alias("prediction_max"),
        F.avg(score).alias("prediction_mean"),
        F.max(F.size("edges") - 1).alias("num_bins"),
    )
    people = distinct_accounts(placed, [model, "month"], account, "account_count")
    return values.join(stats, [model, "month"], "inner").join(people, [model, "month"], "left")


def _baseline_month_shares(
    df: DataFrame,
    features: Sequence[str],
    segments: Sequence[str],
    month: str,
    baseline: str | None,
    types: Mapping[str, str] | None,
    policy: str | ZeroPolicy,
    top: int,
) -> tuple[DataFrame, DataFrame]:
    """(per-bin shares, rows per segment and month) against each segment's baseline month."""
    kinds = dict(types) if types is not None else binning.feature_types(df, features, "at_most")
    dated_rows = df.where(F.col(month).isNotNull())
    overall = ("Overall", "Overall")
    # Counts come before the segment copies: copies are copies of counts.
    sizes = one_at_a_time(
        dated_rows.groupBy(*segments, month).agg(F.count(F.lit(1)).alias("__n")), segments, overall
    ).groupBy(*SEGMENT, month).agg(F.sum("__n").alias("records"))
    first = F.min(month) if baseline is None else F.max(F.when(F.col(month) == baseline, F.col(month)))
    bases = sizes.groupBy(*SEGMENT).agg(first.alias("baseline_month"), F.count(F.lit(1)).alias("__months"))
    bases = bases.where((F.col("__months") >= 2) & F.col("baseline_month").isNotNull()).drop("__months")

    long = binning.long_features(dated_rows, kinds, list(dict.fromkeys([*segments, month])))
    counted = (
        long.where(F.col("number").isNotNull() | F.col("category").isNotNull())
        .groupBy(*dict.fromkeys([*segments, month]), "Feature", "Feature_Type", "number", "category")
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    present = one_at_a_time(counted, segments, overall)
    dated = present.join(broadcast_checked(bases), SEGMENT, "inner")
    base_rows = dated.where(F.col(month) == F.col("baseline_month"))
    groups = [*SEGMENT, "baseline_month", "Feature", "Feature_Type"]
    counts = binning.feature_bin_counts(
        dated, base_rows, kinds, [*SEGMENT, "baseline_month", month], SEGMENT, "quantile", top,
        include_lowest=False, others="Other", weight="__n",
    )
    is_base = F.col(month) == F.col("baseline_month")
    dated_counts = counts.withColumn(month, F.when(~is_base, F.col(month)))
    shares = compare_bins(dated_counts, groups, month, policy, attributes=["Bin_Min", "Bin_Max"])
    return shares, sizes


def baseline_month_psi(
    df: DataFrame,
    features: Sequence[str],
    segments: Sequence[str] = (),
    month: str = MONTH,
    baseline: str | None = None,
    types: Mapping[str, str] | None = None,
    policy: str | ZeroPolicy = "zero_1e-6",
    top: int = 6,
) -> DataFrame:
    """PSI of every later month against a baseline month, bins learnt inside each segment."""
    shares, sizes = _baseline_month_shares(df, features, segments, month, baseline, types, policy, top)
    groups = [*SEGMENT, "baseline_month", "Feature", "Feature_Type"]
    values = index_of(shares, [*groups, month], "psi")
    base = sizes.select(
        *SEGMENT, F.col(month).alias("baseline_month"), F.col("records").alias("num_baseline_records")
    )
    now = sizes.withColumnRenamed("records", "num_current_records")
    return (
        values.join(base, [*SEGMENT, "baseline_month"], "left")
        .join(now, [*SEGMENT, month], "left")
        .withColumn("psi_interpretation", band(F.col("psi"), "change"))
        .withColumnRenamed(month, "current_month")
    )


def baseline_month_bin_psi(
    df: DataFrame,
    features: Sequence[str],
    segments: Sequence[str] = (),
    month: str = MONTH,
    baseline: str | None = None,
    types: Mapping[str, str] | None = None,
    policy: str | ZeroPolicy = "zero_1e-6",
    top: int = 6,
) -> DataFrame:
    """The bins behind `baseline_month_psi` with the change of each share."""
    shares, _ = _baseline_month_shares(df, features, segments, month, baseline, types, policy, top)
    change = F.col("a") - F.col("e")
    return shares.select(
        *SEGMENT,
        "baseline_month",
        "Feature",
        "Feature_Type",
        F.col(month).alias("current_month"),
        "Bin",
        "Bin_Min",
        "Bin_Max",
        F.col("e").alias("baseline_percentage"),
        F.col("a").alias("current_percentage"),
        F.col("term").alias("psi_component"),
        F.coalesce("e_n", F.lit(0)).alias("baseline_count"),
        F.coalesce("a_n", F.lit(0)).alias("current_count"),
        change.alias("percentage_change"),
        band(change, "size").alias("change_interpretation"),
    )


def whole_frame_feature_psi(
    df: DataFrame,
    feature: str,
    kind: str,
    month: str = MONTH,
    baseline: str | None = None,
    policy: str | ZeroPolicy = "add_1e-6",
    by_bin: bool = False,
    top: int = 6,
) -> DataFrame:
    """PSI against the first month with bins of the whole frame; the baseline's own row is 0."""
    if kind == "numerical":
        binned = binning.whole_frame_bins(df, feature, "Bin")
    else:
        binned = binning.whole_frame_categories(df, feature, "Bin", top)
    counts = binned.groupBy(month, "Bin").agg(F.count(F.lit(1)).alias("n"))
    first = F.lit(baseline) if baseline is not None else df.agg(F.min(month)).scalar()
    counts = counts.withColumn("base_month", first)
    counts = with_baseline_copy(counts, month, F.col(month) == F.col("base_month"))
    shares = compare_bins(counts, ["base_month"], month, policy)
    if by_bin:
        return shares.select(
            "base_month", F.col(month).alias("month"), "Bin", F.col("e").alias("expected_share"),
            F.col("a").alias("actual_share"), F.col("term").alias("psi_component"),
        )
    return index_of(shares, ["base_month", month], "psi", [F.max("a_total").alias("sample_size")]).select(
        F.lit(feature).alias("feature"), "base_month", F.col(month).alias("month"), "psi", "sample_size"
    )


def pooled_bin_psi(
    df: DataFrame,
    score: str,
    period: str,
    baseline: object,
    policy: str | ZeroPolicy = "zero_1e-7",
    buckets: int = 10,
) -> DataFrame:
    """PSI of each later period against a fixed one; bins from both periods pooled."""
    counts = (
        df.where(F.col(score).isNotNull())
        .groupBy(period, score)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    base = F.lit(baseline).cast(df.schema[period].dataType)
    later = counts.where(F.col(period) > base).withColumn("side", F.lit("actual"))
    periods = later.agg(F.collect_set(period))
    fixed = (
        counts.where(F.col(period) == base)
        .drop(period)
        .withColumn(period, F.explode(periods.scalar()))
        .withColumn("side", F.lit("expected"))
    )
    both = later.unionByName(fixed)
    pooled = both.groupBy(period, score).agg(F.sum("n").alias("n"))
    edges = quantiles_of_counts(pooled, [period], score, [i / buckets for i in range(buckets + 1)])
    placed = (
        both.join(edges.select(period, "quantiles"), period, "inner")
        .withColumn("Bin", B.left_closed(F.col(score), F.col("quantiles"), buckets + 1))
        .groupBy(period, "side", "Bin")
        .agg(F.sum("n").alias("n"))
    )
    sided = placed.select(
        F.col(period).alias("__of"), F.when(F.col("side") == "actual", F.col(period)).alias(period), "Bin", "n"
    )
    shares = compare_bins(sided, ["__of"], period, policy)
    return index_of(shares, [period], "psi")


def period_psi_detail(
    df: DataFrame,
    score: str,
    selection: str = SELECTION,
    train: str = "Train",
    test: str = "Test",
    bins: int = 10,
) -> DataFrame:
    """Bin table of two populations in percent, with a 'Grand Total' row."""
    rows = df.where(F.col(selection).isin(train, test) & F.col(score).isNotNull())
    spec = binning.left_closed_edges(rows.where(F.col(selection) == train), score, bins)
    placed = (
        rows.withColumn("__edges", spec.scalar())
        .withColumn("Bin", B.left_closed(F.col(score), F.col("__edges"), bins + 1))
        .withColumn("__side", F.when(F.col(selection) != train, "test"))
        .groupBy("__side", "Bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    numbers = df.sparkSession.range(1, bins + 1)
    empty = numbers.select(
        F.lit(None).cast("string").alias("__side"), F.col("id").cast("int").alias("Bin"), F.lit(0).cast("long").alias("n")
    )
    shares = compare_bins(placed.unionByName(empty), [], "__side", "empty_is_nothing")
    e, a = F.coalesce("e_share", F.lit(0.0)), F.coalesce("a_share", F.lit(0.0))
    ratio = F.when((e > 0) & (a > 0), F.ln(F.try_divide(a, e))).otherwise(F.lit(0.0))
    detail = shares.select(
        F.col("Bin").cast("string").alias("Bins"),
        F.coalesce("e_n", F.lit(0)).alias("train"),
        (e * 100).alias("train_pct"),
        F.coalesce("a_n", F.lit(0)).alias("test"),
        (a * 100).alias("test_pct"),
        ((a - e) * 100).alias("difference"),
        ratio.alias("ln_ratio"),
        (F.col("term") * 100).alias("PSI"),
    )
    total = detail.agg(
        F.lit("Grand Total").alias("Bins"),
        F.sum("train").alias("train"),
        F.lit(100.0).alias("train_pct"),
        F.sum("test").alias("test"),
        F.lit(100.0).alias("test_pct"),
        F.lit(None).cast("double").alias("difference"),
        F.lit(None).cast("double").alias("ln_ratio"),
        F.sum("PSI").alias("PSI"),
    )
    return detail.unionByName(total)
