"""Characteristic stability on bins that are already columns, down to single bins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from scorewatch.functions import bins as B
from scorewatch.functions.stability import ZeroPolicy, adjusted, band, policy_named, term
from scorewatch.operators import binning
from scorewatch.operators.ordered import quantiles
from scorewatch.operators.segments import one_at_a_time
from scorewatch.operators.shares import compare_bins, index_of, segment_accounts
from scorewatch.session import materialise

ACCOUNT, MONTH, SELECTION = "digitalLoanAccountId", "Application_month", "dataselection"
SEGMENT = ["Segment_Column", "Segment_Value"]


def _counts(
    df: DataFrame, features: Sequence[str], segments: Sequence[str], month: str, selection: str,
    train: str, test: str, min_rows: int,
) -> DataFrame:
    """Counts per segment, feature, month and bin column value; train rows have a null month.

    Nulls are null bins. Segments with fewer than `min_rows` rows, or without rows on one
    side, drop out.
    """
    rows = df.withColumn("__side", F.col(selection))
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("Bin")) for f in features])
    counts = (
        rows.select(*segments, F.when(F.col("__side") == test, F.col(month)).alias(month), "__side", F.inline(pairs))
        .groupBy(*segments, month, "__side", "feature", "Bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    by_segment = one_at_a_time(counts.where(F.col("__side").isin(train, test)), segments)
    known = F.col("__side") == train
    sized = by_segment.groupBy(*SEGMENT, "feature", month, "__side", "Bin").agg(F.sum("n").alias("n"))
    # One row per segment and feature, however many bins there are.
    totals = sized.groupBy(*SEGMENT, "feature").agg(
        F.sum("n").alias("__all"),
        F.sum(F.when(known, F.col("n"))).alias("__train_n"),
        F.sum(F.when(~known, F.col("n"))).alias("__test_n"),
    )
    enough = (F.col("Segment_Column") == "Overall") | (F.col("__all") >= min_rows)
    return sized.join(totals, [*SEGMENT, "feature"]).where(enough & (F.col("__train_n") > 0) & (F.col("__test_n") > 0)).select(
        *SEGMENT, "feature", month, "Bin", "n"
    )


def _read_once(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named columns, written once for the counts, accounts and months that each read them.

    A population of several tables would be joined for each, its sorts in the tasks that count.
    """
    return materialise(df.select(*dict.fromkeys(columns)))


def segmented_csi(
    df: DataFrame, features: Sequence[str], segments: Sequence[str] = (), account: str = ACCOUNT,
    month: str = MONTH, selection: str = SELECTION, train: str = "Train", test: str = "Test", min_rows: int = 50,
) -> DataFrame:
    """CSI per feature and month with a Training row of 0, overall and per segment value."""
    df = _read_once(df, [*features, *segments, account, month, selection])
    counts = _counts(df, features, segments, month, selection, train, test, min_rows)
    groups = [*SEGMENT, "feature"]
    shares = compare_bins(counts, groups, month, "absent_1e-4", denominator="binned")
    values = index_of(shares, [*groups, month], "csi")
    now = segment_accounts(df.where(F.col(selection) == test), segments, [month], account, "account_count")
    monthly = values.join(now, [*SEGMENT, month], "left").withColumn("DateCategory", F.lit("Monthly"))
    base = segment_accounts(df.where(F.col(selection) == train), segments, [], account, "account_count")
    last = df.where(F.col(selection) == train).select(*segments, month).distinct()
    last_month = one_at_a_time(last, segments).groupBy(*SEGMENT).agg(F.max(month).alias(month))
    training = (
        counts.select(*groups).distinct()
        .join(base, SEGMENT, "left")
        .join(last_month, SEGMENT, "left")
        .withColumns({"csi": F.lit(0.0), "DateCategory": F.lit("Training")})
    )
    return monthly.unionByName(training).withColumnRenamed(month, "Month")


def bin_csi(
    df: DataFrame, features: Sequence[str], segments: Sequence[str] = (), account: str = ACCOUNT,
    month: str = MONTH, selection: str = SELECTION, train: str = "Train", test: str = "Test", min_rows: int = 50,
) -> DataFrame:
    """CSI of every bin next to its feature's CSI, with Training rows of 0 and a month sort key.

    Bin shares are of all rows with a floor of 1e-4; the feature's CSI uses shares of the rows
    that have a bin, and 1e-4 for bins absent on one side.
    """
    df = _read_once(df, [*features, *segments, account, month, selection])
    counts = materialise(_counts(df, features, segments, month, selection, train, test, min_rows))
    groups = [*SEGMENT, "feature"]
    per_bin = compare_bins(counts, groups, month, "floor_1e-4", written=True)
    whole = index_of(
        compare_bins(counts, groups, month, "absent_1e-4", denominator="binned", written=True),
        [*groups, month],
        "feature_csi",
    )
    now = segment_accounts(df.where(F.col(selection) == test), segments, [month], account, "account_count")
    # Only the distinct months of a segment are ranked.
    order = Window.partitionBy(*SEGMENT).orderBy(month)
    ranks = counts.where(F.col(month).isNotNull()).select(*SEGMENT, month).distinct().withColumn("__rank", F.dense_rank().over(order))
    monthly = (
        per_bin.join(whole, [*groups, month], "left")
        .join(now, [*SEGMENT, month], "left")
        .join(ranks, [*SEGMENT, month], "left")
        .withColumn("MonthSortKey", month_key(F.col("__rank"), F.col(month)))
        .select(
            *groups, F.col(month).alias("Month"), "MonthSortKey", F.col("Bin").alias("bin_value"),
            F.lit("b_Monthly").alias("DateCategory"), F.col("e").alias("train_pct"), F.col("a").alias("test_pct"),
            F.col("term").alias("bin_csi"), "feature_csi", "account_count",
        )
    )
    trained = df.where(F.col(selection) == train)
    base = segment_accounts(trained, segments, [], account, "account_count")
    last_month = one_at_a_time(trained.select(*segments, month).distinct(), segments).groupBy(*SEGMENT).agg(
        F.max(month).alias("Month")
    )
    trained_counts = counts.where(F.col(month).isNull()).drop(month)
    training = (
        trained_counts.join(trained_counts.groupBy(*groups).agg(F.sum("n").alias("__n")), groups)
        .withColumn("share", F.col("n") / F.col("__n"))
        .where(F.col("Bin").isNotNull())
        .join(base, SEGMENT, "left")
        .join(last_month, SEGMENT, "left")
        .select(
            *groups, "Month", F.concat(F.lit("a_"), F.col("Month")).alias("MonthSortKey"),
            F.col("Bin").alias("bin_value"), F.lit("a_Training").alias("DateCategory"),
            F.col("share").alias("train_pct"), F.col("share").alias("test_pct"),
            F.lit(0.0).alias("bin_csi"), F.lit(0.0).alias("feature_csi"), "account_count",
        )
    )
    return training.unionByName(monthly)


def month_key(position, month):
    """Ordering label of a test month: b_, c_, ... z_, then zero-padded numbers after z."""
    letter = F.char(F.lit(97) + position)
    return F.concat(
        F.when(position <= 25, letter).otherwise(F.concat(F.lit("z"), F.lpad(position.cast("string"), 4, "0"))),
        F.lit("_"),
        month,
    )


def pair_bin_csi(train: DataFrame, test: DataFrame, feature: str) -> DataFrame:
    """Bin and feature CSI of one bin column between two frames."""
    def counted(df: DataFrame, side: str | None) -> DataFrame:
        bins = df.groupBy(F.col(feature).cast("string").alias("Bin")).agg(F.count(F.lit(1)).alias("n"))
        return bins.withColumn("side", F.lit(side).cast("string"))

    counts = materialise(counted(train, None).unionByName(counted(test, "test")))
    bins = compare_bins(counts, [], "side", "floor_1e-4", written=True)
    whole = compare_bins(counts, [], "side", "absent_1e-4", denominator="binned", written=True).agg(F.sum("term"))
    return bins.select(
        F.lit(feature).alias("feature"), F.col("Bin").alias("bin_value"), F.col("e").alias("train_pct"),
        F.col("a").alias("test_pct"), F.col("term").alias("bin_csi"), whole.scalar().alias("feature_csi"),
    )


def band_share_csi(
    df: DataFrame, band_column: str, value: str, period: str, baseline: str, policy: str | ZeroPolicy = "zero_1e-7"
) -> DataFrame:
    """CSI of each band from its row counts: shares of baseline and later rows in their sum.

    Null where either side has no rows.
    """
    policy = policy_named(policy)
    counts = (
        df.where(F.col(value).isNotNull() & F.col(band_column).isNotNull())
        .groupBy(band_column, period)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    base = counts.where(F.col(period) == baseline).select(band_column, F.col("n").alias("e_n"))
    bands = df.where(F.col(band_column).isNotNull()).select(band_column).distinct()
    periods = df.where(F.col(period) > baseline).agg(F.collect_set(period))
    grid = bands.withColumn(period, F.explode(periods.scalar()))
    joined = grid.join(base, band_column, "left").join(
        counts.withColumnRenamed("n", "a_n"), [band_column, period], "left"
    )
    whole = F.col("e_n") + F.col("a_n")
    e = adjusted(F.col("e_n") / whole, policy)
    a = adjusted(F.col("a_n") / whole, policy)
    return joined.withColumn(
        "csi", F.when(F.col("e_n").isNotNull() & F.col("a_n").isNotNull(), term(e, a))
    ).select(band_column, period, "csi")


def psi_table(train: DataFrame, test: DataFrame, score: str, bins: int = 10) -> DataFrame:
    """Bin, train and test shares and PSI part, with the total on every row; empty sides are unprotected."""
    spec = quantiles(train, [], score, [i / bins for i in range(bins + 1)]).select(
        F.array_sort(F.array_distinct("quantiles"))
    )

    def counted(df: DataFrame, side: str | None) -> DataFrame:
        return (
            df.where(F.col(score).isNotNull())
            .withColumn("__edges", spec.scalar())
            .withColumn("Bin", B.right_closed(F.col(score), F.col("__edges"), bins + 1))
            .groupBy("Bin")
            .agg(F.count(F.lit(1)).alias("n"))
            .withColumn("side", F.lit(side).cast("string"))
        )

    counts = counted(train, None).unionByName(counted(test, "test"))
    shares = compare_bins(counts, [], "side", "unprotected", denominator="binned")
    return shares.select(
        F.col("Bin").alias("bin"), F.col("e").alias("train_pct"), F.col("a").alias("test_pct"),
        F.col("term").alias("psi"), shares.agg(F.sum("term")).scalar().alias("total_psi"),
    )


def csi_table(
    train: DataFrame, test: DataFrame, features: Sequence[str], bins: int | Mapping[str, int] = 10
) -> DataFrame:
    """CSI and status per feature; categories absent on one side count as 1e-4."""
    per_feature = {f: bins if isinstance(bins, int) else bins.get(f, 10) for f in features}
    numeric = {f: isinstance(train.schema[f].dataType, NumericType) for f in features}
    kinds = {f: "numerical" if numeric[f] else "categorical" for f in features}
    train_long, test_long = (binning.long_features(df, kinds, []) for df in (train, test))
    sizes = sorted(set(per_feature.values()))
    probabilities = sorted({i / s for s in sizes for i in range(s + 1)})
    q = quantiles(train_long.where(F.col("Feature_Type") == "numerical"), ["Feature"], "number", probabilities)
    chain = None
    for f in features:
        picked = F.array(*[F.get("quantiles", F.lit(probabilities.index(i / per_feature[f]))) for i in range(per_feature[f] + 1)])
        chain = F.when(F.col("Feature") == f, picked) if chain is None else chain.when(F.col("Feature") == f, picked)
    # One row per named feature.
    spec = F.broadcast(q.select("Feature", F.array_sort(F.array_distinct(chain)).alias("edges")))

    def counted(long: DataFrame, side: str | None) -> DataFrame:
        number = B.right_closed(F.col("number"), F.col("edges"), max(sizes) + 1)
        return (
            long.join(spec, "Feature", "left")
            .withColumn("Bin", F.coalesce(number.cast("string"), F.col("category")))
            .where(F.col("Bin").isNotNull())
            .groupBy("Feature", "Feature_Type", "Bin")
            .agg(F.count(F.lit(1)).alias("n"))
            .withColumn("side", F.lit(side).cast("string"))
        )

    groups = ["Feature", "Feature_Type"]
    counts = counted(train_long, None).unionByName(counted(test_long, "test"))
    # A numeric bin always exists on both sides, so an empty one is a zero share.
    mixed = compare_bins(counts, groups, "side", "absent_1e-4")
    strict = term(F.coalesce("e_share", F.lit(0.0)), F.coalesce("a_share", F.lit(0.0)))
    value = F.when(F.col("Feature_Type") == "numerical", strict).otherwise(F.col("term"))
    result = mixed.groupBy("Feature").agg(F.sum(value).alias("csi"))
    return result.select(F.col("Feature").alias("feature"), "csi", band(F.col("csi"), "status").alias("status"))


