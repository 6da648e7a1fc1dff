"""Reports over metric tables: bands, alerts, top contributors, recounts, combined metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorewatch.functions.stability import band
from scorewatch.operators.aggregates import pivoted_by_rank
from scorewatch.operators.dedup import top_per_key
from scorewatch.operators.shares import segment_accounts
from scorewatch.plans.csi import csi_table, psi_table
from scorewatch.plans.gini import gini_by

SEGMENT = ["Segment_Column", "Segment_Value"]


def with_band(df: DataFrame, value: str, name: str, output: str) -> DataFrame:
    return df.withColumn(output, band(F.col(value), name))


def alerts(df: DataFrame, value: str = "PSI", limit: float = 0.1) -> DataFrame:
    """Rows at or above the limit."""
    return df.where(F.col(value) >= limit)


def top_bins(
    df: DataFrame, keys: Sequence[str], value: str = "bin_csi", whole: str = "feature_csi",
    ties: Sequence[str] = ("bin_value",), most: int = 3,
) -> DataFrame:
    """The bins with the largest absolute part per key, their share of the whole and rank."""
    order = [F.abs(F.col(value)).desc_nulls_last(), *[F.col(t) for t in ties]]
    best = top_per_key(df, keys, order, most)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    share = F.when(F.col(whole) != 0, F.col(value) / F.col(whole) * 100).otherwise(F.lit(0.0))
    return best.withColumns({"rank": rank, "pct_contribution": share})


def top_bins_wide(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The three ranked bins side by side."""
    return pivoted_by_rank(df, keys, "rank", ["bin_value", "bin_csi", "pct_contribution"])


def largest(df: DataFrame, value: str, most: int = 10, absolute: bool = False, ties: Sequence[str] = ()) -> DataFrame:
    """The `most` rows with the largest (absolute) value."""
    by = F.abs(F.col(value)) if absolute else F.col(value)
    return df.orderBy(by.desc_nulls_last(), *[F.col(t) for t in ties]).limit(most)


def psi_summaries(df: DataFrame, value: str = "psi", label: str = "psi_interpretation") -> DataFrame:
    """Mean index by feature, segment column and month, and share of each label, in one table."""
    pairs = F.array(
        *[
            F.struct(F.lit(kind).alias("summary"), F.col(c).cast("string").alias("value"))
            for kind, c in (
                ("feature", "Feature"), ("segment", "Segment_Column"), ("month", "current_month"), ("label", label)
            )
        ]
    )
    groups = (
        df.select(F.col(value).alias("__v"), F.inline(pairs))
        .groupBy("summary", "value")
        .agg(F.avg("__v").alias("mean_psi"), F.count(F.lit(1)).alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy("summary"))
    return groups.withColumn("pct", F.col("n") * F.lit(100.0) / total)


def relabelled(df: DataFrame, column: str, names: Mapping[str, str], **constants: str) -> DataFrame:
    """Replace labels and add constant descriptive columns."""
    replaced = df.replace(dict(names), subset=[column]) if names else df
    return replaced.withColumns({k: F.lit(v) for k, v in constants.items()})


def wide_scores(frames: Mapping[str, DataFrame], value: str = "psivalues") -> DataFrame:
    """Stack per-score results, each with its own value column."""
    result = None
    for name, frame in frames.items():
        renamed = frame.withColumnRenamed(value, f"{name}_{value}")
        result = renamed if result is None else result.unionByName(renamed, allowMissingColumns=True)
    return result


def recount(
    result: DataFrame, source: DataFrame, segments: Sequence[str], account: str, month: str,
    selection: str, train: str = "Train", keys: Sequence[str] = (),
) -> DataFrame:
    """Check the account counts of a feature PSI result against its source."""
    is_train = F.coalesce(F.col(selection) == train, F.lit(False))
    base = segment_accounts(source.where(is_train), segments, keys, account, "Actual_Train_Count")
    now = segment_accounts(source.where(~is_train), segments, [*keys, month], account, "Actual_Test_Count")
    now = now.withColumnRenamed(month, "Month")
    joined = result.join(base, [*SEGMENT, *keys], "left").join(now, [*SEGMENT, *keys, "Month"], "left")
    trained = F.coalesce("Actual_Train_Count", F.lit(0))
    tested = F.coalesce("Actual_Test_Count", F.lit(0))
    return joined.withColumns(
        {
            "Actual_Train_Count": trained,
            "Actual_Test_Count": tested,
            "Train_Match": F.col("Base_Count") == trained,
            "Test_Match": F.col("Actual_Count") == tested,
            "Train_Difference": F.col("Base_Count") - trained,
            "Test_Difference": F.col("Actual_Count") - tested,
        }
    )


def monitor(
    train: DataFrame, test: DataFrame, score: str, features: Sequence[str], target: str | None = None,
    bins: int | Mapping[str, int] = 10,
) -> dict[str, DataFrame]:
    """PSI table, CSI table and Gini of a train and a test frame."""
    per_score = bins if isinstance(bins, int) else bins.get(score, 10)
    result = {"psi": psi_table(train, test, score, per_score), "csi": csi_table(train, test, features, bins)}
    if target is not None and target in test.columns:
        result["gini"] = gini_by(test, [], score, target)
    return result
