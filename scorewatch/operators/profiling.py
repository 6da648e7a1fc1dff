"""Data quality report and reproducible quota samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from scorewatch.operators.aggregates import unbiased_kurtosis, unbiased_skewness
from scorewatch.operators.dedup import top_per_key
from scorewatch.operators.ordered import numbered, quantiles_of_counts


def data_quality(df: DataFrame, target: str | None = None) -> DataFrame:
    """One row per column: type, missing, distinct, mode and, for numbers, the distribution.

    Distinct counts, modes and quantiles all come from one count per (column, value);
    moments and correlations from one pass over the rows.
    """
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    names = df.columns
    correlated = [c for c in numeric if target in numeric and c != target]

    def number(c: str):
        return F.col(c).cast("double")

    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                (number(c) if c in numeric else F.lit(None).cast("double")).alias("number"),
                F.col(c).cast("string").alias("text"),
            )
            for c in names
        ]
    )
    counts = df.select(F.inline(cells)).groupBy("column", "number", "text").agg(F.count(F.lit(1)).alias("n"))
    known = counts.where(F.col("text").isNotNull())
    per_column = counts.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("text").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
        F.count("text").alias("unique_values"),
    )
    modes = top_per_key(
        known, ["column"], [F.col("n").desc(), F.col("number").asc_nulls_last(), F.col("text").asc()], 1
    ).select("column", F.col("text").alias("mode"), F.col("n").alias("__mode_n"))
    values = known.where(F.col("number").isNotNull()).groupBy("column", "number").agg(F.sum("n").alias("n"))
    q = quantiles_of_counts(values, ["column"], "number", [0.25, 0.5, 0.75]).select(
        "column",
        F.get("quantiles", F.lit(0)).alias("q25"),
        F.get("quantiles", F.lit(1)).alias("median"),
        F.get("quantiles", F.lit(2)).alias("q75"),
    )
    measures = {
        "min": lambda c: F.min(number(c)),
        "max": lambda c: F.max(number(c)),
        "mean": lambda c: F.avg(number(c)),
        "std": lambda c: F.stddev(number(c)),
        "skewness": lambda c: unbiased_skewness(c),
        "kurtosis": lambda c: unbiased_kurtosis(c),
        "correlation": lambda c: F.corr(number(c), number(target)) if c in correlated else F.lit(None).cast("double"),
    }
    result = per_column.join(modes, "column", "left").join(q, "column", "left")
    if numeric:
        wide = df.agg(*[m(c).alias(f"m{i}_{k}") for i, c in enumerate(numeric) for k, m in measures.items()])
        moments = wide.select(
            F.inline(
                F.array(
                    *[
                        F.struct(F.lit(c).alias("column"), *[F.col(f"m{i}_{k}").cast("double").alias(k) for k in measures])
                        for i, c in enumerate(numeric)
                    ]
                )
            )
        )
        result = result.join(moments, "column", "left")
    else:
        result = result.withColumns({k: F.lit(None).cast("double") for k in measures})
    types = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())])
    rows = F.col("rows").cast("double")
    return result.select(
        "column",
        F.element_at(types, F.col("column")).alias("data_type"),
        "missing",
        (F.col("missing") / rows * 100).alias("missing_pct"),
        ((rows - F.col("missing")) / rows * 100).alias("non_missing_pct"),
        "unique_values",
        "min", "max", "mean", "median", "mode",
        (F.col("__mode_n") / rows * 100).alias("mode_pct"),
        "std", "q25", F.col("median").alias("q50"), "q75",
        (F.col("q75") - F.col("q25")).alias("iqr"),
        "skewness", "kurtosis",
        F.try_divide(F.col("std"), F.col("mean")).alias("__cv"),
        "correlation",
    ).withColumn("cv_pct", F.col("__cv") * 100).drop("__cv")


def quota_sample(
    df: DataFrame, segment: str, keep_all: Sequence[str], fill_from: str, size: int, identifier: str, seed: int = 42
) -> DataFrame:
    """All rows of some segments, filled up to `size` from another one.

    Rows of the filling segment are drawn by the hash of seed and id, so a repeated run
    draws the same rows.
    """
    kept = df.where(F.col(segment).isin(*keep_all))
    ticket = F.md5(F.concat(F.lit(f"{seed}-"), F.col(identifier).cast("string")))
    pool = df.where(F.col(segment) == fill_from).withColumn("__ticket", ticket)
    # At most `size` rows can be drawn, so each task keeps its first ones and no more are ranked.
    first = pool.orderBy("__ticket", identifier).limit(size)
    ranked = numbered(first, ["__ticket", identifier], "__rank")
    room = F.lit(size) - kept.agg(F.count(F.lit(1))).scalar()
    drawn = ranked.where(F.col("__rank") <= room).drop("__ticket", "__rank")
    return kept.unionByName(drawn)


def id_check(df: DataFrame, identifier: str, length: int = 25) -> DataFrame:
    """Nulls, lengths and uniqueness of an id and of its last characters."""
    text = F.col(identifier).cast("string")
    suffix = F.right(text, F.lit(length))
    return df.agg(
        F.count(F.when(text.isNull(), 1)).alias("nulls"),
        F.countDistinct(text).alias("unique_ids"),
        F.countDistinct(suffix).alias("unique_suffixes"),
        F.count(F.when(F.length(text) < length, 1)).alias("shorter_ids"),
        F.max(F.length(suffix)).alias("longest_suffix"),
    )
