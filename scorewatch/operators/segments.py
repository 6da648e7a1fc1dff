"""Segment families: one column at a time, prefixes, and all combinations.

All of them take an already aggregated frame, so that the copies made per segment are
copies of counts and not of source rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewatch.functions.rules import filled
from scorewatch.functions.text import product_of

OVERALL = ("Overall", "All")


def one_at_a_time(
    df: DataFrame, segments: Sequence[str], overall: tuple[str, str] | None = OVERALL
) -> DataFrame:
    """Copies of each row labelled Segment_Column / Segment_Value: overall, then each column.

    Rows with a null in a segment column take no part in that column's segments.
    """
    pairs = []
    if overall:
        pairs.append(F.struct(F.lit(overall[0]).alias("c"), F.lit(overall[1]).alias("v")))
    for name in segments:
        pairs.append(F.struct(F.lit(name).alias("c"), F.col(name).cast("string").alias("v")))
    rest = [c for c in df.columns if c not in segments]
    return (
        df.select(*rest, F.explode(F.array(*pairs)).alias("__seg"))
        .where(F.col("__seg.v").isNotNull())
        .select(
            F.col("__seg.c").alias("Segment_Column"), F.col("__seg.v").alias("Segment_Value"), *rest
        )
    )


def grouped_by_sets(
    df: DataFrame,
    sets: Sequence[Sequence[str]],
    dims: Sequence[str],
    keys: Sequence[str],
    aggregates: Sequence[Column],
) -> DataFrame:
    """GROUPING SETS over `dims` with `keys` always grouped.

    Adds `set_id` (bits of the inactive dims) and drops groups in which an active dim is null.
    """
    dims, keys = list(dims), list(keys)
    grouped = df.groupingSets(
        [[F.col(c) for c in (*chosen, *keys)] for chosen in sets], *[F.col(c) for c in (*dims, *keys)]
    ).agg(*aggregates, *[F.grouping(c).cast("int").alias(f"__g_{c}") for c in dims])
    keep, set_id = F.lit(True), F.lit(0)
    for i, c in enumerate(dims):
        keep = keep & ((F.col(f"__g_{c}") == 1) | F.col(c).isNotNull())
        set_id = set_id + F.col(f"__g_{c}") * F.lit(1 << (len(dims) - 1 - i))
    return grouped.where(keep).withColumn("set_id", set_id).drop(*[f"__g_{c}" for c in dims])


def copied_to_sets(df: DataFrame, sets: Sequence[Sequence[str]], dims: Sequence[str]) -> DataFrame:
    """A copy of each row per set with the inactive dims null, not aggregated, with `set_id`.

    For rows that hardly ever fall together, where aggregating the copies would not shrink
    them. Rows with a null in an active dim are left out of that set.
    """
    dims = list(dims)
    rest = [c for c in df.columns if c not in dims]
    copies = []
    for chosen in sets:
        set_id = sum(1 << (len(dims) - 1 - i) for i, c in enumerate(dims) if c not in chosen)
        known = F.lit(True)
        for c in chosen:
            known = known & F.col(c).isNotNull()
        shown = [(F.col(c) if c in chosen else F.lit(None).cast(df.schema[c].dataType)).alias(c) for c in dims]
        copies.append(F.when(known, F.struct(F.lit(set_id).alias("set_id"), *shown)))
    return df.select(*rest, F.explode(F.array_compact(F.array(*copies))).alias("__set")).select("__set.*", *rest)


def prefixes(segments: Sequence[str]) -> list[list[str]]:
    """[c1], [c1, c2], ... without the grand total."""
    return [list(segments[: i + 1]) for i in range(len(segments))]


def all_combinations(segments: Sequence[str], max_depth: int | None = None) -> list[list[str]]:
    """Every subset up to `max_depth` columns, the empty one included."""
    depth = len(segments) if max_depth is None else min(max_depth, len(segments))
    return [list(c) for r in range(depth + 1) for c in combinations(segments, r)]


def subset_labels(df: DataFrame, key: str, member: str) -> DataFrame:
    """Every non-empty subset of the members found under each key, one row per (subset, member).

    The number of subsets doubles with each member, which is what is asked for; they are made
    by adding one member after the other, each row on its own.
    """
    found = df.where(F.col(member).isNotNull()).select(key, F.col(member).cast("string").alias("__m")).distinct()
    ranked = found.groupBy(key).agg(F.array_sort(F.collect_set("__m")).alias("__all"))
    most = ranked.agg(F.max(F.size("__all"))).first()[0] or 0
    grown = ranked.withColumn("__set", F.array().cast("array<string>"))
    for i in range(most):
        own = F.get("__all", F.lit(i))
        without = F.array(F.col("__set"))
        both = F.array(F.col("__set"), F.concat("__set", F.array(own)))
        grown = grown.select(key, "__all", F.explode(F.when(own.isNull(), without).otherwise(both)).alias("__set"))
    return grown.where(F.size("__set") > 0).select(
        key, F.array_join("__set", ",").alias(f"{member}_set"), F.explode("__set").alias(member)
    )


def version_trench_config(
    df: DataFrame, name: str = "modelDisplayName", version: str = "modelVersionId", trench: str = "trenchCategory"
) -> DataFrame:
    """Distinct (model, version, trench) combinations plus an 'ALL' trench for each."""
    known = df.select(name, version, trench).distinct()
    own = known.withColumn(trench, filled(F.col(trench), "ALL"))
    every = known.where(F.col(trench).isNotNull()).withColumn(trench, F.lit("ALL"))
    return (
        own.unionByName(every).distinct().withColumn("product_category", product_of(F.col(name)))
    )


# Columns of each hierarchical level, as positions in (model, version, trench, loan, product).
LEVELS = {
    "Trench_Level": (0, 1, 2),
    "Model_Level": (0, 1),
    "Loan_Type_Level": (0, 1, 2, 3),
    "Product_Type_Level": (0, 1, 2, 4),
    "Full_Level": (0, 1, 2, 3, 4),
}


def hierarchical_copies(
    df: DataFrame, dims: Sequence[str], known_trenches: Sequence[str] | None = ("Trench 1", "Trench 2", "Trench 3")
) -> DataFrame:
    """A copy of each row per trench, model, loan type, product type and full level segment.

    `dims` are model, version, trench, loan type and product; inactive ones read 'All'. The
    model level counts only `known_trenches`. Rows with a null in an active column drop out.
    """
    rest = [c for c in df.columns if c not in dims]
    copies = []
    for name, active in LEVELS.items():
        known = F.lit(True)
        for i in active:
            known = known & F.col(dims[i]).isNotNull()
        if name == "Model_Level" and known_trenches is not None:
            known = known & F.col(dims[2]).isin(*known_trenches)
        shown = [
            (F.col(c).cast("string") if i in active else F.lit("All")).alias(c) for i, c in enumerate(dims)
        ]
        copies.append(F.when(known, F.struct(F.lit(name).alias("segment_type"), *shown)))
    return df.select(*rest, F.explode(F.array_compact(F.array(*copies))).alias("__level")).select("__level.*", *rest)
