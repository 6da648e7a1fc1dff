"""Running totals and exact quantiles that never put a large group into one task.

Both start from one row per (keys, value). The rows are range-partitioned on (keys, value),
which splits even a group that holds most of the data; each range is summed on its own and
the totals of the earlier ranges of the same group are added. Ranges begin as many as the
session has shuffle partitions and are merged by size, so small frames have one or a few.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorewatch.session import materialise

RANGE = "__range"


def join_null_safe(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left"
) -> DataFrame:
    """Join on `keys` where null matches null; key columns come from the left side."""
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    condition = [F.col(f"__l.{k}").eqNullSafe(F.col(f"__r.__r_{k}")) for k in keys]
    joined = left.alias("__l").join(renamed.alias("__r"), condition, how)
    return joined.drop(*[f"__r_{k}" for k in keys])


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    descending: bool = False,
    totals: bool = True,
) -> DataFrame:
    """Add `cum_<c>` (inclusive, in `order` within `keys`) and `all_<c>` for each column.

    Rows with equal `order` within a group must be interchangeable.
    """
    keys, order, columns = list(keys), list(order), list(columns)
    direction = [F.col(c).desc() if descending else F.col(c).asc() for c in order]

    ranged = materialise(
        df.repartitionByRange(*[F.col(k) for k in keys], *direction).withColumn(RANGE, F.spark_partition_id())
    )
    # One row per group and range it touches: at most as many rows as ranges for any one group.
    group = Window.partitionBy(*keys)
    before = group.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*keys, RANGE)
        .agg(*[F.sum(c).alias(f"__s_{c}") for c in columns])
        .select(
            *keys,
            RANGE,
            *[F.coalesce(F.sum(f"__s_{c}").over(before), F.lit(0)).alias(f"__b_{c}") for c in columns],
            *[F.sum(f"__s_{c}").over(group).alias(f"all_{c}") for c in columns],
        )
    )
    local = (
        Window.partitionBy(*keys, RANGE)
        .orderBy(*direction)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    summed = ranged.withColumns({f"cum_{c}": F.sum(c).over(local) for c in columns})
    joined = join_null_safe(summed, offsets, [*keys, RANGE], "inner")
    result = joined.withColumns({f"cum_{c}": F.col(f"cum_{c}") + F.col(f"__b_{c}") for c in columns})
    unwanted = [RANGE, *[f"__b_{c}" for c in columns]]
    if not totals:
        unwanted += [f"all_{c}" for c in columns]
    return result.drop(*unwanted)


def numbered(df: DataFrame, order: Sequence[str], name: str, start: int = 1) -> DataFrame:
    """Consecutive numbers over the whole frame in `order`."""
    ones = running_totals(df.withColumn("__one", F.lit(1).cast("long")), [], order, ["__one"], totals=False)
    return ones.withColumn(name, F.col("cum___one") + F.lit(start - 1).cast("long")).drop("__one", "cum___one")


def value_counts(
    df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None
) -> DataFrame:
    """One row per (keys, value) with the number of rows in `n`; nulls left out."""
    count = F.sum(weight) if weight else F.count(F.lit(1))
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(count.alias("n"))


def quantiles_of_counts(
    counts: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float], weight: str = "n"
) -> DataFrame:
    """Linearly interpolated quantiles from one row per (keys, value) with its weight.

    Returns one row per group: keys, `rows` (sum of weights) and `quantiles` (array).
    """
    ranked = running_totals(counts, keys, [value], [weight]).withColumns(
        {
            "__value": F.col(value),
            "__upto": F.col(f"cum_{weight}"),
            "__before": F.col(f"cum_{weight}") - F.col(weight),
            "__last": F.col(f"all_{weight}") - 1,
        }
    )
    # The two order statistics around each position; SQL text keeps the plan quick to build.
    picks = []
    for i, p in enumerate(probabilities):
        for side, rank in (("lo", f"floor({float(p)}D * __last)"), ("hi", f"ceil({float(p)}D * __last)")):
            picks.append(F.expr(f"max(CASE WHEN __before <= {rank} AND {rank} < __upto THEN __value END) AS {side}{i}"))
    points = [
        f"lo{i} + (hi{i} - lo{i}) * ({float(p)}D * (rows - 1) - floor({float(p)}D * (rows - 1)))"
        for i, p in enumerate(probabilities)
    ]
    return (
        ranked.groupBy(*keys)
        .agg((F.max("__last") + 1).alias("rows"), *picks)
        .select(*keys, "rows", F.expr(f"array({', '.join(points)}) AS quantiles"))
    )


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    method: str = "exact",
    weight: str | None = None,
) -> DataFrame:
    """Quantiles of `value` per group; `approx` trades exactness for a mergeable sketch."""
    if method == "approx":
        return (
            df.where(F.col(value).isNotNull())
            .groupBy(*keys)
            .agg(
                F.count(F.lit(1)).alias("rows"),
                F.percentile_approx(value, [float(p) for p in probabilities], 100_000).alias("quantiles"),
            )
        )
    if method != "exact":
        raise ValueError(f"unknown quantile method {method!r}")
    return quantiles_of_counts(value_counts(df, keys, value, weight), keys, value, probabilities)
