"""Feature typing, bin specifications learnt from a baseline, and their application.

A specification is a small frame with one row per feature (and per `keys` value): the edges
of a numeric feature or the top categories of a categorical one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from scorewatch.functions import bins as B
from scorewatch.operators.aggregates import stacked
from scorewatch.operators.dedup import top_per_key
from scorewatch.operators.ordered import join_null_safe, quantiles, quantiles_of_counts, value_counts
from scorewatch.session import broadcast_checked, materialise

DECILES = [i / 10 for i in range(11)]
# Positions of the three-bin step of the ladder, as published.
THIRDS = [0.3333, 0.6667]


# --- feature typing -------------------------------------------------------------------

# Words in a feature name that decide its type under the `names` rule.
CATEGORY_WORDS = ("flag", "flg", "type", "category", "range")
NUMBER_WORDS = ("ratio", "amt", "cnt", "age", "limit", "max")


def feature_types(
    df: DataFrame,
    features: Sequence[str],
    rule: str = "few_integers",
    limit: int | None = None,
    named_categories: Sequence[str] = (),
) -> dict[str, str]:
    """'numerical' or 'categorical' per feature; absent columns are left out.

    few_integers: numeric with fewer than 15 distinct whole numbers is categorical
    at_most_integers: the same with at most 10
    at_most: at most 10 distinct values is categorical
    names: words in the name first, then at most 20 distinct values

    One pass sketches the distinct counts. A sketch never reports clearly more values than
    there are for counts this small, so only features near the limit are counted exactly.
    """
    limits = {"few_integers": 14, "at_most_integers": 10, "at_most": 10, "names": 20}
    if rule not in limits:
        raise ValueError(f"unknown typing rule {rule!r}")
    most = limits[rule] if limit is None else limit
    present = [f for f in features if f in df.columns]
    numeric = [f for f in present if isinstance(df.schema[f].dataType, NumericType)]
    types = {f: "categorical" for f in present}
    undecided = []
    for f in present:
        low = f.lower()
        if f in named_categories:
            continue
        if rule == "names" and any(w in low for w in CATEGORY_WORDS):
            continue
        if rule == "names" and any(w in low for w in NUMBER_WORDS):
            types[f] = "numerical"
        elif f in numeric:
            undecided.append(f)
    if not undecided:
        return types

    sketch = df.agg(
        *[F.approx_count_distinct(f, 0.02).alias(f"d{i}") for i, f in enumerate(undecided)],
        *[
            F.coalesce(F.bool_and(F.col(f).cast("double") == F.floor(F.col(f).cast("double"))), F.lit(True)).alias(f"w{i}")
            for i, f in enumerate(undecided)
        ],
    ).first()
    whole_needed = rule in ("few_integers", "at_most_integers")
    near = []
    for i, f in enumerate(undecided):
        if sketch[f"d{i}"] > 2 * most + 10 or (whole_needed and not sketch[f"w{i}"]):
            types[f] = "numerical"
        else:
            near.append(f)
    if near:
        exact = df.agg(*[F.countDistinct(f).alias(f"d{i}") for i, f in enumerate(near)]).first()
        for i, f in enumerate(near):
            types[f] = "categorical" if exact[f"d{i}"] <= most else "numerical"
    return types


# --- long form --------------------------------------------------------------------------


def long_features(
    df: DataFrame, types: dict[str, str], keep: Sequence[str]
) -> DataFrame:
    """One row per source row and feature with `number` or `category` filled."""
    entries = []
    for f, kind in types.items():
        column = F.col(f)
        number = F.when(~F.isnan(column.cast("double")), column.cast("double")) if kind == "numerical" else F.lit(None).cast("double")
        category = column.cast("string") if kind == "categorical" else F.lit(None).cast("string")
        entries.append(
            F.struct(
                F.lit(f).alias("Feature"),
                F.lit(kind).alias("Feature_Type"),
                number.alias("number"),
                category.alias("category"),
            )
        )
    return df.select(*keep, F.inline(F.array(*entries)))


# --- edges ------------------------------------------------------------------------------


def _distinct_sorted(edges: Column) -> Column:
    return F.array_sort(F.array_distinct(edges))


def _equal_width(low: Column, high: Column, parts: int) -> Column:
    step = (high - low) / F.lit(float(parts))
    inner = [low + F.lit(float(i)) * step for i in range(1, parts)]
    return F.array(low, *inner, high)


def _pick(q: Column, positions: Sequence[int]) -> Column:
    return F.array(*[F.get(q, F.lit(i)) for i in positions])


def edges_by_policy(q: Column, policy: str) -> Column:
    """Edges from quantiles at the deciles followed by the two thirds."""
    deciles = _distinct_sorted(_pick(q, range(11)))
    low, high = F.get(q, F.lit(0)), F.get(q, F.lit(10))
    if policy == "quantile":
        return deciles
    if policy == "ladder":
        fifths = _distinct_sorted(_pick(q, [0, 2, 4, 6, 8, 10]))
        thirds = _distinct_sorted(_pick(q, [0, 11, 12, 10]))
        around = F.array(low - F.lit(0.1), low, low + F.lit(0.1))
        edges = (
            F.when(F.size(deciles) >= 11, deciles)
            .when(F.size(fifths) >= 6, fifths)
            .when(F.size(thirds) >= 4, thirds)
            .when(low == high, around)
            .otherwise(_distinct_sorted(_equal_width(low, high, 5)))
        )
        return B.open_ended(edges)
    if policy == "deciles":
        around = F.array(low, low - F.lit(0.001), low, low + F.lit(0.001), low)
        return B.open_ended(F.when(F.size(deciles) >= 2, deciles).otherwise(around))
    raise ValueError(f"unknown edge policy {policy!r}")


def numeric_spec(
    long_train: DataFrame, keys: Sequence[str] = (), policy: str = "ladder", method: str = "exact",
    weight: str | None = None,
) -> DataFrame:
    """(keys, Feature, edges) from the baseline's long rows, or from counts of them in `weight`."""
    groups = [*keys, "Feature"]
    q = quantiles(
        long_train.where(F.col("Feature_Type") == "numerical"), groups, "number", DECILES + THIRDS, method, weight
    )
    return q.select(*groups, edges_by_policy(F.col("quantiles"), policy).alias("edges"))


def category_spec(
    long_train: DataFrame, keys: Sequence[str] = (), top: int = 6, weight: str | None = None
) -> DataFrame:
    """(keys, Feature, top) with the most frequent categories, ties by name."""
    groups = [*keys, "Feature"]
    counts = value_counts(
        long_train.where(F.col("Feature_Type") == "categorical"), groups, "category", weight
    )
    best = top_per_key(counts, groups, [F.col("n").desc(), F.col("category").asc()], top)
    return best.groupBy(*groups).agg(F.array_sort(F.collect_list("category")).alias("top"))


def _bin_spec(
    long_train: DataFrame, types: dict[str, str], keys: Sequence[str], policy: str, top: int, method: str, weight: str | None
) -> DataFrame:
    """(keys, Feature, edges, top): bins of each feature from the baseline rows of each key."""
    specs = []
    if "numerical" in types.values():
        specs.append(numeric_spec(long_train, keys, policy, method, weight))
    if "categorical" in types.values():
        specs.append(category_spec(long_train, keys, top, weight))
    spec = stacked(specs)
    for name, kind in (("edges", "array<double>"), ("top", "array<string>")):
        if name not in spec.columns:
            spec = spec.withColumn(name, F.lit(None).cast(kind))
    return spec


def _placed(long: DataFrame, spec: DataFrame, keys: Sequence[str], include_lowest: bool, others: str, mark: str) -> DataFrame:
    """Each row's bin number or category and its edges, as columns ending in `mark`."""
    if keys:
        joined = join_null_safe(long, broadcast_checked(spec), [*keys, "Feature"], "left")
    else:
        # Without keys the specification has one row per named feature.
        joined = long.join(F.broadcast(spec), "Feature", "left")
    numerical = F.col("Feature_Type") == "numerical"
    return joined.withColumns(
        {
            f"__position{mark}": F.when(
                numerical, B.numeric_position(F.col("number"), F.col("edges"), len(DECILES), include_lowest)
            ),
            f"__category{mark}": F.when(~numerical, B.category_label(F.col("category"), F.col("top"), others)),
        }
    ).withColumnRenamed("edges", f"__edges{mark}").drop("top")


def _labelled_bins(counts: DataFrame, by: Sequence[str], mark: str) -> DataFrame:
    position = F.col(f"__position{mark}")
    inside = position > 0
    return counts.select(
        *by,
        "Feature",
        "Feature_Type",
        F.coalesce(B.numeric_label(position), f"__category{mark}").alias("Bin"),
        F.when(inside, F.col(f"__low{mark}")).alias("Bin_Min"),
        F.when(inside, F.col(f"__high{mark}")).alias("Bin_Max"),
        "n",
    )


def feature_bin_counts(
    long: DataFrame,
    long_train: DataFrame,
    types: dict[str, str],
    by: Sequence[str],
    keys: Sequence[str] = (),
    policy: str = "ladder",
    top: int = 6,
    method: str = "exact",
    include_lowest: bool = True,
    others: str = B.OTHERS,
    weight: str | None = None,
    pooled: tuple[str, str] | None = None,
) -> DataFrame:
    """Rows `n` (or the sum of `weight`) per (by, Feature, Feature_Type, Bin) with Bin_Min and Bin_Max.

    Bins come from the baseline rows of each key. Rows are counted by bin number in the task
    that reads them; labels are made afterwards, on the counts. `pooled`: a key and a value of
    it that stands for all rows, with bins of its own. The baseline's values are counted per
    key once, bins of the whole come from the sums, and each row is counted by both bin numbers.
    """
    marks = [""]
    if pooled:
        column, whole = pooled
        rest = [k for k in keys if k != column]
        values = long_train.groupBy(*keys, "Feature", "Feature_Type", "number", "category").agg(
            (F.sum(weight) if weight else F.count(F.lit(1))).alias("__n")
        )
        values = materialise(values)
        own = _bin_spec(values, types, keys, policy, top, method, "__n")
        both = _bin_spec(values, types, rest, policy, top, method, "__n")
        placed = _placed(_placed(long, own, keys, include_lowest, others, ""), both, rest, include_lowest, others, "_whole")
        marks.append("_whole")
    else:
        spec = _bin_spec(long_train, types, keys, policy, top, method, weight)
        placed = _placed(long, spec, keys, include_lowest, others, "")
    bounds = []
    for mark in marks:
        position, edges = F.col(f"__position{mark}"), f"__edges{mark}"
        bounds += [
            F.first(F.get(edges, F.greatest(position - 1, F.lit(0)))).alias(f"__low{mark}"),
            F.first(F.get(edges, F.greatest(position, F.lit(0)))).alias(f"__high{mark}"),
        ]
    bins = [f"__{what}{mark}" for mark in marks for what in ("position", "category")]
    counts = placed.groupBy(*by, "Feature", "Feature_Type", *bins).agg(
        (F.sum(weight) if weight else F.count(F.lit(1))).alias("n"), *bounds
    )
    if not pooled:
        return _labelled_bins(counts, by, "")
    counts = materialise(counts)
    # Rows of the key's own value `whole` are among all rows already.
    separate = counts.where(~F.col(column).eqNullSafe(F.lit(whole)))
    together = counts.withColumn(column, F.lit(whole))
    what = [*by, "Feature", "Feature_Type", "Bin"]
    sides = _labelled_bins(separate, by, "").unionByName(_labelled_bins(together, by, "_whole"))
    return sides.groupBy(*what).agg(F.first("Bin_Min", True).alias("Bin_Min"), F.first("Bin_Max", True).alias("Bin_Max"), F.sum("n").alias("n"))


# --- single score edges -------------------------------------------------------------------


def left_closed_edges(
    train: DataFrame, value: str, bins: int = 10, keys: Sequence[str] = ()
) -> DataFrame:
    """Train quantiles; when some coincide, quantiles of the distinct values, else equal width."""
    steps = [i / bins for i in range(bins + 1)]
    counts = value_counts(train, keys, value)
    plain = quantiles_of_counts(counts, keys, value, steps).select(
        *keys, F.col("quantiles").alias("plain"), F.lit(None).cast("array<double>").alias("once"), F.lit(None).cast("long").alias("values")
    )
    single = counts.withColumn("n", F.lit(1).cast("long"))
    once = quantiles_of_counts(single, keys, value, steps).select(
        *keys, F.lit(None).cast("array<double>").alias("plain"), F.col("quantiles").alias("once"), F.col("rows").alias("values")
    )
    both = plain.unionByName(once).groupBy(*keys).agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("plain", "once", "values")]
    )
    distinct = _distinct_sorted(F.col("plain"))
    low, high = F.get("plain", F.lit(0)), F.get("plain", F.lit(bins))
    return both.select(
        *keys,
        F.when(F.size(distinct) == bins + 1, distinct)
        .when(F.col("values") >= bins + 1, F.col("once"))
        .otherwise(_equal_width(low, high, bins))
        .alias("edges"),
    )


def first_period_edges(
    df: DataFrame, model: str, value: str, period: str, bins: int = 10
) -> DataFrame:
    """Per model: quantiles of the first period, outer edges just beyond the full range.

    Models with fewer than two periods or three different edges are left out.
    """
    steps = [i / bins for i in range(bins + 1)]
    per_period = df.groupBy(model, period, value).agg(F.count(F.lit(1)).alias("n"))
    span = per_period.groupBy(model).agg(
        F.min(period).alias("baseline"),
        F.max(period).alias("__last"),
        F.min(value).alias("__low"),
        F.max(value).alias("__high"),
    )
    first = per_period.join(span.select(model, F.col("baseline").alias(period)), [model, period], "inner")
    q = quantiles_of_counts(first, [model], value, steps)
    edges = _distinct_sorted(F.col("quantiles"))
    middle = F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))
    return (
        q.where(F.size(edges) >= 3)
        .join(span.where(F.col("baseline") < F.col("__last")), model, "inner")
        .select(
            model,
            "baseline",
            F.concat(
                F.array(F.col("__low") - F.lit(0.0001)), middle, F.array(F.col("__high") + F.lit(0.0001))
            ).alias("edges"),
        )
    )


def whole_frame_bins(df: DataFrame, value: str, output: str, bins: int = 10) -> DataFrame:
    """Quantile bins over the whole frame: `0`, `1`, ... , `Missing`, or `All` for one value."""
    edges = quantiles(df, [], value, [i / bins for i in range(bins + 1)]).select(
        _distinct_sorted(F.col("quantiles"))
    )
    joined = df.withColumn("__edges", edges.scalar())
    label = (
        F.when(F.col(value).isNull(), F.lit(B.MISSING))
        .when(F.size("__edges") < 2, F.lit("All"))
        .otherwise((B.right_closed(F.col(value), F.col("__edges"), bins + 1) - 1).cast("string"))
    )
    return joined.withColumn(output, label).drop("__edges")


def whole_frame_categories(df: DataFrame, value: str, output: str, top: int = 6) -> DataFrame:
    """The frame's top categories, the rest as `Others`, null as `Missing`."""
    best = (
        value_counts(df, [], value)
        .orderBy(F.col("n").desc(), F.col(value).asc())
        .limit(top)
        .agg(F.collect_list(F.col(value).cast("string")))
    )
    return df.withColumn(output, B.category_label(F.col(value).cast("string"), best.scalar()))


def bin_audit(train: DataFrame, value: str) -> DataFrame:
    """Bounds, count, share, min, max and mean of each left-closed decile bin of the baseline."""
    clean = train.where(F.col(value).isNotNull())
    counts = value_counts(clean, [], value)
    q = quantiles_of_counts(counts, [], value, DECILES)
    spec = q.select(F.struct(B.open_ended(_distinct_sorted(F.col("quantiles"))).alias("edges"), "rows"))
    placed = counts.withColumn("__spec", spec.scalar()).select("*", "__spec.edges", "__spec.rows")
    position = B.left_closed(F.col(value), F.col("edges"), len(DECILES))
    return (
        placed.withColumn("bin", position)
        .groupBy("bin", F.get("edges", position - 1).alias("lower_bound"), F.get("edges", position).alias("upper_bound"))
        .agg(
            F.sum("n").alias("count"),
            F.try_divide(F.sum("n") * F.lit(100.0), F.max("rows")).alias("percentage"),
            F.min(value).alias("min_in_bin"),
            F.max(value).alias("max_in_bin"),
            F.try_divide(F.sum(F.col(value) * F.col("n")), F.sum("n")).alias("mean_in_bin"),
        )
    )
