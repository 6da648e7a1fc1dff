"""Joins of the population builder. Broadcasts are left to Spark, which checks sizes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewatch.operators.dedup import earliest_per_key, latest_per_key
from scorewatch.operators.ordered import join_null_safe


def _tasks(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def heavy_keys(rows: DataFrame, keys: Sequence[str]) -> Column:
    """Map from the hash of each key with more than a task's share of `rows` to the tasks it fills.

    Counted by a mergeable heavy-hitter sketch as a scalar subquery, so nothing runs before the
    query itself. With n rows and t shuffle tasks at most t keys have more than n / t rows.
    """
    tasks = _tasks(rows)
    tracked = min(1_000_000, max(10_000, 10 * tasks))
    found = rows.select(F.xxhash64(*keys).alias("__hash")).agg(
        F.expr(f"approx_top_k(__hash, {min(tasks, tracked)}, {tracked})").alias("__top"), F.count(F.lit(1)).alias("__n")
    )
    fills = lambda item: F.ceil(item["count"] * F.lit(tasks) / F.col("__n")).cast("int")
    heavy = F.filter("__top", lambda item: item["count"] * F.lit(tasks) > F.col("__n"))
    entries = F.transform(heavy, lambda item: F.struct(item["item"], F.least(fills(item), F.lit(tasks))))
    return found.select(F.map_from_entries(entries)).scalar()


def with_lookup(df: DataFrame, lookup: DataFrame, keys: Sequence[str], spread_like: DataFrame | None = None) -> DataFrame:
    """Left join to a lookup of any size with one row per key, null matching null.

    Only keys that would fill more than one task are dealt: their rows draw a number from
    their own columns, and the lookup's one row is copied to as many numbers as the key fills
    tasks. `spread_like`: a frame whose keys are spread alike, where counting them in `df`
    would compute many joins once more.
    """
    keys = list(keys)
    tasks = F.coalesce(heavy_keys(df if spread_like is None else spread_like, keys)[F.xxhash64(*keys)], F.lit(1))
    own = [c for c, kind in df.dtypes if not kind.startswith(("map", "variant"))]
    salt = F.when(F.col("__tasks") > 1, F.pmod(F.xxhash64(*own), F.col("__tasks")).cast("int")).otherwise(F.lit(0))
    salted = df.withColumn("__tasks", tasks).withColumn("__salt", salt).drop("__tasks")
    copies = lookup.withColumn("__salt", F.explode(F.sequence(F.lit(0), tasks - 1)))
    return join_null_safe(salted, copies, [*keys, "__salt"], "left").drop("__salt")


def with_latest(
    df: DataFrame,
    dimension: DataFrame,
    left_key: str,
    right_key: str,
    by: str,
    columns: Sequence[str],
    ties: Sequence[str] = (),
    spread_like: DataFrame | None = None,
) -> DataFrame:
    """Left join to the latest dimension row per key; popular and null keys are dealt.

    `spread_like` holds `left_key` too, spread as in `df` (see `with_lookup`).
    """
    latest = latest_per_key(dimension.where(F.col(right_key).isNotNull()), [right_key], by, ties)
    lookup = latest.select(F.col(right_key).alias("__key"), *columns)
    like = None if spread_like is None else spread_like.select(F.col(left_key).alias("__key"))
    return with_lookup(df.withColumn("__key", F.col(left_key)), lookup, ["__key"], like).drop("__key")


def with_train_precedence(train: DataFrame, test: DataFrame, account: str) -> DataFrame:
    """Train rows plus the test rows whose account is not in train."""
    known = train.select(account).distinct()
    return train.unionByName(test.join(known, account, "left_anti"), allowMissingColumns=True)


def nearest_in_time(
    anchors: DataFrame,
    snapshots: DataFrame,
    key: str,
    anchor_date: str,
    snapshot_date: str,
    within_days: int = 2,
    ties: Sequence[str] = (),
) -> DataFrame:
    """The snapshot closest to each anchor, fewer than `within_days` days away.

    `anchors` has one row per key. Each anchor is stated for every date that is near enough, so
    the join is on key and date and meets only snapshots that count.
    """
    reach = within_days - 1
    if reach < 0:
        return anchors.join(snapshots, key).withColumn("day_gap", F.lit(0)).where("false")
    day = F.to_date(F.col(anchor_date))
    near = anchors.withColumn("__on", F.explode(F.sequence(F.date_sub(day, reach), F.date_add(day, reach))))
    dated = snapshots.withColumn("__on", F.to_date(F.col(snapshot_date)))
    close = near.join(dated, [key, "__on"], "inner").withColumn("day_gap", F.abs(F.datediff(F.col("__on"), day))).drop("__on")
    return earliest_per_key(close, [key], "day_gap", [snapshot_date, *ties])


def worst_snapshot_after(
    loans: DataFrame,
    snapshots: DataFrame,
    key: str,
    due_date: str,
    snapshot_key: str,
    snapshot_date: str,
    amount: str,
    days: Sequence[int] = (10, 11),
) -> DataFrame:
    """Largest amount among the snapshots dated `days` after the due date, per loan."""
    dated = loans.select(
        key, due_date, F.explode(F.array(*[F.date_add(F.col(due_date), d) for d in days])).alias("__on")
    )
    seen = snapshots.groupBy(
        F.col(snapshot_key).alias(key), F.to_date(snapshot_date).alias("__on")
    ).agg(F.max(amount).alias("__amount"))
    return (
        dated.join(seen, [key, "__on"], "inner")
        .groupBy(key, due_date)
        .agg(F.max("__amount").alias(f"worst_{amount}"))
    )


def with_membership_flags(
    df: DataFrame, others: DataFrame, key: str, flags: Mapping[str, Column]
) -> DataFrame:
    """0/1 columns telling whether `others` holds a row of the same key passing each test."""
    tests = {n: F.max(F.when(test, 1).otherwise(0)).alias(n) for n, test in flags.items()}
    found = others.where(F.col(key).isNotNull()).groupBy(key).agg(*tests.values())
    return with_lookup(df, found, [key]).withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in flags})


def with_first_value(df: DataFrame, others: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Smallest `value` among the rows of the same key in `others`."""
    least = others.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias(name))
    return with_lookup(df, least, [key])


def with_absence_flag(df: DataFrame, others: DataFrame, key: str, name: str) -> DataFrame:
    """1 where `others` has no row of the key, else 0; a null key has none."""
    known = others.where(F.col(key).isNotNull()).select(key).distinct().withColumn(name, F.lit(0))
    return with_lookup(df, known, [key]).withColumn(name, F.coalesce(F.col(name), F.lit(1)))


def with_stage_flags(
    df: DataFrame, stages: Mapping[str, tuple[DataFrame, str]], key: str
) -> DataFrame:
    """Funnel flags: 1 where the stage's table has a row of the key; all stages in one join."""
    marks = [
        stage.where(F.col(stage_key).isNotNull()).select(F.col(stage_key).alias(key), *[F.lit(int(n == name)).alias(n) for n in stages])
        for name, (stage, stage_key) in stages.items()
    ]
    reached = reduce(DataFrame.unionByName, marks).groupBy(key).agg(*[F.max(n).alias(n) for n in stages])
    return with_lookup(df, reached, [key]).withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in stages})


def recoded(
    df: DataFrame, column: str, names: Mapping[str, str | None], output: str, keep_unmatched: bool = True
) -> DataFrame:
    """Replace labels by a mapping table; unmatched ones stay or become null."""
    spark = df.sparkSession
    table = spark.createDataFrame(
        list(names.items()), "__old string, __new string"
    ).withColumn("__hit", F.lit(True))
    # The table has one row per entry of `names`.
    joined = df.join(F.broadcast(table), df[column] == F.col("__old"), "left")
    unmatched = F.col(column) if keep_unmatched else F.lit(None).cast("string")
    return joined.withColumn(
        output, F.when(F.col("__hit"), F.col("__new")).otherwise(unmatched)
    ).drop("__old", "__new", "__hit")


def with_surrogate(fact: DataFrame, dimension: DataFrame, keys: Sequence[str], surrogate: str) -> DataFrame:
    """Attach the dimension's surrogate key; null keys match null keys."""
    return join_null_safe(fact, dimension.select(*keys, surrogate), keys, "left")


def outer_on(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer join of several frames on the same keys.

    Each frame has one row per key, so one grouping pass replaces a chain of joins.
    """
    values = [[c for c in f.columns if c not in keys] for f in frames]
    combined = frames[0]
    for frame in frames[1:]:
        combined = combined.unionByName(frame, allowMissingColumns=True)
    names = [c for group in values for c in group]
    return combined.groupBy(*keys).agg(*[F.first(c, ignorenulls=True).alias(c) for c in names])
