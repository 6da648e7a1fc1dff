"""Rank sums and distinct accounts of many groupings, from one pass over the rows.

What a rank statistic needs of a group within a range of scores are a few numbers: goods, bads,
and the area between them (bads times the goods below, ties half). Ranges combine in order:
the areas add up, plus the bads of the later times the goods of the earlier one. So the rows
are range-partitioned by the score alone, each range is reduced for all groupings at once,
and only the few numbers per group and range travel on. No row is copied per grouping. A range
comes sorted and is streamed in pieces of a fixed size, whose numbers combine in the same way,
so what a task holds does not grow with the range.

Deciles need a row's place in its group: the rows of its range before it, and the sizes of the
group in earlier ranges. The sizes are counted first; then each range meets its few offsets
and is reduced to one row per group and decile.

Distinct accounts work alike: an account's rows share a partition, so the counts of the
partitions add up exactly.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scorewatch.session import materialise

# What runs in Python workers travels by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECE = 1 << 18  # rows of a partition that a task holds at once
GROUPS = 500_000  # groups whose sums a task holds
OUT = 50_000  # rows of a result batch
RANGE_BITS = 19  # a range of deciles has at most so many bits of rows


@dataclass(frozen=True)
class Grouping:
    """Columns that make up the groups; rows with a null in one take no part, nor those not `where`."""

    columns: tuple[str, ...]
    where: str | None = None  # a boolean column


def _codes(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the values, -1 for null, and the values."""
    numbers, values = pd.factorize(column, use_na_sentinel=True)
    return numbers.astype(np.int64), values


def _numbered(codes: Sequence[np.ndarray], rows: int) -> np.ndarray:
    """One number per different row of codes, column by column so that the numbers stay small."""
    group = np.zeros(rows, dtype=np.int64)
    for column in codes:
        group = group * (int(column.max(initial=0)) + 1) + column
        group = np.unique(group, return_inverse=True)[1]
    return group


def _pieces(batches: Iterator[pa.RecordBatch], whole: str | None) -> Iterator[pa.Table]:
    """Pieces of PIECE rows or little more; neighbours with equal `whole` share a piece."""
    held, rows, least = [], 0, PIECE
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        piece = pa.Table.from_batches(held).combine_chunks()
        if whole is None:
            yield piece
            held, rows = [], 0
            continue
        values = _encoded(piece.column(whole))[0]
        other = np.flatnonzero(values != values[-1])
        if not len(other):
            least = 2 * rows  # one value so far
            continue
        cut = int(other[-1]) + 1
        yield piece.slice(0, cut)
        # The rest is copied, so that the piece can be freed.
        held = piece.slice(cut).take(pa.array(np.arange(rows - cut))).to_batches()
        rows, least = rows - cut, PIECE
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _encoded(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Numbers of the values, -1 for null, and the values."""
    made = column.combine_chunks().dictionary_encode()
    return made.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), made.dictionary


def _reduced(group: np.ndarray, score: np.ndarray, bad: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, ...]:
    """First row and sums of each group, for rows in order of (group, score)."""
    start = np.concatenate([[True], (group[1:] != group[:-1]) | (score[1:] != score[:-1])])
    at = np.flatnonzero(start)  # of each distinct score of a group
    bads, goods, group = np.add.reduceat(bad, at), np.add.reduceat(good, at), group[at]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(first, len(group)))
    below = [np.cumsum(x) - x for x in (bads, goods)]
    bads_below, goods_below = (b - np.repeat(b[first], size) for b in below)
    rows = (bads + goods).astype(float)
    area = np.add.reduceat(bads * (goods_below + goods / 2.0), first)
    cumulated = np.add.reduceat(rows * bads_below + bads * (rows + 1.0) / 2.0, first)
    low, high = score[at[first]], score[at[first + size - 1]]
    return at[first], np.add.reduceat(bads, first), np.add.reduceat(goods, first), area, cumulated, low, high


def _taking_part(rows: pd.DataFrame, groupings: Sequence[Grouping]) -> Iterator[tuple[int, Grouping, np.ndarray, np.ndarray]]:
    """Per grouping that has any: its number, the numbers of the rows that take part, and of their groups."""
    codes = {c: _codes(rows[c]) for c in dict.fromkeys(c for g in groupings for c in g.columns)}
    for number, grouping in enumerate(groupings):
        keep = rows[grouping.where].fillna(False).to_numpy(bool) if grouping.where else np.ones(len(rows), dtype=bool)
        for c in grouping.columns:
            keep &= codes[c][0] >= 0
        taken = np.flatnonzero(keep)
        if not len(taken):
            continue
        # Number the groups column by column, so that the numbers stay small.
        group = np.zeros(len(taken), dtype=np.int64)
        for c in grouping.columns:
            group = group * max(1, len(codes[c][1])) + codes[c][0][taken]
            group = np.unique(group, return_inverse=True)[1]
        yield number, grouping, taken, group


def _shown(rows: pd.DataFrame, at: np.ndarray, grouping: Grouping, used: Sequence[str]) -> pd.DataFrame:
    """The group columns of the rows `at`; null where the grouping does not use them."""
    own = rows.iloc[at]
    return pd.DataFrame({c: own[c].to_numpy() if c in grouping.columns else np.full(len(at), None, dtype=object) for c in used})


class _Sums:
    """Sums per group of one grouping, over the pieces of a partition so far.

    Groups are rows of `codes`; `values` are the sums, one array each.
    """

    def __init__(self, merge) -> None:
        self.codes: np.ndarray | None = None
        self.values: list[np.ndarray] = []
        self.merge = merge

    def __len__(self) -> int:
        return 0 if self.codes is None else len(self.codes)

    def add(self, codes: np.ndarray, values: Sequence[np.ndarray]) -> None:
        if self.codes is None:
            self.codes, self.values = codes, list(values)
            return
        codes = np.concatenate([self.codes, codes])
        values = [np.concatenate(pair) for pair in zip(self.values, values)]
        group = _numbered(codes.T, len(codes))
        # The earlier of the at most two rows of a group comes first.
        order = np.argsort(group, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(group[order]) != 0]))
        twice = np.diff(np.append(first, len(order))) > 1
        earlier, later = order[first], order[first[twice] + 1]
        merged = [v[earlier] for v in values]
        both = self.merge([v[earlier[twice]] for v in values], [v[later] for v in values])
        for column, sums in zip(merged, both):
            column[twice] = sums
        self.codes, self.values = codes[earlier], merged


def _by_grouping(df: DataFrame, groupings: Sequence[Grouping], needed: Sequence[str], sums: str, whole: str | None, reduce, merge) -> DataFrame:
    """Sums per grouping and group of each partition of `df`, whose rows are streamed in pieces.

    Rows with equal `whole` follow each other and come into one piece. `reduce` gets a piece's
    columns, the numbers of the rows that take part and the number of each one's group; it returns
    a row number per group and the values of `sums`. `merge` unites the values of an earlier and a
    later piece. What is held is one piece and at most GROUPS groups; beyond that the largest
    grouping's sums go out, so a group may have several rows, in the order of `__part`.
    """
    used = list(dict.fromkeys(c for g in groupings for c in g.columns))
    flags = list(dict.fromkeys(g.where for g in groupings if g.where))
    schema = StructType([df.schema[c] for c in used])
    names = [f.split()[0] for f in sums.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 33
        known: dict[str, dict] = {c: {} for c in used}
        kinds: dict[str, pa.DataType] = {}
        held = [_Sums(merge) for _ in groupings]

        def out(number: int) -> Iterator[pa.RecordBatch]:
            own, held[number] = held[number], _Sums(merge)
            columns = groupings[number].columns
            for low in range(0, len(own), OUT):
                codes = own.codes[low : low + OUT]
                shown = []
                for c in used:
                    if c in columns:
                        shown.append(pa.array(list(known[c]), kinds[c]).take(pa.array(codes[:, columns.index(c)])))
                    else:
                        shown.append(pa.nulls(len(codes), kinds[c]))
                fixed = [pa.array(np.full(len(codes), number, np.int32)), pa.array(np.full(len(codes), part, np.int64))]
                values = [pa.array(v[low : low + OUT]) for v in own.values]
                yield pa.RecordBatch.from_arrays([*shown, *fixed, *values], names=[*used, "__set", "__part", *names])

        for piece in _pieces(batches, whole):
            part += 1
            codes = {}
            for c in used:
                numbers, values = _encoded(piece.column(c))
                kinds[c] = piece.column(c).type
                own = known[c]
                # Neither null nor NaN makes a group.
                places = np.array([own.setdefault(v, len(own)) if v == v else -1 for v in values.to_pylist()] + [-1], dtype=np.int32)
                codes[c] = places[numbers]
            columns = {}
            for c in needed:
                kind = piece.column(c).type
                plain = pa.types.is_integer(kind) or pa.types.is_floating(kind)
                columns[c] = piece.column(c).to_numpy() if plain else _encoded(piece.column(c))[0]
            where = {c: piece.column(c).combine_chunks().fill_null(False).to_numpy(zero_copy_only=False) for c in flags}
            for number, grouping in enumerate(groupings):
                keep = where[grouping.where].copy() if grouping.where else np.ones(piece.num_rows, dtype=bool)
                for c in grouping.columns:
                    keep &= codes[c] >= 0
                taken = np.flatnonzero(keep)
                if not len(taken):
                    continue
                group = _numbered([codes[c][taken] for c in grouping.columns], len(taken))
                at, *results = reduce(columns, taken, group)
                own = [codes[c][taken[at]] for c in grouping.columns]
                held[number].add(np.stack(own, axis=1) if own else np.zeros((len(at), 0), np.int32), results)
            while sum(map(len, held)) > GROUPS:
                yield from out(max(range(len(held)), key=lambda n: len(held[n])))
        for number in range(len(held)):
            yield from out(number)

    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "__set int, __part long", sums])
    return df.select(*dict.fromkeys([*used, *flags, *needed])).mapInArrow(run, kinds)


SUMS = "n long, bad long, good long, area double, cumulated double, low double, high double"


def rank_sums(counts: DataFrame, groupings: Sequence[Grouping], score: str) -> DataFrame:
    """Per grouping (its number in `__set`), group and range of scores (`__part`): the sums of SUMS.

    `counts` holds the group columns, `score`, rows `n` and bads `bad`; scores may repeat.
    cumulated: sum over rows of the bads below, the own score's bads at their average place.
    Columns that a grouping does not use are null.
    """

    def reduce(columns: dict[str, np.ndarray], taken: np.ndarray, group: np.ndarray) -> tuple:
        order = np.argsort(group, kind="stable")
        rows = taken[order]
        bad = columns["bad"][rows].astype(np.int64)
        good = columns["n"][rows].astype(np.int64) - bad
        at, bads, goods, area, cumulated, low, high = _reduced(group[order], columns[score][rows], bad, good)
        return order[at], bads + goods, bads, goods, area, cumulated, low, high

    def merge(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
        (n, bad, good, area, cumulated, low, high), (n2, bad2, good2, area2, cumulated2, low2, high2) = a, b
        return [
            n + n2, bad + bad2, good + good2, area + area2 + bad2 * good.astype(float),
            cumulated + cumulated2 + n2 * bad.astype(float), np.fmin(low, low2), np.maximum(high, high2),
        ]

    ranged = counts.withColumn(score, F.col(score).cast("double")).repartitionByRange(F.col(score)).sortWithinPartitions(score)
    return _by_grouping(ranged, groupings, [score, "n", "bad"], SUMS, score, reduce, merge)


def account_counts(people: DataFrame, groupings: Sequence[Grouping], account: str, flag: str) -> DataFrame:
    """Distinct accounts and those with a flagged row, per grouping (`__set`) and group, exactly.

    `people` holds the group columns, `account` and `flag` (0 or 1), rows without repeats.
    """

    def reduce(columns: dict[str, np.ndarray], taken: np.ndarray, group: np.ndarray) -> tuple:
        who = columns[account][taken]
        order = np.lexsort((who, group))
        group, who, flags = group[order], who[order], columns[flag][taken][order].astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (who[1:] != who[:-1])]))
        flagged, group = np.maximum.reduceat(flags, start), group[start]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        return order[start[first]], np.diff(np.append(first, len(group))), np.add.reduceat(flagged, first)

    def merge(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
        return [x + y for x, y in zip(a, b)]

    keys = ["__set", *dict.fromkeys(c for g in groupings for c in g.columns)]
    dealt = people.repartition(account).sortWithinPartitions(account)
    parts = _by_grouping(dealt, groupings, [account, flag], "distinct_accounts long, bad_count long", account, reduce, merge)
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("distinct_accounts", "bad_count")])


def combined(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per group: the ranges' sums combined in the order of the scores."""
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("double")
    placed = sums.withColumns({"__bads": earlier("bad"), "__goods": earlier("good")})
    return placed.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("good").alias("good"),
        F.sum(F.col("area") + F.col("bad") * F.col("__goods")).alias("area"),
        F.sum(F.col("cumulated") + F.col("n") * F.col("__bads")).alias("cumulated"),
        F.min("low").alias("low"), F.max("high").alias("high"),
    )


def quantiles_by_grouping(counts: DataFrame, groupings: Sequence[Grouping], score: str, probabilities: Sequence[float]) -> DataFrame:
    """Per grouping (`__set`) and group: `quantiles` of `score`, exact and linearly interpolated.

    `counts` holds the group columns as strings, `score`, not null, and the rows `n` it stands for.
    As with deciles, ranges are counted first; each then finds the ranks that fall into it. No row
    is copied per grouping.
    """
    used = list(dict.fromkeys(c for g in groupings for c in g.columns))
    wanted = counts.select(*used, F.col(score).cast("double").alias("__score"), F.col("n").cast("long").alias("n"))
    numbers = F.shiftright(F.monotonically_increasing_id(), RANGE_BITS)
    # Equal scores may lie in several ranges: which of them a rank falls on makes no difference.
    ranged = materialise(wanted.repartitionByRange("__score", *used).sortWithinPartitions("__score").withColumn("__range", numbers))
    steps = [float(p) for p in probabilities]

    def size(columns: dict[str, np.ndarray], taken: np.ndarray, group: np.ndarray) -> tuple:
        order = np.argsort(group, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(group[order]) != 0]))
        return order[first], np.add.reduceat(columns["n"][taken][order], first)

    keys = ["__set", *used]
    within = [Grouping((*g.columns, "__range"), g.where) for g in groupings]
    sizes = _by_grouping(ranged, within, ["n"], "n long", None, size, lambda a, b: [a[0] + b[0]])
    sizes = sizes.groupBy(*keys, "__range").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys)
    offsets = sizes.select(
        *keys, "__range",
        F.coalesce(F.sum("n").over(group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.sum("n").over(group).alias("__all"),
    )
    schema = StructType([ranged.schema[c] for c in used])

    def place(rows: pd.DataFrame, offsets: pd.DataFrame) -> pd.DataFrame:
        rows = rows.iloc[np.argsort(rows["__score"].to_numpy(), kind="stable")].reset_index(drop=True)
        by_set = dict(list(offsets.groupby("__set")))
        score, n = rows["__score"].to_numpy(), rows["n"].to_numpy(np.int64)
        parts = []
        for number, grouping, taken, group in _taking_part(rows, groupings):
            sort = np.argsort(group, kind="stable")
            taken, group = taken[sort], group[sort]
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            last = np.append(first[1:], len(group))
            own = by_set[number]
            if grouping.columns:
                own = _shown(rows, taken[first], grouping, grouping.columns).merge(own, on=list(grouping.columns), how="left")
            upto = np.cumsum(n[taken])
            found = []
            for at, (low, high, before, every) in enumerate(zip(first, last, own["__before"].to_numpy(np.int64), own["__all"].to_numpy(np.int64))):
                here = before + upto[low:high] - (upto[low - 1] if low else 0)
                place = np.array(steps) * float(every - 1)
                ranks = np.stack([np.floor(place), np.ceil(place)], axis=1).ravel().astype(np.int64)
                slots = np.flatnonzero((ranks >= before) & (ranks < here[-1]))
                found += [(at, slot, score[taken[low + i]], every) for slot, i in zip(slots, np.searchsorted(here, ranks[slots], side="right"))]
            if found:
                at, slot, value, every = zip(*found)
                shown = _shown(rows, taken[first[list(at)]], grouping, used)
                parts.append(shown.assign(__set=number, slot=slot, value=value, rows=every))
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=[*used, "__set", "slot", "value", "rows"])

    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "__set int, slot int, value double, rows long"])
    picked = ranged.groupBy("__range").cogroup(offsets.groupBy("__range")).applyInPandas(place, kinds)
    ends = [F.max(F.when(F.col("slot") == slot, F.col("value"))).alias(f"__{slot}") for slot in range(2 * len(steps))]
    points = [f"__{2 * i} + (__{2 * i + 1} - __{2 * i}) * ({p}D * (rows - 1) - floor({p}D * (rows - 1)))" for i, p in enumerate(steps)]
    return picked.groupBy(*keys).agg(F.max("rows").alias("rows"), *ends).select(*keys, F.expr(f"array({', '.join(points)}) AS quantiles"))


DECILES = "decile int, low double, high double, total double, n long, bad long"


def decile_sums(rows: DataFrame, groupings: Sequence[Grouping], score: str, ties: str, label: str) -> DataFrame:
    """Per grouping (`__set`), group and decile: lowest, highest and total score, rows and bads.

    Decile 10 has the lowest scores; equal scores are split by `ties`, then by `label` (0 or 1),
    nulls first. Group columns are strings, `score` is not null. Groups with fewer than ten rows
    lack deciles, and a group of one row has only the tenth.
    """
    used = list(dict.fromkeys(c for g in groupings for c in g.columns))
    flags = list(dict.fromkeys(g.where for g in groupings if g.where))
    wanted = rows.select(*used, *flags, F.col(score).cast("double").alias("__score"), F.col(ties).alias("__ties"), F.col(label).cast("long").alias("__label"))
    order = ["__score", "__ties", "__label"]
    # The number of a row in its partition and in order, cut to pieces: however large a partition is, a range is not.
    numbers = F.shiftright(F.monotonically_increasing_id(), RANGE_BITS)
    ranged = materialise(wanted.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__range", numbers))

    def size(columns: dict[str, np.ndarray], taken: np.ndarray, group: np.ndarray) -> tuple:
        _, at, counts = np.unique(group, return_index=True, return_counts=True)
        return at, counts

    within = [Grouping((*g.columns, "__range"), g.where) for g in groupings]
    sizes = _by_grouping(ranged, within, [], "n long", None, size, lambda a, b: [a[0] + b[0]])
    keys = ["__set", *used]
    sizes = sizes.groupBy(*keys, "__range").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys)
    offsets = sizes.select(
        *keys, "__range",
        F.coalesce(F.sum("n").over(group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.sum("n").over(group).alias("__all"),
    )
    schema = StructType([ranged.schema[c] for c in used])
    names = [f.split()[0] for f in DECILES.split(", ")]

    def place(rows: pd.DataFrame, offsets: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable", na_position="first").reset_index(drop=True)
        by_set = dict(list(offsets.groupby("__set")))
        score, bad = rows["__score"].to_numpy(), rows["__label"].fillna(0).to_numpy(np.int64)
        parts = []
        for number, grouping, taken, group in _taking_part(rows, groupings):
            sort = np.argsort(group, kind="stable")
            taken, group = taken[sort], group[sort]
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            size = np.diff(np.append(first, len(group)))
            own = by_set[number]
            if grouping.columns:
                own = _shown(rows, taken[first], grouping, grouping.columns).merge(own, on=list(grouping.columns), how="left")
            before, every = (np.repeat(own[c].to_numpy(np.int64), size) for c in ("__before", "__all"))
            rank = before + np.arange(len(group)) - np.repeat(first, size)  # from 0
            decile = 11 - np.maximum(np.ceil(rank * 10.0 / np.maximum(every - 1, 1)), 1).astype(np.int64)
            at = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (decile[1:] != decile[:-1])]))
            s = score[taken]
            values = (decile[at], s[at], s[np.append(at[1:], len(s)) - 1], np.add.reduceat(s, at), np.diff(np.append(at, len(s))), np.add.reduceat(bad[taken], at))
            parts.append(_shown(rows, taken[at], grouping, used).assign(__set=number, **dict(zip(names, values))))
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=[*used, "__set", *names])

    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "__set int", DECILES])
    placed = ranged.groupBy("__range").cogroup(offsets.groupBy("__range")).applyInPandas(place, kinds)
    return placed.groupBy(*keys, "decile").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"), F.sum("n").alias("n"), F.sum("bad").alias("bad"))
