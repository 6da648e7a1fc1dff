"""Benchmark decontamination by greedy string tiling.

Benchmark items and documents are word sequences. A document and an item that share a seed
(a run of `MIN_MATCH` words) are tiled: running Karp-Rabin finds the common runs of at least
a search length, the longest are marked first, and the search length falls until no run of
`MIN_MATCH` words is left. Tiles never overlap and may stand in any order, so passages whose
parts were moved around are covered too. A document is contaminated by an item if tiles cover
at least `COVERAGE` of the item's words.

Items go to the tasks in blocks of bounded size, one pass over the documents each.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewatch.llm.common import documents, slices, text_column

WORD = re.compile(r"\w+")
MIN_MATCH = 5
COVERAGE = 0.6
FIRST_SEARCH = 20
BLOCK_CHARS = 8_000_000
BASE = 0x100000001B3


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def run_hashes(values: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hash of each run of `length` values."""
    n = len(values) - length + 1
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        # Doubling: the hash of 2^j values from two of 2^(j-1), then the bits of `length`.
        power, width, part = np.uint64(BASE), 1, values.astype(np.uint64) + np.uint64(1)
        done, left = 0, length
        while left:
            if left & 1:
                out = out * power + part[done : done + n]
                done += width
            left >>= 1
            if left:
                part = part[: len(part) - width] * power + part[width:]
                power, width = power * power, 2 * width
    return out


def greedy_tiles(item: np.ndarray, text: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles (item position, text position, length): longest first, then leftmost in item and text."""
    free_item, free_text = np.ones(len(item), bool), np.ones(len(text), bool)
    tiles: list[tuple[int, int, int]] = []
    search = max(least, min(FIRST_SEARCH, len(item), len(text)))
    while True:
        runs = _common_runs(item, text, free_item, free_text, search)
        longest = max((r[2] for r in runs), default=0)
        if longest > 2 * search:
            search = longest
            continue
        for i, t, length in sorted(runs, key=lambda r: (-r[2], r[0], r[1])):
            # A run that is partly taken by now is found again, shorter, by a later search.
            if free_item[i : i + length].all() and free_text[t : t + length].all():
                tiles.append((i, t, length))
                free_item[i : i + length] = free_text[t : t + length] = False
        if search > least:
            search = max(least, search // 2)
        elif not runs:
            return tiles


def _common_runs(item, text, free_item, free_text, length) -> list[tuple[int, int, int]]:
    """Maximal common runs of unmarked words, at least `length` long."""
    if length > len(item) or length > len(text):
        return []
    open_item, open_text = _open(free_item, length), _open(free_text, length)
    places = defaultdict(list)
    hashes = run_hashes(item, length)
    for i in np.flatnonzero(open_item).tolist():
        places[int(hashes[i])].append(i)
    if not places:
        return []
    own = run_hashes(text, length)
    hits = np.flatnonzero(open_text & np.isin(own, np.fromiter(places, np.uint64, len(places))))
    found = set()
    for t in hits.tolist():
        for i in places[int(own[t])]:
            if i and t and free_item[i - 1] and free_text[t - 1] and item[i - 1] == text[t - 1]:
                continue  # belongs to a run that began earlier
            most = min(len(item) - i, len(text) - t)
            same = (item[i : i + most] == text[t : t + most]) & free_item[i : i + most] & free_text[t : t + most]
            size = most if same.all() else int(np.argmin(same))
            if size >= length:
                found.add((i, t, size))
    return list(found)


def _open(free: np.ndarray, length: int) -> np.ndarray:
    """Where `length` unmarked words in a row begin."""
    sums = np.concatenate([[0], np.cumsum(free)])
    return sums[length:] - sums[:-length] == length


class Benchmark:
    """Items of one block as word numbers, and where their seeds stand."""

    def __init__(self, items: list[tuple[int, str | None]], least: int = MIN_MATCH, coverage: float = COVERAGE) -> None:
        self.least, self.coverage = least, coverage
        self.words: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        seeds = defaultdict(set)
        for item_id, text in items:
            numbers = np.array([self.words.setdefault(w, len(self.words)) for w in words_of(text)], np.int64)
            if len(numbers) >= least:
                for h in run_hashes(numbers, least).tolist():
                    seeds[h].add(len(self.items))
                self.items.append((item_id, numbers))
        self.seeds = {h: sorted(s) for h, s in seeds.items()}
        self.hashes = np.array(sorted(seeds), np.uint64)

    def overlaps(self, text: str | None) -> list[dict]:
        """The items that cover `text` enough, with their coverage."""
        get = self.words.get
        values = np.array([get(w, -1) for w in words_of(text)], np.int64)
        if len(values) < self.least or not len(self.hashes):
            return []
        at = np.flatnonzero(_open(values >= 0, self.least))
        if not len(at):
            return []
        own = run_hashes(values, self.least)[at]
        where = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
        shared = np.unique(own[self.hashes[where] == own])
        out = []
        for number in sorted({i for h in shared.tolist() for i in self.seeds[h]}):
            item_id, item = self.items[number]
            tiles = greedy_tiles(item, values, self.least)
            covered = sum(length for _, _, length in tiles)
            if covered >= self.coverage * len(item) - 1e-9:
                out.append({"item_id": item_id, "coverage": covered / len(item), "tiles": len(tiles), "longest": tiles[0][2]})
        return out


def blocks(benchmark: DataFrame, **options) -> Iterator[Benchmark]:
    """The benchmark in blocks of at most about BLOCK_CHARS characters (one item at least).

    Items without an id or text, or with fewer than `MIN_MATCH` words, contaminate nothing.
    """
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    held, size = [], 0
    for row in rows.where("item_id is not null and text is not null").orderBy("item_id", "text").toLocalIterator():
        if held and size + len(row["text"]) > BLOCK_CHARS:
            yield Benchmark(held, **options)
            held, size = [], 0
        held.append((row["item_id"], row["text"]))
        size += len(row["text"])
    yield Benchmark(held, **options)


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, coverage, tiles, longest for each document that an item contaminates."""
    own = documents(docs)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.int64()), ("longest", pa.int64())])

    def pass_over(items: Benchmark) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                rows = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    rows += [{"doc_id": doc_id} | hit for hit in items.overlaps(text)]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

        return own.mapInArrow(run, "doc_id long, item_id long, coverage double, tiles long, longest long")

    passes = [pass_over(b) for b in blocks(benchmark, **options)]
    result = passes[0]
    for more in passes[1:]:
        result = result.unionAll(more)
    return result


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """`docs`, all columns, without the documents that any item contaminates."""
    for items in blocks(benchmark, **options):
        hit = text_column(lambda texts, items=items: [bool(items.overlaps(t)) for t in texts], "boolean")
        docs = docs.where(~hit(F.col("text").cast("string")))
    return docs
