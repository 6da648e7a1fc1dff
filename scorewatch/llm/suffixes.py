"""Removal of repeated strings by sparse suffix sorting.

Every byte covered by a string of `LENGTH` bytes that also starts earlier (in a smaller id, or
earlier in the same document) is removed. The work is exact, but never looks at all suffixes:

1. Anchors. In each window of `LENGTH` bytes the position of the smallest gram hash (rightmost
   of equals) is its anchor. Equal strings have equal anchors at equal offsets, so only
   suffixes that begin at anchors have to be sorted; an anchor stands for the run of windows
   that chose it.
2. Anchors of equal grams meet in one task. An anchor whose surroundings (all of its windows)
   occurred earlier is covered whole. Repeats within a batch are settled before the shuffle,
   so a passage that a third of the documents share reaches its task as a few rows.
3. Grams with different surroundings are ambiguous: their surroundings are cut into two ranges
   of offsets, each grouped by the bytes all its windows share. In a group, the suffixes at
   the anchor are sorted deep-shallow: multikey quicksort to `SHALLOW` more bytes, then blind
   tries for those that still agree. In each node of the sorted order, members with equal
   bytes on the other side of the anchor are repeats. The same, mirrored, gives the other end.
   A core with more members than GROUP is not gathered in a task: its windows are dealt by two
   hashes of their own bytes (128 bits), and those that are not the first of their kind are repeats.

A row is known by its id, 64 bits of its text (`key`) and 15 more (`copy`); spans are grouped and
joined by all three, so rows without an id are told apart and no array grows with their number.
Rows that share an id are compared by where strings start; null ids come last. Rows equal in
id and text are one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewatch.llm.common import documents, slices, utf8_values, written

LENGTH, GRAM = 100, 32
WINDOW = LENGTH - GRAM + 1
RANGES = ((0, 34), (35, 68))  # offsets of the anchor in a window
SHALLOW = 8
GROUP = 5_000  # members of a core that are sorted in one task
NO_ID = 2**63 - 1
LOW = np.uint64(0xFFFFFFFF)
COPY = 0x7FFF  # bits of a second digest of the text, packed with the position
ROW = ["doc_id", "key", "copy"]


class Hasher:
    """Polynomial hashes of byte ranges from prefix sums, with two bases."""

    def __init__(self) -> None:
        draw = np.random.default_rng(11)
        self.values = draw.integers(0, 2**64, (2, 256), dtype=np.uint64)
        self.bases = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
        self.powers, self.undone = [np.ones(1, np.uint64)] * 2, [np.ones(1, np.uint64)] * 2

    def _grow(self, n: int) -> None:
        if len(self.powers[0]) > n:
            return
        size = 2 * n + 1024
        with np.errstate(over="ignore"):
            for i, base in enumerate(self.bases):
                for target, factor in ((self.powers, base), (self.undone, pow(base, -1, 2**64))):
                    steps = np.full(size, factor, np.uint64)
                    steps[0] = 1
                    target[i] = np.cumprod(steps)

    def ranges(self, data: np.ndarray, which: int):
        """A function (starts, ends) -> 64-bit hashes of data[start:end]."""
        self._grow(len(data))
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.values[which][data] * self.powers[which][: len(data)])])

        def of(starts, ends):
            with np.errstate(over="ignore"):
                x = (sums[ends] - sums[starts]) * self.undone[which][starts]
                x ^= x >> np.uint64(32)
                x *= np.uint64(0xD6E8FEB86659FD93)
                return x ^ (x >> np.uint64(29))

        return of


def anchors(data: np.ndarray, hasher: Hasher):
    """(gram hash, surroundings hash, position, largest offset, smallest offset) of each anchor."""
    n = len(data)
    if n < LENGTH:
        return None
    grams = hasher.ranges(data, 0)
    hashes = grams(slice(0, n - GRAM + 1), slice(GRAM, n + 1))
    count = len(hashes)
    keys = (hashes & ~LOW) | (LOW - np.arange(count, dtype=np.uint64))
    blocks = -(-count // WINDOW)
    grid = np.full(blocks * WINDOW, np.iinfo(np.uint64).max, dtype=np.uint64)
    grid[:count] = keys
    grid = grid.reshape(blocks, WINDOW)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: count - WINDOW + 1], ahead[WINDOW - 1 : count])
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.concatenate([first[1:], [len(least)]]) - 1
    at = (LOW - (least[first] & LOW)).astype(np.int64)
    most, fewest = at - first, at - last
    around = hasher.ranges(data, 1)(first, last + LENGTH)
    around ^= (most * 128 + fewest).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return hashes[at].astype(np.int64), around.astype(np.int64), at, most, fewest


def anchor_rows(docs: DataFrame) -> DataFrame:
    """(gram, around, doc_id, key, packed) of all anchors.

    `packed` holds position, copy and offsets. Of equal surroundings in one batch only the first is
    compared further; the others are repeats already, marked by a negative `packed` and dealt
    by a hash of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in slices(batches):
            parts = []
            for *row, text in zip(*(batch.column(c).to_pylist() for c in ROW), utf8_values(batch.column("text"))):
                doc_id, key, copy = row
                found = anchors(np.frombuffer(text, np.uint8), hasher)
                if found is not None:
                    gram, around, at, most, fewest = found
                    parts.append((gram, around, np.full(len(gram), doc_id, np.int64), np.full(len(gram), key, np.int64), (at << 29) | (copy << 14) | (most << 7) | fewest))
            if not parts:
                continue
            gram, around, doc, key, packed = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((key, packed, doc, around, gram))
            gram, around, doc, key, packed = (x[order] for x in (gram, around, doc, key, packed))
            equal = (gram[1:] == gram[:-1]) & (around[1:] == around[:-1])
            other = np.concatenate([[True], ~equal | (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (packed[1:] != packed[:-1])])
            again = np.concatenate([[False], equal])[other]  # rows equal in id and text count once
            gram, around, doc, key, packed = (x[other] for x in (gram, around, doc, key, packed))
            with np.errstate(over="ignore"):
                gram = np.where(again, ((doc * 1_000_003 + key) * 1_000_003 + packed) * 0x5851F42D4C957F2D, gram)
            packed = np.where(again, -1 - packed, packed)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (gram, around, doc, key, packed)], names=["gram", "around", "doc_id", "key", "packed"])

    return docs.mapInArrow(run, "gram long, around long, doc_id long, key long, packed long")


def unpacked(packed):
    """(position, copy, largest offset, smallest offset)."""
    return packed >> 29, (packed >> 14) & COPY, (packed >> 7) & 127, packed & 127


def compare_surroundings(rows: DataFrame) -> DataFrame:
    """Repeats (doc_id, key, copy, start, stop) and, with `packed` set, anchors whose bytes must be compared."""

    def answer(gram, around, doc, key, packed, asked: bool, open_run: bool):
        """(batch, held row, whether it was asked).

        Held is the first row of the last surroundings of an open last gram. It is asked once
        the gram has other surroundings; `asked` tells so of the row held before, now the first.
        """
        new_gram = np.concatenate([[True], gram[1:] != gram[:-1]])
        new = new_gram | np.concatenate([[True], around[1:] != around[:-1]])
        run = np.cumsum(new_gram) - 1
        kinds = np.bincount(run, new)
        kinds[0] += asked
        sure = packed < 0
        # An equal row (repeated id and text) is no repeat of itself.
        same = np.concatenate([[False], ~new[1:] & (doc[1:] == doc[:-1]) & (key[1:] == key[:-1]) & (packed[1:] == packed[:-1])])
        leader = new.copy()
        for i in np.flatnonzero(same & ~new).tolist():
            leader[i] = leader[i - 1]
        repeat = sure | ~leader
        ask = new & ~sure & (kinds[run] > 1)
        ask[0] &= not asked
        at, copy, most, fewest = unpacked(np.where(sure, -1 - packed, packed))
        take = (repeat & ~same) | ask
        none = ~ask[take]
        out = pa.RecordBatch.from_arrays(
            [pa.array(doc[take]), pa.array(key[take]), pa.array(copy[take]), pa.array((at - most)[take]), pa.array((at - fewest + LENGTH)[take]), pa.array(packed[take], mask=none)],
            names=[*ROW, "start", "stop", "packed"],
        )
        keep = np.flatnonzero((run == run[-1]) & new & ~sure & open_run)[-1:]
        return out, [x[keep] for x in (gram, around, doc, key, packed)], bool(len(keep)) and bool(kinds[-1] > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, asked = [np.zeros(0, np.int64)] * 5, False
        for batch in batches:
            if batch.num_rows:
                own = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("gram", "around", "doc_id", "key", "packed"))]
                out, held, asked = answer(*own, asked, True)
                yield out
        if len(held[0]):
            yield answer(*held, asked, False)[0]

    sorted_rows = rows.repartition("gram").sortWithinPartitions("gram", "around", "doc_id", "packed", "key")
    return sorted_rows.mapInArrow(run, "doc_id long, key long, copy long, start long, stop long, packed long")


def cut_surroundings(asked: DataFrame) -> DataFrame:
    """(core, doc_id, key, place, left, right): the bytes on both sides of each asked anchor, per range.

    `place` holds position and copy.
    `left` runs outwards from the anchor; `core` is a hash of what all windows of the range share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out, seen = [], set()
            for *row, text, places in zip(*(batch.column(c).to_pylist() for c in ROW), utf8_values(batch.column("text")), batch.column("asks").to_pylist()):
                if tuple(row) in seen:
                    continue
                seen.add(tuple(row))
                doc_id, key, _ = row
                for packed in places:
                    at, copy, most, fewest = unpacked(packed)
                    for number, (low, high) in enumerate(RANGES):
                        a, b = max(low, fewest), min(high, most)
                        if a <= b:
                            core = xxhash.xxh64_intdigest(text[at - low : at + LENGTH - high], number) - 2**63
                            out.append((core, doc_id, key, at << 15 | copy, text[at - b : at][::-1], text[at : at + LENGTH - a]))
            columns = list(zip(*out)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["core", "doc_id", "key", "place", "left", "right"])

    return asked.mapInArrow(run, "core long, doc_id long, key long, place long, left binary, right binary")


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class BlindTrie:
    """A Patricia trie that keeps branching bytes only; strings are looked at once per insertion."""

    def __init__(self, strings: list[bytes]) -> None:
        self.strings = strings
        self.root: list | None = None  # leaf: [string numbers]; inner node: (depth, {byte or -1: node}, any leaf below)

    def insert(self, number: int) -> None:
        text = self.strings[number]
        if self.root is None:
            self.root = [number]
            return
        node = self.root
        while isinstance(node, tuple):  # blind descent
            depth, children, leaf = node
            node = children.get(text[depth] if depth < len(text) else -1, leaf)
        other = self.strings[node[0]]
        depth = common_prefix(text, other)
        if depth == len(text) == len(other):
            node.append(number)
            return
        parent, key, node = None, None, self.root
        while isinstance(node, tuple) and node[0] < depth:
            parent, key = node, text[node[0]]
            node = node[1][key]
        mine = text[depth] if depth < len(text) else -1
        if isinstance(node, tuple) and node[0] == depth:
            node[1][mine] = [number]
            return
        theirs = other[depth] if depth < len(other) else -1
        leaf = node[2] if isinstance(node, tuple) else node
        made = (depth, {theirs: node, mine: [number]}, leaf)
        if parent is None:
            self.root = made
        else:
            parent[1][key] = made

    def ordered(self, node=None) -> tuple[list[int], list[int]]:
        """(string numbers in order, common prefix with the one before)."""
        node = self.root if node is None else node
        if isinstance(node, list):
            return list(node), [-1] + [len(self.strings[node[0]])] * (len(node) - 1)
        order, prefix = [], []
        for key in sorted(node[1]):
            own, lcp = self.ordered(node[1][key])
            prefix += [node[0] if order else -1] + lcp[1:]
            order += own
        return order, prefix


def deep_shallow(strings: list[bytes], depth: int = 0, limit: int | None = None) -> tuple[list[int], list[int]]:
    """Sorted numbers of the strings and the common prefix of each with the one before (-1: first).

    `depth`: bytes that all strings share. Multikey quicksort splits by one byte at a time up
    to `limit`; groups that still agree there are ordered by a blind trie.
    """
    limit = depth + SHALLOW if limit is None else limit
    order: list[int] = []
    prefix: list[int] = []
    work: list[tuple[list[int], int, int]] = [(list(range(len(strings))), depth, -1)]
    while work:
        group, at, before = work.pop()  # before: common prefix with the group in front
        if not group:
            continue
        if len(group) == 1 or at >= limit:
            trie = BlindTrie(strings)
            for number in group:
                trie.insert(number)
            own, lcp = trie.ordered()
            order += own
            prefix += [before] + lcp[1:]
            continue
        byte = [strings[g][at] if at < len(strings[g]) else -1 for g in group]
        pivot = sorted((byte[0], byte[len(byte) // 2], byte[-1]))[1]
        less = [g for g, b in zip(group, byte) if b < pivot]
        more = [g for g, b in zip(group, byte) if b > pivot]
        same = [g for g, b in zip(group, byte) if b == pivot]
        # The first group met keeps `before`; groups after it share `at` bytes with the one in front.
        fronts = [before if i == 0 else at for i in range(3)] if less else [before, before, at]
        work.append((more, at, fronts[2]))
        work.append((same, limit if pivot == -1 else at + 1, fronts[1]))
        work.append((less, at, fronts[0]))
    return order, prefix


def nodes_of(prefix: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, from, to) of each interval of the sorted order that shares `depth` bytes, innermost first."""
    stack: list[list[int]] = []
    for i in range(1, len(prefix) + 1):
        depth, low = prefix[i] if i < len(prefix) else -1, i - 1
        while stack and stack[-1][0] > depth:
            top = stack.pop()
            yield top[0], top[1], i
            low = top[1]
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append([depth, low])


def longest_repeats(near: list[bytes], far: list[bytes], shared: int) -> list[int]:
    """For each member, in order of first occurrence: the most bytes p of `near` such that an
    earlier member has the same p bytes there and the same LENGTH - p bytes of `far`; -1 if none.
    """
    best = [-1] * len(near)
    order, prefix = deep_shallow(near, shared)
    for depth, low, high in nodes_of(prefix):
        need = max(LENGTH - depth, 0)
        first: dict[bytes, int] = {}
        members = sorted(order[low:high])
        for number in members:
            if len(far[number]) >= need:
                key = far[number][:need]
                if key in first:
                    best[number] = max(best[number], min(depth, LENGTH))
                else:
                    first[key] = number
    return best


def settle_group(items: list[tuple[int, int, int, bytes, bytes]]) -> list[tuple[int, int, int, int, int]]:
    """(doc_id, key, copy, start, stop) of the repeated stretches around the anchors of one core."""
    known: dict[tuple[bytes, bytes], int] = {}
    firsts, out = [], []
    for doc_id, key, place, left, right in items:  # in order of id and position
        if (left, right) in known:
            if firsts[known[left, right]][:3] != (doc_id, key, place):
                out.append((doc_id, key, place & COPY, (place >> 15) - len(left), (place >> 15) + len(right)))
        else:
            known[left, right] = len(firsts)
            firsts.append((doc_id, key, place, left, right))
    if len(firsts) < 2:
        return out
    lefts, rights = [f[3] for f in firsts], [f[4] for f in firsts]
    right_most = longest_repeats(rights, lefts, 0)
    left_most = longest_repeats(lefts, rights, 0)
    for (doc_id, key, place, _, _), right, left in zip(firsts, right_most, left_most):
        if right >= 0 and left >= 0:
            out.append((doc_id, key, place & COPY, (place >> 15) - left, (place >> 15) + right))
    return out


def compare_bytes(rows: DataFrame) -> DataFrame:
    """Repeats (doc_id, key, copy, start, stop) among the cut surroundings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core, items, out = None, [], []

        def batch_of(rows_) -> pa.RecordBatch:
            columns = list(zip(*rows_)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[*ROW, "start", "stop"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("core", "doc_id", "key", "place", "left", "right"))):
                if row[0] != core:
                    if len(items) > 1:
                        out += settle_group(items)
                    core, items = row[0], []
                if not items or items[-1][:3] != row[1:4]:
                    items.append(row[1:])
            yield batch_of(out)
            out = []
        if len(items) > 1:
            yield batch_of(settle_group(items))

    return rows.repartition("core").sortWithinPartitions("core", "doc_id", "place", "key").mapInArrow(run, "doc_id long, key long, copy long, start long, stop long")


def windows_of(rows: DataFrame) -> DataFrame:
    """(doc_id, key, place, offset, low, high) of every window in the cut surroundings, with two hashes of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500_000):
            out = []
            for doc_id, key, place, left, right in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "place", "left", "right"))):
                text = left[::-1] + right
                for at in range(len(text) - LENGTH + 1):
                    digest = xxhash.xxh3_128_intdigest(text[at : at + LENGTH])
                    out.append((doc_id, key, place, len(left) - at, (digest >> 64) - 2**63, (digest & 2**64 - 1) - 2**63))
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "key", "place", "offset", "low", "high"])

    return rows.mapInArrow(run, "doc_id long, key long, place long, offset long, low long, high long")


def compare_windows(rows: DataFrame) -> DataFrame:
    """Repeats (doc_id, key, copy, start, stop) among the cut surroundings of large cores.

    The first of equal windows is found by an aggregate, so a popular window is no task of its
    own; the offset is part of what is compared, as equal windows have equal anchors.
    """
    window, one = ["low", "high", "offset"], F.struct("doc_id", "place", "key")
    all_of = written(windows_of(rows), "windows")
    firsts = all_of.groupBy(*window).agg(F.min(one).alias("first"), F.max(one).alias("last")).where("first <> last")
    start = F.shiftright("place", 15) - F.col("offset")
    found = all_of.join(firsts.select(*window, "first"), window).where(one != F.col("first"))
    return found.select("doc_id", "key", F.col("place").bitwiseAND(F.lit(COPY)).alias("copy"), start.alias("start"), (start + LENGTH).alias("stop"))


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, key, copy, start, stop): stretches whose bytes are covered by repeated strings; may overlap."""
    compared = written(compare_surroundings(anchor_rows(docs)), "compared")
    sure = compared.where("packed is null").select(*ROW, "start", "stop")
    asks = compared.where("packed is not null").groupBy(*ROW).agg(F.collect_set("packed").alias("asks"))
    cut = written(cut_surroundings(docs.join(asks, ROW).select(*ROW, "text", "asks")), "surroundings")
    large = written(cut.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP).select("core"), "cores")
    if large.isEmpty():
        return sure.unionAll(compare_bytes(cut))
    small = cut.join(large, "core", "left_anti")
    return sure.unionAll(compare_bytes(small)).unionAll(compare_windows(cut.join(large, "core", "left_semi")))


def remove_repeats(table: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes) of each text.

    Null texts count as empty. Texts shorter than LENGTH bytes keep everything.
    """
    text = F.coalesce("text", F.lit(""))
    docs = documents(table).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    docs = docs.withColumns({"key": F.xxhash64(text), "copy": F.crc32(text.cast("binary")).bitwiseAND(F.lit(COPY))})
    spans = repeats(docs).groupBy(*ROW).agg(F.collect_set(F.struct("start", "stop")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc_id, text, cuts in zip(batch.column("doc_id").to_pylist(), utf8_values(batch.column("text")), batch.column("spans").to_pylist()):
                removed, kept, runs, upto = 0, [], 0, 0
                end = -1
                for start, stop in sorted((c["start"], c["stop"]) for c in cuts or ()):
                    if stop <= end:
                        continue
                    if start > end:
                        runs += 1
                        kept.append(text[upto:start])
                    removed += stop - max(start, end)
                    end = upto = stop
                kept.append(text[upto:])
                rest = b"".join(kept)
                row = [None if doc_id == NO_ID else doc_id, len(text), removed, runs, hashlib.sha256(rest).hexdigest()]
                rows.append(row + [rest] if with_text else row)
            columns = list(zip(*rows)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema(fields + [("kept", pa.binary())] * with_text)
    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return docs.join(spans, ROW, "left").select("doc_id", "text", "spans").mapInArrow(run, kinds)
