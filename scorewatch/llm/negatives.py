"""Hard-negative mining over Hilbert-ordered Parquet blocks with zone maps.

The vectors are written once as blocks of one label each, in the order of a Hilbert curve
through all dimensions, so that a block's vectors lie close together. Beside each block stand
its zone maps: the smallest and the largest value of every dimension. For an anchor a, the sums
of min(a*lo, a*hi) and max(a*lo, a*hi) over the dimensions bound every inner product with the
block. These intervals choose the blocks an anchor has to read: for its positives those whose
upper bound reaches the fifth best score known so far, for its windows those whose interval
meets a window. Only the chosen blocks are read, and scored exactly.

Anchors are a stated query set; they meet the zone maps and the blocks batch by batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorewatch.llm.common import bounded_batches, slices, written

BLOCK_ROWS = 256
BITS = 4  # of the curve, per dimension
POSITIVES, NEGATIVES = 5, 10
LEAST_PERCENT, MOST_PERCENT = 30, 90  # of the positive's score
ANCHORS = 256  # in a batch
SHARD_BLOCKS, SLOT_BLOCKS = 1_024, 16  # blocks whose zone maps, or whose rows, meet a batch at a time
EXACT = 2.0**53  # below this, sums of whole numbers are exact in doubles


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of each row of whole numbers below 2^bits, as bytes.

    The axes are turned into the transposed position by undoing excess work and Gray encoding,
    for all rows at once; the bits are then interleaved.
    """
    x = points.astype(np.uint32).T.copy()
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        p = np.uint32(q - 1)
        for i in range(n):
            high = (x[i] & np.uint32(q)) != 0
            t = np.where(high, np.uint32(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros(x.shape[1], dtype=np.uint32), top
    while q > 1:
        t ^= np.where((x[n - 1] & np.uint32(q)) != 0, np.uint32(q - 1), np.uint32(0))
        q >>= 1
    x ^= t
    shifts = np.arange(bits - 1, -1, -1, dtype=np.uint32)
    digits = (x.T[:, None, :] >> shifts[None, :, None]) & np.uint32(1)
    return np.packbits(digits.reshape(len(points), -1).astype(np.uint8), axis=1)


def scores(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of whole numbers, exactly.

    Doubles while no sum can pass 2^53, whole numbers of any length beyond; a score that does
    not fit into 64 bits is an error.
    """
    if not len(one) or not len(other):
        return np.zeros((len(one), len(other)), dtype=np.int64)
    if float(np.abs(one).max(initial=0)) * float(np.abs(other).max(initial=0)) * max(1, one.shape[1]) < EXACT:
        return (one @ other.T).astype(np.int64)
    whole = [np.array([[int(v) for v in row] for row in side], dtype=object) for side in (one, other)]
    return (whole[0] @ whole[1].T).astype(np.int64)


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each anchor with anything inside each block's box.

    Rounding is undone by a margin, so the interval never is too narrow.
    """
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    largest, least = up @ high.T + down @ low.T, up @ low.T + down @ high.T
    reach = np.abs(anchors) @ np.maximum(np.abs(low), np.abs(high)).T
    margin = np.where(reach < EXACT / 4, 0.0, reach * 2.0**-40)
    return least - margin, largest + margin


def matrix(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, dtype="<f8").reshape(-1, width) if width else np.zeros((0, 0))


def listed(column: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix, shorter lists filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == width).all():
        return flat.reshape(-1, width)
    full = np.zeros((len(column), width))
    full[np.repeat(np.arange(len(column)), lengths), np.concatenate([np.arange(n) for n in lengths])] = flat
    return full


def taking_part(vectors: DataFrame, label: Column) -> DataFrame:
    """vec_id, label, vector of the rows with a label and a vector of finite components."""
    bounded_batches(vectors.sparkSession)
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return vectors.where(label.isNotNull() & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"), label.cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("vector")
    )


def ranges_of(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest whole number of each dimension over all rows (zeros where a row ends)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = np.zeros(0)
        for batch in slices(batches):
            column = batch.column("vector")
            width = max(len(low), int(np.diff(column.offsets.to_numpy()).max(initial=0)))
            full = np.floor(256 * listed(column, width))
            low, high = (np.pad(a, (0, width - len(a))) for a in (low, high))
            low, high = np.minimum(low, full.min(axis=0, initial=0)), np.maximum(high, full.max(axis=0, initial=0))
        yield pa.RecordBatch.from_pydict({"d": pa.array(range(len(low)), pa.int32()), "low": low, "high": high})

    ends = rows.select("vector").mapInArrow(run, "d int, low double, high double").groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    found = sorted(map(tuple, ends.collect()))  # one row per dimension
    return np.array([r[1] for r in found]), np.array([r[2] for r in found])


def blocks_of(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """Blocks of one label in curve order, with zone maps, as a written table; and their width."""
    low, high = ranges_of(rows)
    width, span, steps = len(low), np.where(high > low, high - low, 1.0), (1 << BITS) - 1

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            full = np.floor(256 * listed(batch.column("vector"), width))
            keys = hilbert_keys(np.rint((full - low) / span * steps))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), *(pa.array([row.tobytes() for row in side], pa.binary()) for side in (keys, full.astype("<f8")))],
                names=["vec_id", "label", "key", "vector"],
            )

    schema = pa.schema([("block", pa.int64()), ("label", pa.int32()), *((c, pa.binary()) for c in ("ids", "known", "vectors", "low", "high"))])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number, held = TaskContext.get().partitionId() << 32, 0, []

        def block() -> pa.RecordBatch:
            ids, data = [i for i, _, _ in held], b"".join(v for _, _, v in held)
            box = np.frombuffer(data, "<f8").reshape(len(held), width)
            return pa.RecordBatch.from_pylist([{
                "block": base + number, "label": held[0][1], "vectors": data,
                "ids": np.array([i or 0 for i in ids], "<i8").tobytes(), "known": np.array([i is not None for i in ids], "u1").tobytes(),
                "low": box.min(axis=0).tobytes(), "high": box.max(axis=0).tobytes(),
            }], schema=schema)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "label", "vector"))):
                if held and (len(held) == block_rows or held[0][1] != row[1]):
                    yield block()
                    number, held = number + 1, []
                held.append(row)
        if held:
            yield block()

    # Equal vectors have one key; their ids deal them out.
    order = ("label", "key", "vec_id", "vector")
    curve = rows.mapInArrow(keyed, "vec_id long, label int, key binary, vector binary").repartitionByRange(*order).sortWithinPartitions(*order)
    table = curve.select("vec_id", "label", "vector").mapInArrow(packed, "block long, label int, ids binary, known binary, vectors binary, low binary, high binary")
    return written(table, "blocks"), width


BATCHES = "batch long, anchors binary, labels binary, homes binary, places binary, least binary, vectors binary"


def anchor_batches(blocks: DataFrame, width: int, every: int, positives: int) -> DataFrame:
    """Anchors, ANCHORS in a row at most, each with a lower bound of its last positive's score.

    The bound is that score within the anchor's own block, its neighbours on the curve.
    """

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for b in batch.itertuples():
                ids, known, full = np.frombuffer(b.ids, "<i8"), np.frombuffer(b.known, "u1"), matrix(b.vectors, width)
                for i in np.flatnonzero((known == 1) & (ids % every == 0)):
                    near = np.sort(np.delete(scores(full[i : i + 1], full)[0], i))
                    least = float(near[-positives]) if len(near) >= positives else -math.inf
                    out.append((int(ids[i]), b.label, b.block, int(i), least, full[i].tobytes()))
            yield pd.DataFrame(out, columns=["anchor", "label", "home", "place", "least", "vector"])

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, number = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for at in range(0, len(batch), ANCHORS):
                part = batch[at : at + ANCHORS]
                flat = [part[c].to_numpy(np.float64 if c == "least" else np.int64).tobytes() for c in ("anchor", "label", "home", "place", "least")]
                yield pd.DataFrame([(base + number, *flat, b"".join(part["vector"]))], columns=[c.split()[0] for c in BATCHES.split(", ")])
                number += 1

    anchors = written(blocks.select("block", "label", "ids", "known", "vectors").mapInPandas(found, "anchor long, label int, home long, place int, least double, vector binary"), "anchors")
    # Anchors of one label and neighbouring blocks choose much the same blocks.
    order, pieces = ("label", "home", "place"), max(1, anchors.count() // ANCHORS)
    return written(anchors.repartitionByRange(pieces, *order).sortWithinPartitions(*order).mapInPandas(packed, BATCHES), "batches")


def chosen_blocks(batches: DataFrame, blocks: DataFrame, width: int, shards: int, wants) -> DataFrame:
    """batch, block, wanted (numbers of the anchors) where the zone maps say a block must be read.

    Zone maps are dealt into shards; each batch is stated to each shard. `wants` gets a batch
    and the labels and interval bounds of the blocks and marks (anchor, block).
    """
    zones = blocks.withColumn("shard", F.pmod(F.xxhash64("block"), F.lit(shards))).groupBy("shard").agg(F.collect_list(F.struct("block", "label", "low", "high")).alias("zones"))
    stated = batches.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in (r for part in rows for r in part.itertuples()):
            low, high = (matrix(b"".join(z[c] for z in row.zones), width) for c in ("low", "high"))
            least, largest = bounds(matrix(row.vectors, width), low, high)
            marks = wants(row, np.array([z["label"] for z in row.zones]), least, largest)
            out = [(row.batch, row.zones[j]["block"], np.flatnonzero(marks[:, j]).astype("<i4").tobytes()) for j in np.flatnonzero(marks.any(axis=0))]
            yield pd.DataFrame(out, columns=["batch", "block", "wanted"])

    return stated.join(zones, "shard").mapInPandas(run, "batch long, block long, wanted binary")


def read_blocks(batches: DataFrame, blocks: DataFrame, chosen: DataFrame, width: int, slots: int, reads, schema: str) -> DataFrame:
    """Rows of `reads(batch, rows read)` for each batch and each slot of the blocks it chose."""
    slot = F.pmod(F.xxhash64("block", F.lit(1)), F.lit(slots))
    wanted = chosen.join(blocks.select("block", "label", "ids", "known", "vectors"), "block").withColumn("slot", slot)
    stated = batches.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))

    def run(some: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in schema.split(", ")]
        if some.empty or batch.empty:
            return pd.DataFrame([], columns=names)
        batch = batch.iloc[0]
        full = np.concatenate([matrix(v, width) for v in some["vectors"]])
        sizes = [len(k) for k in some["known"]]
        marks = np.zeros((len(batch["anchors"]) // 8, len(some)), dtype=bool)
        for j, chosen_here in enumerate(some["wanted"]):
            marks[np.frombuffer(chosen_here, "<i4"), j] = True
        rows = {
            "ids": np.concatenate([np.frombuffer(x, "<i8") for x in some["ids"]]),
            "known": np.concatenate([np.frombuffer(x, "u1") for x in some["known"]]),
            "labels": np.repeat(some["label"].to_numpy(), sizes), "blocks": np.repeat(some["block"].to_numpy(), sizes),
            "places": np.concatenate([np.arange(n) for n in sizes]), "read": np.repeat(marks, sizes, axis=1),
            "scores": scores(matrix(batch["vectors"], width), full),
        }
        return pd.DataFrame(reads(batch, rows), columns=names)

    return wanted.groupBy("batch", "slot").cogroup(stated.groupBy("batch", "slot")).applyInPandas(run, schema)


def best_first(rows: dict, at: int, among: np.ndarray) -> np.ndarray:
    """Numbers of the rows in `among`: higher scores first, then smaller ids, rows without one last."""
    return among[np.lexsort((rows["ids"][among], 1 - rows["known"][among], -rows["scores"][at, among]))]


def hard_negatives(
    vectors: DataFrame, label: Column, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES,
    least_percent: int = LEAST_PERCENT, most_percent: int = MOST_PERCENT, block_rows: int = BLOCK_ROWS, told: dict | None = None,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows of `vectors` (vec_id, embedding, and `label`, a column of it) whose id
    is divisible by `every`; positives the first other rows of the same label; negatives the
    first rows of other labels whose score lies between the two percentages of the positive's.
    Rows without a label or with a missing or infinite component take no part. Rows are told
    apart by their place, so repeated rows are rows of their own and may be each other's
    positives; rows without an id are no anchors and come last among equal scores. Shorter
    vectors end in zeros. An empty table gives no rows. `told`, if given, gets the number of
    (anchor, block) pairs and of those read for positives and for windows.
    """
    rows = taking_part(vectors, label)
    blocks, width = blocks_of(rows, block_rows)
    batches = anchor_batches(blocks, width, every, positives)
    n = blocks.count()
    shards, slots = max(1, -(-n // SHARD_BLOCKS)), max(1, -(-n // SLOT_BLOCKS))

    def near(batch, labels, least, largest):
        same = np.frombuffer(batch.labels, "<i8")[:, None] == labels[None, :]
        return same & (largest >= np.frombuffer(batch.least, "<f8")[:, None])

    def best(batch, rows):
        homes, places, out = np.frombuffer(batch["homes"], "<i8"), np.frombuffer(batch["places"], "<i8"), []
        for at in range(len(homes)):
            itself = (rows["blocks"] == homes[at]) & (rows["places"] == places[at])
            for j in best_first(rows, at, np.flatnonzero(rows["read"][at] & ~itself))[:positives]:
                out.append((batch["batch"], at, int(rows["ids"][j]) if rows["known"][j] else None, int(rows["scores"][at, j])))
        return out

    nearest = written(chosen_blocks(batches, blocks, width, shards, near), "chosen")
    first = read_blocks(batches, blocks, nearest, width, slots, best, "batch long, at int, positive_id long, positive_score long")
    by_score = Window.partitionBy("batch", "at").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"))
    pairs = written(first.withColumn("p", F.row_number().over(by_score)).where(F.col("p") <= positives), "positives")
    windows = written(batches.join(pairs.groupBy("batch").agg(F.collect_list(F.struct("at", "p", "positive_id", "positive_score")).alias("pairs")), "batch"), "windows")

    def window_of(score: int) -> tuple[int, int]:
        """Whole scores between the percentages of a positive's score."""
        return -(-least_percent * score // 100), most_percent * score // 100

    def meeting(batch, labels, least, largest):
        marks = np.zeros(least.shape, dtype=bool)
        for pair in batch.pairs:
            low, high = window_of(int(pair["positive_score"]))
            if low <= high:
                marks[pair["at"]] |= (largest[pair["at"]] >= low) & (least[pair["at"]] <= high)
        return marks & (np.frombuffer(batch.labels, "<i8")[:, None] != labels[None, :])

    def inside(batch, rows):
        anchors, out, pairs = np.frombuffer(batch["anchors"], "<i8"), [], {}
        for pair in batch["pairs"]:
            pairs.setdefault(pair["at"], []).append((pair["p"], pair["positive_id"], int(pair["positive_score"])))
        for at, own in pairs.items():
            spans = [window_of(score) for _, _, score in own]
            fit = rows["read"][at] & (rows["scores"][at] >= min(low for low, _ in spans)) & (rows["scores"][at] <= max(high for _, high in spans))
            order = best_first(rows, at, np.flatnonzero(fit))
            falling = -rows["scores"][at, order]
            for (p, positive, score), (low, high) in zip(own, spans):
                start, end = np.searchsorted(falling, -high, "left"), np.searchsorted(falling, -low, "right")
                for j in order[start : min(end, start + negatives)]:
                    out.append((batch["batch"], at, p, int(anchors[at]), positive, int(rows["ids"][j]) if rows["known"][j] else None, score, int(rows["scores"][at, j])))
        return out

    chosen = written(chosen_blocks(windows, blocks, width, shards, meeting), "chosen")
    if told is not None:
        read = F.sum(F.octet_length("wanted") / 4).cast("long")
        told.update(pairs=n * (batches.agg(F.sum(F.octet_length("anchors") / 8).cast("long")).first()[0] or 0), positives=nearest.agg(read).first()[0], windows=chosen.agg(read).first()[0])
    met = read_blocks(
        windows, blocks, chosen, width, slots, inside,
        "batch long, at int, p int, anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long",
    )
    by_score = Window.partitionBy("batch", "at", "p").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    return met.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
