"""Document fingerprints by winnowing.

Every k-gram of code points has a rolling hash; from each window of w neighbouring hashes the
smallest is kept, the rightmost of equals, with its position. Two texts that share at least
w + k - 1 code points in a row share a kept hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewatch.llm.common import documents, id_bounds, id_range, pieces_of, slices

GRAM, WINDOW = 20, 60
BASE = 0x9E3779B97F4A7C15  # odd, so that its powers can be undone modulo 2^64
UNDO = pow(BASE, -1, 2**64)
LOW = np.uint64(0xFFFFFFFF)
NO_ID = -(2**63)  # stands for a null id; such documents come last


def rolling(points: np.ndarray, gram: int) -> np.ndarray:
    """32-bit hash of every run of `gram` values: a polynomial from prefix sums."""
    n = len(points) - gram + 1
    with np.errstate(over="ignore"):
        powers, undone = np.full(len(points), BASE, dtype=np.uint64), np.full(n, UNDO, dtype=np.uint64)
        powers[0] = undone[0] = 1
        powers, undone = np.cumprod(powers), np.cumprod(undone)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers)])
        # Bring each difference to the lowest power, so that equal grams are equal anywhere.
        values = (sums[gram:] - sums[:n]) * undone
        values ^= values >> np.uint64(31)
        values *= np.uint64(0x7FB5D329728EA185)
        values ^= values >> np.uint64(29)
        values *= np.uint64(0x81DADEF4BC2DD44D)
    return values >> np.uint64(32)


def winnow(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) kept for a text; a text shorter than `gram` is one gram, an empty one none."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(points):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = rolling(points, min(gram, len(points)))
    n = len(hashes)
    # The position, counted down, in the low half makes the rightmost of equals the smallest.
    keys = (hashes << np.uint64(32)) | (LOW - np.arange(n, dtype=np.uint64))
    if n <= window:
        least = keys.min(keepdims=True)
    else:
        blocks = -(-n // window)
        grid = np.full(blocks * window, np.iinfo(np.uint64).max, dtype=np.uint64)
        grid[:n] = keys
        grid = grid.reshape(blocks, window)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(back[: n - window + 1], ahead[window - 1 : n])
        least = least[np.concatenate([[True], least[1:] != least[:-1]])]
    return least >> np.uint64(32), (LOW - (least & LOW)).astype(np.int64)


def spelled(hashes: np.ndarray) -> str:
    """The kept hashes in text order, eight hexadecimal digits each."""
    return hashes.astype(">u4").tobytes().hex()


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """Shared hashes by all hashes; two empty fingerprints are alike, one empty is not."""
    if not len(one) and not len(other):
        return 1.0
    shared = len(np.intersect1d(one, other))
    return shared / (len(np.unique(one)) + len(np.unique(other)) - shared)


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, fingerprint (hex), positions of each text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            kept = [winnow(t, gram, window) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([spelled(h) for h, _ in kept]), pa.array([p for _, p in kept], pa.list_(pa.int64()))],
                names=["doc_id", "n_chars", "fingerprint", "positions"],
            )

    return documents(docs).mapInArrow(run, "doc_id long, n_chars long, fingerprint string, positions array<long>")


def beside_next(docs: DataFrame, pieces: int) -> DataFrame:
    """Rows (piece, lent, doc_id, text) such that one task meets each document and the next.

    Ids are cut into ranges; the first document of each range is also lent to the range
    that comes before it in descending order (the very first one to the last range). Only
    these few rows are copied.
    """
    own = documents(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    place = id_range(id_bounds(own, pieces))
    placed = own.withColumn("piece", place("doc_id"))
    heads = {row["piece"]: row["head"] for row in placed.groupBy("piece").agg(F.max("doc_id").alias("head")).collect()}
    order = sorted(heads, reverse=True)
    lend = {heads[piece]: order[k - 1] for k, piece in enumerate(order)}

    def lent_to(ids: pd.Series) -> pd.Series:
        return ids.map(lend).astype("Int32")

    to = F.pandas_udf(lent_to, "int")("doc_id")
    return placed.withColumn("to", to).select(
        F.explode(F.when(F.col("to").isNull(), F.array(F.struct(F.lit(False).alias("lent"), "piece"))).otherwise(
            F.array(F.struct(F.lit(False).alias("lent"), "piece"), F.struct(F.lit(True).alias("lent"), F.col("to").alias("piece"))))).alias("at"),
        "doc_id", "text",
    ).select("at.piece", "at.lent", "doc_id", "text")


def edited_fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Each text's fingerprint against that of its edited text and of the next document.

    The edited text has its last floor(n/2) code points replaced by the first as many of the
    next document in descending id order (after the last one: the first). Equal ids are
    ordered by text, null ids come last, null texts count as empty.
    """
    tasks = pieces_of(docs.sparkSession)
    rows = beside_next(docs, 2 * tasks)

    def compare(doc_id: int, text: str, own, after: str, next_own) -> dict:
        n = len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        changed = winnow(edited, gram, window)
        return {
            "doc_id": None if doc_id == NO_ID else doc_id,
            "n_chars": n,
            "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(),
            "fingerprint": spelled(own[0]),
            "edited_fingerprint": spelled(changed[0]),
            "near_edited": likeness(own[0], changed[0]),
            "near_next": likeness(own[0], next_own[0]),
        }

    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (piece, doc_id, text, fingerprint) waiting for the next document
        for batch in slices(batches):
            out = []
            for piece, lent, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("piece", "lent", "doc_id", "text"))):
                if lent and held is None:
                    continue  # a further copy of the lent document
                text = text or ""
                own = winnow(text, gram, window)
                if held is not None:
                    out.append(compare(held[1], held[2], held[3], text, own))
                held = None if lent else (piece, doc_id, text, own)
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return (
        rows.repartition(tasks, "piece")
        .sortWithinPartitions("piece", "lent", F.desc("doc_id"), "text")
        .select("piece", "lent", "doc_id", "text")
        .mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    )
