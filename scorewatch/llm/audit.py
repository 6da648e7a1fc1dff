"""Interaction audit of document filters: what each one removes in every order.

Each document is reduced to a mask with one bit per filter it fails, and the documents to
counts per part and mask, 2^n cells at most. A Gray code then visits every subset of the
filters, toggling one at a time: each cell keeps the number of active filters it fails, and
the running survivors change by the cells whose number leaves or reaches zero. The states of
all subsets are stored; any step of any order is the difference of two of them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorewatch.llm.common import bounded_batches, slices, utf8_values, written

MARKS = re.compile(rb"[#$%&*|]")
NOT_CAPITALS = bytes(set(range(256)) - set(range(ord("A"), ord("Z") + 1)))
CONTINUED = bytes(range(0x80, 0xC0))  # second and later bytes of a code point in UTF-8

# A filter is told by its letter; it gets the UTF-8 of a text and its words and says whether the text fails.
Failure = Callable[[bytes, list[bytes]], bool]


def few_words(text: bytes, words: list[bytes], least: int = 200) -> bool:
    return len(words) < least


def repeats_words(text: bytes, words: list[bytes], least_percent: int = 50) -> bool:
    return 100 * len(set(words)) < least_percent * len(words)


def shouts(text: bytes, words: list[bytes], most_percent: int = 3) -> bool:
    return 100 * len(text.translate(None, NOT_CAPITALS)) > most_percent * len(text.translate(None, CONTINUED))


def holds_marks(text: bytes, words: list[bytes]) -> bool:
    return MARKS.search(text) is not None


FILTERS: dict[str, Failure] = {"A": few_words, "B": repeats_words, "C": shouts, "D": holds_marks}
REPEATED = "E"  # fails where a smaller id has the same text


def text_masks(docs: DataFrame, filters: dict[str, Failure]) -> DataFrame:
    """doc_id, part, digest, mask, n: rows of `docs` that agree in all of these, counted.

    Words are the maximal runs without ASCII white space. Null texts count as empty, null
    languages as the empty part.
    """
    checks = list(filters.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            digests, masks = [], []
            for text in utf8_values(batch.column("text")):
                words = text.split()
                digests.append(hashlib.sha256(text).digest())
                masks.append(sum(1 << bit for bit, fails in enumerate(checks) if fails(text, words)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), pa.array(digests, pa.binary()), pa.array(masks, pa.int64())],
                names=["doc_id", "part", "digest", "mask"],
            )

    bounded_batches(docs.sparkSession)
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
        .mapInArrow(run, "doc_id long, part string, digest binary, mask long")
        .groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    )


def cells(docs: DataFrame, labels: DataFrame, filters: dict[str, Failure] = FILTERS) -> DataFrame:
    """part, mask, kept, good, toxic: documents by the filters they fail; bit n is `REPEATED`.

    Rows without an id have no label and are never repeats; rows that share the smallest id of
    a text are all first. Labels given several times count if any row says 1.
    """
    repeated = F.lit(1 << len(filters)).cast("long")
    masks = written(text_masks(docs, filters), "masks")
    marked = written(
        labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic")),
        "labels",
    )
    zero = F.lit(0).cast("long")
    known = masks.where("doc_id is not null").join(marked, "doc_id", "left").withColumns({c: F.coalesce(c, zero) for c in ("good", "toxic")})
    # One row per text, part and label first; only then do the parts of a text meet.
    groups = known.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("first"))
    smallest = F.min("first.doc_id").over(Window.partitionBy("digest"))
    passing = F.when(F.col("first.doc_id") == smallest, F.col("first.n")).otherwise(zero)
    told = groups.withColumn("passing", passing).select(
        "part", "good", "toxic",
        F.explode(F.array(
            F.struct(F.col("mask"), F.col("passing").alias("n")),
            F.struct((F.col("mask") + repeated).alias("mask"), (F.col("n") - F.col("passing")).alias("n")),
        )).alias("cell"),
    ).select("part", "cell.mask", "cell.n", "good", "toxic")
    unknown = masks.where("doc_id is null").select("part", "mask", "n", zero.alias("good"), zero.alias("toxic"))
    return told.unionByName(unknown).groupBy("part", "mask").agg(
        F.sum("n").alias("kept"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    )


def gray_walk(masks: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Survivors of every subset of n filters: a row per subset (as bits), a column per count."""
    active, survivors = np.zeros(len(masks), dtype=np.int64), counts.sum(axis=0)
    states = np.zeros((1 << n, counts.shape[1]), dtype=np.int64)
    states[0], subset = survivors, 0
    for step in range(1, 1 << n):
        bit = (step & -step).bit_length() - 1
        fails = (masks >> bit & 1).astype(bool)
        subset ^= 1 << bit
        if subset >> bit & 1:
            survivors = survivors - counts[fails & (active == 0)].sum(axis=0)
            active[fails] += 1
        else:
            active[fails] -= 1
            survivors = survivors + counts[fails & (active == 0)].sum(axis=0)
        states[subset] = survivors
    return states


STEPS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Failure] = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, zeros included; no documents give no rows.

    removed, good_lost, toxic_lost: what this step takes; redundant: fails its filter but was
    removed earlier; unique_fails: fails this filter alone; shapley: what the filter removes,
    summed over all orders (divided by their number it is the Shapley value).
    """
    names = [*filters, REPEATED]
    n = len(names)

    def steps(part: pd.DataFrame) -> pd.DataFrame:
        states = gray_walk(part["mask"].to_numpy(), part[["kept", "good", "toxic"]].to_numpy(np.int64), n)
        kept, whole = states[:, 0], (1 << n) - 1
        fails = [int(kept[0] - kept[1 << f]) for f in range(n)]
        unique = [int(kept[whole ^ 1 << f] - kept[whole]) for f in range(n)]
        # A filter follows the subset `before` in |before|! (n - 1 - |before|)! orders.
        shapley = [
            sum(int(kept[s] - kept[s | 1 << f]) * factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()) for s in range(1 << n) if not s >> f & 1)
            for f in range(n)
        ]
        rows, label = [], part["part"].iloc[0]
        for order in permutations(range(n)):
            before, spelled = 0, "".join(names[f] for f in order)
            for step, f in enumerate(order, 1):
                lost = states[before] - states[before | 1 << f]
                before |= 1 << f
                rows.append((label, spelled, step, kept[before], lost[0], fails[f] - lost[0], unique[f], lost[1], lost[2], shapley[f]))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in STEPS.split(", ")])

    return cells(docs, labels, filters).groupBy("part").applyInPandas(steps, STEPS)
