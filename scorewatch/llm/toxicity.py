"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are words and beginnings of words (for inflected forms never seen) that occur clearly
more often in one label than the other, by chi-square and odds over the labelled sample; all
other words together are one more term, so that a vector also says how dense its marks are.
Inverse document frequencies count all documents. The
labelled examples lie in a block-max inverted index: postings by example number in aligned
blocks, and the largest weight of each term in each block. A search adds up a block's largest
weights, visits blocks in falling order of that bound, and stops when no block left can
reach the k-th best cosine, so its neighbours are those of a full scan. Votes weigh by
distance and by the rarity of their label, and isotonic regression over left-out examples
turns them into calibrated scores. The neighbours' ids stay as evidence.

The labelled sample is bounded: at most `MOST_OF_LABEL` rows of each label, drawn by a hash
of the id. Terms, examples and calibration come from it; label totals and document
frequencies are counted over all rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewatch.llm.common import crc_remainder, documents, share_by_hash, slices, text_column, written

WORD = re.compile(r"[^\W\d_]+")
MOST_OF_LABEL = 4_000  # labelled rows of each label that are learnt from
MOST_TERMS = 2_048
LEAST_DOCUMENTS, LEAST_CHI_SQUARE, LEAST_ODDS = 5, 30.0, 4.0
NEIGHBOURS = 15
BLOCK = 64
STEM = 5
NEAR = 0.05  # added to a neighbour's distance before it is inverted
DOUBT = 1.0  # weight of the label's share among all rows in each vote
THRESHOLD = 0.3


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def marks_of(words: list[str]) -> set[str]:
    """The words, and their beginnings marked by a star."""
    own = set(words)
    return own | {w[:STEM] + "*" for w in own if len(w) > STEM}


@dataclass
class BlockMaxIndex:
    """Exact top-k cosine over unit vectors of examples."""

    terms: int
    vectors: list[dict[int, float]]
    block: int = BLOCK
    postings: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.blocks = -(-len(self.vectors) // self.block)
        self.most = np.zeros((self.terms, max(self.blocks, 1)))
        lists: dict[tuple[int, int], list[tuple[int, float]]] = {}
        for number, vector in enumerate(self.vectors):
            for term, weight in vector.items():
                lists.setdefault((term, number // self.block), []).append((number % self.block, weight))
        for key, pairs in lists.items():
            weights = np.array([w for _, w in pairs])
            self.postings[key] = (np.array([n for n, _ in pairs]), weights)
            self.most[key] = weights.max()

    def search(self, query: dict[int, float], k: int, leave_out: int = -1) -> list[tuple[int, float]]:
        """The k best (example, cosine) above 0, ties by example number."""
        if not query or not self.blocks:
            return []
        bound = np.zeros(self.blocks)
        for term, weight in query.items():
            bound += weight * self.most[term]
        best: list[tuple[float, int]] = []
        for at in np.argsort(-bound, kind="stable").tolist():
            if bound[at] <= 0 or len(best) >= k and bound[at] < -best[k - 1][0] - 1e-9:
                break
            score = np.zeros(self.block)
            for term, weight in query.items():
                found = self.postings.get((term, at))
                if found is not None:
                    score[found[0]] += weight * found[1]
            floor = -best[k - 1][0] - 1e-9 if len(best) >= k else 0.0
            for slot in np.flatnonzero((score > 0) & (score >= floor)).tolist():
                number = at * self.block + slot
                if number != leave_out:
                    best.append((-round(float(score[slot]), 9), number))
            best = sorted(best)[:k]
        return [(number, -score) for score, number in best]


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the best non-decreasing fit of y by x (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # mean, weight, first x, last x
    for i in order.tolist():
        pools.append([float(y[i]), float(weight[i]), float(x[i]), float(x[i])])
        while len(pools) > 1 and (pools[-2][0] >= pools[-1][0] or pools[-2][3] == pools[-1][2]):
            mean, w, _, last = pools.pop()
            a = pools[-1]
            a[0], a[1], a[3] = (a[0] * a[1] + mean * w) / (a[1] + w), a[1] + w, last
    return np.array([p[j] for p in pools for j in (2, 3)]), np.array([p[0] for p in pools for _ in (2, 3)])


@dataclass
class Model:
    """Everything a task needs to score texts; of bounded size."""

    terms: dict[str, int]
    idf: list[float]
    ids: list[int]
    labels: list[int]
    vectors: list[dict[int, float]]
    vote_weight: tuple[float, float]
    base: float
    without: float  # score of texts without words
    knots: tuple[np.ndarray, np.ndarray] | None = None
    neighbours: int = NEIGHBOURS

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("index", "seen")}

    def vector(self, words: list[str]) -> dict[int, float]:
        """Unit vector of a text; the last term stands for all words without one. A model without terms has none."""
        if not self.terms:
            return {}
        get, counts, others = self.terms.get, Counter(), 0
        for word, n in Counter(words).items():
            own, stem = get(word), get(word[:STEM] + "*") if len(word) > STEM else None
            if own is not None:
                counts[own] += n
            if stem is not None:
                counts[stem] += n
            if own is None and stem is None:
                others += n
        if others:
            counts[len(self.terms)] = others
        weights = {t: (1 + math.log(n)) * self.idf[t] for t, n in sorted(counts.items())}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        return {t: w / norm for t, w in weights.items()} if norm else {}

    def vote(self, query: dict[int, float], leave_out: int = -1) -> tuple[float, list[tuple[int, float]]]:
        if "index" not in self.__dict__:
            self.index = BlockMaxIndex(len(self.idf), self.vectors)
        near = self.index.search(query, self.neighbours, leave_out)
        total, toxic = DOUBT, DOUBT * self.base
        for number, cosine in near:
            weight = self.vote_weight[self.labels[number]] / (NEAR + 1 - cosine)
            total += weight
            toxic += weight * self.labels[number]
        return toxic / total, near

    def score(self, text: str | None) -> tuple[float, list[tuple[int, float]]]:
        """(calibrated score, [(example number, cosine)])."""
        query = self.vector(words_of(text))
        if not query:
            return self.without, []
        seen = self.__dict__.setdefault("seen", {})
        key = tuple(query.items())
        if key not in seen:
            if len(seen) > 50_000:
                seen.clear()
            raw, near = self.vote(query)
            fitted = float(np.interp(raw, *self.knots)) if self.knots is not None else raw
            # A trace of the raw vote keeps the order within a flat stretch of the fit.
            seen[key] = (min(1.0, max(0.0, 0.99 * fitted + 0.01 * raw)), near)
        return seen[key]


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, positive, n): labelled documents that hold each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            every, positive = Counter(), Counter()
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                own = marks_of(words_of(text))
                every.update(own)
                if label:
                    positive.update(own)
            names = list(every)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([positive[t] for t in names], pa.int64()), pa.array([every[t] for t in names], pa.int64())],
                names=["term", "positive", "n"],
            )

    parts = docs.select("text", "label").mapInArrow(run, "term string, positive long, n long")
    return parts.groupBy("term").agg(F.sum("positive").alias("positive"), F.sum("n").alias("n"))


def document_frequencies(docs: DataFrame, terms: dict[str, int]) -> dict[str, int]:
    """Over all documents, for a bounded list of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = terms.keys()
        counts = Counter()
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                counts.update(wanted & marks_of(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    rows = docs.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    return {r["term"]: r["n"] for r in rows}


def training_rows(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) that may be learnt from: one row per id, held-out ids and nulls left out."""
    return (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(label) > 0).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (crc_remainder(F.col("doc_id"), 4) != 2))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST_OF_LABEL) -> Model:
    """Learn from the labelled rows that are not held out; tables without any give a flat model."""
    known = training_rows(labels, label)
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = [
        r for y in (0, 1) for r in share_by_hash(known.where(F.col("label") == y), totals.get(y, 0), most, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    ]
    own = documents(docs)
    flat = Model({}, [], [], [], [], (1.0, 1.0), 0.0, 0.0)
    if not sample:
        return flat
    spark = docs.sparkSession
    # At most 2 x `most` rows: small enough to go to every task.
    chosen = F.broadcast(spark.createDataFrame([(r["doc_id"], r["label"]) for r in sample], "doc_id long, label int"))
    # One row per id, the smallest text where an id repeats: at most 2 x `most` texts.
    learnt = written(own.join(chosen, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")), "learnt")
    found = {r["label"]: r["count"] for r in learnt.groupBy("label").count().collect()}
    counted = [found.get(y, 0) for y in (0, 1)]
    share = [totals.get(y, 0) / max(1, counted[y]) for y in (0, 1)]  # rows that each sampled row stands for
    base = totals.get(1, 0) / sum(totals.values())
    n0, n1 = map(float, counted)
    a, b = F.col("positive").cast("double"), (F.col("n") - F.col("positive")).cast("double")
    odds = ((a + 0.5) * (n0 - b + 0.5)) / ((b + 0.5) * (n1 - a + 0.5))
    gap = a * (n0 - b) - b * (n1 - a)
    # A word that stands in every text tells nothing and has no value here.
    chi = F.try_divide((n0 + n1) * gap * gap, (a + b) * (n0 + n1 - a - b) * n0 * n1)
    picked = (
        term_counts(learnt).withColumns({"odds": odds, "chi": chi})
        .where((F.col("n") >= LEAST_DOCUMENTS) & (F.col("chi") >= LEAST_CHI_SQUARE) & ((F.col("odds") >= LEAST_ODDS) | (F.col("odds") <= 1 / LEAST_ODDS)))
        .orderBy(F.desc("chi"), "term").limit(MOST_TERMS).select("term").collect()
    ) if n0 and n1 else []
    terms = {r["term"]: i for i, r in enumerate(picked)}
    if not terms:
        flat.base = flat.without = base
        return flat
    frequency = document_frequencies(own, terms)
    count = own.count()
    idf = [math.log((1 + count) / (1 + frequency.get(t, 0))) + 1 for t in terms] + [1.0]
    model = Model(terms, idf, [], [], [], (1.0, share[1] / share[0] if share[0] else 1.0), base, base)

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [model.vector(words_of(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array([list(r) for r in rows], pa.list_(pa.int32())),
                 pa.array([list(r.values()) for r in rows], pa.list_(pa.float64()))],
                names=["doc_id", "label", "terms", "weights"],
            )

    # Texts come back as a few weights each, for at most 2 x `most` labelled rows.
    rows = learnt.select("doc_id", "label", "text").mapInArrow(reduced, "doc_id long, label int, terms array<int>, weights array<double>").collect()
    # Examples of like density lie in the same blocks, which keeps the blocks' bounds tight.
    rows = sorted(rows, key=lambda r: (r["weights"][-1:], r["terms"], r["doc_id"], r["weights"]))
    # No search needs more than its number of neighbours, and one to leave out, of equal vectors.
    copies: Counter = Counter()
    bare = [share[r["label"]] * np.array([1, r["label"]]) for r in rows if not r["terms"]]
    held = []
    for r in rows:
        key = (tuple(r["terms"]), tuple(r["weights"]))
        copies[key] += 1
        if r["terms"] and copies[key] <= model.neighbours + 1:
            held.append(r)
    model.ids = [r["doc_id"] for r in held]
    model.labels = [r["label"] for r in held]
    model.vectors = [dict(zip(r["terms"], r["weights"])) for r in held]
    total = sum(bare, np.zeros(2))
    model.without = float((total[1] + base) / (total[0] + 1))
    if held:
        place: dict = {}  # an example of each vector and label, to be left out of its own vote
        for i, (v, y) in enumerate(zip(model.vectors, model.labels)):
            place.setdefault((tuple(v), tuple(v.values()), y), i)
        weight: Counter = Counter()  # over all rows, kept in the index or not
        for r in rows:
            if r["terms"]:
                weight[tuple(r["terms"]), tuple(r["weights"]), r["label"]] += share[r["label"]]
        keys = list(weight)
        raw = np.array([model.vote(dict(zip(k[0], k[1])), place.get(k, -1))[0] for k in keys])
        model.knots = isotonic(raw, np.array([k[2] for k in keys], float), np.array([weight[k] for k in keys]))
    return model


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted, neighbours (example ids, nearest first), cosines.

    Null and empty texts have no term and get the score of texts without words. Rows that repeat give
    a row each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [model.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([s for s, _ in found], pa.float64()), pa.array([int(s >= threshold) for s, _ in found], pa.int32()),
                 pa.array([[model.ids[n] for n, _ in near] for _, near in found], pa.list_(pa.int64())),
                 pa.array([[c for _, c in near] for _, near in found], pa.list_(pa.float64()))],
                names=["doc_id", "score", "predicted", "neighbours", "cosines"],
            )

    return documents(docs).mapInArrow(run, "doc_id long, score double, predicted int, neighbours array<long>, cosines array<double>")


def score_column(model: Model, text):
    """The score as a column, for frames that keep their other columns."""
    return text_column(lambda texts: [model.score(t)[0] for t in texts], "double")(text.cast("string"))
