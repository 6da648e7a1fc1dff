"""Document quality by a byte-level convolutional network in numpy.

A text is bytes; each byte has a learned embedding, and filters of `WIDTH` bytes slide over
it. The text is cut into chunks of `CHUNK` filter positions that overlap by a third and cover
it to its end; a filter's answer in a chunk is its largest. Over the chunks of a document the
mean and the maximum of each filter are taken and combined into one probability. Because
embedding and filter are linear, their product is kept as one table per filter column, and
the answers at all positions are sums of table rows.

Training uses plain numpy with Adam on a bounded sample: at most `MOST_OF_LABEL` rows of each
label, drawn by a hash of the id; the maxima pass their gradient to the window they came from.
Every text of the sample is used whole, every text of the table is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewatch.llm.common import crc_remainder, documents, share_by_hash, slices, utf8_values

WIDTH, FILTERS, EMBEDDED = 8, 12, 6
STEP, PARTS = 32, 3  # a chunk is PARTS blocks of STEP positions; chunks begin every PARTS - 1 blocks
CHUNK = STEP * PARTS
STRIDE = PARTS - 1
MOST_OF_LABEL = 1_200
LONGEST = 50_000  # bytes of a text that is trained on
EPOCHS, BATCH_BYTES, RATE = 8, 150_000, 0.01
THRESHOLD = 0.3
PIECE = 4_096  # blocks worked on at a time: bounds the memory of long texts


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, first chunk of each text): texts one after another, padded to whole chunks.

    Every text has at least one chunk; padding is byte 0 and a last block keeps the windows
    of one text from reaching into the next.
    """
    unit = STEP * STRIDE
    counts = np.array([max(1, -(-len(t) // unit)) for t in texts], dtype=np.int64)
    data = b"".join(t + bytes(int(c) * unit - len(t)) + bytes(unit) for t, c in zip(texts, counts))
    return np.frombuffer(data, dtype=np.uint8), np.concatenate([[0], np.cumsum(counts + 1)])


@dataclass
class Network:
    """Parameters; small enough to travel with the tasks."""

    embedding: np.ndarray  # 256 x EMBEDDED
    filters: np.ndarray  # WIDTH x EMBEDDED x FILTERS
    bias: np.ndarray  # FILTERS
    weights: np.ndarray  # 2 x FILTERS
    offset: np.ndarray  # 1
    scale: tuple[float, float] = (1.0, 0.0)  # slope and shift of the logit, fitted on texts not trained on

    def tables(self) -> np.ndarray:
        return np.einsum("be,kef->kbf", self.embedding, self.filters).astype(np.float32)

    def block_maxima(self, data: np.ndarray, tables: np.ndarray, where: bool = False):
        """Largest answer of each filter in each block of STEP positions, and its position if asked."""
        n = len(data) // STEP
        maxima = np.empty((n, FILTERS), np.float32)
        places = np.empty((n, FILTERS), np.int64) if where else None
        padded = np.concatenate([data, np.zeros(WIDTH, np.uint8)])
        for low in range(0, n, PIECE):
            high = min(n, low + PIECE)
            part = padded[low * STEP : high * STEP + WIDTH]
            size = (high - low) * STEP
            answers = tables[0][part[:size]]
            for k in range(1, WIDTH):
                answers += tables[k][part[k : k + size]]
            answers = answers.reshape(high - low, STEP, FILTERS)
            maxima[low:high] = answers.max(axis=1)
            if where:
                places[low:high] = answers.argmax(axis=1) + (np.arange(low, high) * STEP)[:, None]
        return maxima, places

    def probabilities(self, texts: list[bytes], tables: np.ndarray) -> np.ndarray:
        """One probability per text; an empty one is a chunk of padding."""
        data, first = laid_out(texts)
        maxima, _ = self.block_maxima(data, tables)
        maxima = np.concatenate([maxima, np.full((1, FILTERS), -np.inf, np.float32)])
        starts = np.arange(first[-1]) * STRIDE
        chunks = np.maximum.reduce([maxima[np.minimum(starts + j, len(maxima) - 1)] for j in range(PARTS)])
        chunks = np.maximum(chunks + self.bias.astype(np.float32), 0)
        out = np.empty(len(texts))
        for i in range(len(texts)):
            own = chunks[first[i] : first[i + 1] - 1].astype(np.float64)
            z = own.mean(axis=0) @ self.weights[0] + own.max(axis=0) @ self.weights[1] + self.offset[0]
            out[i] = 1 / (1 + np.exp(-np.clip(self.scale[0] * z + self.scale[1], -30, 30)))
        return out


class Adam:
    def __init__(self, shapes: list[np.ndarray], rate: float) -> None:
        self.m, self.v = [np.zeros_like(s) for s in shapes], [np.zeros_like(s) for s in shapes]
        self.rate, self.t = rate, 0

    def step(self, values: list[np.ndarray], slopes: list[np.ndarray]) -> None:
        self.t += 1
        for value, slope, m, v in zip(values, slopes, self.m, self.v):
            m += 0.1 * (slope - m)
            v += 0.001 * (slope * slope - v)
            value -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def train(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, seed: int = 7, epochs: int = EPOCHS) -> Network:
    """Fit on whole texts; `weights` says how many rows each stands for."""
    draw = np.random.default_rng(seed)
    net = Network(
        draw.normal(0, 0.5, (256, EMBEDDED)), draw.normal(0, 0.5, (WIDTH, EMBEDDED, FILTERS)), np.zeros(FILTERS),
        draw.normal(0, 0.1, (2, FILTERS)), np.zeros(1),
    )
    values = [net.embedding, net.filters, net.bias, net.weights, net.offset]
    adam = Adam(values, RATE)
    for epoch in range(epochs):
        adam.rate = RATE * (1 - epoch / epochs) + RATE / 20
        order = draw.permutation(len(texts))
        held: list[int] = []
        size = 0
        for number, i in enumerate(order.tolist()):
            held.append(i)
            size += len(texts[i])
            if size >= BATCH_BYTES or len(held) >= 48 or number == len(order) - 1:
                adam.step(values, slopes_of(net, [texts[j] for j in held], labels[held], weights[held]))
                held, size = [], 0
    return net


def slopes_of(net: Network, texts: list[bytes], labels: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """Gradients of the weighted log loss of a batch."""
    data, first = laid_out(texts)
    maxima, places = net.block_maxima(data, net.tables(), where=True)
    maxima = np.concatenate([maxima, np.full((1, FILTERS), -np.inf, np.float32)])
    places = np.concatenate([places, np.zeros((1, FILTERS), np.int64)])
    chunk = np.concatenate([np.arange(first[i], first[i + 1] - 1) for i in range(len(texts))])
    owner = np.repeat(np.arange(len(texts)), np.diff(first) - 1)
    begin = np.concatenate([[0], np.cumsum(np.diff(first) - 1)])
    options = np.stack([maxima[np.minimum(chunk * STRIDE + j, len(maxima) - 1)] for j in range(PARTS)])
    best = options.argmax(axis=0)
    top = np.take_along_axis(options, best[None], 0)[0] + net.bias
    columns = np.arange(FILTERS)
    at = places[np.minimum(chunk[:, None] * STRIDE + best, len(maxima) - 1), columns]
    answer = np.maximum(top, 0)
    count = np.diff(begin)
    mean = np.add.reduceat(answer, begin[:-1], axis=0) / count[:, None]
    most = np.maximum.reduceat(answer, begin[:-1], axis=0)
    z = mean @ net.weights[0] + most @ net.weights[1] + net.offset[0]
    share = weights / weights.sum()
    slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * share
    to_mean = slope[:, None] * net.weights[0] / count[:, None]
    to_most = slope[:, None] * net.weights[1]
    back = to_mean[owner] + to_most[owner] * (answer == most[owner])
    back = np.where(top > 0, back, 0.0)
    table = np.zeros((WIDTH, 256, FILTERS))
    padded = np.concatenate([data, np.zeros(WIDTH, np.uint8)])
    flat = back.ravel()
    for k in range(WIDTH):
        seen = padded[at + k].astype(np.int64) * FILTERS + columns
        table[k] = np.bincount(seen.ravel(), flat, 256 * FILTERS).reshape(256, FILTERS)
    return [
        np.einsum("kbf,kef->be", table, net.filters) + 1e-5 * net.embedding,
        np.einsum("kbf,be->kef", table, net.embedding) + 1e-5 * net.filters,
        back.sum(axis=0),
        np.stack([slope @ mean, slope @ most]) + 1e-5 * net.weights,
        np.array([slope.sum()]),
    ]


def scaled(net: Network, texts: list[bytes], labels: np.ndarray, weights: np.ndarray) -> Network:
    """Set slope and shift of the logit by Newton steps on texts that were not trained on."""
    p = np.clip(net.probabilities(texts, net.tables()), 1e-9, 1 - 1e-9)
    x = np.stack([np.log(p / (1 - p)), np.ones(len(p))])
    share = weights / weights.sum()
    theta, ridge = np.array([1.0, 0.0]), np.array([1e-4, 1e-4])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(theta @ x, -30, 30)))
        slope = x @ (share * (q - labels)) + ridge * (theta - [1.0, 0.0])
        curve = (x * (share * q * (1 - q))) @ x.T + np.diag(ridge)
        theta = theta - np.clip(np.linalg.solve(curve, slope), -1, 1)
    net.scale = (float(theta[0]), float(theta[1]))
    return net


def train_and_scale(texts: list[bytes], labels: np.ndarray, weights: np.ndarray) -> Network:
    """Train on four fifths, scale the logit on the rest; small samples are not split."""
    rest = np.arange(len(texts)) % 5 == 0
    if min((labels[rest] == y).sum() for y in (0, 1)) < 10:
        return train(texts, labels, weights)
    part = lambda keep: ([t for t, k in zip(texts, keep) if k], labels[keep], weights[keep])
    return scaled(train(*part(~rest)), *part(rest))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_OF_LABEL) -> Network | float:
    """Learn from labelled rows that are not held out; with fewer than two labels, their share."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(label) > 0).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (crc_remainder(F.col("doc_id"), 5) != 0))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return 1.0 if totals.get(1) else 0.0 if totals else 0.5
    chosen = [
        r for y in (0, 1) for r in share_by_hash(known.where(F.col("label") == y), totals[y], most, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    ]
    ids = docs.sparkSession.createDataFrame([(r["doc_id"], r["label"]) for r in chosen], "doc_id long, label int")
    # At most 2 x `most` rows, one per id and none above LONGEST bytes: a broadcast and a collect of bounded size.
    short = documents(docs).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= LONGEST)
    rows = short.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["text"] or ""))
    own = np.array([r["label"] for r in rows], float)
    counts = {y: max(1, int((own == y).sum())) for y in (0, 1)}
    weights = np.array([totals[r["label"]] / counts[r["label"]] for r in rows])
    if not len(own):
        return totals[1] / sum(totals.values())
    return train_and_scale([(r["text"] or "").encode() for r in rows], own, weights)


def scored(docs: DataFrame, model: Network | float, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted for every row; null texts count as empty, repeated rows give a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = None if isinstance(model, float) else model.tables()
        for batch in slices(batches, 2_000_000):
            texts = utf8_values(batch.column("text"))
            scores = np.full(len(texts), model) if tables is None else model.probabilities(texts, tables)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32), pa.int32())],
                names=["doc_id", "score", "predicted"],
            )

    return documents(docs).mapInArrow(run, "doc_id long, score double, predicted int")
