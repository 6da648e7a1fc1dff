"""SimHash near duplicates with BK-trees.

A fingerprint bit is set if more than half of the shingle hashes have it set. Equal
fingerprints are one node. Nodes meet in shards: by blocks of the fingerprint's bits (one
more block than the radius, so that any two within the radius agree in one), or, for wide
radii, by bands of minima over the shingle hashes. Each shard is a BK-tree whose children
are keyed by their integer Hamming distance to the parent; a search follows only edges within
the radius. A shard with too many nodes is split into several trees, each searched by all of
the shard's nodes; the searches of a tree are dealt over tasks and streamed past it. A tree
travels to its searches by the shuffle, as the trees of all shards together grow with the data
and so must not be broadcast.

Links are united within a shard as soon as they are found and leave it as stars, never as all
pairs; connected components follow by alternating star steps.

Where copies are dropped, the same search of 64-bit fingerprints and one of wider ones find
candidates: a node is a set of shingles, and each link is confirmed on the sets themselves
before its groups are united.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewatch.llm.common import bounded_batches, documents, slices, utf8_values, written
from scorewatch.session import broadcast_checked

SEED = 42
TREE_NODES = 50_000  # members of a tree
TREE_BYTES = 16_000_000  # of their texts, where links are confirmed
FEW = 256  # members of a large group that a set is compared with first
SEARCHES = 500_000  # searches of a tree in one task
MEMBER, BOTH, SEARCH = range(3)  # what a row is in its task; members come first


def shingle_digests(text: bytes, size: int) -> np.ndarray:
    """XXH64 of each word shingle, a row of 8 bytes (most significant first) each."""
    words = text.lower().split()
    if not words:
        return np.zeros((0, 8), np.uint8)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    count = max(1, len(words) - size + 1)
    last = ends[min(size, len(words)) - 1 :]
    digest = xxhash.xxh64_digest
    joined = b"".join([digest(line[a:b], SEED) for a, b in zip(starts[:count].tolist(), last.tolist())])
    return np.frombuffer(joined, np.uint8).reshape(count, 8)


def majority(digests: np.ndarray, words: int = 1) -> bytes:
    """Fingerprint of `words` x 64 bits; more than 64 come from further mixes of each hash."""
    if not len(digests):
        return bytes(8 * words)
    votes = np.zeros(64 * words, np.int64)
    for low in range(0, len(digests), 32_768):
        part = digests[low : low + 32_768]
        lanes = [part]
        if words > 1:
            values = part.reshape(-1).view(">u8").astype(np.uint64)
            with np.errstate(over="ignore"):
                for lane in range(1, words):
                    mix = (values + np.uint64(lane)) * np.uint64(0xBF58476D1CE4E5B9)
                    mix ^= mix >> np.uint64(29)
                    mix *= np.uint64(0x94D049BB133111EB)
                    mix ^= mix >> np.uint64(32)
                    lanes.append(mix.astype(">u8").view(np.uint8).reshape(-1, 8))
        votes += np.concatenate([bit_counts(x) for x in lanes])
    return np.packbits(2 * votes > len(digests)).tobytes()


def bit_counts(rows: np.ndarray) -> np.ndarray:
    """How many rows of 8 bytes have each bit set; 255 rows at a time fit a byte."""
    bits = np.unpackbits(rows, axis=1)
    whole = len(bits) // 255 * 255
    counts = bits[whole:].sum(axis=0, dtype=np.uint8).astype(np.int64)
    return counts + bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)


BASE = 3  # words of the shingles whose hashes those of longer ones are mixed from


def shingle_hashes(text: bytes, size: int, base: np.ndarray | None = None) -> np.ndarray:
    """A hash of each word shingle; `base`: the text's digests of BASE words, if known.

    A longer shingle is told by the shorter ones that cover it, so its words are not hashed again.
    """
    if base is None or size < BASE:
        base = shingle_digests(text, min(size, BASE))
    values = base.reshape(-1).view(">u8").astype(np.uint64)
    if size <= BASE or not len(values):
        return values
    count = len(values) - (size - BASE)
    if count < 1:  # fewer words than a shingle has
        return np.array([xxhash.xxh64_intdigest(base.tobytes(), SEED)], np.uint64)
    mixed = np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        for at in [*range(0, size - BASE, BASE), size - BASE]:
            mixed = (mixed ^ values[at : at + count]) * np.uint64(0x9FB21C651E98DF25)
            mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(32)
    return mixed


def shingle_set(text: bytes, size: int, base: np.ndarray | None = None) -> np.ndarray:
    """The different hashes of the word shingles, in order."""
    values = np.sort(shingle_hashes(text, size, base))
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def set_digest(values: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(values.tobytes())


class SetIndex:
    """Which of some sets have a Jaccard similarity of 0.8 at least with a given one; exact, over postings."""

    def __init__(self, sets: list[np.ndarray], members: np.ndarray) -> None:
        self.members, own = members, [sets[i] for i in members.tolist()]
        self.lengths = np.array([len(x) for x in own], np.int64)
        flat = np.concatenate([np.zeros(0, np.uint64), *own])
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        self.owner = np.repeat(np.arange(len(own), dtype=np.int32), self.lengths)[order]
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
        self.values, self.starts = flat[first], np.append(first, len(flat))

    def alike(self, mine: np.ndarray) -> list[int]:
        """Members alike; sets without hashes are equal."""
        if not len(mine):
            return self.members[self.lengths == 0].tolist()
        if not len(self.values):
            return []
        at = np.minimum(np.searchsorted(self.values, mine), len(self.values) - 1)
        at = at[self.values[at] == mine]
        size = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(size)
        held = np.repeat(self.starts[at] - ends + size, size) + np.arange(size.sum())
        both = np.bincount(self.owner[held], minlength=len(self.members))
        return self.members[5 * both >= 4 * (len(mine) + self.lengths - both)].tolist()


def band_factors(count: int) -> np.ndarray:
    """Odd numbers without a relation to each other.

    Were they multiples of one number, a hash whose product with that is small would be the least
    under all of them, and where two sets differ in it they would share no band at all.
    """
    made = np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            made = (made ^ made >> np.uint64(shift)) * np.uint64(factor)
    return made ^ made >> np.uint64(31) | np.uint64(1)


def bands(digests: np.ndarray, count: int, rows: int) -> list[int]:
    """One key per band: the minima of `rows` multiplications of the hashes, mixed together."""
    values = np.zeros(1, np.uint64) if not len(digests) else digests.reshape(-1).view(">u8").astype(np.uint64)
    keys = []
    with np.errstate(over="ignore"):
        factors = band_factors(count * rows)
        least = np.full(count * rows, 2**64 - 1, np.uint64)
        for low in range(0, len(values), 4_096):
            np.minimum(least, (values[None, low : low + 4_096] * factors[:, None]).min(axis=1), out=least)
        for band in range(count):
            key = np.uint64(band + 1)
            for row in range(rows):
                key = (key ^ least[band * rows + row]) * np.uint64(0x94D049BB133111EB)
                key ^= key >> np.uint64(31)
            keys.append(int(key.astype(np.int64)))
    return keys


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id and fingerprint (64 bits in hex). Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = [majority(shingle_digests(text, size)).hex() for text in utf8_values(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    return documents(docs).mapInArrow(run, "doc_id long, fingerprint string")


def set_signature(text: Column, size: int, words: int, band_count: int, band_rows: int, plain: int) -> Column:
    """fingerprint (`words` x 64 bits in hex, then 32 digits that tell sets apart), keys (of the bands) and
    plain (the 64-bit fingerprint of `plain` words) of a text, as a struct. Null counts as empty.

    Repeated shingles vote once, but for `plain`.
    """

    def apply(texts: pa.Array) -> pa.Array:
        prints, keys, plains = [], [], []
        for value in utf8_values(texts):
            base = shingle_digests(value, plain)
            values = shingle_set(value, size, base if plain == BASE else None)
            digests = values.astype(">u8").view(np.uint8).reshape(-1, 8)
            prints.append(majority(digests, words).hex() + set_digest(values))
            keys.append(bands(digests, band_count, band_rows))
            plains.append(majority(base).hex())
        made = [pa.array(prints, pa.string()), pa.array(keys, pa.list_(pa.int64())), pa.array(plains, pa.string())]
        return pa.StructArray.from_arrays(made, names=["fingerprint", "keys", "plain"])

    return F.arrow_udf(apply, "fingerprint string, keys array<long>, plain string")(text.cast("string"))


def bit_blocks(fingerprint: Column, bits: int, count: int) -> Column:
    """Keys of `count` blocks that cover all bits of a hexadecimal fingerprint of 64 bits."""
    if bits != 64:
        raise ValueError("blocks are cut from fingerprints of 64 bits; use bands for wider ones")
    value = F.conv(fingerprint, 16, -10).cast("long")
    cuts = [bits * i // count for i in range(count + 1)]
    keys = []
    for number, (low, high) in enumerate(zip(cuts, cuts[1:])):
        part = F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << (high - low)) - 1))
        keys.append(F.xxhash64(F.lit(number), part))
    return F.array(*keys)


class BKTree:
    """Nodes by integer Hamming distance to their parent."""

    def __init__(self, values: list[int]) -> None:
        self.values, self.children = values, [{} for _ in values]
        for number in range(1, len(values)):
            value, at = values[number], 0
            while True:
                distance = (values[at] ^ value).bit_count()
                child = self.children[at].get(distance)
                if child is None:
                    self.children[at][distance] = number
                    break
                at = child

    def within(self, value: int, radius: int, skip=None) -> Iterator[int]:
        """Numbers of the nodes at most `radius` away; subtrees that `skip` accepts are left out."""
        stack = [0] if self.values else []
        while stack:
            at = stack.pop()
            if skip is not None and skip(at):
                continue
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius:
                yield at
            stack += [child for key, child in self.children[at].items() if distance - radius <= key <= distance + radius]


class Shard:
    """One tree and the searches of it that came to one task.

    Members come first; the searches that follow are answered one at a time. Unions are kept
    between members only, so neither lists nor unions grow with the number of searches.

    A search leaves out subtrees that lie in its own group as a whole, which makes a dense
    group cost little more than its nodes. Which subtrees do is noted anew whenever the number
    of united groups has doubled, and after so many searches that noting stays a small part.

    With `size` the members are sets, not a tree: a search counts what it shares with each of
    them (`SetIndex`). Here too the largest group is noted when the unions have doubled, and
    what belongs to it is compared with the rest only.
    """

    def __init__(self, radius: int, digits: int | None = None, size: int | None = None) -> None:
        self.radius, self.digits, self.size = radius, digits, size
        self.names: list[str] = []
        self.sets: list[np.ndarray] = []
        self.searched: list[int] = []
        self.tree: BKTree | None = None

    def take(self, kind: int, name: str, text: bytes | None = None) -> Iterator[tuple[str, str]]:
        """Take a row; yield the link of a search that is no member."""
        if kind != SEARCH:
            if kind == BOTH:
                self.searched.append(len(self.names))
            self.names.append(name)
            if self.size:
                self.sets.append(shingle_set(text or b"", self.size))
            return
        self._grow()
        group = self._search_sets(shingle_set(text or b"", self.size)) if self.size else self._search(int(name[: self.digits], 16))
        if group is not None:
            yield name, self.names[group]

    def stars(self) -> Iterator[tuple[str, str]]:
        """The members' links, as stars around one of each group."""
        self._grow()
        for number, name in enumerate(self.names):
            if (root := self._root(number)) != number:
                yield name, self.names[root]

    def _grow(self) -> None:
        if self.tree is not None:
            return
        self.tree = BKTree([] if self.size else [int(name[: self.digits], 16) for name in self.names])
        self.parent = list(range(len(self.names)))
        self.united, self.next_note, self.count = 0, 8, 0
        if self.size:
            self.every, self.large = SetIndex(self.sets, np.arange(len(self.names))), None
            for number in self.searched:
                self._search_sets(self.sets[number], number)
            return
        self.whole: list[int | None] = [None if children else i for i, children in enumerate(self.tree.children)]
        for number in self.searched:
            self._search(self.tree.values[number], number)

    def _root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def _note(self) -> None:
        for at in range(len(self.names) - 1, -1, -1):  # children come after their parents
            own = self._root(at)
            below = (self.whole[child] for child in self.tree.children[at].values())
            self.whole[at] = own if all(w is not None and self._root(w) == own for w in below) else None

    def _search(self, value: int, own: int | None = None) -> int | None:
        """The group that a value belongs to, after uniting all groups it links; None without a link."""
        group = None if own is None else self._root(own)
        whole, root = self.whole, self._root
        for at in self.tree.within(value, self.radius, lambda i: group is not None and whole[i] is not None and root(whole[i]) == group):
            group = self._with(group, at)
        self.count += 1
        if self.united >= self.next_note or self.count % (len(self.names) // 32 + 8) == 0:
            self._note()
            self.next_note = max(8, 2 * self.united)
        return group

    def _with(self, group: int | None, at: int) -> int:
        """The group united with that of a member."""
        other = self._root(at)
        if group is not None and other != group:
            self.parent[max(group, other)] = other = min(group, other)
            self.united += 1
        return other

    def _search_sets(self, mine: np.ndarray, own: int | None = None) -> int | None:
        """As `_search`, for the members whose sets are alike."""
        group, index = None if own is None else self._root(own), self.every
        if self.large is not None:
            if group != self._root(self.large):
                for at in self.few.alike(mine):
                    group = self._with(group, at)
            if group == self._root(self.large):
                index = self.rest
        for at in index.alike(mine):
            group = self._with(group, at)
        if self.united >= self.next_note:
            self.next_note = max(8, 2 * self.united)
            roots = np.array([self._root(i) for i in range(len(self.names))])
            found, counts = np.unique(roots, return_counts=True)
            if 4 * counts.max() >= len(roots):
                self.large = int(found[counts.argmax()])
                self.few = SetIndex(self.sets, np.flatnonzero(roots == self.large)[:FEW])
                self.rest = SetIndex(self.sets, np.flatnonzero(roots != self.large))
        return group


def dealt(rows: DataFrame) -> DataFrame:
    """A row per place (key, tree, slice) of each member and search: `rows` has key and fingerprint.

    A tree has TREE_NODES members and, if `rows` has texts, TREE_BYTES of them on average; its
    searches are dealt over slices of SEARCHES; the members go to every slice. Keys of one row
    are left out.
    """
    text = [c for c in ("text",) if c in rows.columns]
    held = F.sum(F.octet_length("text")) / TREE_BYTES if text else F.lit(0)
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), held.alias("held")).where("n > 1")
    sizes = sizes.select("key", F.ceil(F.greatest(F.col("n") / TREE_NODES, F.coalesce("held", F.lit(0)))).cast("int").alias("trees"), F.ceil(F.col("n") / SEARCHES).cast("int").alias("parts"))
    sizes = broadcast_checked(sizes)  # written, so that the rows of a popular key need not pass one task
    home, own = (F.pmod(F.xxhash64("fingerprint", F.lit(seed)), F.col(n)).cast("int") for seed, n in ((7, "trees"), (11, "parts")))

    def place(tree: Column, part: Column, kind: Column) -> Column:
        return F.struct(tree.alias("tree"), part.alias("slice"), kind.alias("kind"))

    as_member = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda s: place(F.col("home"), s, F.when(s == F.col("own"), BOTH).otherwise(MEMBER)))
    others = F.filter(F.sequence(F.lit(0), F.col("trees") - 1), lambda t: t != F.col("home"))
    as_search = F.transform(others, lambda t: place(t, F.col("own"), F.lit(SEARCH)))
    placed = rows.join(sizes, "key").withColumns({"home": home, "own": own}).withColumn("place", F.explode(F.concat(as_member, as_search)))
    return placed.select("key", "place.tree", "place.slice", "place.kind", "fingerprint", *text)


def links(nodes: DataFrame, radius: int, digits: int | None = None, size: int | None = None) -> DataFrame:
    """Links (a, b) that connect all fingerprints within `radius` sharing a key.

    `nodes`: fingerprint (each once) and keys (array). Distances are exact; the links leave
    out only those that others already imply. The first `digits` of a fingerprint are its bits.
    With `size` the nodes have a text too, and those are linked whose sets of shingles of so
    many words are alike, however far their fingerprints lie apart.
    """
    bounded_batches(nodes.sparkSession)
    text = ["text"] if size else []
    rows = nodes.select(F.explode(F.array_distinct("keys")).alias("key"), "fingerprint", *text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, Shard(radius, digits, size)

        def batch_of(pairs: list[tuple[str, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            found: list[tuple[str, str]] = []
            texts = utf8_values(batch.column("text")) if size else [None] * batch.num_rows
            for *place, kind, name, words in zip(*(batch.column(c).to_pylist() for c in ("key", "tree", "slice", "kind", "fingerprint")), texts):
                if place != at:
                    found += shard.stars()
                    at, shard = place, Shard(radius, digits, size)
                found += shard.take(kind, name, words)
            yield batch_of(found)
        yield batch_of(list(shard.stars()))

    shards = dealt(rows).repartition("key", "tree", "slice").sortWithinPartitions("key", "tree", "slice", "kind", "fingerprint")
    return shards.mapInArrow(run, "a string, b string")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node connected with each node that has a link.

    Alternating large-star and small-star steps, each written to the shared folder, until
    every node hangs on its root.
    """
    def oriented(frame: DataFrame) -> DataFrame:
        return frame.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def weight(frame: DataFrame):
        row = frame.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    current = written(oriented(edges), "links")
    state = weight(current)
    while state[0]:
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).union(current.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = oriented(both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")))
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        current = written(oriented(small.select("e.a", "e.b")), "links")
        before, state = state, weight(current)
        if state == before:
            break
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(current.select("b", "b").distinct())


def with_components(prints: DataFrame, edges: DataFrame) -> DataFrame:
    """Add root and component_id, the smallest doc_id reachable over links, to `prints`.

    `prints`: doc_id, fingerprint. Rows without an id take part; a component whose ids
    are all null has a null component_id.
    """
    nodes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    roots = components(edges).withColumnRenamed("node", "fingerprint")
    joined = nodes.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    lowest = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.join(lowest, "root").select("fingerprint", "root", "component_id")
    # One fingerprint may hold a third of the rows: the large side is dealt by a salt.
    salts = 16
    salted = prints.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    copies = named.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(copies, ["fingerprint", "salt"]).drop("salt")


def plain_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) among `fingerprint`s whose 64-bit `plain` ones link, directly or over others.

    One star around the least of each component. The same search of BK-trees as
    `near_duplicates`.
    """
    pairs = written(prints.select("fingerprint", "plain").distinct(), "pairs")
    nodes = pairs.select(F.col("plain").alias("fingerprint")).distinct().withColumn("keys", bit_blocks(F.col("fingerprint"), 64, radius + 1))
    roots = components(links(nodes, radius)).withColumnsRenamed({"node": "plain", "root": "group"})
    grouped = pairs.join(roots, "plain", "left").select("fingerprint", F.coalesce("group", "plain").alias("group")).distinct()
    least = grouped.groupBy("group").agg(F.min("fingerprint").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return grouped.join(least, "group").where("fingerprint <> b").select(F.col("fingerprint").alias("a"), "b")


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint, component_id by 64-bit fingerprints of word shingles.

    Texts of fewer words than `size` are one shingle; texts without words (null too) have
    fingerprint zero and are linked like any other. Repeated rows give a row each.
    """
    prints = written(signatures(docs, size), "fingerprints")
    nodes = prints.select("fingerprint").distinct().withColumn("keys", bit_blocks(F.col("fingerprint"), 64, radius + 1))
    return with_components(prints, links(nodes, radius)).select("doc_id", "fingerprint", "component_id")


ROW, SIGN = "__row", "__sign"


def signed(docs: DataFrame, size: int = 5, band_count: int = 12, band_rows: int = 2, plain: int = 3) -> DataFrame:
    """`docs` with ROW, a number that tells rows apart, and SIGN, what `set_signature` gives; written once."""
    bounded_batches(docs.sparkSession)
    sign = set_signature(F.col("text"), size, DIGITS // 16, band_count, band_rows, plain)
    return written(docs.withColumns({ROW: F.monotonically_increasing_id(), SIGN: sign}), "signed")


DIGITS = 64  # of the bits in a fingerprint of `set_signature`


def copy_links(rows: DataFrame, size: int = 5, radius: int = 72, plain_radius: int = 2) -> DataFrame:
    """Links (a, b) among fingerprints of `signed` documents whose sets of shingles are alike.

    Candidates are of two kinds. Those that `near_duplicates` links: 64-bit fingerprints of
    `plain` words within `plain_radius`, found in BK-trees by blocks of their bits, which miss no
    pair within the radius. And, as copies often lie beyond it, sets whose 256-bit fingerprints
    are within `radius` and that share one of 12 bands of two minima; two sets of similarity 0.8 miss all of them once in 200,000 times,
    and differ in 39 bits on average with a deviation of about 6 (sets of four and five shingles
    in 48), so the radius leaves room for nearly four deviations at the least.

    Every two sets that candidates connect, directly or over others, are then compared as sets,
    however far their fingerprints lie apart and however large their group is: it is cut into
    parts of TREE_BYTES, and each is searched for all of its group. Texts travel to that once per part.
    """
    nodes = rows.groupBy(f"{SIGN}.fingerprint").agg(F.min(f"{SIGN}.keys").alias("keys"), F.min(ROW).alias(ROW))
    nodes = written(nodes, "nodes")
    candidates = links(nodes.select("fingerprint", "keys"), radius, DIGITS).unionByName(plain_links(rows.select(f"{SIGN}.*"), plain_radius))
    near = components(candidates).withColumnRenamed("node", "fingerprint")
    wanted = broadcast_checked(nodes.join(near, "fingerprint").select(ROW, F.array(F.xxhash64("root")).alias("keys")))
    texts = rows.select(ROW, f"{SIGN}.fingerprint", F.col("text").cast("string").alias("text"))
    return links(texts.join(wanted, ROW).drop(ROW), 0, DIGITS, size)


def similar_documents(
    docs: DataFrame, size: int = 5, radius: int = 72, band_count: int = 12, band_rows: int = 2, plain: int = 3, plain_radius: int = 2
) -> DataFrame:
    """doc_id, fingerprint, root, component_id for near copies of 0.8 similarity and more; see `copy_links`."""
    rows = signed(docs, size, band_count, band_rows, plain)
    prints = rows.select(F.col("doc_id").cast("long").alias("doc_id"), f"{SIGN}.fingerprint")
    return with_components(prints, copy_links(rows, size, radius, plain_radius)).select("doc_id", "fingerprint", "root", "component_id")


def one_of_each(
    docs: DataFrame, size: int = 5, radius: int = 72, band_count: int = 12, band_rows: int = 2, plain: int = 3, plain_radius: int = 2
) -> DataFrame:
    """`docs` with one row of each group of near copies (see `copy_links`): the one with the smallest id.

    All columns stay. Ties in the id fall to the smallest fingerprint, then to any one of the
    equal rows; null ids count as larger than all others.
    """
    rows = signed(docs, size, band_count, band_rows, plain)
    roots = components(copy_links(rows, size, radius, plain_radius)).withColumnRenamed("node", "fingerprint")
    doc_id = F.col("doc_id").cast("long")
    order = F.struct(doc_id.isNull().alias("none"), doc_id.alias("id"), f"{SIGN}.fingerprint", F.col(ROW).alias("row"))
    firsts = rows.groupBy(f"{SIGN}.fingerprint").agg(F.min(order).alias("k")).join(roots, "fingerprint", "left")
    keep = firsts.groupBy(F.coalesce("root", "fingerprint")).agg(F.min("k").alias("k")).select(F.col("k.row").alias(ROW))
    return rows.join(keep, ROW, "left_semi").drop(ROW, SIGN)
