"""Byte-level BPE: vectorised pre-tokenisation by class arrays and scans, cached pair merging.

Texts are laid end to end as one array of code points. Each code point has a class; each
class is a transition function on a few automaton states. Functions compose associatively,
so the state before every position comes from a blocked scan over function numbers (a table
holds the composition of any two), without a regular expression and without a loop over
characters. The state, the class and two looked-ahead classes decide where pieces begin.
Pieces are slices of the UTF-8 bytes; their ids come from a cache or from merging the
lowest-ranked neighbours, for all pieces not in the cache at once. Offsets of the ids are kept, so ids can be decoded per document.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
import unicodedata
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scorewatch.llm.common import documents, slices

# Classes of code points: letters that take part in contractions have their own.
LETTER, NUMBER, OTHER, SPACE, BLANK, QUOTE, EDGE = 0, 1, 2, 3, 4, 5, 6
LETTER_S, LETTER_T, LETTER_M, LETTER_D, LETTER_R, LETTER_V, LETTER_L, LETTER_E = range(7, 15)
CLASSES = 15
OF_LETTER = {"s": LETTER_S, "t": LETTER_T, "m": LETTER_M, "d": LETTER_D, "r": LETTER_R, "v": LETTER_V,
             "l": LETTER_L, "e": LETTER_E}
# White space of the pattern (Unicode property White_Space). Fixed values.
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004,
               0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# Automaton states: what the position before belongs to.
AT_START, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, AFTER_BLANK, ONE_MORE, TWO_MORE = range(8)
STATES = 8
# Symbols of the automaton: the broad classes and the quotes that may open a contraction.
SHORT_QUOTE, LONG_QUOTE = 6, 7
SYMBOL_EDGE = 8
SYMBOLS = 9

BLOCK = 64
CACHE_BYTES = 24_000_000  # of pieces and their ids, as counted by ENTRY_BYTES
ENTRY_BYTES = 190  # of a piece, its packed ids and their place in the cache
MERGED_TOGETHER = 20_000  # pieces
COPIED_TOGETHER = 16_384  # ids that are spelled or decoded at once
NO_RANK = np.int32(2**31 - 1)
BATCH_BYTES, SLICE_BYTES = 8_000_000, 1_000_000
LONG_PIECE = 48


def class_table() -> np.ndarray:
    """Class of every code point, by Unicode category."""
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    category = unicodedata.category
    for point in range(0x110000):
        first = category(chr(point))[0]
        if first == "L":
            table[point] = LETTER
        elif first == "N":
            table[point] = NUMBER
    table[WHITE_SPACE] = BLANK
    table[0x20] = SPACE
    table[0x27] = QUOTE
    for letter, number in OF_LETTER.items():
        table[ord(letter)] = number
    return table


def class_runs() -> tuple[np.ndarray, np.ndarray]:
    """The class table as classes and how many code points in a row have each."""
    table = class_table()
    at = np.flatnonzero(np.concatenate([[True], table[1:] != table[:-1]]))
    return table[at], np.diff(np.append(at, len(table)))


def _step(state: int, symbol: int) -> int:
    """Next state of the automaton."""
    if symbol == SYMBOL_EDGE:
        return AT_START
    if state == TWO_MORE:
        return ONE_MORE
    if state == ONE_MORE:
        return AT_START
    if symbol in (SHORT_QUOTE, LONG_QUOTE):
        if state in (IN_OTHER, AFTER_SPACE):
            return IN_OTHER
        return ONE_MORE if symbol == SHORT_QUOTE else TWO_MORE
    return {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER, SPACE: AFTER_SPACE, BLANK: AFTER_BLANK,
            QUOTE: IN_OTHER}[symbol]


def _begins(state: int, symbol: int, before_word: bool) -> bool:
    """Whether a piece begins at a symbol read in `state`; `before_word`: no white space follows.

    A blank in a run of white space begins a piece when it is the last one before a word.
    """
    if symbol == SYMBOL_EDGE or state == AT_START:
        return True
    if state in (ONE_MORE, TWO_MORE):
        return False
    if symbol in (SPACE, BLANK):
        return state not in (AFTER_SPACE, AFTER_BLANK) or before_word
    if state == AFTER_SPACE:
        return False
    if symbol == LETTER:
        return state != IN_LETTERS
    if symbol == NUMBER:
        return state != IN_NUMBERS
    return state != IN_OTHER


def scan_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(function of each symbol, composition table, image of each function and state, begins)."""
    functions = {tuple(range(STATES)): 0}
    images = [tuple(range(STATES))]
    of_symbol = []
    for symbol in range(SYMBOLS):
        image = tuple(_step(state, symbol) for state in range(STATES))
        if image not in functions:
            functions[image] = len(images)
            images.append(image)
        of_symbol.append(functions[image])
    at = 0
    while at < len(images):  # close the set under composition
        for number in set(of_symbol):
            image = tuple(images[number][s] for s in images[at])
            if image not in functions:
                functions[image] = len(images)
                images.append(image)
        at += 1
    image = np.array(images, dtype=np.int32)
    compose = np.empty((len(images), len(images)), dtype=np.uint16)
    for first in range(len(images)):
        for second in range(len(images)):
            compose[first, second] = functions[tuple(images[second][s] for s in images[first])]
    begins = np.array(
        [[[_begins(state, symbol, word) for word in (False, True)] for symbol in range(SYMBOLS)] for state in range(STATES)]
    )
    return np.array(of_symbol, dtype=np.uint16), compose, image.astype(np.uint8), begins


def prefix_functions(numbers: np.ndarray, compose: np.ndarray) -> np.ndarray:
    """Function composed of everything before each position: a blocked scan, exclusive."""
    n = len(numbers)
    if n <= BLOCK:
        out = np.zeros(n, dtype=np.uint16)
        for i in range(1, n):
            out[i] = compose[out[i - 1], numbers[i - 1]]
        return out
    rows = -(-n // BLOCK)
    padded = np.zeros(rows * BLOCK, dtype=np.uint16)
    padded[:n] = numbers
    steps = np.ascontiguousarray(padded.reshape(rows, BLOCK).T)
    inside = np.zeros((BLOCK + 1, rows), dtype=np.uint16)
    width = compose.shape[0]
    flat = compose.ravel()
    for k in range(BLOCK):
        inside[k + 1] = flat[inside[k].astype(np.int32) * width + steps[k]]
    before = prefix_functions(inside[BLOCK], compose)
    whole = flat[before.astype(np.int32)[None, :] * width + inside[:BLOCK]]
    return np.ascontiguousarray(whole.T).ravel()[:n]


class PieceFinder:
    """Boundaries of pieces in many texts at once."""

    def __init__(self, runs: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        """`runs`: the class table as `class_runs` gives it, so that a task need not look up every code point."""
        self.classes = class_table() if runs is None else np.repeat(*runs)
        self.of_symbol, self.compose, self.image, self.begins = scan_tables()
        broad = np.full(CLASSES, LETTER, dtype=np.uint8)
        broad[[NUMBER, OTHER, SPACE, BLANK, QUOTE]] = [NUMBER, OTHER, SPACE, BLANK, QUOTE]
        broad[EDGE] = SYMBOL_EDGE
        self.broad = broad

    def starts(self, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Byte offsets at which pieces begin; `data`: UTF-8 bytes, `edges`: where texts begin."""
        if not len(data):
            return np.zeros(0, dtype=np.int64)
        heads = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        kinds = self.classes[points]
        symbols = self.broad[kinds]
        count = len(points)
        first = np.zeros(count, dtype=bool)
        if len(heads) == len(data):
            first[edges[edges < len(data)]] = True
        else:
            first[np.searchsorted(heads, edges[edges < len(data)])] = True
        # Contractions: the quote, then one or two letters of the same text.
        quotes = np.flatnonzero(symbols == QUOTE)
        if len(quotes):
            kinds_more = np.concatenate([kinds, [EDGE, EDGE]])
            first_more = np.concatenate([first, [True, True]])
            one, two = kinds_more[quotes + 1], kinds_more[quotes + 2]
            same_one = ~first_more[quotes + 1]
            same_two = same_one & ~first_more[quotes + 2]
            short = same_one & np.isin(one, [LETTER_S, LETTER_T, LETTER_M, LETTER_D])
            long = same_two & (((one == LETTER_R) | (one == LETTER_V)) & (two == LETTER_E) | (one == LETTER_L) & (two == LETTER_L))
            symbols[quotes[short]] = SHORT_QUOTE
            symbols[quotes[long]] = LONG_QUOTE
        # A text that begins forgets what was before: its first symbol acts from AT_START.
        numbers = self.of_symbol[symbols]
        begin_at = np.flatnonzero(first)
        edge = self.of_symbol[SYMBOL_EDGE]
        numbers = numbers.copy()
        numbers[begin_at] = self.compose[edge, numbers[begin_at]]
        before = prefix_functions(numbers, self.compose)
        state = self.image[before, AT_START]
        state[begin_at] = AT_START
        blank = (symbols == SPACE) | (symbols == BLANK)
        word_next = np.zeros(count, dtype=np.uint8)
        word_next[:-1] = ~blank[1:] & ~first[1:]
        return heads[self.begins[state, symbols, word_next]]


class Merges:
    """Ids of pieces by rank-ordered pair merging, many pieces at once, with a cache of bounded bytes."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.spelled = [b"%d" % rank for rank in range(len(self.tokens))]
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        # Every way to put a token together from two: left, right, the token's rank.
        get = self.ranks.get
        pairs = [
            (left << 32 | right, rank)
            for token, rank in self.ranks.items()
            for i in range(1, len(token))
            if (left := get(token[:i])) is not None and (right := get(token[i:])) is not None
        ]
        pairs.sort()
        self.pair_keys, self.pair_ranks = np.array([k for k, _ in pairs], dtype=np.int64), np.array([r for _, r in pairs], dtype=np.int32)
        # As one array: what decoding and spelling copy from.
        self.token_size = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.token_at = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        self.digits = max(map(len, self.spelled)) + 1
        self.spelled_bytes = np.frombuffer(b"".join(t.rjust(self.digits - 1) + b" " for t in self.spelled), dtype=np.uint8).reshape(-1, self.digits)
        self.spelled_size = np.array([len(t) + 1 for t in self.spelled], dtype=np.int64)
        pairs = np.arange(65_536)
        self.first_ranks = self.ranks_of(self.single[pairs >> 8], self.single[pairs & 255])  # of two bytes
        self.known = {token: struct.pack("=i", rank) for token, rank in self.ranks.items()}
        self.cache, self.earlier = dict(self.known), {}
        self.most = len(self.known) + CACHE_BYTES // ENTRY_BYTES // 2

    def learn(self, pieces: Sequence[bytes]) -> None:
        """Put the packed ids of all `pieces` into the cache.

        A full cache becomes the earlier one; what is met again is taken over from it.
        """
        if len(self.cache) > self.most:
            self.cache, self.earlier = dict(self.known), self.cache
        missing = set(pieces).difference(self.cache)
        again = self.earlier.keys() & missing
        self.cache.update((p, self.earlier[p]) for p in again)
        missing = list(missing - again)
        short = [p for p in missing if len(p) <= LONG_PIECE]
        for at in range(0, len(short), MERGED_TOGETHER):
            part = short[at : at + MERGED_TOGETHER]
            self.cache.update(zip(part, self.merged(part)))
        self.cache.update((p, self._long(p)) for p in missing if len(p) > LONG_PIECE)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of what two neighbours make together, NO_RANK if nothing."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NO_RANK)

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each piece: rounds that merge the first of the lowest pairs in every piece."""
        lengths = np.array([len(p) for p in pieces])
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        ids = self.single[data]
        own = np.repeat(np.arange(len(pieces)), lengths)
        ranks = np.full(len(ids), NO_RANK, dtype=np.int32)  # of each id with the next one of its piece
        inner = np.flatnonzero(own[:-1] == own[1:])
        ranks[inner] = self.first_ranks[data[inner].astype(np.int32) << 8 | data[inner + 1]]
        out = [b""] * len(pieces)
        while len(ids):
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            counts = np.diff(np.append(starts, len(ids)))
            lowest = np.minimum.reduceat(ranks, starts)
            done = lowest == NO_RANK
            if done.any():
                packed = ids.tobytes()
                for piece, start, count in zip(own[starts[done]].tolist(), (4 * starts[done]).tolist(), (4 * counts[done]).tolist()):
                    out[piece] = packed[start : start + count]
                left = np.repeat(~done, counts)
                ids, own, ranks = ids[left], own[left], ranks[left]
                counts, lowest = counts[~done], lowest[~done]
                if not len(ids):
                    break
            at = np.flatnonzero(ranks == np.repeat(lowest, counts))
            at = at[np.concatenate([[True], own[at[1:]] != own[at[:-1]]])]
            ids[at] = lowest
            left = np.ones(len(ids), dtype=bool)
            left[at + 1] = False
            ids, own, ranks = ids[left], own[left], ranks[left]
            at = at - np.arange(len(at))
            # Only the merged id has new neighbours.
            for one in (at, at[at > 0] - 1):
                inside = one[(one + 1 < len(own))]
                same = own[inside] == own[np.minimum(inside + 1, len(own) - 1)]
                ranks[one] = NO_RANK
                ranks[inside[same]] = self.ranks_of(ids[inside[same]], ids[inside[same] + 1])
        return out

    def _long(self, piece: bytes) -> bytes:
        """The same merges with a heap, for pieces of any length."""
        n, get = len(piece), self.ranks.get
        end = list(range(1, n + 1))  # a part that begins at i ends before end[i]; 0: merged away
        left = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not end[i] or end[i] >= n or not end[end[i]] or end[end[i]] != stop:
                continue
            middle = end[i]
            end[i], end[middle] = stop, 0
            if stop < n:
                left[stop] = i
                if (r := get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (before := left[i]) >= 0 and (r := get(piece[before:stop])) is not None:
                heapq.heappush(heap, (r, before, stop))
        return array("i", [self.ranks[piece[i : end[i]]] for i in range(n) if end[i]]).tobytes()


class Codec:
    """Encode texts of a batch and decode the ids again."""

    def __init__(self, path: str, runs: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        self.finder, self.merges = PieceFinder(runs), Merges(path)

    def encode(self, texts: Sequence[bytes]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        data = b"".join(texts)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        edges = np.concatenate([[0], np.cumsum(lengths)])
        starts = self.finder.starts(np.frombuffer(data, dtype=np.uint8), edges[:-1][lengths > 0])
        cuts = starts.tolist() + [len(data)]
        bounds = np.searchsorted(starts, edges).tolist()
        pieces = [data[a:b] for a, b in zip(cuts, cuts[1:])]
        self.merges.learn(pieces)
        get = self.merges.cache.__getitem__
        for low, high in zip(bounds, bounds[1:]):
            yield np.frombuffer(b"".join(map(get, pieces[low:high])), dtype=np.int32)

    def spell(self, ids: np.ndarray) -> bytes:
        """Ids as decimal text, joined by spaces."""
        merges, place = self.merges, np.arange(self.merges.digits)
        parts = []
        for low in range(0, len(ids), COPIED_TOGETHER):
            part = ids[low : low + COPIED_TOGETHER]
            parts.append(merges.spelled_bytes[part][place >= merges.digits - merges.spelled_size[part][:, None]].tobytes())
        return b"".join(parts)[:-1]

    def decode(self, ids: np.ndarray) -> bytes:
        merges, parts = self.merges, []
        for low in range(0, len(ids), COPIED_TOGETHER):
            part = ids[low : low + COPIED_TOGETHER]
            size = merges.token_size[part]
            ends = np.cumsum(size)
            at = np.repeat(merges.token_at[part] - ends + size, size)
            at += np.arange(ends[-1])
            parts.append(merges.token_bytes[at].tobytes())
        return b"".join(parts)


def lists_of(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """A list column from one array a row, through one buffer."""
    ends = np.cumsum([0, *(len(a) for a in arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else [], kind))


def encode_ids(docs: DataFrame, path: str) -> DataFrame:
    """Ids of each text: doc_id, ids (array of int), ends (byte offset at which each id ends).

    Null texts count as empty and have no ids. Repeated rows and null ids give a row each.
    """

    runs = class_runs()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, runs)
        size = np.array([len(token) for token in codec.merges.tokens])
        for batch in slices(batches, SLICE_BYTES):
            texts = [b"" if x is None else x for x in batch.column("text").cast(pa.binary()).to_pylist()]
            encoded = list(codec.encode(texts))
            ends = [np.cumsum(size[ids], dtype=np.int64) for ids in encoded]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), lists_of(encoded, pa.int32()), lists_of(ends, pa.int64())],
                names=["doc_id", "ids", "ends"],
            )

    return documents(docs, batch_bytes=BATCH_BYTES).mapInArrow(run, "doc_id long, ids array<int>, ends array<long>")


def round_trip(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """Encode, then decode: doc_id, n_tokens, ids_sha256 (decimal ids), decoded_sha256 (bytes)
    and, if asked for, the ids themselves.

    `path`: ranks, one token a line. Null texts count as empty (no ids, digest of nothing).
    """

    runs = class_runs()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, runs)
        for batch in slices(batches, SLICE_BYTES):
            texts = [b"" if x is None else x for x in batch.column("text").cast(pa.binary()).to_pylist()]
            counts, digests, back, kept = [], [], [], []
            for ids in codec.encode(texts):
                counts.append(len(ids))
                digests.append(hashlib.sha256(codec.spell(ids)).hexdigest())
                back.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                if keep_ids:
                    kept.append(ids)
            columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(digests, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
            if keep_ids:
                columns["ids"] = lists_of(kept, pa.int32())
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")
    return documents(docs, batch_bytes=BATCH_BYTES).mapInArrow(run, schema)
