"""Token ids in flat binary files with 64-bit document offsets.

Documents are dealt into ranges of ids; each range is sorted and encoded by one task, which
writes three little-endian files: `.bin` (ids, uint16 or uint32), `.idx` (int64 offsets of
the documents in this file, one more than documents) and `.doc` (int64 document ids). File
names are never reused, and only the files named in the manifest of finished tasks count, so
a task that runs twice does no harm. Where each file stands in the whole sequence of tokens
is the prefix sum of the token counts of the ranges before it.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorewatch.llm.common import documents, id_bounds, id_range, pieces_of, slices, utf8_values, written
from scorewatch.llm.files import array_of, make_folder, open_store

NO_ID = -(2**63)  # stands for a null document id in a .doc file
CACHE_ENTRIES = 600_000
TAIL = b".,!?;:&$%*#()\"-"
LATIN_END = "\u0250"


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves, the others for the code points from 256 on.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class ChunkEncoder:
    """Ids of a text as bytes, through the library.

    The tokenizer splits at white space and drops it, so a text's ids are those of its
    chunks between ASCII white space, one after the other. Chunks already met come from a
    cache. A chunk of Latin letters, which no step but lower-casing changes or splits, goes to
    the library's model at once; letters before plain punctuation are two such parts. All
    other chunks go through the whole tokenizer in one call.
    """

    def __init__(self, path: str, dtype: str, lower: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype, self.lower = Tokenizer.from_file(path), dtype, lower
        self.code = "H" if np.dtype(dtype).itemsize == 2 else "I"
        self.letters = str.maketrans(dict(enumerate(byte_letters())))
        self.cache: dict[bytes, bytes] = {}

    def chunks(self, text: bytes) -> list[bytes]:
        # Lower case first where the tokenizer lowers anyway: fewer different chunks. Texts that
        # may hold a special token's name are left as they are.
        return (text.lower() if self.lower and b"<|" not in text else text).split()

    def packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def word(self, text: str) -> bytes:
        """Ids of Latin letters, as one word of the model."""
        if not text.isascii():
            text = text.lower().encode().decode("latin-1").translate(self.letters)
        return self.packed([t.id for t in self.tokenizer.model.tokenize(text)])

    def learn(self, wanted: set[bytes]) -> None:
        missing = wanted.difference(self.cache)
        if len(self.cache) + len(missing) > CACHE_ENTRIES:
            self.cache.clear()
            missing = wanted
        cache, others, joined = self.cache, set(), []
        for chunk in missing:
            core = chunk.rstrip(TAIL)
            text = core.decode()
            if self.lower and text.isalpha() and (text.isascii() and text.islower() or not text.isascii() and max(text) < LATIN_END and "\u0130" not in text):
                ids = cache.get(core)
                if ids is None:
                    ids = cache[core] = self.word(text)
                if len(core) < len(chunk):
                    tail = chunk[len(core) :]
                    others.add(tail)
                    joined.append((chunk, ids, tail))
            else:
                others.add(chunk)
        unknown = list(others.difference(cache))
        found = self.tokenizer.encode_batch_fast([c.decode() for c in unknown], add_special_tokens=False)
        cache.update((c, self.packed(e.ids)) for c, e in zip(unknown, found))
        cache.update((chunk, ids + cache[tail]) for chunk, ids, tail in joined)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = [self.chunks(t) for t in texts]
        self.learn(set().union(*split))
        get = self.cache.__getitem__
        return [b"".join(map(get, c)) for c in split]


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, dtype: str = "<u2", lower: bool = True
) -> DataFrame:
    """Write `docs` (doc_id, text) to token files under `folder`; returns the manifest.

    Manifest: piece, path (without ending), n_docs, n_tokens, base (tokens of all pieces
    before). Documents stand in ascending id order, null ids first, repeated ids by text;
    a null or empty text has only `end_id`. An empty table writes no file. `lower` says that
    the tokenizer is of the byte-level kind, lowers its input and splits letters from punctuation.
    """
    spark = docs.sparkSession
    make_folder(folder)
    tasks = pieces_of(spark)
    own = documents(docs)
    place = id_range(id_bounds(own, 2 * tasks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(tokenizer, dtype, lower)
        end = np.array([end_id], dtype=dtype)
        size = end.itemsize
        out, piece, offsets, ids, path = None, None, [0], [], ""

        def finish():
            out.close()
            store, at = open_store(path)
            for ending, values in ((".idx", offsets), (".doc", ids)):
                with store.open_output_stream(at + ending) as file:
                    file.write(np.array(values, dtype="<i8").tobytes())
            return pa.RecordBatch.from_pydict(
                {"piece": pa.array([piece], pa.int32()), "path": [path], "n_docs": [len(ids)], "n_tokens": [offsets[-1]]}
            )

        for batch in slices(batches):
            encoded = encoder.encode(utf8_values(batch.column("text")))
            for number, doc_id, data in zip(batch.column("piece").to_pylist(), batch.column("doc_id").to_pylist(), encoded):
                if number != piece:
                    if out is not None:
                        yield finish()
                    piece, offsets, ids = number, [0], []
                    path = f"{folder}/{number + 1:08d}-{uuid.uuid4().hex}"
                    store, at = open_store(path)
                    out = store.open_output_stream(at + ".bin")
                out.write(data + end.tobytes())
                offsets.append(offsets[-1] + len(data) // size + 1)
                ids.append(NO_ID if doc_id is None else doc_id)
        if out is not None:
            yield finish()

    files = (
        own.withColumn("piece", place("doc_id"))
        .repartition(tasks, "piece")
        .sortWithinPartitions("piece", "doc_id", "text")
        .select("piece", "doc_id", "text")
        .mapInArrow(run, "piece int, path string, n_docs long, n_tokens long")
    )
    # A row per file, so the ordered sum is small at any size of the input.
    before = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    manifest = written(files, "files")
    return written(manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))), "manifest")


def read_tokens(manifest: DataFrame, dtype: str = "<u2", with_ids: bool = False) -> DataFrame:
    """Read the files of a manifest: doc_id, start (ids of all documents before), n_tokens,
    ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and, if asked for, ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, n_docs, n_tokens, base in zip(*(batch.column(c).to_pylist() for c in ("path", "n_docs", "n_tokens", "base"))):
                tokens, offsets, ids = array_of(path + ".bin", dtype), array_of(path + ".idx", "<i8"), array_of(path + ".doc", "<i8")
                if len(ids) != n_docs or len(offsets) != n_docs + 1 or len(tokens) != n_tokens or offsets[-1] != n_tokens:
                    raise ValueError(f"{path}: its files do not fit each other or the manifest")
                for low in range(0, n_docs, 4096):
                    high = min(low + 4096, n_docs)
                    rows = [tokens[offsets[i] : offsets[i + 1]] for i in range(low, high)]
                    columns = {
                        "doc_id": pa.array(ids[low:high], pa.int64(), mask=ids[low:high] == NO_ID),
                        "start": pa.array(offsets[low:high] + base, pa.int64()),
                        "n_tokens": pa.array(np.diff(offsets[low : high + 1]), pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(r.astype("<u4").tobytes()) for r in rows], pa.int64()),
                    }
                    if with_ids:
                        columns["ids"] = pa.array([r.astype("int64") for r in rows], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return manifest.repartition(pieces_of(manifest.sparkSession), "piece").select("path", "n_docs", "n_tokens", "base").mapInArrow(run, schema)
