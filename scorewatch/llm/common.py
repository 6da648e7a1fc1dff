"""Shared folder, interim tables, text batches and id ranges used by several operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INTERIM = "scorewatch-interim-"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; an own one only in local sessions without it."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="scorewatch-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{INTERIM}{uuid.uuid4().hex}/{label}"


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` as a table in the shared folder: cuts the lineage, survives lost executors."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH_BYTES = 4_000_000  # both sides of a worker hold a batch several times over, and an executor has several workers
_bounds = {2**31 - 1, BATCH_BYTES}  # the default, and what this package has set


def bounded_batches(spark: SparkSession, most_bytes: int = BATCH_BYTES) -> None:
    """Bound the bytes of the batches that Spark hands to Python, unless the user has done so.

    The default bounds rows only, so very long texts could fill a worker's memory. It is a
    setting of the session; each operator sets its own bound for the jobs that follow.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    _bounds.add(most_bytes)
    if int(spark.conf.get(name, str(2**31 - 1))) in _bounds:
        spark.conf.set(name, str(most_bytes))


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Only id and text, as long and string; other columns of the table are left alone."""
    bounded_batches(docs.sparkSession, batch_bytes)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def crc_remainder(id_col: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo `mod`; null ids count as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % mod


def share_by_hash(rows: DataFrame, total: int, most: int, *names: str) -> DataFrame:
    """Rows whose hash falls below a bound that leaves about `most` of `total` (a fifth more)."""
    if total <= most:
        return rows
    bound = int(2.0**64 * min(1.0, (1.2 * most + 50) / total)) - 2**63
    return rows.where(F.xxhash64(*names) < F.lit(min(bound, 2**63 - 1)).cast("long"))


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most about `most_bytes` (one row at least)."""
    for batch in batches:
        if batch.nbytes <= most_bytes or batch.num_rows <= 1:
            yield batch
            continue
        step = max(1, int(batch.num_rows * most_bytes / batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def utf8_values(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def text_column(function, kind: str):
    """A column function from a function of a list of texts (None allowed) to a list of values."""

    def apply(texts: pd.Series) -> pd.Series:
        return pd.Series(function(texts.tolist()), index=texts.index, dtype=object)

    return F.pandas_udf(apply, kind)


def id_bounds(docs: DataFrame, pieces: int) -> list[int]:
    """About `pieces` - 1 ids that cut the ids into ranges of equal row counts."""
    if pieces < 2:
        return []
    shares = [i / pieces for i in range(1, pieces)]
    row = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * pieces)).alias("q")).first()
    return sorted(set(row.q or []))


def id_range(bounds: list[int]):
    """Column function: number of the range an id falls into, null ids first (-1)."""
    edges = np.array(bounds, dtype=np.int64)

    def place(ids: pd.Series) -> pd.Series:
        known = ids.notna()
        where = np.searchsorted(edges, ids.where(known, 0).astype("int64").to_numpy(), side="left")
        return pd.Series(np.where(known, where, -1).astype("int32"), index=ids.index)

    return F.pandas_udf(place, "int")


def pieces_of(spark: SparkSession) -> int:
    """Tasks of a shuffle, as the session sets them."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
