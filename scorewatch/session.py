"""Session set-up and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(
    app: str = "scorewatch",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **conf: str,
) -> SparkSession:
    """A session with the settings the library expects (AQE, skew join, UTC).

    Shuffles begin with `shuffle_partitions` pieces and are merged by size from there, so on
    large data it should be set so high that a piece fits into a task.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


MB = 1024 * 1024
TASK_INPUT = 8 * MB  # of a file that a task reads
TASK_SHUFFLE = 16 * MB  # of a shuffle that a task reads
SHUFFLE_PIECES = 200  # that a shuffle begins with; small ones are merged, and up to 200 are written without a sort


def sized(spark: SparkSession) -> SparkSession:
    """Settings that hold what one task reads steady while the data grow, on any session.

    By default Spark merges pieces up to four times as large and no further than to one piece per
    core, so on a session of few cores or shuffle partitions a task grows with the data. Settings
    that are finer already stay.
    """
    pieces = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    begun = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get(pieces, None) or 0))
    if begun < SHUFFLE_PIECES or not spark.conf.get(pieces, None):
        spark.conf.set(pieces, str(max(begun, SHUFFLE_PIECES)))
    for name, most in (("spark.sql.files.maxPartitionBytes", TASK_INPUT), ("spark.sql.adaptive.advisoryPartitionSizeInBytes", TASK_SHUFFLE)):
        if _bytes_of(spark.conf.get(name)) > most:
            spark.conf.set(name, str(most))
    return spark


def bounded_splits(spark: SparkSession, most: int) -> None:
    """Tasks read at most `most` bytes of a file, unless the session's bound is finer already."""
    name = "spark.sql.files.maxPartitionBytes"
    if _bytes_of(spark.conf.get(name)) > most:
        spark.conf.set(name, str(most))


def _bytes_of(text: str) -> int:
    """Bytes of a size as Spark's settings write it: 64MB, 128m, 1g, 1024b or a plain number."""
    digits = text.strip().lower().rstrip("bkmgt")
    unit = text.strip().lower()[len(digits) :].rstrip("b")
    return int(digits) * 1024 ** ["", "k", "m", "g", "t"].index(unit)


def use_checkpoint_folder(spark: SparkSession) -> str:
    """The folder the cluster names; a temporary one only for local sessions without it."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="scorewatch-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


INTERIM = "scorewatch-tables"


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` as a table below the shared checkpoint folder and read it again.

    Cuts the lineage and survives lost executors; unlike a checkpoint the table is read by
    column and its size is known. Columns may have any name; tables stay until the
    application's folder is cleared.
    """
    spark = df.sparkSession
    path = f"{use_checkpoint_folder(spark)}/{INTERIM}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` in the shared checkpoint folder, partitions in their order."""
    use_checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


# A lookup of at most this many bytes, counted on its rows, may go to every task.
BROADCAST_BYTES = 32 * 1024 * 1024


def broadcast_checked(df: DataFrame) -> DataFrame:
    """`df`, computed once; to be broadcast if its counted bytes allow it, else joined by a shuffle.

    The sources may have any size: what counts is the lookup itself, written and measured.
    """
    lookup = materialise(df)
    size = lookup.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(lookup) if size <= BROADCAST_BYTES else lookup
