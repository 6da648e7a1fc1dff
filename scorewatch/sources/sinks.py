"""Writing tables and files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scorewatch.session import checkpointed
from scorewatch.sources.files import FORMATS

DISPOSITIONS = {"truncate": "overwrite", "append": "append"}


def ordered(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Rows in `order`, over all files written; as they are without one."""
    return df.orderBy(*order) if order else df


def write_file(
    df: DataFrame, path: str, kind: str, mode: str = "overwrite", order: Sequence[str | Column] = ()
) -> str:
    """CSV with header or parquet, sorted if an order is given; returns the path."""
    if kind not in FORMATS:
        raise ValueError(f"unsupported format {kind!r}; use one of {FORMATS}")
    df = ordered(df, order)
    writer = df.write.mode(mode)
    writer.csv(path, header=True) if kind == "csv" else writer.parquet(path)
    return path


def export(df: DataFrame, base_path: str, name: str, kinds: Sequence[str] = FORMATS) -> dict[str, str]:
    """The same frame in several formats: format to path."""
    return {kind: write_file(df, f"{base_path}/{kind}/{name}", kind) for kind in kinds}


def load_table(
    df: DataFrame, table: str, disposition: str = "append", order: Sequence[str | Column] = ()
) -> bool:
    """Truncate-load or append, sorted if an order is given; an empty frame is skipped and False returned.

    The frame is computed once, before it is known whether there is anything to load.
    """
    if disposition not in DISPOSITIONS:
        raise ValueError(f"unknown disposition {disposition!r}; use one of {tuple(DISPOSITIONS)}")
    df = checkpointed(ordered(df, order))
    if df.isEmpty():
        return False
    df.write.mode(DISPOSITIONS[disposition]).saveAsTable(table)
    return True


def with_schema(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns in the declared order and type; columns the frame lacks are null."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def load_with_schema(df: DataFrame, table: str, schema: StructType, disposition: str = "truncate") -> bool:
    return load_table(with_schema(df, schema), table, disposition)


def union_into(tables: Sequence[DataFrame], target: str) -> None:
    """Create or replace the target from the union of per-model frames."""
    reduce(lambda a, b: a.unionByName(b), tables).write.mode("overwrite").saveAsTable(target)


def rows_without(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that do not meet the condition; rows where it is unknown stay."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def delete_rows(spark: SparkSession, table: str, condition: Column) -> None:
    """Delete the rows meeting the condition, in place: layout, properties and the table itself stay.

    Of a partitioned table only the partitions that hold such rows are read again and
    overwritten; partitions left empty are dropped. What is kept is written to the checkpoint
    folder first, so an interrupted overwrite can be repeated from there.
    """
    rows = spark.table(table)
    parts = [c.name for c in spark.catalog.listColumns(table) if c.isPartition]
    if not parts:
        checkpointed(rows_without(rows, condition)).write.insertInto(table, overwrite=True)
        return
    # One row per partition.
    touched = checkpointed(rows.where(condition).select(*parts).distinct())
    same = reduce(lambda x, y: x & y, [F.col(f"__t.{c}").eqNullSafe(F.col(f"__r.{c}")) for c in parts])
    inside = rows.alias("__r").join(F.broadcast(touched).alias("__t"), same, "left_semi")
    kept = checkpointed(rows_without(inside, condition))
    name = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(name)
    spark.conf.set(name, "dynamic")
    try:
        kept.select(*rows.columns).write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set(name, before)
    emptied = touched.alias("__t").join(kept.select(*parts).distinct().alias("__r"), same, "left_anti")
    for row in emptied.select(*[F.col(c).cast("string") for c in parts]).collect():
        spec = ", ".join(f"`{c}` = " + ("null" if v is None else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'") for c, v in row.asDict().items())
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({spec})")


def drop_table(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def backup_table(spark: SparkSession, table: str, backup: str) -> None:
    spark.table(table).write.mode("overwrite").saveAsTable(backup)
