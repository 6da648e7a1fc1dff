"""Reading tables and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FORMATS = ("csv", "parquet")


def read_file(spark: SparkSession, path: str, kind: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV with header or parquet. Without `schema` CSV types are inferred by a pass over the data."""
    if kind not in FORMATS:
        raise ValueError(f"unsupported format {kind!r}; use one of {FORMATS}")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if kind == "csv":
        return reader.csv(path, header=True, inferSchema=schema is None)
    return reader.parquet(path)


def run_query(spark: SparkSession, statement: str, **frames: DataFrame) -> DataFrame:
    """SQL over tables and the given frames, referred to as {name}."""
    return spark.sql(statement, **frames)


def same_columns_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two raw sources with the same columns as one."""
    return first.unionByName(second)
