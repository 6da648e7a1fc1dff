"""De-duplication. Spark limits each map task to the kept rows per key before shuffling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _keep(df: DataFrame, keys: Sequence[str], order: Sequence[Column], most: int = 1) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("__rn", F.row_number().over(window)).where(F.col("__rn") <= most).drop("__rn")
    )


def latest_per_key(df: DataFrame, keys: Sequence[str], by: str, ties: Sequence[str] = ()) -> DataFrame:
    """Row with the largest `by` per key; `ties` decide between equal ones, largest first."""
    return _keep(df, keys, [F.col(by).desc_nulls_last(), *[F.col(t).desc() for t in ties]])


def earliest_per_key(df: DataFrame, keys: Sequence[str], by: str, ties: Sequence[str] = ()) -> DataFrame:
    """Row with the smallest `by` per key, nulls last."""
    return _keep(df, keys, [F.col(by).asc_nulls_last(), *[F.col(t).asc() for t in ties]])


def first_submission(
    df: DataFrame,
    account: str = "digitalLoanAccountId",
    selection: str = "Data_selection",
    version: str = "modelVersionId",
    submitted: str = "appln_submit_datetime",
    ties: Sequence[str] = (),
) -> DataFrame:
    """First application per account, selection and version."""
    return earliest_per_key(df, [account, selection, version], submitted, ties)


def whole_row_distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], most: int) -> DataFrame:
    """At most `most` rows per key in `order`."""
    return _keep(df, keys, order, most)


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
