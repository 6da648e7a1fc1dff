"""The driver's tables as a scored-loan population, for Spark and for the check SQL.

Line items stand for scored applications: the order is the account, the price the score,
a returned item the bad outcome, and shipping before 1999 the training period.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewatch.session import sized

TRAIN_UNTIL = "1999-01-01"
SEGMENTS = ["trenchCategory", "new_loan_type", "osType"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sized(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored applications without loan attributes: line items only."""
    item = table(spark, sf_dir, "lineitem")
    return item.select(
        F.col("l_orderkey").alias("digitalLoanAccountId"),
        F.col("l_partkey").alias("partkey"),
        F.col("l_linenumber").alias("line"),
        F.col("l_extendedprice").alias("score"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("modelVersionId"),
        F.to_date("l_shipdate").alias("disbursementdate"),
        F.date_format("l_shipdate", "yyyy-MM").alias("Application_month"),
        F.when(F.col("l_shipdate") < F.lit(TRAIN_UNTIL).cast("timestamp_ntz"), "Train")
        .otherwise("Test")
        .alias("Data_selection"),
    )


LINES = f"""lines as (
  select l_orderkey as "digitalLoanAccountId", l_partkey as partkey, l_linenumber as line,
    l_extendedprice as score, l_quantity as quantity, l_discount as discount, l_tax as tax,
    case when l_returnflag = 'R' then 1 else 0 end as label, l_returnflag as flag,
    l_linestatus as "modelVersionId", cast(l_shipdate as date) as disbursementdate,
    strftime(l_shipdate, '%Y-%m') as "Application_month",
    case when l_shipdate < timestamp '{TRAIN_UNTIL}' then 'Train' else 'Test' end as "Data_selection"
  from lineitem)"""


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored applications with segment columns; trench and system hold nulls."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("digitalLoanAccountId"),
        F.col("o_custkey").alias("customerId"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.substring("o_orderpriority", 3, 20)).alias("trenchCategory"),
        F.when(F.col("o_orderstatus") == "F", "android").when(F.col("o_orderstatus") == "O", "ios").alias("osType"),
    )
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customerId"), F.col("c_mktsegment").alias("new_loan_type")
    )
    # The customer is joined to the orders first: there are fewer of them than lines.
    item = lines(spark, sf_dir)
    joined = item.join(orders.join(customer, "customerId", "inner"), "digitalLoanAccountId", "inner")
    return joined.select("customerId", *item.columns, "trenchCategory", "osType", "new_loan_type")


POPULATION = (
    LINES
    + """, population as (
  select l.*, o_custkey as "customerId",
    case when o_orderpriority <> '4-NOT SPECIFIED' then substring(o_orderpriority, 3, 20) end as "trenchCategory",
    case o_orderstatus when 'F' then 'android' when 'O' then 'ios' end as "osType",
    c_mktsegment as new_loan_type
  from lines l join orders on o_orderkey = "digitalLoanAccountId" join customer on c_custkey = o_custkey)"""
)


def rounded(column: str, digits: int = 6):
    """Rounded double without a negative zero, named as before."""
    return (F.round(F.col(column), digits) + F.lit(0.0)).alias(column)


def r(expression: str, digits: int = 6) -> str:
    """The same in the check SQL."""
    return f"(round({expression}, {digits}) + cast(0 as double))"


def quantile_list(values: str, parts: int = 10) -> str:
    """SQL: interpolated quantiles of a sorted list at equal steps."""
    return (
        f"list_transform(range(0, {parts + 1}), lambda i: {values}[1 + cast(floor({_at(values, parts)}) as bigint)]"
        f" + ({values}[1 + cast(ceil({_at(values, parts)}) as bigint)] - {values}[1 + cast(floor({_at(values, parts)}) as bigint)])"
        f" * ({_at(values, parts)} - floor({_at(values, parts)})))"
    )


def _at(values: str, parts: int) -> str:
    return f"((cast(i as double) / {parts}) * cast(len({values}) - 1 as double))"


def quantile_at(values: str, p: float) -> str:
    """SQL: one interpolated quantile of a sorted list."""
    at = f"(cast({p!r} as double) * cast(len({values}) - 1 as double))"
    low, high = f"{values}[1 + cast(floor({at}) as bigint)]", f"{values}[1 + cast(ceil({at}) as bigint)]"
    return f"({low} + ({high} - {low}) * ({at} - floor({at})))"


def right_bin(value: str, edges: str) -> str:
    """SQL: 1-based (low, high] bin, lowest value included."""
    return (
        f"case when {value} < {edges}[1] or {value} > {edges}[len({edges})] then null "
        f"else greatest(len(list_filter({edges}, lambda y: y < {value})), 1) end"
    )


def left_bin(value: str, edges: str) -> str:
    """SQL: 1-based [low, high) bin, last one closed."""
    return (
        f"case when {value} < {edges}[1] or {value} > {edges}[len({edges})] then null "
        f"else least(len(list_filter({edges}, lambda y: y <= {value})), len({edges}) - 1) end"
    )


def open_edges(edges: str) -> str:
    """SQL: outer edges replaced by infinities."""
    return (
        f"list_concat(list_concat([cast('-infinity' as double)], {edges}[2:len({edges}) - 1]), [cast('infinity' as double)])"
    )
