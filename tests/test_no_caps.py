"""Nothing is refused or cut off because there are many of it."""

import json

from pyspark.sql import functions as F

from scorewatch.operators.aggregates import pivoted
from scorewatch.operators.payload import payload_keys, with_payload_map
from scorewatch.operators.segments import subset_labels
from scorewatch.operators.shares import compare_bins, index_of


def test_five_thousand_and_one_payload_keys(spark):
    rows = [(json.dumps({f"k{i}": i for i in range(j, 5001, 3)}),) for j in range(3)]
    parsed = with_payload_map(spark.createDataFrame(rows, "p string"), "p")
    assert len(payload_keys(parsed)) == 5001


def test_subsets_of_twenty_one_trenches(spark):
    rows = [("v", f"t{i:02}") for i in range(21)]
    assert subset_labels(spark.createDataFrame(rows, "v string, t string"), "v", "t").count() == 21 * 2**20


def test_categories_by_the_hundred_thousand(spark):
    ids = spark.range(100_000).withColumn("Bin", F.concat(F.lit("c"), "id"))
    sides = F.explode(F.array(F.lit(None).cast("string"), F.lit("2024-01"), F.lit("2024-02"))).alias("month")
    counts = ids.select("Bin", sides).withColumn("n", F.lit(2).cast("long")).withColumn("g", F.lit("all"))
    shares = compare_bins(counts, ["g"], "month", "unprotected")
    assert shares.count() == 200_000
    assert [round(r["psi"], 9) + 0.0 for r in index_of(shares, ["g", "month"], "psi").collect()] == [0.0, 0.0]


def test_pivot_without_stated_values(spark):
    df = spark.range(12_000).select((F.col("id") % 2).alias("r"), F.concat(F.lit("c"), (F.col("id") % 300).cast("string")).alias("c"), F.lit(1).alias("v"))
    wide = pivoted(df, ["r"], "c", "v")
    assert len(wide.columns) == 301 and wide.count() == 2
