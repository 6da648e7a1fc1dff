"""Edges, closed sides, labels and the ladder of fallbacks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scorewatch.functions import bins as B
from scorewatch.operators import binning


def positions(spark, values, edges, rule, **options):
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("e", F.lit(edges))
    return [r["p"] for r in df.select(rule(F.col("v"), F.col("e"), **options).alias("p")).collect()]


def test_right_closed_matches_pandas_cut(spark):
    edges = [0.0, 1.0, 2.5, 7.0]
    values = [0.0, 0.5, 1.0, 1.1, 2.5, 7.0, 7.1, -0.1, None]
    want = pd.cut(pd.Series(values, dtype=float), edges, labels=False, include_lowest=True)
    assert positions(spark, values, edges, B.right_closed) == [None if np.isnan(w) else int(w) + 1 for w in want]
    assert positions(spark, [0.0], edges, B.right_closed, include_lowest=False) == [None]


def test_left_closed_matches_histogram(spark):
    edges = [0.0, 1.0, 1.0, 2.5, 7.0]
    values = [0.0, 0.5, 1.0, 2.5, 6.9, 7.0]
    got = positions(spark, values, edges, B.left_closed)
    counts = [got.count(i) for i in range(1, len(edges))]
    assert counts == list(np.histogram(values, edges)[0])
    assert positions(spark, [-1.0, 8.0, None], edges, B.left_closed) == [None, None, None]


def edges_of(spark, values, policy):
    df = spark.createDataFrame([("f", "numerical", float(v)) for v in values], "Feature string, Feature_Type string, number double")
    return binning.numeric_spec(df, policy=policy).first()["edges"]


@pytest.mark.parametrize(
    "values, bins",
    [
        (range(100), 10),
        ([0] * 15 + list(range(1, 86)), 5),
        ([0] * 25 + list(range(1, 76)), 3),
        ([0] * 90 + [1] * 10, 5),
        ([4] * 20, 2),
    ],
)
def test_ladder_steps(spark, values, bins):
    values = list(values)
    edges = edges_of(spark, values, "ladder")
    assert len(edges) - 1 == bins
    assert edges[0] == -np.inf and edges[-1] == np.inf
    if bins == 10:
        assert edges[1:-1] == pytest.approx(list(np.percentile(values, range(10, 100, 10))))
    if bins == 2:
        assert edges[1] == 4.0


def test_unique_decile_policy_and_constant(spark):
    assert len(edges_of(spark, [0] * 90 + [1] * 10, "deciles")) >= 2
    assert edges_of(spark, [3] * 5, "deciles")[1:-1] == pytest.approx([2.999, 3.0, 3.001])
    assert edges_of(spark, [3] * 5, "quantile") == [3.0]


def test_labels_missing_others_and_no_bins(spark):
    rows = [("a", 1.0, "Train", "x"), ("b", None, "Train", None), ("c", 9.0, "Test", "new"), ("d", 0.5, "Test", "x")]
    df = spark.createDataFrame(rows, "id string, num double, sel string, cat string").withColumn("gone", F.lit(None).cast("double"))
    kinds = {"num": "numerical", "cat": "categorical", "gone": "numerical"}
    long = binning.long_features(df, kinds, ["id", "sel"])
    got = binning.feature_bin_counts(long, long.where("sel = 'Train'"), kinds, ["id"]).collect()
    label = {(r["id"], r["Feature"]): r["Bin"] for r in got}
    assert label["b", "num"] == "Missing" and label["b", "cat"] == "Missing"
    assert label["c", "cat"] == "Others" and label["d", "cat"] == "x"
    assert label["c", "num"].startswith("Bin_")
    assert label["a", "gone"] == "Missing"


def test_seventh_category_becomes_others(spark):
    values = [c for i, c in enumerate("abcdefg") for _ in range(10 - i)]
    df = spark.createDataFrame([("f", "categorical", v) for v in values], "Feature string, Feature_Type string, category string")
    assert binning.category_spec(df).first()["top"] == list("abcdef")


def test_fixed_bins_gap_and_missing(spark):
    df = spark.createDataFrame([(1.0,), (10.5,), (20.0,), (None,)], "v double")
    rule = B.fixed_bins(F.col("v"), [("1-10", 1.0, 10.0), (">11", 11.0, None)])
    assert [r[0] for r in df.select(rule).collect()] == ["a. 1-10", None, "b. >11", "c. missing"]


def test_feature_typing_rules(spark):
    n = 60
    df = spark.createDataFrame(
        [(i % 14, float(i % 14) + 0.5, i, "t", i % 3) for i in range(n)], "few int, halves double, many int, word string, loan_amt int"
    )
    assert binning.feature_types(df, ["few", "halves", "many", "word", "absent"]) == {
        "few": "categorical", "halves": "numerical", "many": "numerical", "word": "categorical",
    }
    assert binning.feature_types(df, ["few"], "at_most_integers")["few"] == "numerical"
    assert binning.feature_types(df, ["loan_amt"], "names")["loan_amt"] == "numerical"
    assert binning.feature_types(df, ["many"], "at_most", named_categories=["many"])["many"] == "categorical"
    with pytest.raises(ValueError):
        binning.feature_types(df, ["few"], "unknown")


def test_whole_frame_bins_of_one_value(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (None,)], "v double")
    assert sorted(r["b"] for r in binning.whole_frame_bins(df, "v", "b").collect()) == ["All", "All", "Missing"]


def test_twenty_bins_without_a_stated_bound(spark):
    edges = [float(i) for i in range(21)]
    df = spark.createDataFrame([(i + 0.5,) for i in range(20)], "x double").withColumn("e", F.lit(edges))
    for function in (B.right_closed, B.left_closed):
        got = df.select("x", function(F.col("x"), F.col("e")).alias("b")).collect()
        assert sorted((r["x"], r["b"]) for r in got) == [(i + 0.5, i + 1) for i in range(20)]
