"""Running totals and quantiles, also with one group holding most of the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewatch.operators.ordered import numbered, quantiles, running_totals
from scorewatch.plans import gini

PROBABILITIES = [0.0, 0.1, 0.25, 0.3333, 0.5, 0.9, 1.0]


def hot_rows(spark):
    """A thousand rows: two thirds in one group, one null group, ties throughout."""
    rows = []
    rng = np.random.default_rng(7)
    for i in range(1000):
        key = "hot" if i % 3 else (None if i % 2 else f"k{i % 5}")
        rows.append((key, float(rng.integers(0, 200)), int(rng.integers(0, 2)), i))
    return rows, spark.createDataFrame(rows, "k string, x double, y int, id long")


def check_quantiles(spark):
    rows, df = hot_rows(spark)
    got = {r["k"]: r["quantiles"] for r in quantiles(df, ["k"], "x", PROBABILITIES).collect()}
    for key in {r[0] for r in rows}:
        values = [r[1] for r in rows if r[0] == key]
        assert got[key] == pytest.approx(list(np.quantile(values, PROBABILITIES)))


def check_running(spark):
    rows, df = hot_rows(spark)
    got = running_totals(df, ["k"], ["x", "id"], ["y"]).collect()
    assert len(got) == len(rows)
    for key in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[3]))
        total, want = sum(r[2] for r in ordered), {}
        for r, upto in zip(ordered, np.cumsum([r[2] for r in ordered])):
            want[r[3]] = (int(upto), total)
        mine = {r["id"]: (r["cum_y"], r["all_y"]) for r in got if r["k"] == key}
        assert mine == want


def auc_by_pairs(rows):
    bad = [x for x, y in rows if y == 1]
    good = [x for x, y in rows if y == 0]
    wins = sum((b > g) + 0.5 * (b == g) for b in bad for g in good)
    return 2 * wins / (len(bad) * len(good)) - 1


def check_gini(spark):
    rows, df = hot_rows(spark)
    got = {r["k"]: r["gini"] for r in gini.gini_by(df, ["k"], "x", "y").collect()}
    for key in {r[0] for r in rows}:
        assert got[key] == pytest.approx(auc_by_pairs([(r[1], r[2]) for r in rows if r[0] == key]))


def check_numbers(spark):
    _, df = hot_rows(spark)
    got = numbered(df.select("id"), ["id"], "n", start=0).collect()
    assert sorted((r["id"], r["n"]) for r in got) == [(i, i) for i in range(1000)]


CHECKS = [check_quantiles, check_running, check_gini, check_numbers]


@pytest.fixture
def many_ranges(spark):
    """Keep every range of an ordered scan, however small."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("check", CHECKS)
def test_merged_ranges(spark, check):
    check(spark)


@pytest.mark.parametrize("check", CHECKS)
def test_many_ranges(many_ranges, check):
    check(many_ranges)


def test_range_counts_agree(spark):
    """Deciles, descending curves and keyed bins give the same rows from one range and from many."""
    _, df = hot_rows(spark)
    df = df.where("k is not null")

    def both(make):
        results = []
        for merged in ("true", "false"):
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merged)
            results.append(sorted(map(tuple, make().collect())))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        return results

    one, many = both(lambda: gini.decile_gains(df, ["k"], "x", "y", ["id"]))
    assert one == many and len(one) > 10
    one, many = both(lambda: gini.roc_points(df, ["k"], "x", "y"))
    assert one == many
    one, many = both(
        lambda: gini.gini_cube(
            df.withColumn("d", F.lit("2024-01-01").cast("date")), "x", "y", "bad", [("K", "k")], "d", "id"
        )[0]
    )
    assert one == many and len(one) > 4


def test_approximate_quantiles_are_observed_values(spark):
    rows, df = hot_rows(spark)
    got = quantiles(df, [], "x", [0.0, 0.5, 1.0], method="approx").first()["quantiles"]
    values = {r[1] for r in rows}
    assert set(got) <= values and got[0] == min(values) and got[2] == max(values)
    with pytest.raises(ValueError):
        quantiles(df, [], "x", [0.5], method="other")
