"""Zero policies by hand and properties of the index."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewatch.functions.stability import POLICIES, band, policy_named
from scorewatch.operators.shares import compare_bins
from scorewatch.plans import csi, psi, reports

# Baseline: 6, 4, 0 rows in bins 1 to 3; period: 5, 0, 5.
E = [0.6, 0.4, None]
A = [0.5, None, 0.5]


def by_hand(e, a, policy):
    def fix(share):
        value = policy.absent if share is None else share
        if share is not None and share == 0 and policy.zero is not None:
            value = policy.zero
        if policy.floor is not None:
            value = max(value, policy.floor)
        return value + policy.add

    es, as_ = [fix(x) for x in e], [fix(x) for x in a]
    if policy.renormalise:
        es, as_ = [x / sum(es) for x in es], [x / sum(as_) for x in as_]
    total = 0.0
    for x, y in zip(es, as_):
        if x > 0 and y > 0:
            total += (y - x) * math.log(y / x)
        elif (x > 0 or y > 0) and policy.on_zero == "infinite":
            total = math.inf
    return total


def counts(spark):
    rows = [(None, 1, 6), (None, 2, 4), ("m", 1, 5), ("m", 3, 5)]
    return spark.createDataFrame(rows, "p string, Bin int, n long")


@pytest.mark.parametrize("name", POLICIES)
def test_policy_by_hand(spark, name):
    got = compare_bins(counts(spark), [], "p", name).agg(F.sum("term").alias("v")).first()["v"]
    want = by_hand(E, A, policy_named(name))
    assert got == want if math.isinf(want) else got == pytest.approx(want)


def test_null_bins_and_denominators(spark):
    more = counts(spark).unionByName(spark.createDataFrame([(None, None, 10)], "p string, Bin int, n long"))
    every = {r["Bin"]: r["e_share"] for r in compare_bins(more, [], "p", "zero_1e-4_renormalised").collect()}
    binned = {r["Bin"]: r["e_share"] for r in compare_bins(more, [], "p", "zero_1e-4_renormalised", denominator="binned").collect()}
    assert every[1] == 0.3 and binned[1] == 0.6
    with pytest.raises(ValueError):
        compare_bins(more, [], "p", "no such policy")


def score_rows(spark, shift=0.0):
    rng = np.random.default_rng(3)
    rows = [(int(i), float(x), "2024-01", "Train", "a" if i % 2 else None) for i, x in enumerate(rng.normal(0, 1, 500))]
    rows += [(int(i) + 1000, float(x) + shift, "2024-02", "Test", "a" if i % 2 else "b") for i, x in enumerate(rng.normal(0, 1, 300))]
    return spark.createDataFrame(
        rows, "digitalLoanAccountId long, score double, Application_month string, Data_selection string, seg string"
    )


def test_same_population_has_no_shift(spark):
    train = score_rows(spark).where("Data_selection = 'Train'")
    copy = train.withColumns({"Data_selection": F.lit("Test"), "Application_month": F.lit("2024-09")})
    rows = psi.monthly_score_psi(train.unionByName(copy), "score", policy="zero_1e-4_renormalised").collect()
    assert [r["psivalues"] for r in rows] == pytest.approx([0.0, 0.0])


def test_psi_grows_with_shift_and_bins_add_up(spark):
    small = psi.feature_psi(score_rows(spark, 0.1), ["score"], types={"score": "numerical"}).first()["PSI"]
    large = psi.feature_psi(score_rows(spark, 1.0), ["score"], types={"score": "numerical"}).first()["PSI"]
    assert 0 <= small < large
    bins = psi.feature_bin_psi(score_rows(spark, 0.1), ["score"], types={"score": "numerical"})
    assert bins.agg(F.sum("Bin_PSI")).first()[0] == pytest.approx(small, rel=1e-6)
    assert bins.agg(F.sum("Base_Percentage")).first()[0] == pytest.approx(100.0)


def test_segments_need_both_sides_and_null_segments_drop(spark):
    rows = psi.waterfall_score_psi(score_rows(spark), "score", ["seg"]).collect()
    assert {r["seg"] for r in rows} == {"a"}
    assert {r["DateCategory"] for r in rows} == {"Training", "Monthly"}


def test_train_rows_in_month_option(spark):
    df = score_rows(spark).withColumn("Application_month", F.lit("2024-01"))
    plain = psi.feature_psi(df, ["score"], types={"score": "numerical"}).first()
    mixed = psi.feature_psi(df, ["score"], types={"score": "numerical"}, include_train_in_month=True).first()
    assert (plain["Actual_Count"], mixed["Actual_Count"]) == (300, 800)
    assert mixed["PSI"] < plain["PSI"]


def test_recount_agrees(spark):
    df = score_rows(spark)
    result = psi.feature_psi(df, ["score"], ["seg"], types={"score": "numerical"})
    checked = reports.recount(result, df, ["seg"], "digitalLoanAccountId", "Application_month", "Data_selection")
    assert checked.where("not (Train_Match and Test_Match)").count() == 0


def test_small_csi_segments_are_skipped(spark):
    rows = [(i, "x" if i % 3 else "y", "2024-01" if i < 60 else "2024-02", "Train" if i < 60 else "Test", "big" if i % 4 else "small") for i in range(120)]
    df = spark.createDataFrame(rows, "digitalLoanAccountId long, f_bin string, Application_month string, dataselection string, seg string")
    got = {r["Segment_Value"] for r in csi.segmented_csi(df, ["f_bin"], ["seg"]).collect()}
    assert got == {"All", "big"}


def test_month_keys_go_past_z(spark):
    df = spark.createDataFrame([(1, "2024-01"), (25, "2026-01"), (26, "2026-02")], "p int, m string")
    got = [r[0] for r in df.select(csi.month_key(F.col("p"), F.col("m"))).collect()]
    assert got == ["b_2024-01", "z_2026-01", "z0026_2026-02"] and got == sorted(got, key=lambda s: s.replace("_", " "))


def test_bands(spark):
    df = spark.createDataFrame([(0.05,), (0.1,), (0.25,), (None,)], "v double")
    assert [r[0] for r in df.select(band(F.col("v"), "status")).collect()] == ["stable", "warning", "critical", None]
    assert [r[0] for r in df.select(band(F.col("v"), "traffic")).collect()] == ["Green", "Green", "Amber", None]
    assert [r[0] for r in df.select(band(-F.col("v"), "size")).collect()] == ["Moderate", "Large", "Large", None]
