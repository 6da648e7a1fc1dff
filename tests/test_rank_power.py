"""Gini variants: identities, ties, single classes and minimum sizes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewatch.operators.aggregates import account_summary
from scorewatch.operators.ranksums import Grouping, account_counts, decile_sums
from scorewatch.plans import gini


def frame(spark, scores, labels, **more):
    rows = [(float(s), int(y)) for s, y in zip(scores, labels)]
    return spark.createDataFrame(rows, "score double, label int").withColumns({k: F.lit(v) for k, v in more.items()})


def one(spark, scores, labels, method="auc"):
    return gini.gini_by(frame(spark, scores, labels), [], "score", "label", method).first()["gini"]


def test_perfect_reversed_and_tied(spark):
    assert one(spark, [1, 2, 3, 4], [0, 0, 1, 1]) == 1.0
    assert one(spark, [4, 3, 2, 1], [0, 0, 1, 1]) == -1.0
    assert one(spark, [1, 1, 1, 1], [0, 1, 0, 1]) == 0.0


def test_identities_without_ties(spark):
    rng = np.random.default_rng(1)
    x, y = rng.permutation(200) / 7.0 + 2, rng.integers(0, 2, 200)
    auc = one(spark, x, y)
    goods, n = int((y == 0).sum()), len(y)
    assert one(spark, x, y, "trapezoid") == pytest.approx(-auc)
    assert one(spark, x, y, "hybrid") == pytest.approx(-auc)
    assert one(spark, x / 1000, y, "hybrid") == pytest.approx(auc)
    assert one(spark, x, y, "cumulative") == pytest.approx(goods / n * auc - 1 / n)
    assert one(spark, -x, y) == pytest.approx(-auc)
    assert one(spark, np.exp(x / 50), y) == pytest.approx(auc)


def test_one_class_and_bad_input(spark):
    assert one(spark, [1, 2, 3], [1, 1, 1]) is None
    assert one(spark, [1, 2, 3], [0, 0, 0], "trapezoid") == 0.0
    assert one(spark, [1, 2, 3], [0, 0, 0], "hybrid") is None
    df = spark.createDataFrame([("1.5", 1), ("oops", 0), (None, 1), ("0.5", 0)], "score string, label int")
    row = gini.gini_by(df, [], "score", "label").first()
    assert (row["n"], row["gini"]) == (2, 1.0)
    with pytest.raises(ValueError):
        gini.gini_by(df, [], "score", "label", "other")


def test_minimum_rows_per_period(spark):
    def fact(n):
        df = frame(spark, range(n), [i % 2 for i in range(n)], disbursementdate="2024-01-03", digitalLoanAccountId=1)
        df = df.withColumn("disbursementdate", F.to_date("disbursementdate"))
        rows, _ = gini.gini_cube(df, "score", "label", "bad")
        return {r["period"]: r for r in rows.collect()}

    nine, ten, twenty = fact(9), fact(10), fact(20)
    assert nine["Week"]["gini_value"] is None
    assert ten["Week"]["gini_value"] is not None and ten["Month"]["gini_value"] is None
    assert twenty["Month"]["gini_value"] is not None
    assert str(twenty["Week"]["start_date"]) == "2024-01-01" and str(twenty["Week"]["end_date"]) == "2024-01-07"
    assert str(twenty["Month"]["end_date"]) == "2024-01-31"
    assert twenty["Month"]["distinct_accounts"] == 1 and twenty["Month"]["bad_count"] == 1


def test_cube_overall_equals_ungrouped_and_nulls_stay_out(spark):
    rng = np.random.default_rng(5)
    rows = [(float(rng.integers(0, 30)), int(rng.integers(0, 2)), [None, "a", "b"][i % 3], i) for i in range(300)]
    df = spark.createDataFrame(rows, "score double, label int, seg string, digitalLoanAccountId long")
    df = df.withColumn("disbursementdate", F.lit("2024-02-05").cast("date"))
    fact, dimension = gini.gini_cube(df, "score", "label", "bad", [("Seg", "seg")])
    got = {(r["segment_type"], r["period"]): r["gini_value"] for r in fact.collect()}
    assert got["Overall", "Month"] == pytest.approx(gini.gini_by(df, [], "score", "label").first()["gini"])
    assert {k for k, _ in got} == {"Overall", "Seg_a", "Seg_b"}
    ids = {r["segment_type"]: r["segment_id"] for r in dimension.collect()}
    assert ids == {"Overall": 0, "Seg_a": 1, "Seg_b": 2}


def test_deciles_follow_rank_cut(spark):
    df = frame(spark, range(23), [i % 2 for i in range(23)], digitalLoanAccountId=1)
    rows = gini.decile_gains(df, [], "score", "label").orderBy("decile").collect()
    assert [r["records_in_decile"] for r in rows] == [3, 2, 2, 2, 2, 3, 2, 2, 2, 3]
    assert rows[0]["score_max"] == 22.0 and rows[-1]["cum_pct_records"] == pytest.approx(100.0)


def test_combined_scores(spark):
    df = spark.createDataFrame([(0.0, 10.0, 0), (1.0, 20.0, 1), (2.0, 5.0, 1)], "a double, b double, label int")
    made = gini.with_combined_scores(df, ["a", "b"], "label").orderBy("a").collect()
    assert [r["combined_mean"] for r in made] == pytest.approx([1 / 6, 0.75, 0.5])
    assert [r["combined_max"] for r in made] == pytest.approx([1 / 3, 1.0, 1.0])
    assert [r["combined_median"] for r in made] == pytest.approx([1 / 6, 0.75, 0.5])


def test_overlapping_and_empty_periods(spark):
    df = frame(spark, range(10), [i % 2 for i in range(10)], day="2024-05-05")
    periods = [("one", "2024-01-01", "2024-12-31"), ("two", "2024-05-01", "2024-05-31"), ("none", "2020-01-01", "2020-01-02")]
    got = {r["Period"]: r for r in gini.named_period_gini(df, "day", "label", ["score"], periods).collect()}
    assert got["one"]["sample_size"] == got["two"]["sample_size"] == 10
    assert got["none"]["sample_size"] == 0 and got["none"]["score_gini"] is None


def test_groupings_equal_a_copy_per_grouping(spark):
    """Ranges of scores reduced for all groupings against one query per grouping, ties and nulls included."""
    draw = random.Random(5)
    rows = [(draw.choice(["x", "y", None]), draw.choice([1, 2, None]), draw.random() < 0.8, draw.choice([round(draw.random(), 2), 0.5]), int(draw.random() < 0.3)) for _ in range(3_000)]
    df = spark.createDataFrame(rows, "a string, b int, ok boolean, score double, label int")
    counts = gini.collapse(df, ["a", "b", "ok"], "score", "label")
    groupings = [Grouping(()), Grouping(("a",)), Grouping(("b",), "ok"), Grouping(("a", "b"))]
    for method in gini.METHODS:
        got = {tuple(r)[:3]: tuple(r)[3:] for r in gini.gini_by_groupings(counts, groupings, "score", method).collect()}
        want = {}
        for number, grouping in enumerate(groupings):
            part = counts.where(grouping.where) if grouping.where else counts
            for c in grouping.columns:
                part = part.where(F.col(c).isNotNull())
            for r in gini.gini_of_counts(part, list(grouping.columns), "score", method).collect():
                own = r.asDict()
                want[number, own.get("a"), own.get("b")] = tuple(own[c] for c in ("n", "bad", "good", "gini"))
        assert got.keys() == want.keys()
        assert all(got[k][:3] == want[k][:3] and got[k][3] == pytest.approx(want[k][3], abs=1e-12) for k in want)
    none = gini.gini_by_groupings(counts.where("false"), groupings, "score")
    assert none.count() == 0


def test_account_counts_of_groupings(spark):
    draw = random.Random(6)
    rows = [(draw.choice(["x", "y", None]), f"A{draw.randint(0, 400) if draw.random() < 0.7 else 7}", int(draw.random() < 0.2)) for _ in range(4_000)]
    people = spark.createDataFrame(rows, "a string, account string, bad int").groupBy("a", "account").agg(F.max("bad").alias("bad"))
    got = {tuple(r)[:2]: tuple(r)[2:] for r in account_counts(people, [Grouping(()), Grouping(("a",))], "account", "bad").collect()}
    want = {(0, None): (len({r[1] for r in rows}), len({r[1] for r in rows if r[2]}))}
    for a in ("x", "y"):
        want[1, a] = (len({r[1] for r in rows if r[0] == a}), len({r[1] for r in rows if r[0] == a and r[2]}))
    assert got == want


def test_estimated_accounts(spark):
    """Sketches of the finest groups, united, stay within three standard errors of the exact counts."""
    df = spark.range(60_000).select(
        (F.col("id") % 20_000).cast("string").alias("account"), (F.col("id") % 3).cast("string").alias("g"), F.lit(0.5).alias("score"),
        (F.col("id") % 7 == 0).cast("int").alias("label"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 60).cast("int")).alias("disbursementdate"),
    )
    exact = {r["g"]: tuple(r)[1:] for r in account_summary(df, ["g"], "account", "label").collect()}
    near = {r["g"]: tuple(r)[1:] for r in account_summary(df, ["g"], "account", "label", approx=True).collect()}
    assert exact.keys() == near.keys()
    assert all(abs(near[g][i] - exact[g][i]) <= 0.025 * exact[g][i] for g in exact for i in (0, 1))
    keys = ["segment_id", "period", "start_date"]
    cubes = [gini.gini_cube(df, "score", "label", "FPD10", [("G", "g")], account="account", approx_accounts=approx)[0].select(*keys, "distinct_accounts", "bad_count") for approx in (False, True)]
    own, other = ({tuple(r)[:3]: tuple(r)[3:] for r in c.collect()} for c in cubes)
    assert own.keys() == other.keys() and all(abs(a - b) <= max(2, 0.03 * a) for k in own for a, b in zip(own[k], other[k]))
    assert account_summary(df.where("false"), ["g"], "account", "label", approx=True).count() == 0


def test_decile_sums_of_many_groupings(spark):
    """Against the definition: a hot score over several ranges, nulls in groups and ties, small groups."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(3000):
        score = 0.5 if i % 2 else round(float(rng.random()), 2)
        segment = None if i % 97 == 0 else "one" if i == 5 else "hot" if i % 3 else str(rng.choice(["a", "b"]))
        rows.append((score, None if i % 50 == 0 else f"acc{int(rng.integers(0, 2000)):05}", int(rng.random() < score), segment, str(i % 4), i % 5 > 0))
    df = spark.createDataFrame(rows, "score double, account string, label int, segment string, month string, known boolean").repartition(7)
    groupings = [Grouping(()), Grouping(("segment",)), Grouping(("segment", "month"), "known"), Grouping(("month",))]
    got = {}
    for r in decile_sums(df, groupings, "score", "account", "label").collect():
        key = (r["__set"], r["segment"], r["month"], r["decile"])
        assert key not in got
        got[key] = (r["low"], r["high"], round(r["total"], 6), r["n"], r["bad"])
    places = {"segment": 3, "month": 4}
    want = {}
    for number, grouping in enumerate(groupings):
        groups = {}
        for row in rows:
            name = {c: row[places[c]] for c in grouping.columns}
            if None not in name.values() and (grouping.where is None or row[5]):
                groups.setdefault((name.get("segment"), name.get("month")), []).append(row)
        for name, members in groups.items():
            members.sort(key=lambda r: (r[0], r[1] is not None, r[1] or "", r[2]))
            deciles = {}
            for rank, row in enumerate(members):
                up = -(-rank * 10 // (len(members) - 1)) if len(members) > 1 else 1
                deciles.setdefault(11 - max(up, 1), []).append(row)
            for decile, own in deciles.items():
                s = [r[0] for r in own]
                want[(number, *name, decile)] = (min(s), max(s), round(sum(s), 6), len(own), sum(r[2] for r in own))
    assert got == want
    assert decile_sums(df.where("false"), groupings, "score", "account", "label").count() == 0
