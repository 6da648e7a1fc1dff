"""What one task holds: pieces of ranges, accounts dealt once, settings for any session."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from scorewatch.catalog.base import table
from scorewatch.operators import ranksums
from scorewatch.operators.ranksums import Grouping
from scorewatch.operators.segments import subset_labels
from scorewatch.operators.shares import segment_accounts
from scorewatch.plans import csi, gini, psi
from scorewatch.session import TASK_INPUT, TASK_SHUFFLE, _bytes_of


def test_ranges_are_streamed_in_pieces_whatever_ties_and_groups_they_hold(spark, monkeypatch):
    draw = random.Random(5)
    rows = [(draw.choice(["x", "y", None]), draw.randint(0, 40), float(draw.choice([7, 7, 7, draw.randint(0, 300)])), draw.randint(1, 3)) for _ in range(4000)]
    rows = [(k, w, s, n, draw.randint(0, n)) for k, w, s, n in rows]
    counts = spark.createDataFrame(rows, "k string, w int, s double, n long, bad long").coalesce(1)
    groupings = [Grouping(()), Grouping(("k",)), Grouping(("k", "w"))]
    want = {}
    for number, keys in enumerate(([], ["k"], ["k", "w"])):
        known = counts.where(" and ".join([f"{c} is not null" for c in keys]) or "true")
        for r in gini.gini_of_counts(known, keys, "s", "cumulative").collect():
            want[number, *(r[c] if c in keys else None for c in ("k", "w"))] = (r["n"], r["bad"], r["good"], r["gini"])
    monkeypatch.setattr(ranksums, "PIECE", 100)
    monkeypatch.setattr(ranksums, "GROUPS", 30)
    monkeypatch.setattr(ranksums, "OUT", 7)
    found = gini.gini_by_groupings(counts, groupings, "s", "cumulative").collect()
    assert len(found) == len(want)
    for r in found:
        n, bad, good, value = want[r["__set"], r["k"], r["w"]]
        assert (r["n"], r["bad"], r["good"]) == (n, bad, good)
        assert (r["gini"] is None) == (value is None) and (value is None or abs(r["gini"] - value) < 1e-9)


def test_accounts_of_pieces_add_up(spark, monkeypatch):
    draw = random.Random(6)
    rows = list({(draw.choice(["x", "y", None]), draw.randint(0, 9), draw.choice([1, draw.randint(2, 200)]), 0) for _ in range(900)})
    people = spark.createDataFrame(rows, "k string, w int, account long, flag int").withColumn("flag", (F.col("account") % 2).cast("int"))
    want = {}
    for k, w, account, _ in rows:
        for key in [(0, None, None), *([(1, k, w)] if k else [])]:
            want.setdefault(key, set()).add(account)
    monkeypatch.setattr(ranksums, "PIECE", 40)
    monkeypatch.setattr(ranksums, "GROUPS", 5)
    found = ranksums.account_counts(people, [Grouping(()), Grouping(("k", "w"))], "account", "flag").collect()
    assert {(r["__set"], r["k"], r["w"]): (r["distinct_accounts"], r["bad_count"]) for r in found} == {
        key: (len(own), sum(a % 2 for a in own)) for key, own in want.items()
    }


def test_segment_accounts_travel_once_and_count_once(spark):
    rows = [(1, "p", "A", "m1"), (1, "p", "A", "m1"), (1, "q", None, "m1"), (2, "p", "B", "m1"), (None, "p", "A", "m1"), (None, "q", "C", "m2")]
    df = spark.createDataFrame(rows, "account long, seg string, kind string, month string")
    made = segment_accounts(df, ["seg"], ["kind", "month"], "account", "n", pooled=("kind", "ALL"))
    plan = made._jdf.queryExecution().executedPlan().toString()  # before it runs
    found = {tuple(r) for r in made.collect()}
    want = {}
    for account, seg, kind, month in rows:
        for shown in (kind, "ALL"):
            for key in (("Overall", "All"), ("seg", seg)):
                want.setdefault((*key, shown, month), set()).add(account)
    assert found == {(*key, len(own - {None})) for key, own in want.items()}
    assert plan.count("Exchange hashpartitioning") == 2  # by account, then the counts


def test_accounts_of_trench_subsets_are_not_copied(spark):
    draw = random.Random(7)
    rows = [(draw.choice([None, *range(30)]), draw.choice(["1", "2"]), draw.choice(["a", "b", "c", None]), draw.choice(["x", None]), draw.choice(["m1", None])) for _ in range(300)]
    df = spark.createDataFrame(rows, "account long, v string, t string, seg string, month string")
    subsets = subset_labels(df, "v", "t")
    found = psi._subset_accounts(df, ["seg"], "v", "t", "month", "account", subsets)
    got = {(r["Segment_Column"], r["Segment_Value"], r["v"], r["t_set"], r["month"]): r["Actual_Count"] for r in found.collect()}
    members = {}
    for v, label, t in subsets.collect():
        members.setdefault((v, label), set()).add(t)
    want = {}
    for account, v, t, seg, month in rows:
        for (own, label), some in members.items():
            if own == v and t in some:
                for key in [("Overall", "All"), *([("seg", seg)] if seg else [])]:
                    want.setdefault((*key, v, label, month), set()).add(account)
    assert got == {key: len(own - {None}) for key, own in want.items()}


def test_reading_a_table_sets_the_size_of_tasks(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    assert table(spark, str(tmp_path), "t").count() == 3
    assert int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) >= 200
    assert _bytes_of(spark.conf.get("spark.sql.files.maxPartitionBytes")) <= TASK_INPUT
    assert _bytes_of(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")) <= TASK_SHUFFLE
    assert [_bytes_of(x) for x in ("64MB", "134217728b", "1g", "12", "8m", "3kb")] == [64 << 20, 134217728, 1 << 30, 12, 8 << 20, 3 << 10]


def test_characteristic_stability_reads_its_population_once(spark):
    rows = [(i % 40, "m0" if i % 2 else f"m{1 + i % 3}", "Train" if i % 2 else "Test", ["a", "b", None][i % 3]) for i in range(240)]
    logged = spark.createDataFrame(rows, "marked_key long, month string, side string, bin string")
    people = spark.range(40).select(F.col("id").alias("marked_key"), F.col("id").alias("account"), F.when(F.col("id") % 3 > 0, "s").alias("seg"))
    both = logged.join(people, "marked_key")
    for make in (csi.segmented_csi, csi.bin_csi):
        made = make(both, ["bin"], ["seg"], "account", "month", "side")
        assert "marked_key" not in made._jdf.queryExecution().analyzed().toString()  # the join has been left behind
        kept = both.drop("marked_key").localCheckpoint()
        assert sorted(map(str, made.collect())) == sorted(map(str, make(kept, ["bin"], ["seg"], "account", "month", "side").collect()))


def test_quantiles_of_many_groupings_are_exact_over_many_ranges(spark, monkeypatch):
    draw = random.Random(15)
    rows = [(draw.choice(["x", "y", None]), draw.choice(["p", "q"]), float(draw.choice([5, 5, draw.randint(-50, 50)])), draw.randint(1, 4)) for _ in range(600)]
    rows.append(("z", "p", 3.5, 1))
    counts = spark.createDataFrame(rows, "k string, w string, s double, n long")
    monkeypatch.setattr(ranksums, "RANGE_BITS", 4)
    steps = [0.0, 0.1, 0.37, 0.5, 1.0]
    groupings = [Grouping(()), Grouping(("k",)), Grouping(("k", "w"))]
    found = ranksums.quantiles_by_grouping(counts, groupings, "s", steps).collect()
    want = {}
    for k, w, s, n in rows:
        for key in [(0, None, None), *([(1, k, None), (2, k, w)] if k else [])]:
            want.setdefault(key, []).extend([s] * n)
    assert {(r["__set"], r["k"], r["w"]) for r in found} == set(want)
    for r in found:
        assert np.allclose(r["quantiles"], np.percentile(want[r["__set"], r["k"], r["w"]], [100 * p for p in steps]))


def test_waterfall_reads_the_population_once_and_copies_no_score(spark):
    draw = random.Random(16)
    rows = [(draw.randint(1, 90), draw.choice(["A", "B", None]), draw.choice(["u", "v"]), f"m{draw.randint(1, 4)}", draw.choice(["Train", "Test"]), draw.random()) for _ in range(500)]
    read = spark.sparkContext.accumulator(0)

    def seen(value):
        read.add(1)
        return value

    df = spark.createDataFrame(rows, "account long, seg string, os string, month string, sel string, raw double").coalesce(2)
    df = df.withColumn("score", F.udf(seen, "double").asNondeterministic()("raw"))
    got = psi.waterfall_score_psi(df, "score", ["seg", "os"], "account", "month", "sel").collect()
    assert read.value == len(rows)
    for r in got:
        train = r["DateCategory"] == "Training"
        own = {a for a, seg, os, m, sel, _ in rows if seg == r["seg"] and r["os"] in (os, "NA") and sel == ("Train" if train else "Test") and (train or m == r["Month"])}
        assert r["account_count"] == len(own)
    assert {(r["seg"], r["os"]) for r in got} == {(s, o) for s in "AB" for o in ("NA", "u", "v")}
