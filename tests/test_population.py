"""Population builder, payload edge cases, sinks and reading."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from scorewatch.functions.rules import INDUSTRY_NAMES
from scorewatch.operators import joins, payload
from scorewatch.operators.aggregates import column_differences
from scorewatch.operators.segments import subset_labels
from scorewatch.plans.population import (
    combined_population,
    final_segments,
    labelled_population,
    psi_population,
    risk_segments,
    scored_log,
    with_risk_segments,
)
from scorewatch.sources import files, sinks

DAY = dt.datetime(2024, 5, 1, 10)


def runs(spark):
    rows = [
        (1, "A1", "{'combined_score': 0.7}", DAY, "Old name", "v1", None, "{'x': 1, 'ok': True}", "Android 12"),
        (1, "A1", "{'combined_score': 0.6}", DAY, "Old name", "v1", None, "{'x': 2}", "Android 12"),
        (2, "A2", "{'combined_score': None}", DAY, "Old name", "v1", "", "{}", None),
        (3, "A3", "{'combined_score': 0.2}", DAY, "new_name", "v2", "Trench 2", None, None),
        (4, "A4", "{'combined_score': 0.9}", DAY, "unrelated", "v1", None, None, None),
    ]
    return spark.createDataFrame(
        rows,
        "customerId long, digitalLoanAccountId string, prediction string, start_time timestamp, modelDisplayName string, "
        "modelVersionId string, trenchCategory string, calcFeature string, deviceOs string",
    )


def loans(spark):
    rows = [
        ("A1", "L1", "Flex-up", "BNPL", "F", None, "Android 13", "phone", "M1", DAY, None, DAY, 1),
        ("A3", "L3", "Quick", "CASH", "M", None, None, "ANDROID", "M9", DAY, DAY + dt.timedelta(days=40), DAY, 1),
    ]
    return spark.createDataFrame(
        rows,
        "digitalLoanAccountId string, loanAccountNumber string, new_loan_type string, loantype string, gender string, osVersion string, "
        "osversion_v2 string, deviceType string, purpleKey string, startApplyDateTime timestamp, termsAndConditionsSubmitDateTime timestamp, "
        "disbursementDateTime timestamp, flagDisbursement int",
    )


def others(spark):
    delinquency = spark.createDataFrame(
        [("L1", 1, 1, 1, 1, 0, 0), ("L3", 3, 9, 3, 9, 3, 2)],
        "loanAccountNumber string, obs_min_inst_def0 int, min_inst_def0 int, obs_min_inst_def10 int, min_inst_def10 int, obs_min_inst_def30 int, min_inst_def30 int",
    )
    merchants = spark.createDataFrame(
        [("M1", 1, "x", DAY), ("M1", 3, "y", DAY + dt.timedelta(days=1))], "mer_refferal_code string, store_type int, store_tagging string, created_dt timestamp"
    )
    mart = spark.createDataFrame([("A1", "1_Repeat Applicant", DAY)], "digitalLoanAccountId string, ln_user_type string, onb_tsa_onboarding_datetime timestamp")
    return delinquency, merchants, mart


def log(spark):
    score = F.get_json_object("prediction", "$.combined_score")
    names = {"Old name": "new_name", "new_name": "new_name"}
    return scored_log(runs(spark), score, names, others(spark)[2], as_of=F.lit("2024-06-30").cast("date"))


def test_scored_log(spark):
    got = {(r["digitalLoanAccountId"], r["score"]): r for r in log(spark).collect()}
    assert set(got) == {("A1", 0.7), ("A1", 0.6), ("A3", 0.2)}
    assert got["A1", 0.7]["trenchCategory"] == "Trench 3" and got["A3", 0.2]["trenchCategory"] == "Trench 2"
    assert {r["modelDisplayName"] for r in got.values()} == {"new_name"}


def test_labelled_population(spark):
    delinquency, merchants, _ = others(spark)
    rows = labelled_population(log(spark), loans(spark), delinquency, merchants, "fpd10").collect()
    got = {r["digitalLoanAccountId"]: r for r in rows}
    assert set(got) == {"A1", "A3"} and len(rows) == 2
    assert (got["A1"]["label"], got["A3"]["label"]) == (1, 0)
    assert got["A1"]["loan_product_type"] == "Mall" and got["A3"]["loan_product_type"] == "not applicable"
    assert got["A1"]["osType"] == "android" and got["A3"]["osType"] == "android"
    assert got["A3"]["Application_month"] == "2024-06"
    later = labelled_population(log(spark), loans(spark), delinquency, merchants, "fspd30").collect()
    assert [(r["digitalLoanAccountId"], r["label"]) for r in later] == [("A3", 1)]


def test_psi_population_keeps_unmatched_runs(spark):
    _, merchants, _ = others(spark)
    rows = psi_population(log(spark), loans(spark).where("digitalLoanAccountId = 'A1'"), merchants).collect()
    assert {(r["digitalLoanAccountId"], r["osType"]) for r in rows} == {("A1", "android"), ("A3", "ios")}


def test_train_rows_win(spark):
    train = spark.createDataFrame([("A1", "Train")], "digitalLoanAccountId string, s string")
    test = spark.createDataFrame([("A1", "Test"), ("A2", "Test")], "digitalLoanAccountId string, s string")
    got = {(r[0], r[1]) for r in combined_population(train, test).collect()}
    assert got == {("A1", "Train"), ("A2", "Test")}


def test_payload_edge_cases(spark):
    texts = ["{'a': 1, 'b': None, 'c': True, 'd': 'None of these'}", "[1, 2]", "", None, "{'a': \"it's\"", "{}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, p string")
    got = {r["id"]: r for r in payload.expand_payload(df, "p").collect()}
    assert (got[0]["calc_a"], got[0]["calc_b"], got[0]["calc_c"]) == ("1", None, "true")
    assert got[1]["calc_raw_list"] == "[1, 2]"
    assert all(got[i]["calc_a"] is None for i in (1, 2, 3, 4, 5))


def test_packed_payload_unpacks(spark):
    df = spark.createDataFrame(
        [(1, "A", 0.5, None, DAY, "ios", "Train", DAY.date())],
        "customer_id long, digitalLoanAccountId string, x double, y double, t timestamp, osType string, Data_selection string, application_date date",
    )
    packed = payload.pack_features(df, ["x", "y", "t"], "absent", "m")
    row = packed.first()
    assert row["calcFeature"] == '{"x":0.5,"t":"2024-05-01T10:00:00"}' and row["prediction"] == 0
    assert set(c for c in payload.expand_payload(packed, "calcFeature").columns if c.startswith("calc_")) == {"calc_x", "calc_t"}


def test_filled_features(spark):
    df = spark.createDataFrame([("v1", "T1", 1, None), ("v1", "T2", None, 2)], "v string, t string, a int, b int")
    assert payload.filled_features(df, ["a", "b"], "v", "v1", "t", ["T1"]) == ["a"]


def test_trench_subsets(spark):
    df = spark.createDataFrame([("v", "a"), ("v", "b"), ("w", "a"), ("w", None)], "v string, t string")
    got = sorted((r["v"], r["t_set"], r["t"]) for r in subset_labels(df, "v", "t").collect())
    assert got == [("v", "a", "a"), ("v", "a,b", "a"), ("v", "a,b", "b"), ("v", "b", "b"), ("w", "a", "a")]


def test_industry_recode(spark):
    df = spark.createDataFrame([("Embassy",), ("Banking",), ("Education/Schools",), (None,)], "i string")
    got = {r["i"]: r["o"] for r in joins.recoded(df, "i", INDUSTRY_NAMES, "o").collect()}
    assert got == {"Embassy": None, "Banking": "Banking", "Education/Schools": "Education/Private Schools", None: None}


def test_tables(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, s string")
    try:
        assert sinks.load_table(df, "facts", "truncate") and sinks.load_table(df, "facts")
        assert spark.table("facts").count() == 4
        assert not sinks.load_table(df.where("k > 9"), "facts", "truncate")
        assert spark.table("facts").count() == 4
        sinks.backup_table(spark, "facts", "facts_backup")
        sinks.delete_rows(spark, "facts", F.col("s") == "a")
        assert [r["s"] for r in spark.table("facts").collect()] == [None, None]
        assert spark.table("facts_backup").count() == 4
        sinks.union_into([df, df], "facts")
        assert spark.table("facts").count() == 4
        schema = StructType([StructField("s", StringType()), StructField("k", DoubleType()), StructField("z", LongType())])
        sinks.load_with_schema(df, "typed", schema)
        assert spark.table("typed").schema.simpleString() == "struct<s:string,k:double,z:bigint>"
        with pytest.raises(ValueError):
            sinks.load_table(df, "facts", "other")
    finally:
        for t in ("facts", "facts_backup", "typed"):
            sinks.drop_table(spark, t)


def test_delete_keeps_partitions_and_properties(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "it's"), (5, None), (6, "c"), (7, "c")], "k long, p string")
    try:
        df.write.partitionBy("p").option("owner", "risk").saveAsTable("parted")
        spark.sql("ALTER TABLE parted SET TBLPROPERTIES ('note' = 'kept')")
        untouched = {r["f"] for r in spark.table("parted").where("p = 'c'").select(F.input_file_name().alias("f")).collect()}
        sinks.delete_rows(spark, "parted", F.col("k").isin(2, 3, 4, 5))
        assert sorted(map(tuple, spark.table("parted").select("k", "p").collect())) == [(1, "a"), (6, "c"), (7, "c")]
        assert [c.name for c in spark.catalog.listColumns("parted") if c.isPartition] == ["p"]
        assert {r["partition"] for r in spark.sql("SHOW PARTITIONS parted").collect()} == {"p=a", "p=c"}
        assert spark.sql("SHOW TBLPROPERTIES parted ('note')").first()["value"] == "kept"
        assert {r["f"] for r in spark.table("parted").where("p = 'c'").select(F.input_file_name().alias("f")).collect()} == untouched
        sinks.delete_rows(spark, "parted", F.col("k") > 0)
        assert spark.table("parted").count() == 0
    finally:
        sinks.drop_table(spark, "parted")


def test_lookup_as_large_as_the_facts(spark):
    """Nine tenths of the facts on one key, nulls on both sides; no task gets much more than its share."""
    key = F.when(F.col("id") % 10 < 9, F.lit(5)).when(F.col("id") % 100 == 9, F.lit(None)).otherwise(F.col("id")).cast("long")
    facts = spark.range(60_000).select("id", key.alias("key"))
    lookup = spark.range(60_000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("value"))
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        joined = joins.with_lookup(facts, lookup, ["key"])
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        wrong = joined.where(~F.col("value").eqNullSafe(F.col("key") * 2)).count()
        assert sum(sizes) == 60_000 and wrong == 0 and max(sizes) < 4 * 60_000 / 16
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_risk_segments(spark):
    loans = spark.createDataFrame(
        [("A1", "2026-01-05", "Quick", 1), ("A1", "2026-02-05", "Quick", 2), ("A2", "2026-01-05", "Quick", 9), ("A3", "2025-01-05", "Quick", 1), ("A4", "2026-01-05", "Flex-up", 1)],
        "digitalLoanAccountId string, decision_date string, new_loan_type string, offer_id long",
    )
    offers = spark.createDataFrame(
        [(1, "SEGMENTED_ACL", "2026-01-01", "low"), (2, "SEGMENTED_ACL", "2026-01-01", "old"), (2, "SEGMENTED_ACL", "2026-01-02", "high"), (9, "OTHER", "2026-01-01", "x")],
        "offer_id long, offer_type string, created_date string, risk_segment string",
    )
    finals = spark.createDataFrame(
        [("A1", "2026-01-01", "F1"), ("A1", "2026-03-01", "F2"), ("A1", "2026-04-01", None), (None, "2026-04-01", "F9")], "digitalLoanAccountId string, created_dt string, risk_segment_final string"
    )
    accounts = spark.createDataFrame([("A1",), ("A2",), ("A3",), ("A4",), (None,)], "digitalLoanAccountId string")
    segments = risk_segments(loans, offers, F.lit("2025-11-10").cast("date"))

    def both(final):
        return {r[0]: tuple(r)[1:] for r in with_risk_segments(accounts, segments, final).collect()}

    assert both(final_segments(finals)) == {"A1": ("high", "F2"), "A2": ("Unsegmented", "NA"), "A3": ("NA", "NA"), "A4": ("NA", "NA"), None: ("NA", "NA")}
    assert both(final_segments(finals, F.lit("2026-02-01").cast("date")))["A1"] == ("high", "F1")


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, s string")
    paths = sinks.export(df, str(tmp_path), "out")
    assert set(paths) == {"csv", "parquet"}
    for kind, path in paths.items():
        assert sorted(map(tuple, files.read_file(spark, path, kind).collect())) == [(1, "a"), (2, "b")]
    assert files.read_file(spark, paths["csv"], "csv", "k long, s string").schema["k"].dataType == LongType()
    with pytest.raises(ValueError):
        files.read_file(spark, "x", "xlsx")
    assert column_differences(df, df.drop("s")) == {"only_left": ["s"], "only_right": []}
