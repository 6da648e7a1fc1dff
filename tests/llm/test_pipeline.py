"""The pipeline and the registered queries on the smallest tables."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from scorewatch.llm import bpe, queries, simhash
from scorewatch.llm.common import documents, new_folder, table

DATA = "/root/testdata/sf0.001"


def test_each_stage_keeps_the_columns_and_drops_only_what_it_should(spark):
    docs = table(spark, DATA, "documents")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, DATA).cache()
        assert after.columns == docs.columns, name
        assert after.schema == docs.schema or [f.dataType for f in after.schema] == [f.dataType for f in docs.schema]
        assert 0.5 * before <= after.count() <= before, name
        before = after.count()
        docs = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert last.count() == before


def test_documents_without_text_are_not_toxic(spark):
    """Also where half of the labels say so and no word tells a label."""
    rows = [(i, None if i % 3 == 0 else "" if i % 3 == 1 else " \n ", "en", "s", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    folder = new_folder(spark, "half")
    spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.drop_toxic(spark, docs, folder).count() == 60


def test_pipeline_runs_as_a_query(spark):
    got = entry.queries()["pipeline"](spark, DATA)
    assert {"doc_id", "n_tokens", "ids"} <= set(got.columns) and got.count() > 100


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_gives_a_row_per_document_or_its_check(spark, name):
    got = queries.QUERIES[name](spark, DATA)
    rows = got.collect()
    if name in queries.CHECKS:
        con = duckdb.connect()
        for view in ("documents", "labels", "pages", "embeddings"):
            con.execute(f"create view {view} as select * from '{DATA}/{view}.parquet'")
        want = con.execute(queries.CHECKS[name])
        names = [d[0] for d in want.description]
        assert sorted(tuple(r[c] for c in names) for r in rows) == sorted(want.fetchall())
    elif name != "op6_string_tiling":
        assert len(rows) == table(spark, DATA, "pages" if name == "op13_wrappers" else "documents").count()


def test_near_copies_are_found_by_the_operators_fingerprints(spark):
    """Bands of 64 minima miss nearly every near copy; the trees of 64-bit fingerprints do not."""
    base = " ".join(f"w{i}" for i in range(201)) + " "
    texts = [base * 30 + " ".join(f"{name}{i}" for i in range(15)) for name in ("a", "b")] + ["something else altogether"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()} == {0: 0, 1: 0, 2: 2}
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs, band_count=1, band_rows=64).collect()) == [0, 2]


def test_candidates_are_compared_whatever_the_size_of_their_group(spark, monkeypatch):
    """Copies that share no band, lie beyond the radius or are in a group of more than a tree are still confirmed."""
    base = " ".join(f"w{i}" for i in range(201)) + " "
    texts = [base * 30 + " ".join(f"{name}{i}" for i in range(15)) for name in ("a", "b", "c", "d")] + ["something else altogether"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for most in (simhash.TREE_BYTES, 3_000):
        monkeypatch.setattr(simhash, "TREE_BYTES", most)
        assert sorted(r["doc_id"] for r in simhash.one_of_each(docs, band_count=1, band_rows=64, radius=0).collect()) == [0, 4]


def test_sets_that_differ_in_one_hash_share_bands():
    """Also where that hash is the inverse of what the factors were multiples of, so that it was the least in every band."""
    draw = random.Random(8)
    values = [draw.getrandbits(64) for _ in range(300)]
    both = [simhash.bands(np.array(v, ">u8").view(np.uint8).reshape(-1, 8), 12, 2) for v in (values, [*values, pow(0x9E3779B97F4A7C15, -1, 2**64)])]
    assert len(set(both[0]) & set(both[1])) >= 6
    missed = 0
    for _ in range(1_500):  # 267 of 333 hashes in common: 0.8
        values = [draw.getrandbits(64) for _ in range(333)]
        both = [simhash.bands(np.array(v, ">u8").view(np.uint8).reshape(-1, 8), 12, 2) for v in (values[:300], values[33:])]
        missed += not set(both[0]) & set(both[1])
    assert missed == 0


def test_near_copies_read_and_sign_their_documents_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    rows = [(i, f"text of {i % 7} that some others have too") for i in range(40)] + [(None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text", F.udf(seen, "string").asNondeterministic()("text"))
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect() if r["doc_id"] is not None) == list(range(7))
    assert read.value == len(rows)


def test_pieces_met_again_are_not_merged_again(monkeypatch):
    codec = bpe.Codec(queries.BYTE_RANKS, bpe.class_runs())
    merged, merges = [], codec.merges
    plain = merges.merged
    monkeypatch.setattr(merges, "merged", lambda pieces: merged.extend(pieces) or plain(pieces))
    merges.most = len(merges.known) + 50
    for number in range(20):  # more other pieces than the cache holds
        texts = [" qzqxqjz".encode(), *(f" zq{number}x{i}qj".encode() for i in range(30))]
        assert [codec.decode(ids) for ids in codec.encode(texts)] == texts
    assert merged.count(b" qzqxqjz") == 1
    assert len(merges.cache) + len(merges.earlier) <= 2 * (merges.most + 200)


def test_stages_split_their_input(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "128m")
    corpus_pipeline.encode(spark, table(spark, DATA, "documents"), DATA)
    assert int(spark.conf.get(name)) == corpus_pipeline.SPLIT_BYTES
    spark.conf.set(name, "1m")
    corpus_pipeline.encode(spark, table(spark, DATA, "documents"), DATA)
    assert spark.conf.get(name) == "1m"
    spark.conf.set(name, before)


def test_batches_of_long_texts_are_small(spark):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 100_000).alias("text")).coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "held": [batch.nbytes]})

    found = documents(docs).mapInArrow(sizes, "n long, held long").collect()
    assert sum(r.n for r in found) == 60
    assert max(r.held for r in found) < 6_000_000
