"""The pipeline and the registered queries on the smallest tables, stage by stage."""

from __future__ import annotations

import re
from pathlib import Path

import pytest

import __spark_entry__ as entry
import corpus_pipeline as P
from srcloom.llm.common import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = table(spark, SF, "documents")
    for k, (_, stage) in enumerate(P.STAGES):
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        columns, docs = docs.columns, spark.read.parquet(str(tmp_path / str(k)))
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= before
        assert k == len(P.STAGES) - 1 or docs.columns == columns
    final = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in docs.collect()}
    assert final == {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in P.run(spark, SF).collect()}


def test_pipeline_against_brute_force(spark):
    """What stays is what every single operator lets stay, one after the other."""
    from srcloom.llm import entries

    rows = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    lang = {r.doc_id for r in entries.QUERIES["op1_language_id"](spark, SF).collect() if r.lang_pred != "und"}
    toxic = {r.doc_id for r in entries.QUERIES["op8_toxicity"](spark, SF).collect() if r.toxic}
    left = {i for i in rows if i in lang and i not in toxic}
    prints = {r.doc_id: int(r.fingerprint, 16) for r in entries.QUERIES["op2_simhash"](spark, SF).collect()}
    # near-duplicates: fingerprints as in op2, or five-word shingles with a Jaccard similarity of 0.8 or more
    words = {i: (rows[i] or "").lower().split() for i in left}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    similar = lambda x, y: 10 * len(x & y) >= 8 * len(x | y)
    root = {i: i for i in left}
    for a in sorted(left):
        for b in sorted(left):
            if a < b and (bin(prints[a] ^ prints[b]).count("1") <= 4 or similar(sets[a], sets[b])) and root[a] != root[b]:
                x, y = min(root[a], root[b]), max(root[a], root[b])
                root = {k: x if v == y else v for k, v in root.items()}
    leaks = {r.doc_id for r in entries.QUERIES["op10_decontamination"](spark, SF).collect() if r.contaminated}
    tokens = {r.doc_id: r.n_tokens for r in entries.QUERIES["op4_sentencepiece"](spark, SF).collect()}
    want = {i: tokens[i] for i in left if root[i] == i and i not in leaks}
    assert {r.doc_id: r.n_tokens for r in P.run(spark, SF).collect()} == want


@pytest.fixture
def odd_dir(spark, tmp_path):
    """The tables of a folder with nulls, empty texts, repeated rows, equal ids with different texts, and columns with clashing names."""
    from pyspark.sql import functions as F

    docs = table(spark, SF, "documents")
    some = docs.orderBy("doc_id").limit(60)
    more = some.unionByName(some.limit(7)).unionByName(some.where("doc_id % 9 = 0").withColumn("doc_id", F.lit(5).cast("long"))).unionByName(some.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    more = more.unionByName(some.limit(4).withColumn("text", F.when(F.col("doc_id") % 2 == 0, "")))
    clash = {"score": F.lit("s"), "severity": F.lit(1), "n_hit": F.lit("h"), "__text": F.lit(2), "grade": F.lit(None).cast("string"), "__h": F.lit(3), "page": F.lit("p")}
    more.withColumns(clash).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        table(spark, SF, name).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_stages_on_odd_rows(spark, odd_dir):
    docs = table(spark, odd_dir, "documents")
    before = docs
    for k, (_, stage) in enumerate(P.STAGES):
        after = stage(spark, before, odd_dir)
        if k < len(P.STAGES) - 1:
            assert after.columns == docs.columns
        kept = after.collect()
        if k == 2:  # one of each: texts stay if nothing is like them, also below an id that others have
            had = {(r.doc_id, r.text) for r in before.collect()}
            assert {(r.doc_id, r.text) for r in kept} <= had and any(r.doc_id == 5 for r in kept)
            assert sum(r.doc_id is None for r in kept) == sum(r.doc_id is None for r in before.collect())
        assert kept
        path = f"{odd_dir}/stage-{k}"
        after.write.parquet(path)
        before = spark.read.parquet(path)
    assert before.count() == P.run(spark, odd_dir).count()
    empty = docs.where("false")
    for _, stage in P.STAGES:
        assert stage(spark, empty, odd_dir).count() == 0


def test_registered_queries():
    numbered = [q for q in entry.queries() if re.match(r"op\d+_", q)]
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in numbered) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", ["op3_revisits", "op6_sharding", "op13_lexical_search"])
def test_sql(spark, name):
    from tests.support import same_as_sql

    same_as_sql(spark, name, SF)


def test_texts_go_to_python_in_small_batches(spark):
    """Batches of 10,000 whole texts, held more than once in the JVM and in Python, took an executor to its limit."""
    from pyspark.sql import types as T

    from srcloom.llm.common import BATCH_DEFAULT, BATCH_ROWS, BATCH_SETTING, appended

    docs = spark.range(9_000, numPartitions=1).selectExpr("id", "'a text' as text")
    sizes = lambda: {r.n for r in appended(docs, "text", T.StructType([T.StructField("n", T.IntegerType())]), lambda: lambda texts: [[len(texts)] * len(texts)], buffer_bytes=1).collect()}
    try:
        spark.conf.unset(BATCH_SETTING)
        assert spark.conf.get(BATCH_SETTING) == BATCH_DEFAULT  # what stands for "not set" below
        assert max(sizes()) <= BATCH_ROWS
        spark.conf.set(BATCH_SETTING, "3000")
        assert sizes() == {3_000}  # the session's own value
    finally:
        spark.conf.unset(BATCH_SETTING)
