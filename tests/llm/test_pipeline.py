import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline as cp
from tests.llm import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_each_stage_on_what_its_predecessor_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before, seen = docs.columns, docs, {}
    for name, stage in cp.STAGES:
        stage(spark, before, SF).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, now)
        if name != cp.STAGES[-1][0]:
            assert now.columns == columns
        before = now
    texts = lambda df: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    # quality: the labelled bad ones go, few of the good ones do
    kept = {d for d, _ in texts(seen["quality"][1])}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good, bad = ([d for d, q in labels.items() if q == k] for k in (1, 0))
    assert len(kept & set(bad)) <= 0.1 * len(bad) and len(kept & set(good)) >= 0.95 * len(good)
    # near duplicates: one of each component
    want = sorted(d for d, _, c in brute.components(texts(seen["near_duplicates"][0]), 5, 80) if d == c)
    assert sorted(d for d, _ in texts(seen["near_duplicates"][1])) == want
    # decontamination
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = sorted(d for d, _, hit, _ in brute.contamination(texts(seen["decontamination"][0]), items) if not hit)
    assert sorted(d for d, _ in texts(seen["decontamination"][1])) == want
    # mixing: nothing more than twice, half of all words more than there were, or all that the sources' limits allow
    size = lambda df: df.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    a, b = seen["mixing"]
    assert b.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2 and 1.3 * size(a) <= size(b) <= 1.5 * size(a) + 1
    # tokens: a row for each row, offsets without gaps
    out = sorted(seen["token_ids"][1].collect(), key=lambda r: r["start"])
    at = 0
    for r in out:
        assert r["start"] == at
        at += r["n_tokens"]
    assert sorted(r["doc_id"] for r in out) == sorted(r["doc_id"] for r in seen["token_ids"][0].select("doc_id").collect())


def test_near_duplicates_with_clashing_ids(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(60))
    # id 5 has a near copy of id 1 and a text of its own; id 6 has two texts of their own; id 7 twice the same
    docs = [(1, text("b")), (5, text("b") + " more"), (5, text("c")), (6, text("d")), (6, text("e")), (7, text("f")), (7, text("f")), (None, text("b")), (8, text("c"))]
    df = spark.createDataFrame([(d, t, "en", "s") for d, t in docs], "doc_id long, text string, lang string, source string")
    got = sorted(((r["doc_id"], r["text"]) for r in cp.near_duplicates(spark, df, SF).collect()), key=str)
    assert got == sorted([(1, text("b")), (5, text("c")), (6, text("d")), (6, text("e")), (7, text("f")), (None, text("b"))], key=str)


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    names = ("n_words", "items", "stats", "score", "row", "sent", "mix_copy", "_n", "hash", "contaminated", "key", "k")
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 60").withColumns({c: F.lit(5) for c in names})
    for name, stage in cp.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        got = spark.read.parquet(str(tmp_path / name))
        assert got.columns == docs.columns and got.count() and got.filter(" or ".join(f"`{c}` <> 5" for c in names)).isEmpty(), name


def test_stages_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
