"""Registered queries against plain versions of their contracts, on whole tables."""

import os
import zlib

import pyarrow.parquet as pq
import pytest

from pathspark.llm.queries import QUERIES
from tests.llm import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def rows(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def test_op4_reads_back_every_turn(spark):
    talks = {-7: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for r in rows("conversations"):
        talks.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"] or ""))
    want = {}
    for k, turns in talks.items():
        turns.sort(key=lambda t: t[0])
        loss = "".join(t for _, role, t in turns if role == "assistant")
        want[k] = (len(turns), brute.sha("".join(f"{role}\n{t}\n" for _, role, t in turns)), len(loss), brute.sha(loss))
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in QUERIES["op4_chat"](spark, SF).collect()}
    assert got == want


def test_op6_equals_the_tokenizer(spark):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    encoder = tokenizers.Tokenizer.from_file(str(public.path("word_bpe_49k.json")))
    want, start = [], 0
    for r in sorted(rows("documents"), key=lambda r: r["doc_id"]):
        ids = [*encoder.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op6_tokens"](spark, SF).collect())
    assert got == want


def test_op7_agrees_with_held_out_labels(spark):
    labels = {r["doc_id"]: r["quality"] for r in rows("labels")}
    got = QUERIES["op7_quality"](spark, SF).collect()
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in rows("documents")} and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r["predicted"] == labels[r["doc_id"]] for r in got if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert sum(held) >= 0.9 * len(held) and len(held) > 10


def test_op10_agrees_with_held_out_languages(spark):
    docs = {r["doc_id"]: r for r in rows("documents")}
    got = QUERIES["op10_language"](spark, SF).collect()
    assert len(got) == len(docs) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in got if r["held_out"] and docs[r["doc_id"]]["lang"] and any(c.isalpha() for c in docs[r["doc_id"]]["text"] or "")]
    assert sum(held) >= 0.95 * len(held) and len(held) > 20
    assert all(r["lang_pred"] == "und" for r in got if not any(c.isalpha() for c in docs[r["doc_id"]]["text"] or ""))
