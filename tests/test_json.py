import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from pathspark.functions import text as T
from pathspark.plans import annotations as A
from pathspark.plans.context import instant_ranges, instants

TEXTS = ["", "plain", 'quote " and \\ back', "line\nbreak\r\t\b\f", "\x00\x01\x1f\x7f", "é ß 日本語", "😀 astral 𝒳", "/slash/", "'", "{}[]:,", "a" * 5000 + "é"]


@pytest.mark.parametrize("seed", range(2))
def test_canonical_json_equals_sorted_compact_json(spark, seed):
    r = random.Random(seed)
    rows, want = [], []
    for i in range(60):
        m = {r.choice(TEXTS) + str(k): r.choice([None, *TEXTS]) for k in range(r.randrange(5))}
        items = r.choice([None, [], [(r.choice([None, *TEXTS]), r.choice([None, i]), {"z": True, "a": None})]])
        name, n = r.choice([None, *TEXTS]), r.choice([None, i, -(10**12)])
        keys = list(m)
        r.shuffle(keys)
        rows.append((i, name, n, {k: m[k] for k in keys}, items))
        data = {"name": name, "n": n, "m": m, "items": None if items is None else [{"s": s, "b": b, "t": t} for s, b, t in items]}
        want.append((i, hashlib.sha256(json.dumps(data, sort_keys=True, separators=(",", ":")).encode()).hexdigest()))
    df = spark.createDataFrame(rows, "i int, name string, n long, m map<string,string>, items array<struct<s:string,b:int,t:map<string,boolean>>>")
    assert [tuple(x) for x in df.select("i", T.record_hash(df, ["items", "name", "m", "n"])).orderBy("i").collect()] == want


def test_instants_become_iso_text(spark):
    df = spark.sql("SELECT timestamp'2150-01-02 03:04:05.678' AS a, timestamp_ntz'2150-01-02 03:04:05' AS b, null AS c, true AS d")
    kind = df.schema
    assert df.select(T.canonical_json(F.struct(*df.columns), kind)).first()[0] == '{"a":"2150-01-02T03:04:05.678000","b":"2150-01-02T03:04:05","c":null,"d":true}'


def test_strings_of_json_are_its_values(spark):
    docs = [{"k": "v", "k2": {"a b": ["x", {"y": "z"}], "q": 'in "quotes" : "here"'}}, {"colon : ": ": x", "é": "ü\n"}, ["a", ["b"]], {}, "alone", 5, None, {"a": "\\", "b\\": "c"}]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(90, None), (91, "no json"), (92, json.dumps({"x": "y" * 300_000}))], "i int, j string")

    def strings(x):
        return [x] if isinstance(x, str) else [s for v in (x.values() if isinstance(x, dict) else x if isinstance(x, list) else []) for s in strings(v)]

    got = {r["i"]: r["s"] for r in df.select("i", T.json_strings(F.col("j")).alias("s")).collect()}
    assert all(got[i] == [s for s in strings(d) if s] for i, d in enumerate(docs)) and got[90] is None and got[91] == [] and len(got[92][0]) == 300_000


def test_instants_are_looked_for_in_values_alone(spark):
    doc = {"2140-01-01T00:00:00Z": "x", "a": {"2141-01-01T00:00:00Z": ["2150-01-01T00:00:00Z", "2025-05-05T00:00:00Z", "from 2150-03-01T00:00:00+02:00 on"]}}
    text = json.dumps(doc).replace("2150-01", "2150\\u002d01")
    df = spark.createDataFrame([("p", text), ("q", "{}"), ("r", None)], "id string, j string")
    assert sorted(str(r["at"]) for r in instants(df, "j").collect()) == ["2150-01-01 00:00:00", "2150-02-28 22:00:00"]
    assert {tuple(map(str, r)) for r in instant_ranges(df, "j").collect()} == {("p", "2150-01-01 00:00:00", "2150-02-28 22:00:00"), ("q", "None", "None"), ("r", "None", "None")}


def test_annotations(spark):
    rows = [
        (1, json.dumps({"val_placeholder": {"drug_name1": "A", "drug_name": ["B", "-", None, ""], "lab_name": "L", "lab_value": [1, "2"], "lab_name2": "M", "lab_value3": 9, "x": {"b": 1, "a": [True]}}, "op": {"drug_name1": "C"}})),
        (2, json.dumps({"val_placeholder": {"drug_name7": "A", "lab_name": ["L", "N"], "lab_value": 5.5, "vital_name1": "V", "vital_value1": "null"}, "op": "text", "none": None})),
        (3, "no json"), (4, None), (5, "[1]"), (None, json.dumps({"val_placeholder": {"lab_name": "L", "lab_value": 7}})),
    ]
    found = A.placeholders(spark.createDataFrame(rows, "id long, j string"), "id", "j")
    got = {(r["category"], r["name"]): r["values"] for r in A.value_sets_of(found).collect()}
    v = "val_placeholder"
    assert got == {
        (v, "drug_name1"): ["A"], (v, "drug_name"): ["A", "B"], (v, "drug_name7"): ["A"], (v, "lab_name"): ["L", "N"], (v, "lab_value"): ["1", "2", "5.5", "7"], (v, "lab_name2"): ["M"], (v, "lab_value3"): ["9"],
        (v, "x"): ['{"a":[true],"b":1}'], (v, "vital_name1"): ["V"], ("op", "drug_name1"): ["C"],
    }
    assert {(r["kind"], r["name"]): r["values"] for r in A.value_maps(found, "id").collect()} == {("lab", "L"): ["1", "2", "5.5"], ("lab", "N"): ["5.5"]}


def test_annotations_are_parsed_once(spark):
    from pathspark.queries import QUERIES

    rows = [(json.dumps({"val_placeholder": {"lab_name": n, "lab_value": [v, v + 1]}}),) for n, v in [("L", 1), ("L", 1), ("M", 3), ("L", 5)]]
    texts = A.texts_of(spark.createDataFrame(rows, "j string"), "j")
    assert texts.count() == 3
    assert {(r["kind"], r["name"]): r["values"] for r in A.value_maps_of(texts, "j").collect()} == {("lab", "L"): ["1", "2", "5", "6"], ("lab", "M"): ["3", "4"]}
    for name in ("annotated_value_sets", "annotated_value_maps"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [l_orderkey") == 1


def test_punctuation(spark):
    pairs = [("a , b", "a, b"), ("  a  b ", "a b"), ("x .5 y .", "x .5 y."), ("the patient 's note", "the patient's note"), ("it 'sup", "it 'sup"), ("( a )", "( a)"), ("a\n\nb", "a\n\nb"), ("what ? !", "what?!"), ("", ""), (None, None), (" . ", "."), ("a ] } )b", "a]})b"), ("v :-)", "v:-)"), ("a :b", "a :b")]
    df = spark.createDataFrame([(a, b) for a, b in pairs], "a string, b string")
    assert [tuple(r) for r in df.filter(~T.tidy_punctuation(F.col("a")).eqNullSafe(F.col("b"))).select("a", T.tidy_punctuation(F.col("a"))).collect()] == []
