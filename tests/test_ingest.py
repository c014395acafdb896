import json
import shutil
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from pathspark.plans.compiler import evaluate_path
from pathspark.plans.templates import TEMPLATES
from pathspark.schema import RESOURCES
from pathspark.sources import store
from pathspark.sources.bundles import everything, read_ndjson, resources, stage
from pathspark.streaming.ingest import committed, ingest_batch, read_stream, stream_ndjson


def line(kind, i, patient="p", **more):
    return json.dumps({"resourceType": kind, "id": i, "subject": {"reference": f"Patient/{patient}"}, **more})


def encounter(i, start, patient="p"):
    return line("Encounter", i, patient, period={"start": start})


def condition(i, of, patient="p"):
    return line("Condition", i, patient, encounter={"reference": f"Encounter/{of}"}, code={"coding": [{"display": i}]})


def test_order_follows_files_and_lines(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        texts = {"b b": [json.dumps({"n": i, "x": "y" * (i * 37 % 90)}) for i in range(700)], "a": ['{"n":0}', "", '{"n":1}'], "c": [json.dumps({"n": i}) for i in range(300)]}
        for name, rows in texts.items():
            (tmp_path / f"{name}.ndjson").write_text("\n".join(rows) + "\n")
        got = read_ndjson(spark, str(tmp_path)).select("ord", "resource").orderBy("ord").collect()
        assert [r["resource"] for r in got] == [x for name in sorted(texts) for x in texts[name] if x]
        assert len({r["ord"] for r in got}) == len(got)
    finally:
        for k in ("maxPartitionBytes", "openCostInBytes"):
            spark.conf.unset(f"spark.sql.files.{k}")


def test_the_last_file_wins(spark, tmp_path):
    """The larger file is read first, whichever comes last."""
    old = [json.dumps({"resourceType": "Location", "id": "L", "name": "old"})]
    new = [json.dumps({"resourceType": "Location", "id": "L", "name": "new"}), *(json.dumps({"resourceType": "Encounter", "id": f"e{i}", "subject": {"reference": "Patient/p"}, "x": {"reference": "Location/L"}}) for i in range(50))]
    for k, (first, second) in enumerate(((old, new), (new, old))):
        d = tmp_path / str(k)
        d.mkdir()
        (d / "a.ndjson").write_text("\n".join(first))
        (d / "b.ndjson").write_text("\n".join(second))
        got = everything(read_ndjson(spark, str(d))).filter(F.get_json_object("resource", "$.id") == "L").collect()
        assert [json.loads(r["resource"])["name"] for r in got] == ["new" if k == 0 else "old"]


PARTS = {
    "1": [encounter("e", "2150-01-01T00:00:00Z"), condition("c0", "e"), line("Observation", "o", code={"coding": [{"display": "x"}]})],
    "2": [condition("c1", "e"), condition("c2", "f"), condition("c3", "never"), line("Condition", "c4")],
    "3": [encounter("f", "2150-02-01T00:00:00Z"), condition("c5", "e"), encounter("e", "2150-03-01T00:00:00Z", "q"), json.dumps({"resourceType": "Patient", "id": "p"})],
}


def shown(res, kind):
    return sorted(str((r["patient_id"], r["id"], r["_t"], r["_sort_t"])) for r in res.table(kind).select("patient_id", "id", "_t", "_sort_t").collect())


@pytest.mark.parametrize("order", [("1", "2", "3"), ("2", "1", "3"), ("3", "2", "1")])
def test_batches_in_any_order_give_the_tables_of_one_load(spark, tmp_path, order):
    (tmp_path / "in").mkdir()
    args = (spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"))
    for name in order:  # a call for each file: it goes on from the checkpoint
        (tmp_path / "in" / f"{name}.ndjson").write_text("\n".join(PARTS[name]) + "\n")
        stream_ndjson(*args).awaitTermination()
    assert committed(spark, str(tmp_path / "out")) == [0, 1, 2]
    got, want = read_stream(spark, str(tmp_path / "out")), resources(read_ndjson(spark, str(tmp_path / "in")))
    for kind in RESOURCES:
        assert shown(got, kind) == shown(want, kind)
    assert "('p', 'c1', datetime.datetime(2150, 1, 1, 0, 0), datetime.datetime(2150, 1, 1, 0, 0))" in shown(got, "Condition")
    q = spark.createDataFrame([("q", "p", "2150-01-15", None)], "question_id string, patient_id string, lo string, hi string").select("question_id", "patient_id", F.col("lo").cast("timestamp"), F.col("hi").cast("timestamp"))
    assert evaluate_path(got, TEMPLATES["diagnosis-name"].path(), q).first()["answer"] == '["c2"]'


def test_a_batch_that_was_cut_off_is_made_again(spark, tmp_path):
    rows = lambda name: spark.createDataFrame([("p", x, f"f{name}", 1000, i) for i, x in enumerate(PARTS[name])], "patient_id string, resource string, file string, file_size long, at long")
    target = str(tmp_path)
    ingest_batch(rows("2"), 0, target)
    ingest_batch(rows("1"), 1, target)
    before = shown(read_stream(spark, target), "Condition")
    # the third batch fails before its entry in the ledger
    ingest_batch(rows("3"), 2, target)
    shutil.rmtree(tmp_path / "ledger" / "batch=2")
    assert shown(read_stream(spark, target), "Condition") == before
    ingest_batch(rows("3"), 2, target)
    ingest_batch(rows("3"), 2, target)  # a batch that is committed is left alone
    once = shown(read_stream(spark, target), "Condition")
    assert len(once) == len(set(once)) == 6 and "('p', 'c2', datetime.datetime(2150, 2, 1, 0, 0), datetime.datetime(2150, 2, 1, 0, 0))" in once
    assert read_stream(spark, target).table("Observation").select("ord").distinct().count() == 1
    with pytest.raises(ValueError, match="no batch"):
        read_stream(spark, str(tmp_path / "none"))


def test_one_scan_of_the_raw_input_for_all_types(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, part in PARTS.items():
        (tmp_path / "in" / f"{name}.ndjson").write_text("\n".join(part) + "\n")
    entries = read_ndjson(spark, str(tmp_path / "in"))
    assert entries._jdf.queryExecution().executedPlan().toString().count("FileScan text") == 1
    staged = stage(entries, str(tmp_path / "staged"))
    res = resources(staged)
    for kind in RESOURCES:
        plan = res.table(kind)._jdf.queryExecution().executedPlan().toString()
        assert "FileScan text" not in plan and all("PartitionFilters: [isnotnull(kind" in x for x in plan.splitlines() if "FileScan parquet" in x)
    direct = resources(entries)
    for kind in RESOURCES:
        assert shown(res, kind) == shown(direct, kind)


def test_repeated_encounters_count_once(spark):
    rows = [("p", i, x) for i, x in enumerate([encounter("e", "2150-01-01T00:00:00Z"), condition("c", "e"), encounter("e", "2150-05-01T00:00:00Z")])]
    res = resources(spark.createDataFrame(rows, "patient_id string, ord long, resource string"))
    assert [str(r["_t"]) for r in res.table("Condition").collect()] == ["2150-05-01 00:00:00"]


@pytest.mark.parametrize(("master", "set_to", "path"), [("local", None, "/pathspark-"), ("local[4]", None, "/pathspark-"), ("spark://there:7077", "hdfs://x/y/", "hdfs://x/y"), ("local-cluster[2,1,900]", None, None), ("yarn", None, None)])
def test_shared_folder(master, set_to, path):
    """Only where driver and executors are one process may it be a local one of our own."""
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: set_to), sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda *_: None)))
    if path is None:
        with pytest.raises(ValueError, match="checkpoint"):
            store.shared_folder(session)
    else:
        assert path in store.shared_folder(session)
