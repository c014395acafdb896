import os
import json

import pytest
from pyspark.sql import functions as F

from pathspark.plans import timewin as W
from pathspark.plans.compiler import evaluate_path
from pathspark.plans.context import contexts, datetime_ranges, instants, value_sets
from pathspark.plans.generate import generate
from pathspark.plans.parser import analyze
from pathspark.plans.templates import TEMPLATES, VALUE_PATHS
from pathspark.sources.bundles import bundle_entries, resources
from tests.fixture_bundle import ASK, PA, PB

#: What pA answers to pick = first, and to last.
EXPECTED = {
    "count-drugs-prescribed": ("[2]", "[2]"), "count-hospital-visits": ("[2]", "[2]"), "count-icu-visits": ("[1]", "[1]"), "count-input-intake-events": ("[1]", "[1]"), "count-output-events": ("[2]", "[2]"), "count-lab-test-events": ("[2]", "[2]"),
    "count-procedure-events": ("[1]", "[1]"), "count-specific-drug-prescriptions": ("[2]", "[2]"), "has-normal-vital": ("[true]", "[true]"), "has-organism-found": ("[true]", "[true]"), "has-micro-test-specific": ("[true]", "[true]"),
    "time-hospital-admission": ('["2150-01-10T13:00:00.000Z"]', '["2150-02-01T00:00:00.000Z"]'), "time-intake": ('["2150-01-11T01:00:00.000Z"]', '["2150-01-11T02:00:00.000Z"]'), "lab-measurement": ("[5.5]", "[9.0]"), "vital-measurement": ("[80.0]", "[80.0]"),
    "weight": ('["70.0","kg"]', '["70.0","kg"]'), "diagnosis-name": ('["Flu","Cough"]', '["Fall"]'), "specimen-name": ('["BLD","Blood"]', '["BLD","Blood"]'), "organism-name": ('["E. coli"]', '["E. coli"]'), "drug-name-route": ('["Aspirin"]', '["Aspirin"]'),
    "drug-dose": ("[100.0]", "[]"), "procedure-name": ('["Biopsy"]', '["Dialysis"]'), "patient-gender": ('["female"]', '["female"]'), "admission-type": ('["Direct"]', '["Urgent"]'),
}


@pytest.fixture(scope="module")
def res(spark):
    docs = spark.createDataFrame([("pA", json.dumps(PA)), ("pB", json.dumps(PB))], "patient_id string, value string")
    r = resources(bundle_entries(docs, "value"))
    r.tables = {k: t.cache() for k, t in r.tables.items()}
    return r


def questions(spark, t):
    rows = [(f"{p}-{k}", p, k, *(ASK[s] for s in t.slots[1:])) for p in ("pA", "pB") for k in ("first", "last")]
    return spark.createDataFrame(rows, "question_id string, patient_id string, pick string" + "".join(f", {s} {'double' if s.endswith('value') else 'string'}" for s in t.slots[1:]))


def test_there_are_61_templates_and_all_parse():
    assert len(TEMPLATES) == 61
    assert [analyze(t.path()) for t in TEMPLATES.values()] == [""] * 61
    assert not any(analyze(p) for paths in VALUE_PATHS.values() for p in paths)


@pytest.mark.parametrize("template_id", sorted(TEMPLATES))
def test_template(spark, res, template_id):
    t = TEMPLATES[template_id]
    got = {r["question_id"]: r["answer"] for r in evaluate_path(res, t.path(), questions(spark, t)).collect()}
    if template_id in EXPECTED:
        assert (got["pA-first"], got["pA-last"]) == EXPECTED[template_id]
    if not template_id.startswith("patient-"):
        assert got["pB-first"] == {"count": "[0]", "boolean": "[false]"}.get(t.result, "[]")


def one(spark, res, path, patient="pA"):
    return evaluate_path(res, path, spark.createDataFrame([("q", patient)], "question_id string, patient_id string")).first()["answer"]


@pytest.mark.parametrize(
    ("path", "answer"),
    [
        ("where(resourceType = 'Observation' and code.coding.display = 'Pulse').count()", "[1]"),  # two codings are not one
        ("where(resourceType = 'Observation' and code.coding.where(display = 'Pulse').exists()).count()", "[2]"),
        ("where(resourceType = 'Encounter' and location.where(location.resolve().name = 'Ward').exists()).count()", "[1]"),
        ("where(resourceType = 'Encounter').location.sort(period.start.toDateTime()).first().location.resolve().name", '["Unit"]'),
        ("where(resourceType = 'Condition' and encounter.resolve().period.start.toDateTime() >= @2150-02-01).code.coding.display", '["Fall"]'),
        ("where(resourceType = 'Condition' and encounter.empty()).code.coding.display", '["Lost"]'),
        ("where(resourceType = 'Observation' and valueQuantity.value = %context.Bundle.entry.resource.where(resourceType = 'Observation' and code.coding.display = 'Daily Weight').select(valueQuantity.value)).count()", "[1]"),
        ("where(resourceType = 'Medication').empty()", "[false]"),
        ("where(resourceType = 'Specimen').type.coding.select(code | display)", '["BLD","Blood"]'),
    ],
)
def test_path(spark, res, path, answer):
    assert one(spark, res, "Bundle.entry.resource." + path) == answer


def test_analyze_says_what_is_wrong():
    assert "unknown function" in analyze("Bundle.entry.resource.wher(x)") and analyze("a.") and analyze("") and analyze("a ~ b")


def test_windows_of_all_identifiers(spark):
    q = spark.createDataFrame([(t, "2150-03-31 10:20:30", 2, "2150-03-31 10:20:30") for t in W.TIME_EXPRESSIONS], "time_id string, date string, n int, now string")
    for mode in ("calendar", "compat"):
        got = {r["time_id"]: (str(r["lo"]), str(r["hi"])) for r in W.with_windows(q, mode).collect()}
        assert len(got) == 31 and got["blank"] == ("None", "None") and got["abs-exact-in"] == ("2150-03-31 10:20:30",) * 2
        if mode == "calendar":
            assert got["abs-month-in"] == ("2150-03-01 00:00:00", "2150-03-31 23:59:59.999999") and got["rel-month-in-last"] == ("2150-02-01 00:00:00", "2150-02-28 23:59:59.999999")
            assert got["abs-year-until"] == ("None", "2150-12-31 23:59:59.999999") and got["rel-day-since"] == ("2150-03-29 00:00:00", "None")
        else:
            assert got["abs-month-in"] == ("2150-03-01 10:20:30", "2150-03-31 10:20:30") and got["abs-day-in"] == ("2150-03-31 10:20:30",) * 2 and got["rel-year-in-last"] == ("2149-01-01 10:20:30", "2149-12-31 10:20:30")


def test_phrases(spark):
    q = spark.range(1).select(F.lit("2150-03-31 10:20:30").cast("timestamp").alias("d"), F.lit(1).alias("n"))
    say = lambda t: q.select(W.phrase(F.lit(t), F.col("d"), F.col("n")).alias("p")).first()["p"]
    assert [say(t) for t in ("abs-year-in", "abs-month-until", "abs-day-in", "abs-exact-in", "rel-day-in-last", "rel-month-since-last", "rel-year-until", "exact-last", "blank")] == [
        "in 2150", "until 03/2150", "on 31/03/2150", "at 2150-03-31 10:20:30", "yesterday", "since last month", "until 1 year ago", "last", "",
    ]


def test_value_sets_and_ranges(spark, res):
    patients = spark.createDataFrame([("pA",), ("pB",)], "patient_id string")
    got = {(r["patient_id"], r["slot"]): r["values"] for r in value_sets(res, patients, fallback={"gender": ["x"], "lab_name": ["any"]}).collect()}
    assert got["pA", "drug_name"] == ["Aspirin", "Heparin"] and got["pA", "careunit"] == ["Unit", "Ward"] and got["pB", "lab_name"] == ["any"] and got["pB", "gender"] == ["male"]
    assert got["pA", "vital_value"] == ["180.0", "5.5", "70.0", "80.0", "9.0"]
    ranges = {r["patient_id"]: str(r["first"]) for r in datetime_ranges(res).collect()}
    assert ranges["pA"] == "2150-01-10 10:00:00" and ranges["pB"] == "None"


def test_instants_anywhere_in_json(spark):
    df = spark.createDataFrame([("p", '{"a":["2150-01-01T00:00:00+01:00"],"b":{"c":"2025-01-01T00:00:00Z 2150-01-01T00:00:00.5Z 2150-99-01T00:00:00Z"}}')], "id string, j string")
    assert sorted(str(r["at"]) for r in instants(df, "j").collect()) == ["2149-12-31 23:00:00", "2150-01-01 00:00:00.500000"]


def test_generation_is_deterministic_and_answers_are_not_null(spark, res):
    patients = spark.createDataFrame([("pA",), ("pB",)], "patient_id string")
    ctx = contexts(res, patients).cache()
    some = ["count-hospital-visits", "has-vital-comparison", "lab-name", "patient-gender"]
    first, second = ([tuple(r) for r in generate(res, ctx, some, n=3).drop("s_placeholders", "t_placeholders").orderBy("question_id").collect()] for _ in range(2))
    assert first == second and first and all("{" not in r[2] and "[" not in r[2] and r[-2] not in ("[]", "[0]") for r in first)


def test_questions_of_all_templates_have_no_open_slot(spark, res):
    patients = spark.createDataFrame([("pA",), ("pB",)], "patient_id string")
    got = generate(res, contexts(res, patients).cache(), n=2, answers=False).select("question_template_id", "patient_id", "question", "s_placeholders").collect()
    assert got and not [r for r in got if set("{}[]") & set(r["question"])]
    # pB has no observations, so no question asks for one of a name
    assert not [r for r in got if r["patient_id"] == "pB" and "vital_name" in r["s_placeholders"]]
    assert {r["question_template_id"] for r in got if r["patient_id"] == "pA"} >= {"has-vital-comparison", "count-hospital-visits", "lab-measurement"}


def test_measured_values_belong_to_the_drawn_name(spark, res):
    from pathspark.plans.context import named_values

    patients = spark.createDataFrame([("pA",), ("pB",)], "patient_id string")
    own = {(r["slot"], r["name"]): r["values"] for r in named_values(res, patients).collect()}
    assert own and all(v for v in own.values())
    got = generate(res, contexts(res, patients), ["has-vital-comparison"], n=20, answers=False).select("s_placeholders").collect()
    drawn = {(r[0]["vital_name"], r[0]["vital_value"]) for r in got}
    assert len({n for n, _ in drawn}) > 1 and all(v in own["vital_value", n] for n, v in drawn)


def test_filters_reach_the_scan(spark, tmp_path):
    from pathspark.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    plan = lambda name: QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert any("GreaterThan" in line and "o_orderdate" in line for line in plan("count_visits_by_patient").splitlines() if "PushedFilters" in line)
    assert any("value" in line and "90.0" in line for line in plan("has_value_comparison").splitlines() if "PushedFilters" in line)


def test_placeholders(spark, res):
    from pathspark.plans.templates import PLACEHOLDERS, VALUE_PATHS, placeholder_path, register_placeholder

    assert len(PLACEHOLDERS) == 16
    values = {"drug_name": "Aspirin", "careunit": "Ward", "spec_name": "Blood", "input_name": "Saline"}
    for name, value in values.items():
        for resource in PLACEHOLDERS[name]:
            q = spark.createDataFrame([("q", "pA", value)], "question_id string, patient_id string, value string")
            path = placeholder_path(name, resource) + ".count()"
            if resource in ("Medication", "Specimen"):  # they have no event time, which an open window doesn't ask for
                assert evaluate_path(res, path, q).first()["count"] == 1
            else:
                assert evaluate_path(res, path, q).first()["count"] >= 1
    register_placeholder("weight_unit", {"Observation": "valueQuantity.unit = %value"}, ("Bundle.entry.resource.where(resourceType = 'Observation').valueQuantity.unit",))
    with pytest.raises(ValueError):
        register_placeholder("weight_unit", {})
    del PLACEHOLDERS["weight_unit"], VALUE_PATHS["weight_unit"]


def test_registered_comparisons_are_drawn_and_asked_for(spark, res):
    from pathspark.plans.templates import OPERATIONS, register_operation

    with pytest.raises(ValueError):
        register_operation("greater", ">")
    with pytest.raises(ValueError):
        register_operation("like", "~")
    register_operation("same", "=")
    try:
        q = spark.createDataFrame([("q1", "pA", "Pulse", 80.0, "same"), ("q2", "pA", "Pulse", 81.0, "same"), ("q3", "pA", "Pulse", 79.0, "greater")], "question_id string, patient_id string, vital_name string, vital_value double, comparison string")
        path = TEMPLATES["has-vital-comparison"].path()
        assert not analyze(path)
        assert {r["question_id"]: r["flag"] for r in evaluate_path(res, path, q).collect()} == {"q1": True, "q2": False, "q3": True}
    finally:
        del OPERATIONS["same"]


def test_everything_of_a_patient(spark):
    from pathspark.sources.bundles import everything

    def resource(kind, i, *refs, **more):
        return json.dumps({"resourceType": kind, "id": i, "x": [{"reference": r} for r in refs], **more})

    rows = [
        ("a", 0, resource("Encounter", "e1", "Location/l1", "Patient/a", "Location/gone")), ("a", 1, resource("Encounter", "e1", "Location/l2")), ("b", 2, resource("Observation", "o1", "Specimen/s1", "Location/l2")),
        ("c", 3, resource("Patient", "c")), (None, 4, resource("Location", "l1")), (None, 5, resource("Location", "l2", "Organization/g")), (None, 6, resource("Organization", "g", "Location/l2")),
        (None, 7, resource("Specimen", "s1")), (None, 8, resource("Provenance", "v", "Observation/o1")), (None, 9, resource("Device", "d", "Observation/o1")), (None, 10, resource("Specimen", "s1", y=1)),
    ]
    entries = spark.createDataFrame(rows, "patient_id string, ord long, resource string")
    got = sorted((r["patient_id"], json.loads(r["resource"])["id"]) for r in everything(entries).collect())
    # the last e1 counts, which doesn't refer to l1; l2 brings its organization
    assert got == [("a", "e1"), ("a", "g"), ("a", "l2"), ("b", "g"), ("b", "l2"), ("b", "o1"), ("b", "s1"), ("b", "v"), ("c", "c")]
    assert everything(entries.limit(0)).count() == 0


def test_everything_reads_entries_once_and_stores_no_text_by_patient(spark):
    """Before, each round read all entries again, and stored a shared resource's text once for each patient."""
    import os
    import random

    from pathspark.sources import store
    from pathspark.sources.bundles import everything

    def resource(kind, i, *refs, **more):
        return json.dumps({"resourceType": kind, "id": i, "x": [{"reference": r} for r in refs], **more})

    read, long = spark.sparkContext.accumulator(0), random.Random(5).randbytes(10000).hex()
    rows = [(f"p{i}", i, resource("Encounter", f"e{i}", "Location/l")) for i in range(300)]
    rows += [(None, 300, resource("Location", "l", "Location/m", y=long)), (None, 301, resource("Location", "m", "Organization/g")), (None, 302, resource("Organization", "g", "Location/l"))]
    rows += [(None, 303, resource("Provenance", "v", "Location/gone")), ("q", 304, resource("Encounter", "e", "Location/gone", "Medication/own")), ("q", 305, resource("Medication", "own")), (None, 306, resource("Medication", "own", "Location/l"))]

    @F.udf("string")
    def counted(x):
        read.add(1)
        return x

    entries = spark.createDataFrame(rows, "patient_id string, ord long, resource string").withColumn("resource", counted("resource"))
    with store.Scratch(spark) as keep:
        got = everything(entries, keep=keep)
        size = sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(keep.path.removeprefix("file:")) for f in files)
        assert 10000 < size < 300 * 1000  # of 6 MB if it were stored by patient
        n = got.groupBy("patient_id").agg(F.count("*").alias("n"), F.sum(F.length("resource")).alias("size"), F.sort_array(F.collect_list("ref")).alias("refs")).collect()
    assert read.value == len(rows)
    by = {r["patient_id"]: r for r in n}
    assert len(by) == 301 and by["q"]["refs"] == ["Encounter/e", "Medication/own"]
    assert all(by[f"p{i}"]["refs"] == [f"Encounter/e{i}", "Location/l", "Location/m", "Organization/g"] and by[f"p{i}"]["size"] > 20000 for i in range(300))
