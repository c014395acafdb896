import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pathspark.operators.intervals import interval_join
from pathspark.plans.compiler import Plan, evaluate_path
from pathspark.queries import clinical, windowed_patients
from pathspark.plans.templates import TEMPLATES

SF = "/root/testdata/sf0.001"
START = datetime(2000, 1, 1)


def instant(r):
    return START + timedelta(seconds=r.choice([r.randrange(100), r.randrange(10**5), r.randrange(10**7), r.randrange(10**9)]), microseconds=r.choice([0, 1, 999_999]))


@pytest.mark.parametrize("seed", range(2))
def test_pairs_equal_brute_force(spark, seed):
    r = random.Random(seed)
    events = [(i, r.choice(["a", "b", "c", None]), r.choice([instant(r), instant(r), None]) if i % 9 else None) for i in range(250)]
    windows = []
    for i in range(120):
        lo, hi = sorted([instant(r), instant(r)])
        lo, hi = r.choice([(lo, hi), (lo, lo), (None, hi), (lo, None), (None, None), (hi, lo), (lo, lo + timedelta(days=r.choice([1, 31, 365, 3650]))), (lo - timedelta(days=40000), hi), (START - timedelta(days=9), START - timedelta(days=8))])
        windows.append((i, r.choice(["a", "b", "c", None]), lo, hi))
    events += [(1000 + i, "a", w[2] or w[3]) for i, w in enumerate(windows) if w[2] or w[3]]  # at the very bounds
    w = spark.createDataFrame(windows, "w int, k string, lo timestamp, hi timestamp")
    e = spark.createDataFrame(events, "e int, ek string, t timestamp")
    got = [tuple(x) for x in interval_join(w, e, ("k", "ek"), "lo", "hi", "t").select("w", "e").collect()]
    want = [(i, j) for i, k, lo, hi in windows for j, ek, t in events if k is not None and k == ek and t is not None and (lo is None or t >= lo) and (hi is None or t <= hi)]
    assert sorted(got) == sorted(want) and len(want) > 1000


def test_nothing_to_join(spark):
    w = spark.createDataFrame([(1, "a", None, None)], "w int, k string, lo timestamp, hi timestamp")
    e = spark.createDataFrame([(1, "a", START)], "e int, ek string, t timestamp")
    join = lambda x, y: interval_join(x, y, ("k", "ek"), "lo", "hi", "t")
    assert join(w, e).count() == 1 and join(w.limit(0), e).count() == 0 and join(w, e.limit(0)).count() == 0 and join(w, e.withColumn("t", F.lit(None).cast("timestamp"))).count() == 0
    past = spark.createDataFrame([(1, "a", datetime(1990, 1, 1), datetime(1991, 1, 1))], w.schema)
    assert join(past, e).count() == 0 and join(w, e).columns == ["w", "k", "lo", "hi", "e", "ek", "t"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_batched_windows_use_buckets_and_push_their_bounds(spark):
    res, path = clinical(spark, SF, "Encounter"), TEMPLATES["count-hospital-visits"].path()
    q = windowed_patients(spark, SF, ("abs-month-in", "rel-day-in-last", "rel-month-in-last"))
    df = evaluate_path(res, path, q, windows="buckets")
    spark.conf.set("spark.sql.maxMetadataStringLength", "3000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = [x for x in plan.splitlines() if "PushedFilters" in x and "o_orderdate" in x]
    # from the first of February of 1997, back to May of 1996
    assert any("GreaterThanOrEqual(o_orderdate,1996-05-" in x and "LessThanOrEqual(o_orderdate,1997-0" in x for x in pushed), pushed
    plain = evaluate_path(res, path, q)
    assert {tuple(r) for r in df.select("question_id", "count").collect()} == {tuple(r) for r in plain.select("question_id", "count").collect()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("template_id", ["has-hospital-admission", "list-admission-times", "diagnosis-name", "time-hospital-admission"])
def test_both_ways_answer_alike(spark, template_id):
    res, q = clinical(spark, SF, "Encounter", "Condition"), windowed_patients(spark, SF, ("abs-year-in", "rel-year-until", "blank")).withColumn("pick", F.when(F.length("patient_id") % 2 == 0, "last").otherwise("first"))
    one, two = ({(r["question_id"], r["answer"]) for r in evaluate_path(res, TEMPLATES[template_id].path(), q, windows=w).collect()} for w in ("filter", "buckets"))
    assert one == two and len(one) == q.count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_picks_carry_only_what_is_asked_for(spark):
    res = clinical(spark, SF, "MedicationRequest")
    q = res.table("MedicationRequest").select(F.col("patient_id").alias("question_id"), "patient_id").distinct()
    plan = Plan("Bundle.entry.resource.where(resourceType = 'MedicationRequest').pick().medicationCodeableConcept.coding.code", res).run(q)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "l_returnflag" not in text and "l_quantity" not in text and "max_by" not in text  # routes, doses, and the other end
    assert "p_brand" in text
    distinct = Plan("Bundle.entry.resource.where(resourceType = 'MedicationRequest').select(medicationCodeableConcept).distinct().count()", res).run(q)
    assert "to_json" not in distinct._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_value_sets_scan_each_type_once(spark):
    from pathspark.plans.context import value_sets

    res = clinical(spark, SF, "Observation")
    got = value_sets(res, res.table("Observation").select("patient_id").distinct(), ["lab_name", "output_name", "vital_name", "vital_value", "lab_value"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2  # the patients, and all slots


def test_only_keys_with_many_instants_are_split_by_time(spark, monkeypatch):
    r = random.Random(5)
    w = spark.createDataFrame([(i, r.choice("abc"), START + timedelta(days=i), START + timedelta(days=i + r.choice([0, 3, 300]))) for i in range(60)], "w int, k string, lo timestamp, hi timestamp")
    e = spark.createDataFrame([(i, "aaab"[i % 4] if i % 50 else "c", START + timedelta(hours=7 * i)) for i in range(400)], "e int, ek string, t timestamp")
    pairs = lambda: interval_join(w, e, ("k", "ek"), "lo", "hi", "t")
    assert "Generate" not in pairs()._jdf.queryExecution().optimizedPlan().toString()
    want = sorted((x["w"], x["e"]) for x in w.join(e, (F.col("k") == F.col("ek")) & F.col("t").between(F.col("lo"), F.col("hi"))).collect())
    assert sorted((x["w"], x["e"]) for x in pairs().select("w", "e").collect()) == want and len(want) > 500
    monkeypatch.setattr("pathspark.operators.intervals.FEW", 100)  # a alone has more
    assert "Generate" in pairs()._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((x["w"], x["e"]) for x in pairs().select("w", "e").collect()) == want
