import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pathspark.operators import coverage
from pathspark.plans.context import write_contexts
from pathspark.plans.generate import final_dataset, own_texts, texts_of, write_records
from pathspark.sources import store
from pathspark.sources.bundles import bundle_entries, resources

TEXTS = "template_id string, perspective string, text string"


def texts(r, m):
    return [(r.choice("abc"), r.choice(["clinical", "patient"]), f"t{i}") for i in range(m)]


def by_hash(rows, seed):
    return sorted(rows, key=lambda x: (hashlib.md5("/".join([str(seed), *x]).encode()).hexdigest(), *x))


def expected(rows, people, can, passes, seed, quota):
    """The assignment by its definition: the first patient from the text's beginning on that answers, in the first pass that has one."""
    rows, people = by_hash(set(rows), seed), [p for (p,) in by_hash({(p,) for p in people}, seed)]
    given = {}
    for i, t in enumerate(rows):
        home = i * len(people) // len(rows)
        hit = next(((p, d) for d in range(passes) for p in (people[(home + j) % len(people)] for j in range(len(people))) if can(t[2], p, d)), None)
        if hit:
            given[t] = hit
    cycle, n = {}, {}
    for t in rows:
        if t in given:
            p = given[t][0]
            cycle[t] = n.get(p, 0) // quota + 1
            n[p] = n.get(p, 0) + 1
    return {(*t, *given[t], cycle[t]) for t in given}


#: Which patients answer a text, by a number of both, the same in Spark and Python; few texts are hard to place, some have no patient.
def can(text, patient, attempt):
    i, k = int(text[1:]), int(patient[1:])
    return i % 11 != 0 and (k * 7 + i * 3 + attempt * 5) % 13 == 0 if i % 5 else i % 10 == 0 and k == 3 and attempt == 1


def can_column():
    i, k, a = F.substring("text", 2, 9).cast("int"), F.substring("patient_id", 2, 9).cast("int"), F.col("pass")
    return F.when(i % 5 != 0, (i % 11 != 0) & ((k * 7 + i * 3 + a * 5) % 13 == 0)).otherwise((i % 10 == 0) & (k == 3) & (a == 1))


def run(spark, path, rows, people, attempts=20, passes=1, rounds=None, seed=42, seen=None):
    coverage.begin(spark.createDataFrame(rows, TEXTS), spark.createDataFrame([(p,) for p in people], "patient_id string"), path, seed)

    def answer(asked, n):
        if seen is not None:
            seen.append((asked.groupBy("patient_id").count().agg(F.max("count")).first()[0], asked.count()))
        return asked.filter(can_column()).select("number", "j", "template_id", "perspective", "text", "patient_id", "pass")

    return coverage.sweep(path, spark, answer, attempts, passes, rounds)


@pytest.mark.parametrize(("m", "p", "attempts", "passes", "quota"), [(120, 40, 20, 1, 10), (30, 7, 5, 2, 2), (1, 1, 20, 1, 1)])
def test_each_text_goes_to_the_first_patient_that_answers(spark, tmp_path, m, p, attempts, passes, quota):
    rows, people, seen = texts(random.Random(m), m), [f"p{i}" for i in range(p)], []
    left = run(spark, str(tmp_path), [*rows, rows[0]], [*people, people[0]], attempts, passes, seen=seen)
    got = coverage.records(str(tmp_path), spark, quota)
    want = expected(rows, people, can, passes, 42, quota)
    assert {tuple(r) for r in got.select("template_id", "perspective", "text", "patient_id", "pass", "cycle").collect()} == want and got.count() == len(want)
    assert left == 0 and all(most <= attempts for most, _ in seen)
    assert {r["text"] for r in coverage.unused(str(tmp_path), spark).collect()} == {t[2] for t in rows} - {w[2] for w in want}
    assert got.groupBy("patient_id", "cycle").count().filter(F.col("count") > quota).isEmpty()


def test_a_run_that_was_cut_off_goes_on_with_the_same_assignment(spark, tmp_path):
    rows, people = texts(random.Random(3), 40), [f"p{i}" for i in range(16)]
    path, seen = str(tmp_path), []
    assert run(spark, path, rows, people, 4, 2, rounds=2) > 0
    before = {tuple(r) for r in coverage.records(path, spark).select("text", "patient_id").collect()}
    # a round that was cut off in the middle: records without what is left, and a table of what is left that isn't whole
    spark.createDataFrame([(0, 0, "p0")], "number long, j long, patient_id string").write.parquet(f"{path}/records/round=2")
    spark.range(3).write.parquet(f"{path}/left/cycle=2")
    (tmp_path / "left" / "cycle=2" / "_SUCCESS").unlink()
    assert {tuple(r) for r in coverage.records(path, spark).select("text", "patient_id").collect()} == before
    # other texts and patients of a later call change nothing
    assert run(spark, path, texts(random.Random(9), 5), ["x1"], 20, 2, seen=seen) == 0 and seen
    got = coverage.records(path, spark).select("template_id", "perspective", "text", "patient_id", "pass", "cycle")
    assert {tuple(r) for r in got.collect()} == expected(rows, people, can, 2, 42, 10)
    assert before <= {(r["text"], r["patient_id"]) for r in got.collect()}


def test_attempts_follow_the_texts_and_not_the_patients(spark, tmp_path):
    asked = []
    for p in (100, 2000):
        rows, people, seen = [("a", "clinical", f"t{i}") for i in (1, 2, 3, 4, 6)], [f"p{i}" for i in range(p)], []
        assert run(spark, str(tmp_path / str(p)), rows, people, seen=seen) == 0
        assert {tuple(r) for r in coverage.records(str(tmp_path / str(p)), spark).select("template_id", "perspective", "text", "patient_id", "pass", "cycle").collect()} == expected(rows, people, can, 1, 42, 10)
        asked.append(sum(n for _, n in seen))
    assert max(asked) <= 5 * (4 + 16 + 64)


def test_nothing_to_draw(spark, tmp_path):
    assert run(spark, str(tmp_path / "a"), [], ["p1"]) == 0 and coverage.unused(str(tmp_path / "a"), spark).count() == 0
    assert run(spark, str(tmp_path / "b"), texts(random.Random(1), 3), []) == 3
    assert run(spark, str(tmp_path / "c"), [(None, "clinical", "t1"), ("a", "clinical", "t7")], ["p0", None] + [f"p{i}" for i in range(13)]) == 0
    assert coverage.records(str(tmp_path / "c"), spark).count() == 1
    with pytest.raises(ValueError, match="no round"):
        coverage.records(str(tmp_path / "a"), spark)


@pytest.fixture(scope="module")
def clinic(spark, tmp_path_factory):
    import json

    from tests.fixture_bundle import PA, PB

    people = [("pA", PA), ("pB", PB)]
    for i in range(4):  # patients like pA
        people.append((f"pA{i}", json.loads(json.dumps(PA).replace('"pA"', f'"pA{i}"'))))
    res = resources(bundle_entries(spark.createDataFrame([(p, json.dumps(d)) for p, d in people], "patient_id string, value string"), "value"))
    res.tables = {k: t.cache() for k, t in res.tables.items()}
    contexts = write_contexts(res, res.table("Patient").select("patient_id").distinct(), str(tmp_path_factory.mktemp("contexts") / "c"))
    return res, contexts


def test_final_dataset_uses_every_text_once(spark, tmp_path, clinic):
    res, contexts = clinic
    texts = spark.createDataFrame([("patient-gender", who, f"{who} {i}: {{patient_id}}") for who in ("clinical", "patient") for i in range(8)] + [("lab-name", "clinical", f"lab {i} [time_filter_exact1] {{patient_id}}") for i in range(3)] + [("has-drug-prescribed", "patient", "no slot"), ("unknown", "patient", "x")], TEXTS)
    path = str(tmp_path)
    first = final_dataset(res, contexts, texts, path, quota=2, attempts=8, passes=2, rounds=1)
    some = {(r["question_template"], r["patient_id"]) for r in first.collect()}
    got = final_dataset(res, contexts, texts, path, quota=2, attempts=8, passes=2).collect()
    assert some <= {(r["question_template"], r["patient_id"]) for r in got}
    asked = {tuple(r) for r in texts.collect()} - {("unknown", "patient", "x")}
    used = [(r["question_template_id"], r["perspective"], r["question_template"]) for r in got]
    left = {(r["template_id"], r["perspective"], r["text"]) for r in coverage.unused(path, spark).collect()}
    assert len(used) == len(set(used)) and set(used) | left == asked and not set(used) & left
    assert len([u for u in used if u[0] == "patient-gender"]) == 16 and len({r["id"] for r in got}) == len(got)
    assert all(r["answer"] not in ("[]", "[0]") and "{" not in r["question"] for r in got)
    per = {}
    for r in got:
        per[r["patient_id"], r["cycle"]] = per.get((r["patient_id"], r["cycle"]), 0) + 1
    assert max(per.values()) <= 2
    again = final_dataset(res, contexts, texts, str(tmp_path / "again"), quota=2, attempts=20, passes=2).collect()
    assert {(r["question_template"], r["patient_id"], r["answer"], r["cycle"]) for r in again} == {(r["question_template"], r["patient_id"], r["answer"], r["cycle"]) for r in got}


def leaves(df):
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()


def test_plans_grow_by_a_constant_per_template(spark, tmp_path, clinic):
    from pathspark.plans.generate import generate

    res, contexts = clinic
    one, two, three = (leaves(generate(res, contexts, ["patient-gender", "patient-birth-date", "patient-gender"][:n])) for n in (1, 2, 3))
    assert two - one == three - two <= 12
    assert leaves(generate(res, contexts, ["has-normal-vital"])) < 16
    got = write_records(res, contexts, str(tmp_path / "r"), ["patient-gender", "lab-name"], n=2)
    assert leaves(got) == 1 and {r["question_template_id"] for r in got.select("question_template_id").distinct().collect()} == {"patient-gender", "lab-name"}


def test_texts(spark):
    both = spark.createDataFrame([("a", ["x", "y"], ["z"]), ("b", [], None)], "template_id string, clinical array<string>, patient array<string>")
    assert {tuple(r) for r in texts_of(both).collect()} == {("a", "clinical", "x"), ("a", "clinical", "y"), ("a", "patient", "z")}
    assert own_texts(spark).count() == 61


def test_scratch_tables_go(spark):
    with store.Scratch(spark) as keep:
        assert keep(spark.range(3)).count() == 3 and store.exists(spark, keep.path)
    assert not store.exists(spark, keep.path)
