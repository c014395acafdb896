import json

import pytest

from pathspark import cli
from tests.fixture_bundle import PA, PB


def lines(path):
    return [json.loads(x) for f in path.glob("*.json") for x in f.read_text().splitlines()]


def test_from_bundles_to_a_filtered_corpus(spark, tmp_path):
    (tmp_path / "b").mkdir()
    for name, doc in (("pA", PA), ("pB", PB)):
        (tmp_path / "b" / f"{name}.json").write_text(json.dumps(doc))
    cli.main(["generate", str(tmp_path / "b"), str(tmp_path / "q"), "--templates", "patient-gender", "patient-birth-date"])
    made = lines(tmp_path / "q.jsonl")
    assert {(r["patient_id"], r["answer"]) for r in made if r["question_template_id"] == "patient-gender"} == {("pA", '["female"]'), ("pB", '["male"]')}
    text = made[0]["question_template"]
    (tmp_path / "s.json").write_text(json.dumps({made[0]["question_template_id"]: {text: "train"}}))
    cli.main(["add-splits", str(tmp_path / "q.jsonl"), str(tmp_path / "r"), str(tmp_path / "s.json"), "--holdout2", "patient-birth-date"])
    split = {r["question_template_id"]: (r["split"], r["holdout"]) for r in lines(tmp_path / "r.jsonl")}
    assert split["patient-birth-date"] == ("test", 2)
    cli.main(["filter", str(tmp_path / "r.jsonl"), str(tmp_path / "t"), "--splits", "test"])
    assert {r["question_template_id"] for r in lines(tmp_path / "t.jsonl")} == {"patient-birth-date"}
    cli.main(["valuesets", str(tmp_path / "b"), str(tmp_path / "v")])
    assert json.loads((tmp_path / "v" / "gender.json").read_text()) == ["female", "male"]


def test_paraphrases(spark, tmp_path):
    for name in ("c", "p"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"t": [f"{name} {i}" for i in range(20)]}))
    cli.main(["split-paraphrases", str(tmp_path / "c.json"), str(tmp_path / "p.json"), str(tmp_path / "o.json")])
    split = list(json.loads((tmp_path / "o.json").read_text())["t"].values())
    assert (split.count("test"), split.count("val"), split.count("train")) == (5, 4, 31)
    (tmp_path / "r.csv").write_text("﻿template_id,question_template,paraphrase,good\nt,x,yes,Y\nt,x,no,n\n", encoding="utf-8")
    cli.main(["review", str(tmp_path / "r.csv"), str(tmp_path / "a.json")])
    assert json.loads((tmp_path / "a.json").read_text()) == {"t": ["yes"]}


def test_validate():
    with pytest.raises(SystemExit) as e:
        cli.main(["validate"])
    assert not e.value.code
    with pytest.raises(SystemExit) as e:
        cli.main(["validate", "a.b.("])
    assert e.value.code


def say(asked):
    """A source of paraphrases: a good one, the same again, one that lost its slots, and one that is too near."""
    from pyspark.sql import functions as F

    good = F.concat(F.lit("Please look into the chart and tell me: "), "masked")
    return asked.select("template_id", F.explode(F.array(good, good, F.lit("Who is it that came here at all?"), F.concat("masked", F.lit("?")))).alias("paraphrase"))


def test_paraphrases_of_a_source(spark, tmp_path, capsys):
    out = tmp_path / "p.json"
    cli.main(["generate-paraphrases", "tests.test_cli:say", str(out), "--templates", "patient-gender"])
    cli.main(["generate-paraphrases", "tests.test_cli:say", str(out), "--templates", "patient-gender", "lab-name"])
    made = json.loads(out.read_text())
    assert set(made) == {"patient-gender", "lab-name"}
    own, *more = made["patient-gender"]
    assert "{patient_id}" in own and more == ["Please look into the chart and tell me: " + own]
    cli.main(["verify-paraphrases", str(out), str(tmp_path / "r"), "--analyze-only"])
    assert not (tmp_path / "r").exists()
    cli.main(["verify-paraphrases", str(out), str(tmp_path / "r")])
    text = "".join(f.read_text() for f in (tmp_path / "r").glob("*.csv"))
    assert text.startswith("template_id,question_template,paraphrase\n") and text.count("Please look") == 2
    capsys.readouterr()


def test_final_dataset_uses_all_paraphrases_and_goes_on(spark, tmp_path, capsys):
    (tmp_path / "b").mkdir()
    for name, doc in (("pA", PA), ("pB", PB)):
        (tmp_path / "b" / f"{name}.json").write_text(json.dumps(doc))
    texts = {"patient-gender": [f"Tell the gender of {{patient_id}}, please. {i}" for i in range(5)] + ["Not of this split {patient_id}"], "time-lab-test": ["When was a test of {patient_id} [time_filter_exact1]?"]}
    (tmp_path / "c.json").write_text(json.dumps(texts))
    (tmp_path / "p.json").write_text(json.dumps({"patient-gender": ["Who am I, {patient_id}?"]}))
    split = {t: {x: "test" if x.startswith("Not") else "train" for x in xs} for t, xs in texts.items()}
    split["patient-gender"]["Who am I, {patient_id}?"] = "train"
    (tmp_path / "s.json").write_text(json.dumps(split))
    ask = ["final-dataset", str(tmp_path / "b"), str(tmp_path / "w"), str(tmp_path / "o"), "--templates", "patient-gender", "time-lab-test"]
    ask += ["--paraphrases", str(tmp_path / "c.json"), str(tmp_path / "p.json"), "--split-file", str(tmp_path / "s.json")]
    cli.main([*ask, "--rounds", "1"])
    first = lines(tmp_path / "o.jsonl")
    cli.main(ask)
    made = lines(tmp_path / "o.jsonl")
    assert {r["question"] for r in first} <= {r["question"] for r in made}
    gender = {(r["perspective"], r["question_template"]) for r in made if r["question_template_id"] == "patient-gender"}
    assert gender == {("clinical", t) for t in texts["patient-gender"][:5]} | {("patient", "Who am I, {patient_id}?")}
    assert len(made) == 7 and {r["split"] for r in made} == {"train"} and {r["cycle"] for r in made} == {1}
    # only pA has a lab test
    assert [r["patient_id"] for r in made if r["question_template_id"] == "time-lab-test"] == ["pA"]
    capsys.readouterr()


def test_tags_exclusions_and_value_sets(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "pA.json").write_text(json.dumps(PA))
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "drug_name.json").write_text(json.dumps(["heparin"]))
    cli.main(["generate", str(tmp_path / "b"), str(tmp_path / "q"), "--tags", "Patient", "--templates", "has-drug-prescribed", "--exclude", "patient-birth-date", "--valuesets", str(tmp_path / "v"), "--no-evaluate", "--n", "6"])
    made = lines(tmp_path / "q.jsonl")
    assert {r["question_template_id"] for r in made} == {"patient-gender", "has-drug-prescribed"}
    assert {r["s_placeholders"]["drug_name"] for r in made if "drug_name" in r["s_placeholders"]} == {"Heparin"}
    cli.main(["generate", str(tmp_path / "b"), str(tmp_path / "p"), "--templates", "patient-gender", "--no-annotated"])
    assert [set(r) & {"s_placeholders", "question_template"} for r in lines(tmp_path / "p.jsonl")] == [set()]


def test_setup_and_validation_with_data(spark, tmp_path, capsys):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "pA.json").write_text(json.dumps(PA))
    (tmp_path / "c.json").write_text("{}")

    def run(*args):
        with pytest.raises(SystemExit) as e:
            cli.main(list(args))
        return bool(e.value.code), capsys.readouterr().out

    good, bad = "Bundle.entry.resource.where(resourceType = 'Encounter').count()", "Bundle.entry.resource.where(resourceType = 'Encounter').nothing"
    assert run("validate", good, "--bundles", str(tmp_path / "b")) == (False, "")
    code, said = run("validate", good, bad)
    assert code and said.count("\n") == 1 and "there is no nothing" in said
    assert not run("check-setup", "--bundles", str(tmp_path / "b"))[0]
    code, said = run("check-setup", "--bundles", str(tmp_path / "none"), "--paraphrases", str(tmp_path / "c.json"))
    assert code and said.count("fault") == 2 and said.count("ok ") == 3


def test_annotated_value_sets(spark, tmp_path):
    rows = [{"val_dict": {"val_placeholder": {"drug_name1": "A", "lab_name": "L", "lab_value": [1, 2]}}}, {"val_dict": {"val_placeholder": {"drug_name": ["é"]}}}, {"x": 1}]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, rows)))
    cli.main(["annotations", str(tmp_path / "a.jsonl"), str(tmp_path / "o")])
    read = lambda name: json.loads((tmp_path / "o" / f"{name}.json").read_text())
    assert read("val_placeholder.drug_name") == ["A", "é"] and read("lab_values") == {"L": ["1", "2"]} and read("vital_values") == {}
