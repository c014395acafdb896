"""Command line: python -m pathspark.cli COMMAND .. Files are JSON lines unless a command says otherwise."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from importlib import import_module
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import curation as C
from .operators.coverage import unused
from .plans.annotations import PAIRS, placeholders, value_maps, value_sets_of
from .plans.compiler import Resources
from .plans.context import value_sets, write_contexts
from .plans.generate import final_dataset, own_texts, texts_of, write_records
from .plans.paraphrases import paraphrase
from .plans.templates import TEMPLATES, tagged, tags
from .plans.types import faults, run_time_error
from .schema import QA_RECORD, RESOURCES
from .sources import files, store
from .sources.bundles import read_bundles, read_tables, resources, write_tables

SPLITS = ("train", "val", "test", "unknown")
# The templates that are held out unless others are named.
HOLDOUT1 = ["count-drugs-prescribed", "has-hospital-admission", "time-drug-route", "procedure-name"]
HOLDOUT2 = ["careunit", "count-input-intake-events", "has-input-intake", "time-intake", "time-specific-intake"]


def _spark() -> SparkSession:
    return SparkSession.builder.appName("pathspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _read(spark: SparkSession, path: str) -> DataFrame:
    rows, bad = files.read_jsonl(spark, path, QA_RECORD)
    if n := bad.count():
        print(f"warning: {n} lines of {path} are no JSON and were left out", file=sys.stderr)
    return rows


def _patients(spark: SparkSession, res: Resources, ids: str | None) -> DataFrame:
    return files.read_ids(spark, ids).withColumnRenamed("id", "patient_id") if ids else res.table("Patient").select("patient_id").distinct()


def _stored_tables(spark: SparkSession, bundles: str, path: str) -> Resources:
    """The bundles' typed tables, parsed and written once."""
    if not all(store.exists(spark, f"{path}/{kind}/_SUCCESS") for kind in RESOURCES):
        write_tables(resources(read_bundles(spark, bundles)), path)
    return read_tables(spark, path)


def cmd_generate(a: argparse.Namespace) -> None:
    """Questions, and answers unless --no-evaluate, for the patients of bundle files."""
    spark = _spark()
    with store.Scratch(spark) as keep:
        res = _stored_tables(spark, a.bundles, f"{keep.path}/tables")
        contexts = write_contexts(res, _patients(spark, res, a.patient_ids), f"{keep.path}/contexts", valuesets=_own_values(spark, a.valuesets))
        out = write_records(res, contexts, f"{keep.path}/records", _chosen(a), n=a.n, answers=a.evaluate, seed=a.seed, mode="compat" if a.compat else "calendar")
        files.write_jsonl(_annotated(out, a), files.jsonl_path(a.output))


def _annotated(records: DataFrame, a: argparse.Namespace) -> DataFrame:
    return records if a.annotated else records.drop("s_placeholders", "t_placeholders", "question_template")


def cmd_add_splits(a: argparse.Namespace) -> None:
    """Adds split (by template and text) and holdout; held-out templates are test."""
    spark = _spark()
    rows = _read(spark, a.input)
    splits = files.read_split_map(spark, a.split_file).select(F.col("template_id").alias("question_template_id"), F.col("text").alias("question_template"), "split")
    rows = C.look_up_split(rows.drop("split"), splits, ["question_template_id", "question_template"])
    held = C.holdout(F.col("question_template_id"), a.holdout1, a.holdout2)
    rows = rows.withColumn("holdout", held).withColumn("split", C.override_split(F.col("split"), F.col("holdout")))
    files.write_jsonl(rows, files.jsonl_path(a.output))
    C.distribution(rows, "split", "holdout").orderBy("split", "holdout").show()


def cmd_filter(a: argparse.Namespace) -> None:
    """Keeps some splits, without some templates."""
    if wrong := set(a.splits or ()) - set(SPLITS):
        sys.exit(f"no such split: {', '.join(sorted(wrong))}")
    rows, counters = C.filter_corpus(_read(_spark(), a.input), a.splits, a.exclude)
    files.write_jsonl(rows, files.jsonl_path(a.output))
    counters.show()


def cmd_split_paraphrases(a: argparse.Namespace) -> None:
    """{template: {text: split}} of both perspectives' paraphrases."""
    spark = _spark()
    both = files.read_map_of_lists(spark, a.clinical).unionByName(files.read_map_of_lists(spark, a.patient)).select("key", "text").distinct()
    split = C.ranked_split(both, "key", "text", order=F.xxhash64("text", F.lit(a.seed)))
    maps = split.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("text", "split")))).alias("m"))
    Path(a.output).write_text(files.to_sorted_object(maps, "key", "m").first()["json"])
    C.distribution(split, "split").orderBy("split").show()


def cmd_review(a: argparse.Namespace) -> None:
    """Accepted paraphrases of a reviewed CSV, by template."""
    kept, counters = C.review(files.read_review_csv(_spark(), a.input))
    lists = kept.groupBy("template_id").agg(F.array_sort(F.collect_set("paraphrase")).alias("texts"))
    Path(a.output).write_text(files.to_sorted_object(lists, "template_id", "texts").first()["json"])
    counters.show()


def cmd_generate_paraphrases(a: argparse.Namespace) -> None:
    """Paraphrases of the templates' texts from a source, package.module:function, as {template: [text, paraphrases ..]}."""
    spark = _spark()
    texts = spark.createDataFrame([(t, TEMPLATES[t].text()) for t in a.templates or TEMPLATES], "template_id string, text string")
    out = Path(a.output)
    have = files.read_map_of_lists(spark, a.output).groupBy(F.col("key").alias("template_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias("texts")) if a.resume and out.exists() else None
    if a.dry_run:
        (texts if have is None else C.remaining(texts, have, ["template_id"])).show(len(TEMPLATES), truncate=False)
        return
    module, _, name = a.source.partition(":")
    made = paraphrase(texts, getattr(import_module(module), name), a.n, have)
    out.write_text(files.to_sorted_object(made if have is None else made.unionByName(have), "template_id", "texts").first()["json"])


def cmd_verify_paraphrases(a: argparse.Namespace) -> None:
    """Edit distances between the first text and the others of each template, and, unless --analyze-only, the pairs as CSV for a review."""
    lists = files.read_map_of_lists(_spark(), a.input).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias("texts"))
    pairs = C.pairs_with_first(lists.withColumnRenamed("key", "template_id"), "template_id", "texts")
    C.pair_statistics(pairs, "template_id").orderBy(F.desc("n"), "template_id").show(len(TEMPLATES) + 1, truncate=False)
    if not a.analyze_only:
        files.write_csv(pairs.select("template_id", F.col("original").alias("question_template"), "paraphrase").coalesce(1), a.output)


def cmd_final_dataset(a: argparse.Namespace) -> None:
    """One answered question for each paraphrase of a split, or for each template's own text; goes on where an earlier run was cut off."""
    spark = _spark()
    if not a.resume:
        store.remove(spark, a.work)
    res = _stored_tables(spark, a.bundles, f"{a.work}/tables")
    contexts = write_contexts(res, _patients(spark, res, a.patient_ids), f"{a.work}/contexts", valuesets=_own_values(spark, a.valuesets))
    texts = own_texts(spark, _chosen(a))
    if a.paraphrases:
        texts = texts_of(C.paraphrases_of_split(*(files.read_map_of_lists(spark, p) for p in a.paraphrases), files.read_split_map(spark, a.split_file), a.split))
    records = final_dataset(res, contexts, texts, f"{a.work}/run", _chosen(a), a.seed, "compat" if a.compat else "calendar", a.quota, a.attempts, a.passes, a.rounds)
    files.write_jsonl(_annotated(records, a).drop("number", "pass").withColumn("split", F.lit(a.split)), files.jsonl_path(a.output))
    if n := unused(f"{a.work}/run", spark).count():
        print(f"{n} texts have no answer", file=sys.stderr)


def cmd_valuesets(a: argparse.Namespace) -> None:
    """All patients' values by slot, one JSON list per slot."""
    res = resources(read_bundles(_spark(), a.bundles))
    found = value_sets(res, res.table("Patient").select("patient_id").distinct())
    merged = found.select("slot", F.explode("values").alias("value")).groupBy("slot").agg(F.to_json(F.array_sort(F.collect_set("value"))).alias("json"))
    Path(a.output).mkdir(parents=True, exist_ok=True)
    for row in merged.toLocalIterator():
        (Path(a.output) / f"{row['slot']}.json").write_text(row["json"])


def cmd_validate(a: argparse.Namespace) -> None:
    """Says what is wrong with paths, all templates' without arguments: syntax and types, and with --bundles what comes up when they are run."""
    wrong = {p: e for p in (a.paths or [t.path() for t in TEMPLATES.values()]) if (e := faults(p))}
    if a.bundles:
        spark = _spark()
        res = resources(read_bundles(spark, a.bundles))
        q = res.table("Patient").select(F.col("patient_id").alias("question_id"), "patient_id").distinct()
        slots = sorted({s for t in TEMPLATES.values() for s in t.slots[1:]})
        q = q.select("*", *(F.lit(None).cast("double" if s.endswith("_value") else "string").alias(s) for s in slots))
        wrong |= {p: [e] for p in a.paths or [t.path() for t in TEMPLATES.values()] if p not in wrong and (e := run_time_error(res, p, q))}
    for path, errors in wrong.items():
        for error in errors:
            print(f"{path}: {error}")
    sys.exit(bool(wrong))


def cmd_check_setup(a: argparse.Namespace) -> None:
    """Says whether what the other commands need is there: Spark, a shared folder, and the files that are named."""
    checks: dict[str, Callable[[], object]] = {"Spark starts": lambda: _spark().range(1).count(), "the shared folder takes tables": lambda: store.cut(_spark().range(1)).count(), "all templates are well typed": lambda: not [t for t in TEMPLATES.values() if faults(t.path())] or 1 / 0}
    if a.bundles:
        checks["bundles have patients"] = lambda: resources(read_bundles(_spark(), a.bundles)).table("Patient").count() or 1 / 0
    if a.patient_ids:
        checks["patient ids are there"] = lambda: files.read_ids(_spark(), a.patient_ids).count() or 1 / 0
    for name in a.paraphrases or ():
        checks[f"{name} has paraphrases"] = lambda name=name: files.read_map_of_lists(_spark(), name).count() or 1 / 0
    bad = 0
    for what, check in checks.items():
        try:
            check()
            print(f"ok    {what}")
        except Exception as e:  # noqa: BLE001  whatever it is, it is reported
            bad += 1
            print(f"fault {what}: {str(e).splitlines()[0] if not isinstance(e, ZeroDivisionError) else 'nothing found'}")
    sys.exit(bool(bad))


def cmd_annotations(a: argparse.Namespace) -> None:
    """Value sets of annotated questions (JSON lines with val_dict): one file per category and placeholder, and the values by name."""
    entries = _spark().read.text(a.input, wholetext=False).select(F.monotonically_increasing_id().alias("line"), F.get_json_object("value", "$.val_dict").alias("json"))
    with store.Scratch(_spark()) as keep:
        found = keep(placeholders(entries, "line", "json"))
        out = Path(a.output)
        out.mkdir(parents=True, exist_ok=True)
        for row in value_sets_of(found).toLocalIterator():
            (out / f"{row['category']}.{row['name']}.json").write_text(json.dumps(row["values"], ensure_ascii=False))
        for kind in PAIRS:
            rows = value_maps(found, "line").filter(F.col("kind") == kind)
            (out / f"{kind}_values.json").write_text(files.to_sorted_object(rows, "name", "values").first()["json"] or "{}")


def _chosen(a: argparse.Namespace) -> list[str]:
    """The templates that --templates and --tags name, without those of --exclude."""
    named = set(a.templates or ()) | {t for tag in a.tags or () for t in tagged(tag)}
    return [t for t in TEMPLATES if (t in named or not (a.templates or a.tags)) and t not in (a.exclude or ())]


def _own_values(spark: SparkSession, folder: str | None) -> dict[str, DataFrame] | None:
    """The value sets that patients' own values have to be in, by slot."""
    if not folder:
        return None
    every = files.read_valuesets(spark, folder)
    names = [r["name"] for r in every.select("name").distinct().collect()]  # a row per file
    return {n: every.filter(F.col("name") == n).select("value") for n in names}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pathspark")
    sub = p.add_subparsers(required=True)

    def command(name, f):
        c = sub.add_parser(name, help=f.__doc__)
        c.set_defaults(run=f)
        return c

    choosing = [c := command("generate", cmd_generate)]
    c.add_argument("bundles")
    c.add_argument("output")
    c.add_argument("--patient-ids", help="a file with one id per line")
    c.add_argument("--templates", nargs="*", choices=sorted(TEMPLATES))
    c.add_argument("--n", type=int, default=1, help="questions per template and patient")
    c.add_argument("--evaluate", action=argparse.BooleanOptionalAction, default=True)
    c.add_argument("--compat", action="store_true", help="windows that keep the time of day")
    c.add_argument("--seed", type=int, default=42)
    c = command("add-splits", cmd_add_splits)
    for x in ("input", "output", "split_file"):
        c.add_argument(x)
    c.add_argument("--holdout1", nargs="*", default=HOLDOUT1)
    c.add_argument("--holdout2", nargs="*", default=HOLDOUT2)
    c = command("filter", cmd_filter)
    c.add_argument("input")
    c.add_argument("output")
    c.add_argument("--splits", nargs="*", default=["train", "val"])
    c.add_argument("--exclude", nargs="*", default=[])
    c = command("split-paraphrases", cmd_split_paraphrases)
    for x in ("clinical", "patient", "output"):
        c.add_argument(x)
    c.add_argument("--seed", type=int, default=42)
    for name, f in (("review", cmd_review), ("valuesets", cmd_valuesets)):
        c = command(name, f)
        c.add_argument("bundles" if name == "valuesets" else "input")
        c.add_argument("output")
    c = command("generate-paraphrases", cmd_generate_paraphrases)
    c.add_argument("source", help="package.module:function")
    c.add_argument("output")
    c.add_argument("--templates", nargs="*", choices=sorted(TEMPLATES))
    c.add_argument("--n", type=int, default=20, help="most paraphrases of a template")
    c.add_argument("--dry-run", action="store_true")
    c.add_argument("--resume", action=argparse.BooleanOptionalAction, default=True)
    c = command("verify-paraphrases", cmd_verify_paraphrases)
    c.add_argument("input")
    c.add_argument("output", nargs="?", default="review.csv")
    c.add_argument("--analyze-only", action="store_true")
    choosing.append(c := command("final-dataset", cmd_final_dataset))
    for x in ("bundles", "work", "output"):
        c.add_argument(x)
    c.add_argument("--patient-ids", help="a file with one id per line")
    c.add_argument("--templates", nargs="*", choices=sorted(TEMPLATES))
    c.add_argument("--paraphrases", nargs=2, metavar=("CLINICAL", "PATIENT"))
    c.add_argument("--split-file", default="splits.json")
    c.add_argument("--split", choices=SPLITS, default="train")
    c.add_argument("--quota", type=int, default=10, help="most questions of a patient in one cycle")
    c.add_argument("--attempts", type=int, default=20, help="most attempts of a patient in one round")
    c.add_argument("--passes", type=int, default=3, help="how often all patients are tried before a text is given up")
    c.add_argument("--rounds", type=int, help="stop after so many rounds; another run goes on")
    c.add_argument("--seed", type=int, default=42)
    c.add_argument("--compat", action="store_true", help="windows that keep the time of day")
    c.add_argument("--resume", action=argparse.BooleanOptionalAction, default=True)
    c = command("validate", cmd_validate)
    c.add_argument("paths", nargs="*")
    c.add_argument("--bundles", help="run the paths over these")
    c = command("check-setup", cmd_check_setup)
    c.add_argument("--bundles")
    c.add_argument("--patient-ids")
    c.add_argument("--paraphrases", nargs="*")
    c = command("annotations", cmd_annotations)
    c.add_argument("input")
    c.add_argument("output")
    for c in choosing:
        c.add_argument("--tags", nargs="*", choices=tags(), help="templates with one of these")
        c.add_argument("--exclude", nargs="*", choices=sorted(TEMPLATES))
        c.add_argument("--valuesets", help="a folder of value sets that patients' own values have to be in")
        c.add_argument("--annotated", action=argparse.BooleanOptionalAction, default=True, help="keep templates and slot values")
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(args)


if __name__ == "__main__":
    main()
