"""Question generation: patients x templates x n, slots drawn by hash, texts rendered, answers from one plan per template."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fill_slots, record_hash, tidy_punctuation
from ..operators import coverage
from ..operators.curation import null_answer, pick
from ..sources import store
from . import timewin as W
from .compiler import Resources, evaluate_path
from .context import NAMED
from .templates import OPERATIONS, TEMPLATES, Template


def cross(patients: DataFrame, templates: DataFrame, n: int) -> DataFrame:
    """A row for each patient, template and 1..n. Templates are few; they are counted before they are broadcast."""
    if templates.count() > 10_000:
        raise ValueError("too many templates to pair with every patient")
    return patients.crossJoin(F.broadcast(templates)).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(n))))


def draw(contexts: DataFrame, template: Template, n: int = 1, seed: int = 42) -> DataFrame:
    """n questions per patient of one template, all slots filled: question_id, patient_id, slots, time_id, date, n, now, exact_id. A slot
    for which the patient has no value stays null; generate() drops such questions. A measured value is one of those under the name
    that the question has drawn."""
    q = contexts.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return fill(q.withColumn("question_id", F.concat_ws("/", F.lit(template.template_id), "patient_id", "i")), template, seed)


def fill(q: DataFrame, template: Template, seed: int = 42) -> DataFrame:
    """draw() for rows of contexts that have a question_id already, and i, which draws go by."""
    key = lambda what: [F.lit(template.template_id), F.col("patient_id"), F.col("i"), F.lit(seed), F.lit(what)]
    for slot in template.slots[1:]:
        if slot == "comparison":
            q = q.withColumn(slot, pick(F.array(*map(F.lit, OPERATIONS)), *key(slot)))
            continue
        base = slot.rstrip("0123456789")
        options = F.try_element_at("values", F.lit(base))
        if base in NAMED and NAMED[base] in template.slots:
            options = F.try_element_at("named", F.concat_ws("/", F.lit(base), F.col(NAMED[base])))
        drawn = pick(F.coalesce(options, F.array().cast("array<string>")), *key(slot))
        q = q.withColumn(slot, drawn.try_cast("double") if base.endswith("_value") else drawn)
    choices = W.GLOBAL if template.window else ("blank",)
    q = q.withColumn("time_id", pick(F.array(*map(F.lit, choices)), *key("time")))
    unit = F.when(F.col("time_id").contains("year"), "year").when(F.col("time_id").contains("month"), "month").otherwise("day")
    date, back = W.sample_anchor(F.col("question_id"), F.col("first"), F.col("last"), unit)
    exact = pick(F.array(F.lit("exact-first"), F.lit("exact-last")), *key("exact")) if template.exact else F.lit(None).cast("string")
    return q.withColumn("date", date).withColumn("n", back).withColumn("exact_id", exact).drop("values", "named", "i")


def draw_paraphrase(q: DataFrame, template: Template, paraphrases: DataFrame | None, seed: int = 42) -> DataFrame:
    """Adds perspective and text: one of the perspectives that have texts for the template in paraphrases (template_id, clinical,
    patient), and one of its texts, by the hash of the question. Without any, the template's own text and no perspective."""
    own = F.lit(template.text())
    if paraphrases is None:
        return q.withColumn("perspective", F.lit(None).cast("string")).withColumn("text", own)
    who = ("clinical", "patient")
    one = paraphrases.filter(F.col("template_id") == template.template_id).groupBy("template_id").agg(*(F.array_sort(F.flatten(F.collect_list(w))).alias(f"_{w}") for w in who))
    q = q.withColumn("_of", F.lit(template.template_id)).join(one, F.col("_of") == F.col("template_id"), "left")
    some = F.filter(F.array(*(F.when(F.size(f"_{w}") > 0, w) for w in who)), lambda x: x.isNotNull())
    key = lambda what: [F.col("question_id"), F.lit(seed), F.lit(what)]
    q = q.withColumn("perspective", pick(some, *key("perspective")))
    texts = F.when(F.col("perspective") == "clinical", F.col("_clinical")).when(F.col("perspective") == "patient", F.col("_patient"))
    return q.withColumn("text", F.coalesce(pick(texts, *key("paraphrase")), own)).drop("_of", "template_id", "_clinical", "_patient")


def render(q: DataFrame, template: Template, text: Column | None = None) -> DataFrame:
    """Adds question: the template's text, or a paraphrase's, with all slots filled and punctuation tidied."""
    t = fill_slots(F.lit(template.text()) if text is None else text, {s: F.col(s) for s in template.slots})
    t = F.replace(t, F.lit("(comparison1)"), F.col("comparison")) if "comparison" in template.slots else t
    t = fill_slots(t, {"time_filter_global1": W.phrase(F.col("time_id"), F.col("date"), F.col("n")), "time_filter_exact1": W.phrase(F.col("exact_id"), F.col("date"), F.col("n"))}, brackets=True)
    return q.withColumn("question", tidy_punctuation(t))


#: The columns of a record, but for its answer.
RECORD = ("question_id", "patient_id", "question", "query", "now", "question_template_id", "question_template", "perspective", "s_placeholders", "t_placeholders")


def answered(res: Resources, template: Template, q: DataFrame, mode: str = "calendar", answers: bool = True, drop_null_answers: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """Records of one template's filled questions with text and perspective, and the columns `keep` of q. Questions with an empty slot
    are dropped."""
    slots = list(template.slots[1:])
    q = W.with_windows(q.dropna(subset=slots) if slots else q, mode)
    q = render(q, template, F.col("text"))
    given = F.map_filter(F.create_map(*(x for s in template.slots for x in (F.lit(s), F.col(s).cast("string")))), lambda k, v: v.isNotNull())
    records = q.select(
        "question_id", "patient_id", "question", F.lit(template.path()).alias("query"), F.date_format("now", "yyyy-MM-dd'T'HH:mm:ss").alias("now"), F.lit(template.template_id).alias("question_template_id"), F.col("text").alias("question_template"), "perspective",
        given.alias("s_placeholders"), F.create_map(F.lit("time_filter_global1"), F.col("time_id")).alias("t_placeholders"), *keep,
    )
    if not answers:
        return records.withColumn("answer", F.lit(None).cast("string"))
    got = evaluate_path(res, template.path(), q.select("question_id", "patient_id", "lo", "hi", "pick", *slots)).select(F.col("question_id").alias("a"), "answer")
    records = records.join(got, F.col("question_id") == F.col("a")).drop("a")
    return records.filter(~null_answer(F.col("answer"))) if drop_null_answers else records


def generate(res: Resources, contexts: DataFrame, template_ids: Sequence[str] | None = None, n: int = 1, answers: bool = True, seed: int = 42, mode: str = "calendar", drop_null_answers: bool = True, paraphrases: DataFrame | None = None) -> DataFrame:
    """QA records: one plan per template for all patients. Questions with a slot that the patient has no value for, and null answers
    ([] and [0]), are dropped. paraphrases (template_id, clinical, patient) give texts and perspectives. Each template's plan reads contexts
    a few times: they should be a stored table (write_contexts())."""
    out = None
    for template_id in template_ids or TEMPLATES:
        t = TEMPLATES[template_id]
        records = answered(res, t, draw_paraphrase(draw(contexts, t, n, seed), t, paraphrases, seed), mode, answers, drop_null_answers)
        out = records if out is None else out.unionByName(records)
    return out.withColumn("id", record_hash(out))


def write_records(res: Resources, contexts: DataFrame, path: str, template_ids: Sequence[str] | None = None, **options) -> DataFrame:
    """generate(), a template at a time: each one's records are written under `path` before the next one's plan is made, so that no plan holds
    more than one template's scans. Templates that are there already, whole, are not made again."""
    spark = contexts.sparkSession
    for template_id in template_ids or TEMPLATES:
        if not store.exists(spark, f"{path}/template={template_id}/_SUCCESS"):
            generate(res, contexts, [template_id], **options).write.mode("overwrite").parquet(f"{path}/template={template_id}")
    return spark.read.parquet(*(f"{path}/template={t}" for t in template_ids or TEMPLATES))


def own_texts(spark: SparkSession, template_ids: Sequence[str] | None = None) -> DataFrame:
    """(template_id, perspective, text): the templates' own texts, where there are no paraphrases."""
    return spark.createDataFrame([(t, "clinical", TEMPLATES[t].text()) for t in template_ids or TEMPLATES], "template_id string, perspective string, text string")


def texts_of(paraphrases: DataFrame) -> DataFrame:
    """(template_id, perspective, text) of (template_id, clinical, patient)."""
    one = lambda who: paraphrases.select("template_id", F.lit(who).alias("perspective"), F.explode(who).alias("text"))
    return one("clinical").unionByName(one("patient"))


def final_dataset(res: Resources, contexts: DataFrame, texts: DataFrame, path: str, template_ids: Sequence[str] | None = None, seed: int = 42, mode: str = "calendar", quota: int = 10, attempts: int = 20, passes: int = 3, rounds: int | None = None, resume: bool = True) -> DataFrame:
    """One QA record, with an answer that isn't null, for every text (template_id, perspective, text) that some patient can answer: texts are
    drawn without replacement until all are used. A text that no patient answers is tried with other slot values and windows, `passes` times
    in all, and is then in unused(). Of each cycle a patient has `quota` records at most. See operators.coverage for the order.

    All work is in `path`: a run that was cut off goes on behind its last whole round, one that was done returns its records, and without
    `resume` it begins anew. contexts is read once per template and round, and should be a stored table."""
    spark = contexts.sparkSession
    if not resume:
        store.remove(spark, path)
    ids = list(template_ids or TEMPLATES)
    coverage.begin(texts.filter(F.col("template_id").isin(ids)).select("template_id", "perspective", "text"), contexts, path, seed)

    def ask(asked: DataFrame, round_: int) -> DataFrame:
        at = f"{path}/answers/round={round_}"
        for row in asked.groupBy("template_id").count().orderBy("template_id").collect():  # a row per template
            t = TEMPLATES[row["template_id"]]
            own = asked.filter(F.col("template_id") == t.template_id).select("number", "j", "pass", "perspective", "text", F.col("patient_id").alias("_p"))
            q = contexts.join(own, F.col("patient_id") == F.col("_p")).drop("_p").withColumn("i", F.xxhash64("perspective", "text", "pass"))
            q = q.withColumn("question_id", F.concat_ws("/", F.lit(t.template_id), F.col("number").cast("string"), "patient_id", F.col("pass").cast("string")))
            answered(res, t, fill(q, t, seed), mode, keep=("number", "j", "pass")).write.mode("overwrite").parquet(f"{at}/template={t.template_id}")
        return spark.read.parquet(f"{at}/template=*")

    coverage.sweep(path, spark, ask, attempts, passes, rounds)
    got = coverage.records(path, spark, quota)
    return got.withColumn("id", record_hash(got, [*RECORD, "answer"]))
