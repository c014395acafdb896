"""Paraphrases of templates from a source of texts: a function from (template_id, masked, n) to (template_id, paraphrase), such as a
language model's client in mapInPandas. The library has none of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import curation as C

Source = Callable[[DataFrame], DataFrame]
SOURCES: dict[str, Source] = {}


def register_source(name: str, source: Source) -> None:
    if name in SOURCES:
        raise ValueError(f"source {name} is registered already")
    SOURCES[name] = source


def candidates(templates: DataFrame, source: Source, n: int = 20) -> DataFrame:
    """What the source says to the masked texts of templates (template_id, text): template_id, text, masked, paraphrase, and reason, why
    a paraphrase is refused: other slots than the template's, or a text too near to it."""
    asked = templates.select("template_id", "text", T.mask(F.col("text")).alias("masked"))
    said = source(asked.select("template_id", "masked", F.lit(n).alias("n"))).select(F.col("template_id").alias("_t"), F.trim("paraphrase").alias("paraphrase"))
    rows = asked.join(said, F.col("template_id") == F.col("_t")).drop("_t")
    return C.filter_chain(rows, {"slots": C.slot_reason(F.col("paraphrase"), T.slots(F.col("masked"), T.MASK)), "difference": C.difference_reason(F.col("masked"), F.col("paraphrase"))})


def paraphrase(templates: DataFrame, source: Source, n: int = 20, done: DataFrame | None = None) -> DataFrame:
    """(template_id, texts): the template's own text, then up to n paraphrases that differ from it and from each other. Templates of done
    (template_id) are left out."""
    left = templates if done is None else C.remaining(templates, done, ["template_id"])
    good = candidates(left, source, n).filter("reason IS NULL")
    good = C.keep_first(good.select("template_id", "paraphrase", F.md5("paraphrase").alias("o")), ["template_id", "paraphrase"], "o")
    kept = C.quota(C.greedy_distinct(good, "template_id", "o", "paraphrase"), "template_id", "o", n)
    rows = left.join(kept.withColumnRenamed("template_id", "_t"), F.col("template_id") == F.col("_t"), "left")
    lists = rows.withColumn("p", T.unmask(F.col("paraphrase"), F.col("text"))).groupBy("template_id", "text").agg(F.array_sort(F.collect_list(F.when(F.col("_t").isNotNull(), F.struct("o", "p")))).alias("ps"))
    return lists.select("template_id", F.concat(F.array("text"), F.transform("ps", lambda x: x["p"])).alias("texts"))
