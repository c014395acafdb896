"""A corpus pipeline of five stages over `documents`: quality classifier, near-duplicate removal, benchmark decontamination,
mixing of sources, token output. Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathspark.llm._common import release, stored, table, tables_of
from pathspark.llm.decontaminate import contamination
from pathspark.llm.jaccard import component_ids, jaccard_join
from pathspark.llm.mixing import mix_sources
from pathspark.llm.quality import score_quality
from pathspark.llm.tokens import token_output

#: A document is rejected only where the classifier is sure of it: below the threshold of the query.
QUALITY = 0.3
#: Near duplicates: shingles of five words, similarity 0.8.
SHINGLE, SIMILARITY = 5, 80


def _columns(docs: DataFrame) -> list[str]:
    return docs.columns


def _stage(f):
    """What a stage stores on its way is removed when the next one begins."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark)
        with tables_of(spark, "pipeline"):
            return f(spark, docs, sf_dir)

    return run_stage


def _row(docs: DataFrame) -> Column:
    """All columns of docs as one: what an operator adds meets none of their names."""
    return F.struct(*(F.col(c) for c in _columns(docs))).alias("row")


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that score below QUALITY. The model learns from the labelled documents among those given, but not from the
    fifth that is held out. Each row is judged by its own text."""
    scored = score_quality(docs.select(_row(docs), "doc_id", "text"), table(spark, sf_dir, "labels"), ["row"])
    return scored.filter(F.col("score") >= QUALITY).select("row.*")


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the one with the smallest id, once. A document is known by its id and its
    text's hash, so texts that share an id are judged each by itself. Empty texts are in no group, so each stays; rows without an id stay."""
    known = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.xxhash64("text").alias("text_hash")))
    ids = component_ids(jaccard_join(docs.select(known.alias("row"), "text"), key="row", shingle=SHINGLE, percent=SIMILARITY))
    kept = ids.filter(F.col("doc") == F.col("component_id")).select("doc.doc_id", F.col("doc.text_hash").alias("hash")).distinct()
    rows = docs.select(_row(docs), "doc_id", F.xxhash64("text").alias("hash")).join(kept, ["doc_id", "hash"], "left_semi")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "hash").orderBy("row.source", "row.lang", F.xxhash64("row")))).filter("n = 1")
    return rows.select("row.*").unionByName(docs.filter(F.col("doc_id").isNull()))


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which a window of ten words of a benchmark item occurs. A null or empty text has no words and stays, as does
    every row whose text is clean, with or without an id; repeated rows stay or go together, and an empty table gives an empty one."""
    found = contamination(docs.select(_row(docs)), table(spark, sf_dir, "benchmark"), ["row"], key="row.doc_id", text="row.text")
    return found.filter(~F.col("contaminated")).select("row.*")


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources with weights 5, 2, 1 of 150 % of all words: a row for each time that the mix takes a document, twice at most. Rows
    without words take no room and are in the mix; a null source is one of its own; equal rows count each; an empty table gives an empty one."""
    return mix_sources(docs.select(_row(docs)), names={"key": "row.doc_id", "text": "row.text", "source": "row.source"}).select("row.*")


@_stage
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns what is read back: doc_id, start, n_tokens, ids_crc32, a row for each row given. Null and empty
    texts have the end id alone; rows of one id, or without one, come one after another; an empty table gives an empty one."""
    return token_output(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("token_ids", token_ids)]
#: The classifier and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written as Parquet and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
