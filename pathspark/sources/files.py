"""Flat sources and sinks: JSONL, id lists, CSV, value sets, paraphrases, split maps, checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import store


def jsonl_path(path: str) -> str:
    return path if path.endswith(".jsonl") else (path[:-5] if path.endswith(".json") else path) + ".jsonl"


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """The rows of a JSONL file, and the lines that are no JSON. Blank lines are neither."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    parsed = lines.withColumn("r", F.from_json("value", StructType([*schema.fields]).add("_corrupt", "string"), {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}))
    return parsed.filter("r._corrupt IS NULL").select("r.*").drop("_corrupt"), parsed.filter("r._corrupt IS NOT NULL").select("value")


def write_jsonl(df: DataFrame, path: str, append: bool = False, single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("id")).filter("id <> ''")


def read_valuesets(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of a folder of JSON lists, or objects with `values`; the file's stem is the name."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"([^/]*?)(\.json)?$", 1).alias("name"), F.trim("value").alias("v"))
    listed = F.when(F.col("v").startswith("["), F.from_json("v", "array<string>")).otherwise(F.from_json("v", "struct<values:array<string>>")["values"])
    return files.select("name", F.explode(listed).alias("value"))


def read_map_of_lists(spark: SparkSession, path: str) -> DataFrame:
    """(key, ord, text) of one JSON object of lists: paraphrases by template."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return whole.select(F.explode("m").alias("key", "texts")).select("key", F.posexplode("texts").alias("ord", "text"))


def read_split_map(spark: SparkSession, path: str) -> DataFrame:
    """(template_id, text, split) of {template: {text: split}}; no rows where there is no such file."""
    from pyspark.errors import AnalysisException

    try:
        whole = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], "template_id string, text string, split string")
    parsed = whole.select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("template_id", "m"))
    return parsed.select("template_id", F.explode("m").alias("text", "split"))


def read_review_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def to_sorted_object(df: DataFrame, key: str, values: str) -> DataFrame:
    """One row with one JSON object of sorted keys: value sets, paraphrase maps. All of it is one string, as such a file is."""
    rows = F.collect_list(F.struct(F.col(key).alias("key"), F.col(values).alias("value")))  # maps have no order, keys do
    entries = F.array_sort(rows, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    return df.agg(F.to_json(F.map_from_entries(entries)).alias("json"))


def balanced_parts(df: DataFrame, n: int, order: str) -> DataFrame:
    """Adds part: n consecutive parts in the order of a unique column, whose sizes differ by one at most, the first ones larger."""
    from ..operators.curation import numbered

    total = df.count()
    size, more = divmod(total, n)
    i = F.col("_i")
    part = F.when(i < more * (size + 1), F.floor(i / (size + 1)) + 1).otherwise(more + F.floor((i - more * (size + 1)) / max(size, 1)) + 1)
    return numbered(df, order, name="_i").withColumn("part", part.cast("long")).drop("_i")


def save_checkpoint(tracking: DataFrame, path: str, cycle: int) -> None:
    """The remaining work as a table of its own; a reader takes the highest cycle that is whole."""
    tracking.withColumn("saved_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/cycle={cycle}")


def load_checkpoint(spark: SparkSession, path: str) -> DataFrame | None:
    """The tracking table of the last cycle whose write has ended, with cycle; None without any."""
    done = store.whole(spark, path, "cycle")
    return spark.read.parquet(f"{path}/cycle={done[-1]}").withColumn("cycle", F.lit(done[-1])) if done else None
