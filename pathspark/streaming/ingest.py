"""Continuous ingest: new NDJSON files of resources into the typed tables, one micro-batch at a time.

A batch is written in folders of its number, and counts when its entry in the ledger is whole: one that is run again after a failure
overwrites what it left, and readers see committed batches only. Conditions take their time from their encounter, which may come in an
earlier, the same or a later batch, or never. Those without wait in a table of their own: each batch joins what waits, and its own
conditions, with the encounters that can be new to them. So the tables don't depend on how files are dealt to batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.compiler import Resources
from ..schema import RESOURCES
from ..sources import store
from ..sources.bundles import _owner, encounter_starts, numbered_lines, stage, timed_conditions, typed

#: Bits of ord that a batch's bytes fill.
BATCH_BITS = 44


def committed(spark: SparkSession, target: str) -> list[int]:
    """The numbers of the batches that are whole."""
    return store.whole(spark, f"{target}/ledger", "batch")


def _read(spark: SparkSession, target: str, kind: str, batches: list[int]) -> DataFrame | None:
    return spark.read.parquet(*(f"{target}/{kind}/batch={n}" for n in batches)) if batches else None


def _staged(batch: DataFrame, number: int, target: str) -> DataFrame:
    """The batch's resources by type. ord is unique over all batches: the batch, then its files by name, then lines."""
    raw = f"{target}/raw/batch={number}"
    batch.write.mode("overwrite").parquet(raw)
    rows = batch.sparkSession.read.schema(batch.schema).parquet(raw)
    files = rows.select("file", "file_size").distinct()  # a row per file of the batch
    before = F.coalesce(F.sum("file_size").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = files.select(F.col("file").alias("_file"), before.alias("_base"))
    ord_ = F.lit(number).cast("long") * (1 << BATCH_BITS) + F.col("_base") + F.col("at")
    return stage(rows.join(base, F.col("file") == F.col("_file")).select("patient_id", ord_.alias("ord"), "resource"), f"{target}/staged/batch={number}")


def ingest_batch(batch: DataFrame, number: int, target: str) -> None:
    """One batch of (patient_id, resource, file, file_size, at) into target/<type>/batch=<number>; conditions without their encounter into
    target/waiting/batch=<number>, with those of the batch before that are still without."""
    spark = batch.sparkSession
    if number in committed(spark, target):
        return
    earlier = [n for n in committed(spark, target) if n < number]
    tables = typed(_staged(batch, number, target))
    for kind, table in tables.items():
        if kind != "Condition":
            table.write.mode("overwrite").parquet(f"{target}/{kind}/batch={number}")
    own = spark.read.parquet(f"{target}/Encounter/batch={number}")
    known = _read(spark, target, "Encounter", [*earlier, number])
    placed = timed_conditions(tables["Condition"], encounter_starts(known))
    if earlier:  # what waits has met all encounters but this batch's
        waiting = spark.read.parquet(f"{target}/waiting/batch={earlier[-1]}").select(*tables["Condition"].columns)
        placed = placed.unionByName(timed_conditions(waiting, encounter_starts(own)))
    both = f"{target}/placed/batch={number}"
    placed.write.mode("overwrite").partitionBy("_found").parquet(both)
    placed = spark.read.schema(placed.schema).parquet(both)
    for found, kind in ((True, "Condition"), (False, "waiting")):
        placed.filter(F.col("_found") == found).drop("_found").write.mode("overwrite").parquet(f"{target}/{kind}/batch={number}")
    batch.sparkSession.range(1).select(F.lit(number).alias("number"), F.current_timestamp().alias("at")).write.mode("overwrite").parquet(f"{target}/ledger/batch={number}")
    for scratch in ("raw", "staged", "placed"):
        store.remove(spark, f"{target}/{scratch}/batch={number}")


def stream_ndjson(spark: SparkSession, source: str, target: str, checkpoint: str, patient: str = "$.subject.reference", files_per_batch: int | None = None) -> StreamingQuery:
    """Follows a folder of NDJSON files, all that is there now in batches of files_per_batch (or one), into tables under target.
    read_stream() gives the tables; another call with the same checkpoint goes on."""
    reader = spark.readStream.schema("value string")
    lines = (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).text(source)
    rows = numbered_lines(lines).select(_owner(patient).alias("patient_id"), F.col("value").alias("resource"), "file", "file_size", "at")
    return rows.writeStream.foreachBatch(lambda batch, number: ingest_batch(batch, number, target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_stream(spark: SparkSession, target: str) -> Resources:
    """The typed tables of all committed batches, as one load of the same files has them: conditions whose encounter never came have no
    time."""
    batches = committed(spark, target)
    if not batches:
        raise ValueError(f"no batch of {target} is whole")
    tables = {kind: _read(spark, target, kind, batches) for kind in RESOURCES}
    waiting = spark.read.parquet(f"{target}/waiting/batch={batches[-1]}")
    return Resources(tables | {"Condition": tables["Condition"].unionByName(waiting)})
