"""Per-patient generation contexts: the values and the time range that questions are filled from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import instants_in, json_strings
from ..operators.curation import or_fallback, says_something
from ..sources import store
from .compiler import Resources, evaluate_path, values_by_type
from .templates import VALUE_PATHS, placeholder_path


def value_sets(res: Resources, patients: DataFrame, slots: Sequence[str] | None = None, keep_numbers: bool = False, valuesets: dict[str, DataFrame] | None = None, fallback: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """(patient_id, slot, values): each patient's own distinct values of each slot, sorted, without blanks and numeric codes, those
    of the slot's value set where one is given, and the fallback's where none is left. One scan for each resource type, a plan of its own for each
    path that follows references, and one aggregate over all."""
    wanted = [s for s in (slots or VALUE_PATHS) if VALUE_PATHS[s]]
    found, others = values_by_type(res, {s: list(VALUE_PATHS[s]) for s in wanted})
    asked = patients.select(F.col("patient_id").alias("question_id"), "patient_id")
    for slot, paths in others.items():
        for path in paths:
            rows = evaluate_path(res, path, asked).select("patient_id", F.lit(slot).alias("slot"), F.explode("values").alias("value"))
            found = rows if found is None else found.unionByName(rows)
    if not keep_numbers:
        kept, trimmed = says_something(F.col("value"))
        measured = F.col("slot").endswith("_value")
        found = found.filter(measured | kept).withColumn("value", F.when(measured, F.col("value")).otherwise(trimmed))
    if valuesets:
        allowed = None
        for slot, values in valuesets.items():
            rows = values.select(F.lit(slot).alias("_slot"), F.lower(F.trim("value")).alias("_v")).dropna().distinct()
            allowed = rows if allowed is None else allowed.unionByName(rows)
        limited = [r[0] for r in allowed.select("_slot").distinct().collect()]  # an empty value set lets all through
        found = found.join(allowed, (F.col("slot") == F.col("_slot")) & (F.lower(F.trim("value")) == F.col("_v")), "left")
        found = found.filter(~F.col("slot").isin(limited) | F.col("_v").isNotNull()).drop("_slot", "_v")
    own = found.groupBy(F.col("patient_id").alias("_p"), F.col("slot").alias("_s")).agg(F.array_sort(F.collect_set("value")).alias("values"))
    every = patients.select("patient_id", F.explode(F.array(*map(F.lit, wanted))).alias("slot"))
    out = every.join(own, (F.col("patient_id") == F.col("_p")) & (F.col("slot") == F.col("_s")), "left").select("patient_id", "slot", F.coalesce("values", F.array().cast("array<string>")).alias("values"))
    for slot, values in (fallback or {}).items():
        out = out.withColumn("values", F.when(F.col("slot") == slot, or_fallback(F.col("values"), values)).otherwise(F.col("values")))
    return out


#: The value slots whose values belong to the name that another slot has drawn, and whose resources hold both.
NAMED = {"vital_value": "vital_name", "lab_value": "lab_name"}


def named_values(res: Resources, patients: DataFrame) -> DataFrame:
    """(patient_id, slot, name, values): of the slots in NAMED, the patient's distinct values under each name, sorted."""
    out = None
    for slot, name in NAMED.items():
        names = value_sets(res, patients, [name]).select("patient_id", F.explode("values").alias("value")).withColumn("question_id", F.concat_ws("/", "patient_id", "value"))
        got = evaluate_path(res, placeholder_path(name, "Observation") + ".valueQuantity.value", names).select(F.col("question_id").alias("q"), F.array_sort(F.array_distinct("values")).alias("values"))
        rows = names.join(got, F.col("question_id") == F.col("q")).filter(F.size("values") > 0).select("patient_id", F.lit(slot).alias("slot"), F.col("value").alias("name"), F.col("values").cast("array<string>").alias("values"))
        out = rows if out is None else out.unionByName(rows)
    return out


def datetime_ranges(res: Resources) -> DataFrame:
    """(patient_id, first, last) over the event times of all resources."""
    times = None
    for table in res.tables.values():
        rows = table.select("patient_id", F.col("_t").alias("t"))
        times = rows if times is None else times.unionByName(rows)
    return times.groupBy("patient_id").agg(F.min("t").alias("first"), F.max("t").alias("last"))


def instants(documents: DataFrame, column: str, skip: str = "2025-") -> DataFrame:
    """All instants in the values of JSON text, at any depth, whatever its structure: other columns, and `at`; distinct. Names are no values, and
    escapes are undone."""
    keep = [c for c in documents.columns if c != column]
    found = documents.select(*keep, F.explode(F.flatten(F.transform(json_strings(F.col(column)), instants_in))).alias("text"))
    return found.filter(~F.col("text").startswith(skip)).select(*keep, F.try_to_timestamp("text").alias("at")).filter(F.col("at").isNotNull()).distinct()


def instant_ranges(documents: DataFrame, column: str, skip: str = "2025-") -> DataFrame:
    """The other columns of documents with first and last, the bounds of instants(); null without any."""
    keep = [c for c in documents.columns if c != column]
    times = F.transform(F.filter(F.flatten(F.transform(json_strings(F.col(column)), instants_in)), lambda t: ~t.startswith(skip)), lambda t: F.try_to_timestamp(t))
    return documents.select(*keep, times.alias("_t")).select(*keep, F.array_min("_t").alias("first"), F.array_max("_t").alias("last"))


def translate_ids(df: DataFrame, patients: DataFrame, column: str = "patient_id", to: str = "id", key: str = "number") -> DataFrame:
    """Numbers to ids, or back with to and key exchanged; ids that the map doesn't have stay."""
    found = patients.select(F.col(key).alias("_k"), F.col(to).alias("_v"))
    return df.join(found, F.col(column) == F.col("_k"), "left").withColumn(column, F.coalesce("_v", F.col(column))).drop("_k", "_v")


def patient_numbers(res: Resources) -> DataFrame:
    return res.table("Patient").select("id", F.get("identifier", 0)["value"].alias("number"))


def contexts(res: Resources, patients: DataFrame, now: Column | None = None, **options) -> DataFrame:
    """(patient_id, now, first, last, values map<slot, array>, named map<slot/name, array>): what questions of a patient are drawn from."""
    sets = value_sets(res, patients, **options).groupBy(F.col("patient_id").alias("p")).agg(F.map_from_entries(F.collect_list(F.struct("slot", "values"))).alias("values"))
    ranges = datetime_ranges(res).withColumnRenamed("patient_id", "r")
    named = named_values(res, patients).groupBy(F.col("patient_id").alias("m")).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("/", "slot", "name"), "values"))).alias("named"))
    out = patients.select("patient_id")
    for more, k in ((sets, "p"), (ranges, "r"), (named, "m")):
        out = out.join(more, F.col("patient_id") == F.col(k), "left").drop(k)
    given = F.lit("2100-06-06").cast("timestamp") if now is None else now
    first, last = F.lit("2050-01-01").cast("timestamp"), F.lit("2150-01-01").cast("timestamp")
    return out.select("patient_id", F.coalesce("last", given).alias("now"), F.coalesce("first", first).alias("first"), F.coalesce("last", last).alias("last"), "values", "named")


def write_contexts(res: Resources, patients: DataFrame, path: str, **options) -> DataFrame:
    """contexts() as a stored table under `path`, made once; one that is there already, whole, is read."""
    spark = patients.sparkSession
    if not store.exists(spark, f"{path}/_SUCCESS"):
        contexts(res, patients, **options).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
