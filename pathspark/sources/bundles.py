"""Readers of clinical documents: patient bundles and newline-delimited resources, into one table per resource type."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..plans.compiler import Resources
from ..schema import EVENT_TIMES, RESOURCES

#: A bundle's entries as raw JSON, so that one pass serves all resource types.
_BUNDLE = "struct<entry:array<struct<resource:string>>>"


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """(patient_id, ord, resource) of one-document-per-file bundles `<patient>.json`; resource is JSON text."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"([^/]*?)(\.json)?$", 1).alias("patient_id"), "value")
    return bundle_entries(files, "value")


def bundle_entries(documents: DataFrame, column: str) -> DataFrame:
    """The same from a DataFrame with patient_id and a column of bundle JSON."""
    parsed = documents.select("patient_id", F.from_json(column, _BUNDLE).alias("b"))
    return parsed.select("patient_id", F.posexplode("b.entry").alias("ord", "e")).select("patient_id", F.col("ord").cast("long").alias("ord"), F.col("e.resource").alias("resource")).filter(F.col("resource").isNotNull())


#: Bits of ord that are a line's place in its file; the others are the file's.
FILE_BITS = 40


@F.arrow_udf(LongType())
def _line_in_split(splits: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The number of each row within its split, from a hash of the split's file and where it begins: a task reads its splits one after
    another, and each in order."""
    last, n = None, 0
    for file, start in splits:
        both = np.stack([file.to_numpy(zero_copy_only=False), start.to_numpy(zero_copy_only=False)])
        new = np.r_[True, (both[:, 1:] != both[:, :-1]).any(0)] if both.shape[1] else np.zeros(0, bool)
        if len(new) and last is not None and (both[:, 0] == last).all():
            new[0] = False
        at = np.arange(len(new))
        first = np.maximum.accumulate(np.where(new, at, -1))
        out = np.where(first < 0, n + at, at - first)
        if len(new):
            last, n = both[:, -1].copy(), int(out[-1]) + 1
        yield pa.array(out, pa.int64())


def numbered_lines(lines: DataFrame) -> DataFrame:
    """value, file, file_size and at of a text source's lines that aren't blank. at follows their order in the file: where their split
    begins, and their number in it; a line of two bytes or more keeps it below the next split's. Splits are numbered as they are read,
    without a shuffle."""
    rows = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.file_block_start").alias("_start"))
    rows = rows.filter(F.trim("value") != "").withColumn("_line", _line_in_split(F.xxhash64("file"), F.col("_start")))
    return rows.select("value", "file", "file_size", (F.col("_start") + F.col("_line")).alias("at"))


def _owner(patient: str) -> Column:
    """A resource's patient: a Patient is its own."""
    own = F.when(F.get_json_object("value", "$.resourceType") == "Patient", F.get_json_object("value", "$.id"))
    return F.coalesce(own, F.regexp_replace(F.get_json_object("value", patient), "^Patient/", ""))


def read_ndjson(spark: SparkSession, path: str, patient: str = "$.subject.reference") -> DataFrame:
    """(patient_id, ord, resource) of newline-delimited resources. ord follows the files' names and the order of lines in each, however
    Spark splits and packs them. A file may have 2**FILE_BITS bytes."""
    lines = spark.read.text(path)
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")  # noqa: E731  the two ways in which Spark names a local file
    files = sorted(re.sub("^file:/+", "file:/", f) for f in lines.inputFiles())
    order = spark.createDataFrame(list(enumerate(files)), "_i long, _file string")  # what the driver has listed anyway
    rows = numbered_lines(lines).join(order, plain(F.col("file")) == F.col("_file"))
    return rows.select(_owner(patient).alias("patient_id"), (F.shiftleft("_i", FILE_BITS) + F.col("at")).alias("ord"), F.col("value").alias("resource"))


def _time(paths: tuple[str, ...]) -> Column:
    times = [F.try_to_timestamp(F.col(p).cast("string")) for p in paths]
    return F.least(*times) if len(times) > 1 else times[0] if times else F.lit(None).cast("timestamp")


def with_times(table: DataFrame, kind: str) -> DataFrame:
    """Adds _t, the event time, and _sort_t, the same but for resources that sort by their start alone."""
    paths = EVENT_TIMES.get(kind, ())
    sort = {"MedicationAdministration": ("effectiveDateTime",), "Procedure": ("performedPeriod.start",), "Encounter": ("period.start",)}.get(kind, paths)
    return table.withColumn("_t", _time(paths)).withColumn("_sort_t", _time(sort))


def encounter_starts(encounters: DataFrame) -> DataFrame:
    """(e_patient, e_ref, e_t): when each encounter begins; of those with one id the last counts."""
    starts = encounters.select(F.col("patient_id").alias("e_patient"), F.concat(F.lit("Encounter/"), "id").alias("e_ref"), F.try_to_timestamp("period.start").alias("e_t"), "ord")
    return starts.groupBy("e_patient", "e_ref").agg(F.max_by("e_t", "ord").alias("e_t"))


def timed_conditions(conditions: DataFrame, starts: DataFrame) -> DataFrame:
    """Conditions with their encounter's start as _t and _sort_t, and _found: whether their encounter is among starts."""
    c = conditions.drop("_t", "_sort_t").join(starts, (F.col("patient_id") == F.col("e_patient")) & (F.col("encounter.reference") == F.col("e_ref")), "left")
    return c.withColumn("_t", F.col("e_t")).withColumn("_sort_t", F.col("e_t")).withColumn("_found", F.col("e_ref").isNotNull()).drop("e_patient", "e_ref", "e_t")


def condition_times(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Conditions take their encounter's start: one join at load time, instead of one per question."""
    if "Condition" not in tables or "Encounter" not in tables:
        return tables
    return tables | {"Condition": timed_conditions(tables["Condition"], encounter_starts(tables["Encounter"])).drop("_found")}


def stage(entries: DataFrame, path: str) -> DataFrame:
    """Writes entries (patient_id, ord, resource) by resource type, in one pass over them, and reads them back with `kind`: what
    resources() makes of the result then reads each type's own files alone. Types that no template reads are left out."""
    kind = F.get_json_object("resource", "$.resourceType")
    rows = entries.select("patient_id", "ord", "resource", kind.alias("kind")).filter(F.col("kind").isin(*RESOURCES))
    rows.write.mode("overwrite").partitionBy("kind").parquet(path)
    return entries.sparkSession.read.schema(rows.schema).parquet(path)


def typed(entries: DataFrame) -> dict[str, DataFrame]:
    """A table for each resource type, with event times but for conditions."""
    tables = {}
    kind = F.col("kind") if "kind" in entries.columns else F.get_json_object("resource", "$.resourceType")
    for name, schema in RESOURCES.items():
        rows = entries.filter(kind == name).select("patient_id", "ord", F.from_json("resource", schema).alias("r")).select("patient_id", "ord", "r.*")
        tables[name] = with_times(rows, name)
    return tables


def resources(entries: DataFrame) -> Resources:
    """The typed tables of (patient_id, ord, resource). Elements that no template reads are not parsed. Each table reads entries from its
    source: stage() them first where that is raw text."""
    return Resources(condition_times(typed(entries)))


def from_tables(tables: dict[str, DataFrame]) -> Resources:
    """Resources of tables that already have patient_id, ord and some of the elements; the missing ones are null."""
    out = {}
    for name, table in tables.items():
        have = set(table.columns)
        cols = [F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in RESOURCES[name]]
        rows = table.select("patient_id", "ord", *cols, *(c for c in ("_t", "_sort_t") if c in have))
        out[name] = rows if "_t" in have and "_sort_t" in have else rows.withColumn("_sort_t", F.col("_t")) if "_t" in have else with_times(rows, name)
    return Resources(out if "_t" in (tables.get("Condition").columns if "Condition" in tables else ["_t"]) else condition_times(out))


def write_tables(res: Resources, path: str) -> None:
    """Stores the typed tables as Parquet, each sorted by patient and event time within its files, so that filters on both prune."""
    for name, table in res.tables.items():
        table.repartition("patient_id").sortWithinPartitions("patient_id", "_t").write.mode("overwrite").parquet(f"{path}/{name}")


def read_tables(spark: SparkSession, path: str, kinds: list[str] | None = None) -> Resources:
    return Resources({k: spark.read.parquet(f"{path}/{k}") for k in (kinds or RESOURCES)})


#: The types whose resources a patient's bundle has if it refers to them, and those that it has if they refer to it.
INCLUDED = ("Location", "Organization", "Practitioner", "Specimen", "Medication", "MedicationRequest")
REFERRING = ("Provenance",)


def everything(entries: DataFrame, include: tuple[str, ...] = INCLUDED, referring: tuple[str, ...] = REFERRING, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(patient_id, ord, resource, ref): all resources of each patient, as bundles have them, from entries of read_ndjson, in which shared
    ones have no patient. A shared one comes with each patient whose resources refer to it, or to one that does; the types in
    `referring` come with those that they refer to. Of resources with one id the last counts.

    Entries are read once. What is stored in between, by `keep` (a Scratch, whose block the result's use has to be in; else until the process
    ends), are the last version of each resource, and which patient has which shared ones: their text is joined in the result alone."""
    from ..operators.curation import last_wins
    from .store import release, stored

    keep = keep or stored
    kind = lambda ref: F.split_part(ref, F.lit("/"), F.lit(1))
    targets = lambda df, name: df.withColumn(name, F.explode(F.array_distinct(F.regexp_extract_all("resource", F.lit(r'"reference"\s*:\s*"([^"]+)"'), F.lit(1))))).drop("resource", "ord")
    named = F.concat_ws("/", F.get_json_object("resource", "$.resourceType"), F.get_json_object("resource", "$.id"))
    # dealt by key before they are grouped: versions of one resource are seldom in one task, and sorting them there first gains nothing
    keyed = keep(last_wins(entries.select("patient_id", "ord", "resource", named.alias("ref")).repartition("patient_id", "ref"), ["patient_id", "ref"], "ord"))
    release(entries.sparkSession)
    own, shared = keyed.filter(F.col("patient_id").isNotNull()), keep(keyed.filter(F.col("patient_id").isNull()).drop("patient_id"))
    links = keep(targets(shared.filter(kind("ref").isin(*include, *referring)), "to"))
    steps = links.filter(kind("ref").isin(*include) & kind("to").isin(*include))
    leads = [tuple(r) for r in steps.select(kind("ref"), kind("to")).distinct().collect()]  # names of types, no more pairs than include has
    pairs = lambda df: df.select("patient_id", "ref")
    of_kinds = lambda df, kinds: pairs(df).filter(kind("ref").isin(*kinds))
    fresh = of_kinds(targets(own.drop("ref"), "ref"), include).distinct().join(of_kinds(own, include), ["patient_id", "ref"], "left_anti")
    found, kinds = (fresh := keep(fresh)), set(include)
    while (kinds := {b for a, b in leads if a in kinds}) and not fresh.isEmpty():
        asked = fresh.join(steps, "ref").select("patient_id", F.col("to").alias("ref")).distinct()
        fresh = keep(asked.join(of_kinds(own, kinds).unionByName(of_kinds(found, kinds)), ["patient_id", "ref"], "left_anti"))
        found = found.unionByName(fresh)
    release(entries.sparkSession)
    columns = ["patient_id", "ord", "resource", "ref"]
    out = own.select(*columns).unionByName(found.join(shared, "ref").select(*columns))
    about = links.filter(kind("ref").isin(*referring)).select(F.col("ref").alias("by"), F.col("to").alias("ref"))
    if about.isEmpty():
        return out
    of = about.join(pairs(out), "ref").select("patient_id", F.col("by").alias("ref")).distinct()
    more = shared.join(of.join(of_kinds(out, referring), ["patient_id", "ref"], "left_anti"), "ref")
    return out.unionByName(more.select(*columns))
