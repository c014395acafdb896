"""Value sets of annotated questions: JSON of {category: {placeholder: value}}, where a value is a scalar, a list or an object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that are no value, placeholders whose numbered forms are one, and pairs of a name and its values.
EMPTY = ("", "null", "-")
MERGED = ("drug_name", "procedure_name", "diagnosis_name")
PAIRS = {"lab": ("lab_name", "lab_value"), "vital": ("vital_name", "vital_value")}


def as_texts(value: Column) -> Column:
    """A variant as a list of texts: a list's items, or the value alone; objects as JSON with their keys in order; without empty ones."""
    items = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array(value))
    texts = F.transform(items, lambda v: F.try_variant_get(v, "$", "string"))
    return F.filter(texts, lambda t: t.isNotNull() & ~t.isin(*EMPTY))


def texts_of(entries: DataFrame, column: str) -> DataFrame:
    """The distinct JSON texts of entries: sets and maps of values come from these alone, and each is parsed once."""
    return entries.select(column).distinct()


def placeholders_of(value: Column) -> Column:
    """The placeholders of one entry, a variant: (category, name, texts) of each that has texts."""
    inner = lambda v: F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    one = lambda c: F.transform(inner(c["value"]), lambda p: F.struct(c["key"].alias("category"), p["key"].alias("name"), as_texts(p["value"]).alias("texts")))
    named = F.flatten(F.filter(F.transform(inner(value), one), lambda rows: rows.isNotNull()))
    return F.filter(named, lambda r: F.size(r["texts"]) > 0)


def placeholders(entries: DataFrame, key: str, column: str) -> DataFrame:
    """(key, category, name, texts) of entries with a key and a column of JSON text, which is parsed once. What is no object, or no JSON, has no
    placeholders."""
    # outer, as Spark would compute the list again to leave out empty ones
    found = entries.select(F.col(key), F.inline_outer(placeholders_of(F.try_parse_json(column))))
    return found.filter(F.col("texts").isNotNull())


def value_sets_of(found: DataFrame) -> DataFrame:
    """(category, name, values) of placeholders(): distinct texts, sorted. Numbered forms of MERGED among the category val_placeholder count for
    the plain name too."""
    plain = F.regexp_replace("name", r"\d+$", "")
    merged = (F.col("category") == "val_placeholder") & plain.isin(*MERGED)
    names = F.when(merged, F.array_distinct(F.array("name", plain))).otherwise(F.array("name"))
    rows = found.select("category", names.alias("names"), F.explode_outer("texts").alias("value")).filter(F.col("value").isNotNull())
    rows = rows.groupBy("category", "names", "value").agg(F.lit(1)).select("category", F.explode("names").alias("name"), "value")
    return rows.groupBy("category", "name").agg(F.array_sort(F.collect_set("value")).alias("values"))


def value_maps(found: DataFrame, key: str) -> DataFrame:
    """(kind, name, values): the values that entries give under each name, for the pairs of PAIRS with one number, or none, in one entry. found
    is of placeholders(); rows of one key are one entry."""
    own = found.filter((F.col("category") == "val_placeholder") & F.col(key).isNotNull()).groupBy(key).agg(F.collect_list(F.struct("category", "name", "texts")).alias("_all"))
    return _maps(own.select(_paired(F.col("_all")).alias("_p")))


def value_maps_of(entries: DataFrame, column: str) -> DataFrame:
    """The same of a column of JSON text, each row of which is an entry: nothing but the pairs is shuffled after that."""
    return _maps(entries.select(_paired(placeholders_of(F.try_parse_json(column))).alias("_p")))


def _paired(found: Column) -> Column:
    """The (kind, names, values) of one entry's placeholders."""

    def of(kind: str) -> Column:
        name, value = PAIRS[kind]
        part = lambda prefix: F.filter(found, lambda r: (r["category"] == "val_placeholder") & r["name"].startswith(prefix))
        number = lambda r, prefix: F.substr(r["name"], F.lit(len(prefix) + 1))
        values = lambda n: F.flatten(F.transform(F.filter(part(value), lambda v: number(v, value) == number(n, name)), lambda v: v["texts"]))
        return F.transform(part(name), lambda n: F.struct(F.lit(kind).alias("kind"), n["texts"].alias("names"), values(n).alias("vals")))

    return F.filter(F.concat(*map(of, PAIRS)), lambda p: F.size(p["vals"]) > 0)


def _maps(entries: DataFrame) -> DataFrame:
    rows = entries.select(F.inline_outer("_p")).select("kind", F.explode_outer("names").alias("name"), "vals")
    rows = rows.select("kind", "name", F.explode_outer("vals").alias("value")).filter(F.col("value").isNotNull())
    return rows.groupBy("kind", "name", "value").agg(F.lit(1)).groupBy("kind", "name").agg(F.array_sort(F.collect_set("value")).alias("values"))
