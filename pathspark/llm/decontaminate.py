"""Benchmark decontamination with a distributed positional inverted index, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import packed, stored, table, unpacked

#: Words of a lower-cased text: digits, small letters and everything outside ASCII. What separates them is listed one by one: such a
#: class is a bitmap for Java, some six times as fast as ranges.
WORD = "[^" + "".join(f"\\x{c:02X}" for c in range(128) if not (0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A)) + "]+"
#: A small side is broadcast only where its measured size is below this many bytes.
BROADCAST_BYTES = 8 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A to Z alone. lower() is the same thing, and faster, for texts without other characters that it changes."""
    other = text.rlike(r"[[^\x00-\x7F]&&[\p{Lu}\p{Lt}\p{Nl}\p{So}]]")
    return F.when(other, F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def small(df: DataFrame, column: str) -> DataFrame:
    """df, marked for a broadcast if its strings are measured to be few bytes; Spark's own choice, a shuffle, beyond that."""
    n = df.agg(F.coalesce(F.sum(F.length(column) * 4 + 64), F.lit(0))).first()[0]
    return F.broadcast(df) if n <= BROADCAST_BYTES else df


def phrases(items: DataFrame, item: str, text: str, window: int) -> tuple[DataFrame, DataFrame]:
    """(phrase, words, n) of all distinct windows of the items, and (phrase, item): a window is `window` consecutive words, or all words
    of an item that has fewer but not none."""
    w = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    w = w.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1))), lambda i: F.slice("w", i, window))).alias("words"))
    w = w.select("item", "words", F.array_join("words", " ").alias("phrase")).distinct()
    return w.select("phrase", "words").distinct().withColumn("n", F.size("words")), w.select("phrase", "item")


def term_counts(docs: DataFrame, vocabulary: DataFrame, text: str = "text") -> DataFrame:
    """(term, count): how often each term of the vocabulary stands in all texts. Words that aren't in it never reach the shuffle."""
    at = docs.select(F.explode(words(F.col(text))).alias("term"))
    seen = at.join(small(vocabulary, "term"), "term").groupBy("term").count()
    return vocabulary.join(seen, "term", "left").select("term", F.coalesce("count", F.lit(0)).alias("count"))


def build_index(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The positional inverted index of the given terms, written to the shared folder: one row per term and document with `places`, the
    sorted places (from 1) of the term. A document is known by its key and its text's hash, so rows with the same key stay apart,
    and equal rows are one document. Postings are grouped by term and document together: a frequent term is no hot key."""
    at = docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("text_hash"), F.posexplode(words(F.col(text))).alias("pos", "term"))
    at = at.join(small(terms.select(F.col("term").alias("t")), "t"), F.col("term") == F.col("t")).select("term", "doc", "text_hash", (F.col("pos") + 1).alias("pos"))
    return stored(at.groupBy("term", "doc", "text_hash").agg(F.array_sort(F.collect_set("pos")).alias("places")), "postings")


def rarest_terms(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """windows with `rare`: array<struct<count, offset, term>> of their distinct terms (first offset of each), the rarest first."""
    at = windows.select("phrase", F.posexplode("words").alias("offset", "term")).groupBy("phrase", "term").agg(F.min("offset").alias("offset"))
    at = at.join(counts, "term").groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("count", "offset", "term"))).alias("rare"))
    return windows.join(at, "phrase")


def meet(index: DataFrame, windows: DataFrame) -> DataFrame:
    """(phrase, o1, o2, doc, text_hash, p1, p2): the places of a window's two rarest terms, and their offsets in it, in each document
    that has both; p2 is null where the window has one distinct term."""
    first = windows.select("phrase", F.get("rare", 0)["term"].alias("term"), F.get("rare", 0)["offset"].alias("o1"), F.get("rare", 1)["term"].alias("term2"), F.get("rare", 1)["offset"].alias("o2"))
    found = first.join(index, "term").withColumnRenamed("places", "p1").drop("term")
    second = index.select(F.col("term").alias("t2"), F.col("doc").alias("doc2"), F.col("text_hash").alias("hash2"), F.col("places").alias("p2"))
    pairs = found.filter(F.col("term2").isNotNull()).join(second, (F.col("term2") == F.col("t2")) & F.col("doc").eqNullSafe(F.col("doc2")) & (F.col("text_hash") == F.col("hash2")))
    # a phrase of one distinct term has no second list
    alone = found.filter(F.col("term2").isNull()).withColumn("p2", F.expr("cast(null as array<int>)"))
    columns = ["phrase", "o1", "o2", "doc", "text_hash", "p1", "p2"]
    return pairs.select(*columns).unionByName(alone.select(*columns))


def starts() -> Column:
    """Of meet(): the starts (place less offset) that both terms' lists hold."""
    return F.filter(F.transform("p1", lambda p: p - F.col("o1")), lambda s: (s >= 1) & (F.col("p2").isNull() | F.array_contains("p2", s + F.col("o2"))))


def near(slop: int) -> Column:
    """Of meet(): the places of the rarest term that have the second rarest within slop words."""
    return F.filter("p1", lambda p: F.col("p2").isNull() | F.exists("p2", lambda q: F.abs(q - p) <= slop))


def search(index: DataFrame, windows: DataFrame, slop: int | None = None) -> DataFrame:
    """(phrase, doc, text_hash, start) of the places where a window may occur: the postings of its rarest term give the starts (place less
    offset), and the list of its next rarest term, adjusted by its offset, has to hold them too. What is left is for the
    caller to compare with the document; contamination() does.

    With `slop`, proximity instead: the places of the rarest term that have every other distinct term of the window within slop
    words, in any order. The index has to hold all terms of the windows for that."""
    found = meet(index, windows)
    if slop is None:
        return found.select("phrase", "doc", "text_hash", F.explode(starts()).alias("start"))
    found = found.select("phrase", "doc", "text_hash", F.explode(near(slop)).alias("start")).distinct()
    # the terms after the two rarest, each in its own list
    rest = windows.select(F.col("phrase").alias("ph"), F.explode_outer(F.slice("rare", 3, 1 << 30)["term"]).alias("t3"), F.greatest(F.size("rare") - 2, F.lit(0)).alias("others"))
    wanted = found.join(rest, F.col("phrase") == F.col("ph"))
    lists = index.select("term", F.col("doc").alias("doc2"), F.col("text_hash").alias("hash2"), "places")
    held = wanted.join(lists, (F.col("t3") == F.col("term")) & F.col("doc").eqNullSafe(F.col("doc2")) & (F.col("text_hash") == F.col("hash2")), "left")
    held = held.withColumn("close", F.coalesce(F.exists("places", lambda q: F.abs(q - F.col("start")) <= slop), F.lit(False)))
    return held.groupBy("phrase", "doc", "text_hash", "start", "others").agg(F.count_if("close").alias("n")).filter(F.col("n") == F.col("others")).select("phrase", "doc", "text_hash", "start")


def contamination(docs: DataFrame, items: DataFrame, keep: list[str] | None = None, window: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", slop: int | None = None) -> DataFrame:
    """docs' columns `keep` (all by default) with n_words, n_hit (words inside any occurrence of an item's window), n_items, items
    (sorted ids as strings), contaminated; a column of docs with one of these names is replaced, other names are free. Each row of docs
    is one row of the result; equal rows get equal values. A null
    text has no words; items without words have no windows; a null item id counts as ''. Without docs or items there are no
    rows or no hits. The candidates of one document meet in its row; each is then compared with its words.

    With `slop` there is also n_near: how many items have a window whose distinct words all stand within slop words of a place
    of its rarest one, in any order. Those that hold the two rarest so are candidates; the other words are looked up in the row."""
    keep = docs.columns if keep is None else keep
    windows, owners = phrases(items, item, item_text, window)
    windows, owners = stored(windows, "windows"), stored(owners, "owners")
    counts = stored(term_counts(docs, windows.select(F.explode("words").alias("term")).distinct(), text), "term-counts")
    windows = rarest_terms(windows, counts)
    anchors = windows.select(F.explode(F.slice("rare", 1, 2)["term"]).alias("term")).distinct()
    index = build_index(docs, anchors, key, text)
    owned = windows.join(owners, "phrase").groupBy("phrase", "words").agg(F.collect_set("item").alias("items"))
    places = F.transform(starts(), lambda s: F.struct(s.alias("start"), F.lit(False).alias("near")))
    if slop is not None:
        places = F.concat(places, F.transform(near(slop), lambda s: F.struct(s.alias("start"), F.lit(True).alias("near"))))
    at = meet(index, windows).select("phrase", "doc", "text_hash", F.explode(places).alias("at")).select("phrase", "doc", "text_hash", "at.*")
    maybe = at.join(owned, "phrase").groupBy("doc", "text_hash").agg(F.array_sort(F.collect_set(F.struct("start", "near", "words", "items"))).alias("_maybe"))
    maybe = stored(maybe, "candidates")
    rows = packed(docs, keep, _doc=F.col(key), _hash=F.xxhash64(text), _text=F.col(text))
    # the candidates grow with the corpus, so this join is a sort-merge join at every size; AQE splits a document that many rows repeat
    rows = rows.join(maybe.hint("merge"), F.col("_doc").eqNullSafe(F.col("doc")) & (F.col("_hash") == F.col("text_hash")), "left").withColumn("_w", words(F.col("_text")))
    # the windows that are there, word by word
    held = F.filter("_maybe", lambda x: ~x["near"] & (F.slice("_w", x["start"], F.size(x["words"])) == x["words"]))
    extra = []
    if slop is not None:
        around = lambda p: F.slice("_w", F.greatest(p - slop, F.lit(1)), p + slop - F.greatest(p - slop, F.lit(1)) + 1)
        close = F.filter("_maybe", lambda x: x["near"] & (F.size(F.array_except(x["words"], around(x["start"]))) == 0))
        rows = rows.withColumn("n_near", F.coalesce(F.size(F.array_distinct(F.flatten(F.transform(F.when(F.col("_maybe").isNotNull(), close), lambda x: x["items"])))), F.lit(0)).cast("long"))
        rows = rows.withColumn("n_near", F.greatest("n_near", F.lit(0)))
        extra = ["n_near"]
    rows = rows.withColumn("n_words", F.size("_w").cast("long")).withColumn("_held", F.when(F.col("_maybe").isNotNull(), held)).select("row", *extra, "n_words", "_held")
    covered = F.aggregate(
        "_held", F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(F.greatest(acc["upto"], x["start"] + F.size(x["words"]) - 1).alias("upto"), (acc["n"] + F.greatest(x["start"] + F.size(x["words"]) - 1 - F.greatest(acc["upto"], x["start"] - 1), F.lit(0))).alias("n")),
        lambda acc: acc["n"],
    )
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("_held", lambda x: x["items"]))))
    rows = rows.select("row", *extra, "n_words", F.coalesce(covered, F.lit(0)).cast("long").alias("n_hit"), F.coalesce(items, F.expr("cast(array() as array<string>)")).alias("items"))
    return unpacked(rows, *extra, "n_words", "n_hit", "items", F.size("items").cast("long").alias("n_items"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated, for windows of 10 words of the benchmark's items, and n_near, the
    items with a window whose words all stand within 10 words of its rarest one."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"], slop=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "n_near")
