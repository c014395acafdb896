"""Corpus curation over DataFrames: dedup, splits, holdouts, filters, paraphrase checks, value sets, draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import cut

# -- dedup


def last_wins(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key: the last by `order`, at the place of the first (`order` becomes that)."""
    rest = [c for c in df.columns if c not in keys and c != order]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"), F.min(order).alias(order)).select(*keys, order, *(F.col(f"_r.{c}").alias(c) for c in rest))


def keep_first(df: DataFrame, keys: Sequence[str], order: str, limit: int | None = None) -> DataFrame:
    """One row per key, the first by `order`; then the first `limit` of them."""
    rest = [c for c in df.columns if c not in keys]
    out = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))
    return out if limit is None else out.orderBy(order).limit(limit)


MIN_EDIT, MIN_NORMALISED, MIN_COSINE = 10, 0.15, 0.7


def different(a: Column, b: Column, edit: int = MIN_EDIT, normalised: float = MIN_NORMALISED) -> Column:
    """Far enough apart, by absolute and by normalised edit distance; empty texts are not. Texts whose lengths differ by as much need no
    distance, and no distance is taken further than what decides."""
    longer, by_length = F.greatest(F.length(a), F.length(b)), F.abs(F.length(a) - F.length(b))
    surely = (by_length >= edit) & (by_length >= normalised * longer) & (F.least(F.length(a), F.length(b)) > 0)
    distance = F.call_function("levenshtein", a, b, F.greatest(F.lit(edit), F.ceil(normalised * longer).cast("int")))  # -1: further
    measured = (distance < 0) | (distance >= edit) & (distance / F.nullif(longer, F.lit(0)) >= normalised)
    return F.coalesce(F.when(surely, F.lit(True)).otherwise(measured), F.lit(False))


def difference_reason(a: Column, b: Column, edit: int = MIN_EDIT, normalised: float = MIN_NORMALISED) -> Column:
    d, share = F.levenshtein(a, b), T.normalised_levenshtein(a, b)
    return (
        F.when(d < edit, F.format_string(f"%s edits apart, fewer than {edit}", d.cast("string")))
        .when(share.isNull(), "empty text")
        .when(share < normalised, F.format_string(f"%.3f of the longer text edited, less than {normalised}", share))
    )


def greedy_distinct(df: DataFrame, group: str, order: str, text: str, block: int = 1024) -> DataFrame:
    """Per group, in order (equal places by text): keeps a text if it is different from all texts kept before.

    Only a text's first place counts, as a copy is near to what decided it. All groups go on together, in rounds: the first `block` places of
    each, then twice as many in each round. A round finds the near pairs among its texts that are left, decides these in order, and drops the
    texts behind that are near to one that it keeps. So there are as many rounds as the largest group has doublings of `block`; near pairs
    come from tiles of bounded size, and no group is ever one row or one task's array."""
    from .tiles import TILE, band, near_pairs, signature

    rows = df.select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(text).alias("t")).filter(F.col("g").isNotNull())
    first = rows.groupBy("g", "t").agg(F.min(F.struct("o")).alias("_o")).select("g", F.col("_o.o").alias("o"), "t")
    # a text that is null is near to all: it is kept if it is the first, and then nothing else is
    groups = first.groupBy("g").agg(F.min(F.struct("o", "t")).alias("_first"), F.count("t").alias("_size"))
    alone = groups.filter(F.col("_first.t").isNull()).select("g", "_first.o", "_first.t")
    sizes = groups.filter(F.col("_first.t").isNotNull()).select(F.col("g").alias("_g"), "_size")
    placed = numbered(first.filter(F.col("t").isNotNull()).join(sizes, F.col("g") == F.col("_g")).drop("_g"), "g", "o", "t", name="id")
    begins = placed.groupBy(F.col("g").alias("_g")).agg(F.min("id").alias("_begin"))
    near = F.when(F.col("_size") <= TILE, 0).otherwise(band(F.length("t"), MIN_EDIT, MIN_NORMALISED))
    turn = F.floor(F.log2((F.col("id") - F.col("_begin")) / block + 1)).cast("int")
    left = cut(placed.join(begins, F.col("g") == F.col("_g")).select("id", "g", "o", "t", near.alias("band"), turn.alias("turn"), signature("t").alias("sig")))
    out, last = [alone], left.agg(F.max("turn")).first()[0]
    pairs = lambda x, y, ordered: near_pairs(x, y, different, MIN_EDIT, MIN_NORMALISED, ordered)
    for n in range(0 if last is None else last + 1):
        now, behind = left.filter(F.col("turn") == n), left.filter(F.col("turn") > n)
        kept = cut(now.join(_later_of_kept(pairs(now, now, True)), "id", "left_anti"))
        out.append(kept.select("g", "o", "t"))
        if n < last:
            left = cut(behind.join(pairs(kept, behind, False).select(F.col("b").alias("id")), "id", "left_anti"))
    kept = out[0]
    for more in out[1:]:
        kept = kept.unionByName(more)
    return kept.select(F.col("g").alias(group), F.col("o").alias(order), F.col("t").alias(text))


def _later_of_kept(edges: DataFrame) -> DataFrame:
    """The ids that are not kept when those of edges (a, b), a below b, are decided in order. Each step keeps all that have no undecided one
    before them, and drops their neighbours: as many steps as the longest chain has links that decide each other."""
    edges, gone = cut(edges.distinct()), None
    while not edges.isEmpty():
        kept = edges.select(F.col("a").alias("k")).distinct().join(edges.select(F.col("b").alias("k")).distinct(), "k", "left_anti")
        now = cut(edges.join(kept, F.col("a") == F.col("k")).select(F.col("b").alias("id")).distinct())
        gone = now if gone is None else gone.unionByName(now)
        for end in ("a", "b"):
            edges = edges.join(now, F.col(end) == F.col("id"), "left_anti")
        edges = cut(edges)
    return edges.select(F.col("b").alias("id")) if gone is None else gone


# -- splits and holdouts


def ranked_split(df: DataFrame, group: str, text: str, test: int = 12, val: int = 8, order: Column | None = None) -> DataFrame:
    """Per group: the first ceil(test %) rows of a hash order are test, the next ceil(val %) val, the rest train; val is cut for tiny groups."""
    order = F.md5(F.col(text)) if order is None else order
    rank = F.row_number().over(Window.partitionBy(group).orderBy(order, F.col(text)))
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    up = lambda p: ((n * p + 99) / 100).cast("long")
    return df.withColumn("split", F.when(rank <= up(test), "test").when(rank <= up(test) + up(val), "val").otherwise("train"))


def look_up_split(df: DataFrame, splits: DataFrame, keys: Sequence[str], missing: str | None = "unknown") -> DataFrame:
    """The split of each row's keys; `missing` where there is none."""
    found = splits.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("split").alias("_split"))
    on = [df[k] == found[f"_{k}"] for k in keys]
    out = df.join(found, on, "left").drop(*(f"_{k}" for k in keys))
    return out.withColumn("split", F.coalesce("_split", F.lit(missing)) if missing else F.col("_split")).drop("_split")


def holdout(template: Column, first: Sequence[str], second: Sequence[str]) -> Column:
    """1 for templates of the first set, 2 for those of the second alone, else 0."""
    return F.when(template.isin(*first), 1).when(template.isin(*second), 2).otherwise(0)


def override_split(split: Column, held: Column) -> Column:
    return F.when(held != 0, "test").otherwise(split)


def distribution(df: DataFrame, *columns: str) -> DataFrame:
    """Counts and shares; no rows, no shares."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def filter_corpus(df: DataFrame, splits: Sequence[str] | None = None, exclude: Sequence[str] = (), template: str = "question_template_id") -> tuple[DataFrame, DataFrame]:
    """The rows of the splits without the excluded templates, and one row of counters; the split is looked at first."""
    wrong = ~F.col("split").isin(*splits) if splits else F.lit(False)
    wrong = F.coalesce(wrong, F.lit(True))
    out = F.coalesce(F.col(template).isin(*exclude), F.lit(False)) if exclude else F.lit(False)
    marked = df.withColumn("_s", wrong).withColumn("_t", ~wrong & out)
    counters = marked.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("_s")).alias("removed_by_split"), F.count_if(F.col("_t")).alias("removed_by_template"), F.count_if(~F.col("_s") & ~F.col("_t")).alias("kept"))
    return marked.filter(~F.col("_s") & ~F.col("_t")).drop("_s", "_t"), counters


def null_answer(answer: Column) -> Column:
    """[] and [0] say nothing; [false] does."""
    return F.trim(answer).isin("[]", "[0]")


# -- value sets


def not_numeric_codes(values: DataFrame, column: str = "value") -> DataFrame:
    """Without blanks and strings of digits and separators; the rest trimmed."""
    kept, trimmed = says_something(F.col(column))
    return values.filter(kept).withColumn(column, trimmed)


def says_something(value: Column) -> tuple[Column, Column]:
    """Whether a value is more than digits and separators, and the value trimmed."""
    v = F.trim(value)
    return (v != "") & ~v.rlike(r"^[\d\s\-_./]+$"), v


def in_valueset(values: DataFrame, valueset: DataFrame, column: str = "value") -> DataFrame:
    """Values that the value set has, whatever their case; they keep their own. An empty value set lets all through."""
    allowed = valueset.select(F.lower(F.trim(column)).alias("_v")).distinct()
    return values if allowed.isEmpty() else values.join(allowed, F.lower(F.trim(F.col(column))) == F.col("_v"), "left_semi")


def or_fallback(values: Column, fallback: Sequence[str]) -> Column:
    return F.when(F.size(values) > 0, values).otherwise(F.array(*map(F.lit, fallback)).cast("array<string>"))


def merge_suffixed(df: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """(name, values): names lose a number at their end (drug_name1 is drug_name); their values are distinct and sorted."""
    return df.groupBy(F.regexp_replace(name, r"\d+$", "").alias(name)).agg(F.array_sort(F.collect_set(value)).alias("values"))


# -- paraphrases


def slot_reason(paraphrase: Column, required: Column, pattern: str = T.MASK) -> Column:
    """Null where the paraphrase has exactly the required slots, else which are missing and which are extra."""
    found, required = T.slots(paraphrase, pattern), F.array_sort(F.array_distinct(required))
    missing, extra = F.array_except(required, found), F.array_except(found, required)
    part = lambda what, a: F.when(F.size(a) > 0, F.concat(F.lit(f"{what} "), F.array_join(F.array_sort(a), ", ")))
    return F.when(found != required, F.concat_ws("; ", part("lacks", missing), part("adds", extra)))


def filter_chain(df: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """Adds reason: the first check's that has one; null for rows that pass all."""
    return df.withColumn("reason", F.coalesce(*(F.when(r.isNotNull(), F.concat(F.lit(f"{k}: "), r)) for k, r in reasons.items())))


def pairs_with_first(df: DataFrame, group: str, texts: str) -> DataFrame:
    """(group, original, paraphrase) of an array column whose first element is the original."""
    return df.select(group, F.get(texts, 0).alias("original"), F.posexplode(texts).alias("pos", "paraphrase")).filter("pos > 0").drop("pos")


def pair_statistics(pairs: DataFrame, group: str) -> DataFrame:
    """n, mean, deviation, least and most edit distance per group and over all (group null); 0 where there is nothing."""
    d = pairs.withColumn("_d", F.levenshtein("original", "paraphrase").cast("double"))
    one = lambda f: F.coalesce(f("_d"), F.lit(0.0))
    return d.rollup(group).agg(F.count(F.lit(1)).alias("n"), one(F.avg).alias("mean"), one(F.stddev_pop).alias("std"), one(F.min).alias("least"), one(F.max).alias("most"))


def review(df: DataFrame, flag: str = "good") -> tuple[DataFrame, DataFrame]:
    """The accepted rows, and counters: accepted (y), rejected (n), unknown flags, rejection rate among known ones."""
    f = F.lower(F.trim(flag))
    counters = df.agg(F.count_if(f == "y").alias("accepted"), F.count_if(f == "n").alias("rejected"), F.count_if(F.coalesce(~f.isin("y", "n"), F.lit(True))).alias("unknown"))
    return df.filter(f == "y"), counters.withColumn("rejection_rate", F.col("rejected") / F.nullif(F.col("accepted") + F.col("rejected"), F.lit(0)))


def merge_perspectives(clinical: DataFrame, patient: DataFrame, key: str = "template_id", value: str = "text") -> DataFrame:
    """Full outer join of two paraphrase maps."""
    a = clinical.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("clinical"))
    b = patient.groupBy(F.col(key).alias("_k")).agg(F.array_sort(F.collect_set(value)).alias("patient"))
    return a.join(b, F.col(key) == F.col("_k"), "full").select(F.coalesce(key, "_k").alias(key), "clinical", "patient")


def paraphrases_of_split(clinical: DataFrame, patient: DataFrame, splits: DataFrame, split: str, key: str = "key") -> DataFrame:
    """(template_id, clinical, patient): both perspectives' texts (key, ord, text) that splits (template_id, text, split) puts into the
    split, in their order. A template of which none is there keeps empty lists."""
    both = clinical.select(key, "ord", "text", F.lit("clinical").alias("who")).unionByName(patient.select(key, "ord", "text", F.lit("patient").alias("who")))
    wanted = splits.filter(F.col("split") == split).select(F.col("template_id").alias("_k"), F.col("text").alias("_x")).distinct()
    found = both.join(wanted, (F.col(key) == F.col("_k")) & (F.col("text") == F.col("_x")), "left")
    kept = lambda who: F.transform(F.array_sort(F.collect_list(F.when(F.col("_k").isNotNull() & (F.col("who") == who), F.struct("ord", "text")))), lambda x: x["text"]).alias(who)
    return found.groupBy(F.col(key).alias("template_id")).agg(kept("clinical"), kept("patient"))


# -- draws


def pick(values: Column, *key: Column) -> Column:
    """An element of an array by the hash of key: the same for the same key, evenly spread over keys."""
    return F.when(F.size(values) > 0, F.get(values, F.pmod(F.xxhash64(*key), F.size(values)).cast("int")))


def quota(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(order))).filter(F.col("_n") <= n).drop("_n")


def remaining(tracked: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What a checkpointed run has still to do."""
    return tracked.join(done.select(*keys).distinct(), list(keys), "left_anti")


def resume(fresh: DataFrame, checkpoint: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fresh work that the checkpoint knows too."""
    return fresh.join(checkpoint.select(*keys).distinct(), list(keys), "left_semi")


def numbered(df: DataFrame, *order: str, name: str = "index") -> DataFrame:
    """Consecutive numbers from 0 in a total order: ranges are numbered by themselves and moved by what the ranges before hold."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    ranged = cut(ranged)
    ranges = ranged.groupBy("_p").count()
    base = ranges.select(F.col("_p").alias("_q"), (F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).alias("_base"))
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return ranged.withColumn("_w", within).join(base, F.col("_p") == F.col("_q")).withColumn(name, (F.coalesce("_base", F.lit(0)) + F.col("_w")).cast("long")).drop("_p", "_q", "_base", "_w")


def cover(tracked: DataFrame, evaluate, keys: Sequence[str], most: int = 20, after=None, start: int = 0) -> DataFrame | None:
    """Draws until everything tracked has an answer that isn't null, or `most` rounds are over: in each round `evaluate(rows, round)`
    answers all that remains, the first success of each key is accepted, and the rest is tried again. after(round, accepted, left)
    is called with what each round has accepted and left, so that it can be written; a later call may `start` behind it."""
    done, left = None, tracked
    for r in range(start, most):
        answered = evaluate(left, r).filter(~null_answer(F.col("answer")))
        accepted = answered.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("question_id"))).filter("_n = 1").drop("_n")
        accepted = cut(accepted)
        done = accepted if done is None else done.unionByName(accepted)
        left = remaining(tracked, done, keys)
        if after:
            after(r, accepted, left)
        if left.isEmpty():
            break
    return done
