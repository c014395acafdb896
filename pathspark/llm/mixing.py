"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import WORD, packed, stored, table, unpacked


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, repeats: int) -> DataFrame:
    """From (source, source_size): `target`, the source's part of share x all sizes. Sources in code-point order, null
    last, weigh `weights` in turn. No target is above repeats x its source's size; what is cut off goes to the others by
    weight, until none is above: target = min(cap, level x weight) for the one level that spends everything. One row per
    source is all this sorts."""
    w = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.row_number().over(w) - 1) % len(weights) + 1)
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * repeats)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    upto = fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = (
        rows.withColumn("total", F.least(F.sum("source_size").over(whole) * F.lit(float(share)), F.sum("cap").over(whole)))
        .withColumn("caps_before", F.sum("cap").over(upto) - F.col("cap"))
        .withColumn("weight_left", F.sum("weight").over(whole) - F.sum("weight").over(upto) + F.col("weight"))
        # the level if this source and all that fill up later were the ones left; the true one is the first that leaves it unfilled
        .withColumn("level", (F.col("total") - F.col("caps_before")) / F.col("weight_left"))
        .withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(whole)["level"])
    )
    return rows.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def _queues(docs: DataFrame, keep: list[str], weights: Sequence[float], share: float, repeats: int, seed: int, names: dict[str, str], bucket_rows: int) -> DataFrame:
    """row (docs' columns keep), m_source, m_size, m_order, m_source_size, m_target, m_cycle (the finish time of the whole queue), m_finish,
    and m_small, m_least and m_until, which say what the mix takes of the documents behind the time 1 (_in_mix()).

    A queue is its source's documents in the order of a seeded hash. It is cut into ranges of that hash of about
    `bucket_rows` rows; the ranges' sums are added up first, so a source with a third of all rows is no hot key."""
    key, text, source = (F.col(names[k]) for k in ("key", "text", "source"))
    rows = packed(docs, keep, m_source=source, m_size=count_words(text), m_order=F.xxhash64(key, text, F.lit(seed)))
    slim = stored(rows.drop("row"), "mix-sizes")
    bits = max(0, slim.count() // bucket_rows).bit_length()
    bucket = (F.shiftright("m_order", 64 - bits) if bits else F.lit(0)).cast("long")
    targets = source_targets(slim.groupBy(F.col("m_source").alias("source")).agg(F.sum("m_size").alias("source_size")), weights, share, repeats)
    before = Window.partitionBy("b_source").orderBy("b_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = slim.groupBy(F.col("m_source").alias("b_source"), bucket.alias("b_bucket")).agg(F.sum("m_size").alias("held"))
    sums = sums.withColumn("sent", F.coalesce(F.sum("held").over(before), F.lit(0))).join(targets, F.col("b_source").eqNullSafe(F.col("source")))
    sums = stored(sums.select("b_source", "b_bucket", "sent", F.col("source_size").alias("m_source_size"), F.col("target").alias("m_target")), "mix-sums")
    # rows of one order have one key and one text, so one size
    inside = Window.partitionBy("m_source", "m_bucket").orderBy("m_order", "m_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per_word = F.coalesce(1 / F.nullif(F.col("m_target"), F.lit(0.0)), F.lit(0.0))

    def timed(rows, sums):
        rows = rows.withColumn("m_bucket", bucket).join(sums, F.col("m_source").eqNullSafe(F.col("b_source")) & (F.col("m_bucket") == F.col("b_bucket")))
        rows = rows.withColumn("m_finish", (F.col("sent") + F.sum("m_size").over(inside)) * per_word)
        return rows.withColumn("m_cycle", F.col("m_source_size") * per_word).drop("b_source", "b_bucket", "sent")

    copies = timed(slim, sums).withColumn("m_copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    copies = stored(copies.withColumn("m_finish", F.col("m_finish") + F.col("m_copy") * F.col("m_cycle")).filter("m_size > 0"), "mix-copies")
    ends = _truncated(copies, _passed_over(copies))
    sums = sums.join(ends, F.col("b_source").eqNullSafe(F.col("e_source")), "left").drop("e_source")
    return timed(rows, stored(sums, "mix-ends")).drop("m_bucket")


def _passed_over(copies: DataFrame) -> DataFrame:
    """What each queue sends after the last copy that ends by the time 1, in place of the one that would cross it: the smallest of the copies
    that are left, as far as they fit into the target; of one size, the earlier ones. One row per source: e_source, m_small (all smaller copies
    are sent), m_least (the size of which only some are), m_until (up to which finish time), and of the next copy of that size, which no longer
    fits, but whose end is nearer to the target than its beginning: more (its size), ends (its finish time in the queue), at (its
    virtual finish time, as it is sent next). So a source ends no further from its target than half of its smallest copy left, as far as the budget pays for that.

    Sizes are counted, and only sizes up to twice of what a source lacks are looked at, in a window over sizes, not documents. Copies of
    the one size that is cut are found by ranges of their queue, like all queues."""
    served = F.col("m_finish") <= 1 + _SAME
    state = copies.groupBy(F.col("m_source").alias("e_source")).agg((F.max("m_target") - F.coalesce(F.sum(F.when(served, F.col("m_size"))), F.lit(0))).alias("lacks"), F.max("m_target").alias("e_target"))
    state = stored(state, "mix-lacks")
    later = copies.filter(~served).join(state, F.col("m_source").eqNullSafe(F.col("e_source"))).filter(F.col("m_size") <= 2 * F.col("lacks"))
    counts = later.groupBy("e_source", "lacks", "m_size").agg(F.count(F.lit(1)).alias("n"))
    held = F.col("n") * F.col("m_size")
    upto = Window.partitionBy("e_source").orderBy("m_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    levels = counts.withColumn("below", F.sum(held).over(upto) - held).filter(F.col("below") + held > F.col("lacks") + _SAME)
    level = levels.groupBy("e_source").agg(F.min_by(F.struct("m_size", "below"), "m_size").alias("level")).withColumnRenamed("e_source", "l_source")
    level = state.join(level, F.col("e_source").eqNullSafe(F.col("l_source")), "left").drop("l_source")
    level = level.withColumn("m_least", F.col("level.m_size")).withColumn("k", F.floor((F.col("lacks") - F.col("level.below") + _SAME) / F.col("m_least")))
    level = level.withColumn("rest", F.col("lacks") - F.col("level.below") - F.col("k") * F.col("m_least"))
    # without a level all copies of up to twice the lack are sent
    level = stored(level.withColumn("m_small", F.coalesce("m_least", F.floor(2 * F.col("lacks")) + 1)).drop("level"), "mix-levels")

    cut = level.filter(F.col("m_least").isNotNull()).select(F.col("e_source").alias("c_source"), F.col("m_least").alias("c_size"), F.col("k").alias("c_k"))
    ties = copies.filter(~served).join(cut, F.col("m_source").eqNullSafe(F.col("c_source")) & (F.col("m_size") == F.col("c_size")))
    parts = ties.groupBy("c_source", "c_k", F.col("m_copy").alias("p_copy"), F.col("m_bucket").alias("p_bucket")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("c_source").orderBy("p_copy", "p_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.withColumn("first", F.sum("n").over(upto) - F.col("n")).filter((F.col("first") <= F.col("c_k")) & (F.col("first") + F.col("n") >= F.col("c_k")))
    parts = parts.select(F.col("c_source").alias("p_source"), "p_copy", "p_bucket", "first")
    near = ties.join(parts, F.col("c_source").eqNullSafe(F.col("p_source")) & (F.col("m_copy") == F.col("p_copy")) & (F.col("m_bucket") == F.col("p_bucket")))
    rank = F.col("first") + F.row_number().over(Window.partitionBy("p_source", "p_copy", "p_bucket").orderBy("m_finish"))
    found = near.withColumn("rank", rank).groupBy("p_source").agg(F.max(F.when(F.col("rank") == F.col("c_k"), F.col("m_finish"))).alias("m_until"), F.max(F.when(F.col("rank") == F.col("c_k") + 1, F.col("m_finish"))).alias("ends"))
    out = level.join(found, F.col("e_source").eqNullSafe(F.col("p_source")), "left").drop("p_source")
    nearer = F.when(2 * F.col("rest") >= F.col("m_least") - _SAME, F.col("m_least"))
    return stored(out.select("e_source", "m_small", "m_least", "m_until", nearer.alias("more"), "ends", (1 + (F.col("m_least") - F.col("rest")) / F.col("e_target")).alias("at")), "mix-passed")


def _truncated(copies: DataFrame, ends: DataFrame) -> DataFrame:
    """ends, with the copies that no longer fit into their targets as far as the budget, the sum of the targets, pays for them: all copies that
    queues want to send are range-sorted by finish time, and sizes are added up over the ranges, then within. Where that sum first exceeds
    the budget the mix ends; of the copies from there on, one of each source at most, each is taken that what is left still pays for, in the same order."""
    own = copies.join(ends, F.col("m_source").eqNullSafe(F.col("e_source"))).filter(_in_mix(F.lit(0)))
    wanted = own.select(F.least("m_finish", F.lit(1.0)).alias("at"), "m_size", F.lit(False).alias("last"), F.col("m_source").alias("t_source"), "m_order")
    wanted = wanted.unionByName(ends.filter("more IS NOT NULL").select("at", F.col("more").alias("m_size"), F.lit(True).alias("last"), F.col("e_source").alias("t_source"), F.lit(0).cast("long").alias("m_order")))
    order = ["at", "last", "t_source", "m_order"]
    ranged = stored(wanted.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "mix-sorted")
    sums = ranged.groupBy(F.col("range").alias("r_range")).agg(F.sum("m_size").alias("held"), F.max("last").alias("r_last"))
    sums = sums.withColumn("sent", F.coalesce(F.sum("held").over(Window.orderBy("r_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per range
    within = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # only ranges with copies behind the time 1 can reach the budget
    tail = ranged.join(sums.filter("r_last"), F.col("range") == F.col("r_range")).withColumn("upto", F.col("sent") + F.sum("m_size").over(within)).filter("last")
    budget = copies.groupBy("m_source").agg(F.max("m_target").alias("t")).agg(F.sum("t").alias("budget"))
    listed = tail.agg(F.array_sort(F.collect_list(F.struct("at", F.col("t_source").isNull().alias("none"), "t_source", "m_size", "upto"))).alias("all")).join(F.broadcast(budget))  # one row, and one of a row per source
    # what was passed over before a copy makes room for it
    start = F.struct(F.lit(0).cast("long").alias("over"), F.array().cast("array<struct<source:string>>").alias("paid"))
    step = lambda acc, x: F.when(x["upto"] - acc["over"] <= F.col("budget") + _SAME, F.struct(acc["over"].alias("over"), F.concat(acc["paid"], F.array(F.struct(x["t_source"].cast("string").alias("source")))).alias("paid"))).otherwise(F.struct((acc["over"] + x["m_size"]).alias("over"), acc["paid"].alias("paid")))
    paid = listed.select(F.explode(F.reduce("all", start, step)["paid"]).alias("s")).select(F.col("s.source").alias("p_source"), F.lit(True).alias("pays"))
    out = ends.join(paid, F.col("e_source").cast("string").eqNullSafe(F.col("p_source")), "left")
    return out.select("e_source", "m_small", "m_least", F.when(F.col("pays"), F.col("ends")).otherwise(F.col("m_until")).alias("m_until"))


def _in_mix(copy: int | Column) -> Column:
    """Whether the mix takes a copy (0, 1, ..) of a document: one that ends by the time 1, or that its queue sends in place of the one that
    crosses it."""
    finish = F.col("m_finish") + copy * F.col("m_cycle")
    return F.coalesce((finish <= 1 + _SAME) | (F.col("m_size") < F.col("m_small")) | (F.col("m_size") == F.col("m_least")) & (finish <= F.col("m_until") + _SAME / 1000), F.lit(False))


#: Times nearer to each other than this are the same.
_SAME = 1e-9
_NAMES = {"key": "doc_id", "text": "text", "source": "source"}


def mix_report(docs: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), share: float = 1.5, repeats: int = 2, seed: int = 17, names: dict[str, str] = {}, bucket_rows: int = 20_000) -> DataFrame:
    """Per row of docs: key, size, source_size, target, taken (words that mix_sources() takes of it, over all copies)."""
    key = (_NAMES | names)["key"]
    rows = _queues(docs, [key], weights, share, repeats, seed, _NAMES | names, bucket_rows)
    copies = sum((_in_mix(e).cast("long") for e in range(repeats)), F.lit(0))
    return rows.select(F.col("row")[key].alias(key), F.col("m_size").alias("size"), F.col("m_source_size").alias("source_size"), F.col("m_target").alias("target"), (F.col("m_size") * copies).alias("taken"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), share: float = 1.5, repeats: int = 2, seed: int = 17, names: dict[str, str] = {}, bucket_rows: int = 20_000) -> DataFrame:
    """The mix itself: one row of docs for each time that the mix takes it, with `mix_finish` and `mix_copy` (0, 1, ..)
    added, range-sorted by finish time. Columns of docs with these names are replaced; other names are free.

    Each source is a queue of its documents in a seeded shuffled order, which starts again up to `repeats` times. A
    copy's virtual finish time is the words that its queue has sent up to its end, divided by the queue's target
    (source_targets()); all queues are merged by finish time. A queue passes over the copy that would cross its target, and goes on with smaller
    ones that fit (_passed_over()); the mix ends where the budget, the sum of the targets, is spent (_truncated()). Null texts and texts without words have size 0; null is a source of its own, the last; equal rows count
    each, and rows of one key and different texts keep their places by the texts' hashes; an empty table gives no rows; reruns on the same rows give the same mix."""
    names = _NAMES | names
    rows = _queues(docs, docs.columns, weights, share, repeats, seed, names, bucket_rows)
    rows = rows.withColumn("m_copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).filter(_in_mix(F.col("m_copy")))
    rows = rows.withColumn("m_finish", F.col("m_finish") + F.col("m_copy") * F.col("m_cycle"))
    rows = rows.repartitionByRange("m_finish", "m_order").sortWithinPartitions("m_finish", "m_order")
    return unpacked(rows, F.col("m_finish").alias("mix_finish"), F.col("m_copy").alias("mix_copy"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: size, source_size, target, and the words that the mix takes of it. Weights 5, 2, 1; 150 % of all words; at
    most twice."""
    return mix_report(table(spark, sf_dir, "documents"))
