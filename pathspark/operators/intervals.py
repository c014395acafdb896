"""Join of windows and instants by buckets of time: an equi-join, whatever the windows.

Windows are of very different length, from a day to decades, and many are open. So buckets come in levels, each FINER times as wide as the one
below, and a window takes the level on which it covers FINER + 1 buckets at most. An instant has one bucket on each level that some
window uses: it meets a window once at most, and only if they are near each other. A key with very many instants (a patient with a third of
all events) is split by time. A key of FEW instants at most isn't: its windows meet them all, and are no rows of buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import cut

FINER = 64
#: The most instants of a key that meet its windows by the key alone.
FEW = 512
#: Seconds of a bucket, by level: up to some 2,000 years.
WIDTHS = tuple(FINER**k for k in range(7))


def clamped(windows: DataFrame, instants: DataFrame, lo: str, hi: str, t: str) -> tuple[DataFrame, DataFrame]:
    """Windows without those that hold no instant at all, closed by the first and last of instants, and instants without those before the
    first window or behind the last one. Both bounds are literals, so the second reaches the scan. Two aggregates, one of each side."""
    first, last = instants.agg(F.min(t), F.max(t)).first()
    if first is None:
        return windows.limit(0).withColumns({"_lo": F.lit(None).cast("timestamp"), "_hi": F.lit(None).cast("timestamp")}), instants.limit(0)
    inside = windows.withColumn("_lo", F.greatest(F.col(lo), F.lit(first))).withColumn("_hi", F.least(F.col(hi), F.lit(last))).filter(F.col("_lo") <= F.col("_hi"))
    least, most = inside.agg(F.min("_lo"), F.max("_hi")).first()
    if least is None:
        return inside, instants.limit(0)
    return inside, instants.filter((F.col(t) >= F.lit(least)) & (F.col(t) <= F.lit(most)))


def _level(lo: Column, hi: Column) -> Column:
    seconds = F.unix_seconds(hi) - F.unix_seconds(lo)
    out = F.lit(len(WIDTHS) - 1)
    for k in range(len(WIDTHS) - 2, -1, -1):
        out = F.when(seconds <= FINER * WIDTHS[k], F.lit(k)).otherwise(out)
    return out


def _bucket(t: Column, level: Column) -> Column:
    return F.floor(F.unix_seconds(t) / F.element_at(F.array(*map(F.lit, WIDTHS)), level + 1)).cast("long")


def interval_join(windows: DataFrame, instants: DataFrame, key: tuple[str, str], lo: str, hi: str, t: str) -> DataFrame:
    """The pairs of a window and an instant t of one key (named in windows and in instants) with lo <= t <= hi; a null bound is open. All columns
    of both, whose names have to differ. Rows with a null key or instant are in no pair."""
    some, near = clamped(windows, instants, lo, hi, t)
    inside = (F.col(lo).isNull() | (F.col(t) >= F.col(lo))) & (F.col(hi).isNull() | (F.col(t) <= F.col(hi)))
    same = F.col(key[0]) == F.col(key[1])
    many = cut(near.groupBy(F.col(key[1]).alias("_many")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > FEW).select("_many"))
    if many.isEmpty():  # the key is the only bucket
        return some.drop("_lo", "_hi").withColumn("_bucket", F.col(key[0])).join(near, F.col("_bucket") == F.col(key[1])).filter(inside).drop("_bucket")
    split = F.col("_many").isNotNull()
    some = some.join(many, F.col(key[0]) == F.col("_many"), "left").withColumn("_level", F.when(split, _level(F.col("_lo"), F.col("_hi"))).otherwise(-1))
    near = near.join(many, F.col(key[1]) == F.col("_many"), "left")
    levels = sorted(r[0] for r in some.filter(split).select("_level").distinct().collect())  # one for each level in use
    span = F.sequence(_bucket(F.col("_lo"), F.col("_level")), _bucket(F.col("_hi"), F.col("_level")))
    some = some.withColumn("_bucket", F.explode(F.when(split, span).otherwise(F.array(F.lit(0).cast("long"))))).drop("_lo", "_hi", "_many")
    level = F.explode(F.when(split, F.array(*map(F.lit, levels)).cast("array<int>")).otherwise(F.array(F.lit(-1))))
    near = near.withColumn("_l", level).withColumn("_b", F.when(split, _bucket(F.col(t), F.col("_l"))).otherwise(0)).drop("_many")
    on = same & (F.col("_level") == F.col("_l")) & (F.col("_bucket") == F.col("_b"))
    return some.join(near, on).filter(inside).drop("_level", "_bucket", "_l", "_b")
