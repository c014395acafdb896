"""Drawing without replacement until all is used: every text goes to one patient that can answer it.

Texts and patients are numbered in the order of a hash. Text number i of m begins at patient i * p / m of p, so that beginnings are spread
evenly, and tries patients in their order from there, round the circle. It goes to the first that has an answer: the assignment depends on
the texts, the patients and the seed alone, not on how many attempts a round makes, nor on where an earlier run was cut off.

A round tries several patients for each text that is left: FIRST in the first round, FANOUT times as many in each round after it, and never
more than the limit of attempts per patient has room for. Most texts are placed by few attempts, and few that are hard to place try many patients
at once: the attempts follow the texts rather than the patients, and the number of rounds grows with the logarithm of the work. There is one
equi-join of attempts and patients by number, and no product of the two sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import store
from .curation import numbered

#: The most patients that one text tries in one round; how many it tries in the first, and how many times as many in each later one.
WIDEST = 1 << 16
FIRST, FANOUT = 4, 4


def _hashed(df: DataFrame, seed: int, *keys: str) -> DataFrame:
    return df.withColumn("_h", F.md5(F.concat_ws("/", F.lit(str(seed)), *keys)))


def begin(texts: DataFrame, patients: DataFrame, path: str, seed: int = 42) -> None:
    """Writes the numbered patients (patient_id, place) and texts (number, home and the texts' columns) of a run, unless they are there.
    Repeated texts and patients count once; rows with a null in them are left out."""
    spark = texts.sparkSession
    if not store.exists(spark, f"{path}/patients/_SUCCESS"):
        own = patients.select("patient_id").dropna().distinct()
        numbered(_hashed(own, seed, "patient_id"), "_h", "patient_id", name="place").drop("_h").write.mode("overwrite").parquet(f"{path}/patients")
    if not store.exists(spark, f"{path}/texts/_SUCCESS"):
        keys, p = texts.columns, spark.read.parquet(f"{path}/patients").count()
        rows = numbered(_hashed(texts.dropna().distinct(), seed, *keys), "_h", *keys, name="number").drop("_h")
        m = F.lit(max(rows.count(), 1))
        rows.withColumn("home", F.floor(F.col("number") * p / m).cast("long")).write.mode("overwrite").parquet(f"{path}/texts")


def attempts_of(left: DataFrame, patients: DataFrame, p: int, attempts: int, n: int) -> DataFrame:
    """The attempts of round n: left's columns, patient_id and j, the how-many-eth patient of its text. A patient has `attempts` of them at
    most, those that are nearest to their text's next one first; a text has none beyond one that found no room, so that none is skipped."""
    m = left.count()
    fan = max(1, min(attempts * p // max(m, 1), p, WIDEST, FIRST * FANOUT ** min(n, 20)))
    upto = F.least(F.col("next") + fan, F.lit(p)) - 1
    block = F.sequence(F.col("next"), upto, F.lit(1024))
    rows = left.withColumn("_b", F.explode(block)).withColumn("_to", upto).repartition("number", "_b")
    rows = rows.withColumn("j", F.explode(F.sequence(F.col("_b"), F.least(F.col("_b") + 1023, F.col("_to"))))).drop("_b", "_to")
    rows = rows.withColumn("_place", F.pmod(F.col("home") + F.col("j"), F.lit(p))).join(patients, F.col("_place") == F.col("place")).drop("_place", "place")
    turn = F.row_number().over(Window.partitionBy("patient_id").orderBy(F.col("j") - F.col("next"), "number"))
    rows = store.cut(rows.withColumn("_turn", turn))
    full = rows.filter(F.col("_turn") > attempts).groupBy(F.col("number").alias("_n")).agg(F.min("j").alias("_gap"))
    rows = rows.join(full, F.col("number") == F.col("_n"), "left")
    return rows.filter((F.col("_turn") <= attempts) & (F.col("_gap").isNull() | (F.col("j") < F.col("_gap")))).drop("_turn", "_n", "_gap")


def sweep(path: str, spark: SparkSession, answer: Callable[[DataFrame, int], DataFrame], attempts: int = 20, passes: int = 1, rounds: int | None = None) -> int:
    """Rounds over what begin() has written, until no text is left, or `rounds` are over; returns how many texts are left. answer(asked,
    round) gets the texts' columns with number, j, pass and patient_id, and returns number, j and what else is to be kept of those that
    were answered. A text that no patient answers is tried again, `passes` times in all, and then given up.

    Each round writes path/records/round=n (what it accepted) and then path/left/cycle=n (what is left); a round counts when the latter
    is whole, and another call goes on behind the last one that does."""
    patients, texts = spark.read.parquet(f"{path}/patients"), spark.read.parquet(f"{path}/texts")
    p = patients.count()
    done = store.whole(spark, f"{path}/left", "cycle")
    n = done[-1] + 1 if done else 0
    left = spark.read.parquet(f"{path}/left/cycle={done[-1]}") if done else texts.withColumn("next", F.lit(0).cast("long")).withColumn("pass", F.lit(0))
    while left.count() and p and (rounds is None or n < rounds):
        rows = attempts_of(left, patients, p, attempts, n)
        rows.write.mode("overwrite").partitionBy(*(c for c in ("template_id",) if c in left.columns)).parquet(f"{path}/asked/round={n}")
        asked = spark.read.schema(rows.schema).parquet(f"{path}/asked/round={n}")
        got = answer(asked, n)
        rest = [c for c in got.columns if c != "number"]
        first = got.groupBy("number").agg(F.min_by(F.struct(*rest), "j").alias("_r")).select("number", *(F.col(f"_r.{c}").alias(c) for c in rest))
        first.write.mode("overwrite").parquet(f"{path}/records/round={n}")
        accepted = spark.read.parquet(f"{path}/records/round={n}").select("number")
        tried = asked.groupBy(F.col("number").alias("_n")).agg(F.max("j").alias("_j"))
        on = left.join(accepted, "number", "left_anti").join(tried, F.col("number") == F.col("_n"), "left").drop("_n")
        on = on.withColumn("next", F.coalesce(F.col("_j") + 1, F.col("next"))).drop("_j")
        over = F.col("next") >= p
        on = on.withColumn("pass", F.col("pass") + over.cast("int")).withColumn("next", F.when(over, 0).otherwise(F.col("next"))).filter(F.col("pass") < passes)
        on.write.mode("overwrite").parquet(f"{path}/left/cycle={n}")
        left = spark.read.parquet(f"{path}/left/cycle={n}")
        n += 1
    return left.count()


def records(path: str, spark: SparkSession, quota: int = 10) -> DataFrame:
    """What the whole rounds have accepted: the texts' columns, number, patient_id, what answer() kept, and cycle: in one cycle a patient
    answers `quota` texts at most, in the order of their numbers."""
    done = store.whole(spark, f"{path}/left", "cycle")
    if not done:
        raise ValueError(f"no round of {path} is whole")
    got = spark.read.parquet(*(f"{path}/records/round={n}" for n in done)).drop("j")
    placed = numbered(got, "patient_id", "number", name="_i")
    first = placed.groupBy(F.col("patient_id").alias("_p")).agg(F.min("_i").alias("_first"))
    return placed.join(first, F.col("patient_id") == F.col("_p")).withColumn("cycle", F.floor((F.col("_i") - F.col("_first")) / quota) + 1).drop("_i", "_p", "_first")


def unused(path: str, spark: SparkSession) -> DataFrame:
    """The texts without a record so far: given up, or left by a limit of rounds."""
    texts = spark.read.parquet(f"{path}/texts").drop("home")
    done = store.whole(spark, f"{path}/left", "cycle")
    return texts.join(spark.read.parquet(*(f"{path}/records/round={n}" for n in done)).select("number"), "number", "left_anti") if done else texts
