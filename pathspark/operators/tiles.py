"""Pairs of near texts within groups, without all pairs of them being measured: texts of like length meet in tiles of bounded size, what
their 4-grams have in common rules nearly all pairs out, by matrix products, and only the rest have their edit distance taken."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

#: Characters of a gram, bits of a signature, texts of a tile.
GRAM, BITS, TILE = 4, 4096, 512


@F.arrow_udf(BinaryType())
def signature(texts: pa.Array) -> pa.Array:
    """A bit for each gram and each time that it occurs, by hash. An edit makes or unmakes GRAM of these at most, so of two texts k edits
    apart each has GRAM * k bits at most that the other has not."""
    out = []
    for text in texts.to_pylist():
        bits, seen = np.zeros(BITS, bool), Counter()
        for i in range(len(text) - GRAM + 1):
            gram = text[i : i + GRAM]
            seen[gram] += 1
            bits[zlib.crc32(f"{seen[gram]} {gram}".encode("utf-8", "surrogatepass")) % BITS] = True
        out.append(np.packbits(bits).tobytes())
    return pa.array(out, pa.binary())


def band(length: Column, edit: int, normalised: float) -> Column:
    """A number that differs by 1 at most between near texts: lengths in steps of what makes texts different."""
    turn = edit * (1 - normalised) / normalised
    steps = F.when(length < turn, length / edit).otherwise(turn / edit + F.log(F.greatest(length, F.lit(1.0)) / turn) / -math.log(1 - normalised))
    return F.floor(steps / 1.05).cast("int")  # where both kinds of step meet, near texts are 1.02 apart


def _tiles(df: DataFrame, p: str) -> tuple[DataFrame, DataFrame]:
    """df with the tile of each row, and the number of tiles by group and band."""
    n = df.groupBy(F.col("g").alias(f"{p}g"), F.col("band").alias(f"{p}band")).agg(F.ceil(F.count(F.lit(1)) / TILE).alias(f"{p}n"))
    rows = df.join(n, (F.col("g") == F.col(f"{p}g")) & (F.col("band") == F.col(f"{p}band"))).withColumn(f"{p}tile", F.pmod(F.xxhash64("id"), F.col(f"{p}n")).cast("int"))
    return rows.drop(f"{p}n"), n


def near_pairs(x: DataFrame, y: DataFrame, different, edit: int, normalised: float, ordered: bool) -> DataFrame:
    """(a, b): the ids of near texts of x and y, of one group; x and y have id, g, t, band and sig. ordered: only those whose a is below b,
    for which x and y are the same rows."""
    xs, xn = _tiles(x, "x")
    ys, yn = _tiles(y, "y")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    meet = xn.join(yn, (F.col("xg") == F.col("yg")) & (F.abs(F.col("xband") - F.col("yband")) <= 1)).withColumn("xtile", numbers("xn")).withColumn("ytile", numbers("yn"))
    if ordered:
        meet = meet.filter(F.struct("xband", "xtile") <= F.struct("yband", "ytile"))
    meet = meet.select("xg", "xband", "xtile", "yband", "ytile")
    key = ["xg", "xband", "xtile", "yband", "ytile"]
    left = xs.join(meet, ["xg", "xband", "xtile"]).select(*key, F.lit(0).alias("side"), "id", "t", "sig")
    right = ys.join(meet.withColumnRenamed("xg", "yg"), ["yg", "yband", "ytile"]).withColumnRenamed("yg", "xg").select(*key, F.lit(1).alias("side"), "id", "t", "sig")

    def likely(rows: pd.DataFrame) -> pd.DataFrame:
        one, other = rows[rows.side == 0], rows[rows.side == 1]
        bits = lambda r: np.unpackbits(np.frombuffer(b"".join(r.sig), np.uint8).reshape(len(r), -1), axis=1).astype(np.float32)
        p, q = bits(one), bits(other)
        n, m = one.t.str.len().to_numpy(), other.t.str.len().to_numpy()
        most = np.maximum(edit, np.ceil(normalised * np.maximum.outer(n, m)))
        ok = (np.maximum.outer(p.sum(1), q.sum(1)) - p @ q.T <= GRAM * most) & (np.abs(np.subtract.outer(n, m)) <= most)
        if ordered:
            ok &= np.less.outer(one.id.to_numpy(), other.id.to_numpy()) | ((one.xband != one.yband).any() | (one.xtile != one.ytile).any())
        i, j = ok.nonzero()
        return pd.DataFrame({"a": one.id.to_numpy()[i], "b": other.id.to_numpy()[j], "ta": one.t.to_numpy()[i], "tb": other.t.to_numpy()[j]})

    found = left.unionByName(right).groupBy(*key).applyInPandas(likely, "a long, b long, ta string, tb string").filter(~different(F.col("ta"), F.col("tb")))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")) if ordered else found.select("a", "b")
