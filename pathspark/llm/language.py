"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams, trained with FTRL."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ._common import packed, pieces, table, unpacked
from .quality import remainder

BITS = 13
ORDERS = (1, 2, 3)
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def gram_counts(texts: pa.Array, bits: int = BITS) -> np.ndarray:
    """array[texts, 2**bits]: how often each hashed character n-gram (1 to 3 code points, within the lower-cased text) occurs."""
    raw = pc.fill_null(texts, "")
    sizes = pc.utf8_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
    low = pc.utf8_lower(raw)
    if (pc.utf8_length(low).to_numpy(zero_copy_only=False) != sizes).any():
        sizes = pc.utf8_length(low).to_numpy(zero_copy_only=False).astype(np.int64)
    chars = np.frombuffer("".join(low.to_pylist()).encode("utf-32-le"), np.uint32)
    docs = len(sizes)
    row = np.repeat(np.arange(docs, dtype=np.int64) << bits, sizes)
    cells, total = [], np.zeros(len(chars), np.uint64)
    for n, odd in zip(ORDERS, MULTIPLIERS):  # a multiply-shift hash of the n code points from each position on
        total = total[: len(chars) - n + 1] + chars[n - 1 :] * np.uint64(odd)
        inside = row[: len(total)] == row[n - 1 :]
        cells.append(((total >> np.uint64(64 - bits)).astype(np.int64) + row[: len(total)])[inside])
        if len(chars) <= n:
            break
    return np.bincount(np.concatenate(cells), minlength=docs << bits).astype(np.float32).reshape(docs, 1 << bits)


def _small(batch: pa.RecordBatch, column: str):
    """Pieces of few rows too: a row of counts takes 2**BITS numbers."""
    for part in pieces(batch, column, 1 << 20):
        for at in range(0, part.num_rows, 128):
            yield part.slice(at, 128)


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def vectors(self, texts: pa.Array) -> np.ndarray:
        x = np.log1p(gram_counts(texts)) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.weights + self.bias) / self.temperature


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def ftrl(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dims: int, classes: int, passes: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """Follow-the-regularised-leader with per-coordinate rates: weights[dims, classes] and bias. x: (indices, values) of each row.
    l1 keeps a weight at exactly 0 until its gradient sums outweigh it, l2 shrinks what is left. The bias is not penalised."""
    z, n = np.zeros((dims + 1, classes)), np.zeros((dims + 1, classes))
    l1s = np.full((dims + 1, 1), l1)
    l1s[dims] = 0

    def weights(i):
        return np.where(np.abs(z[i]) <= l1s[i], 0, -(z[i] - np.sign(z[i]) * l1s[i]) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(passes):
        for (i, v), label in zip(x, y):
            i, v = np.r_[i, dims], np.r_[v, 1.0]
            w = weights(i)
            g = softmax((v @ w)[None])[0]
            g[label] -= 1
            g = v[:, None] * g
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    w = weights(np.arange(dims + 1))
    return w[:dims], w[dims]


def train(docs: DataFrame, text: str, lang: str, order_by: str, sample: int = 4000, passes: int = 2, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.001) -> LanguageModel | None:
    """Document frequencies come from all rows of docs with a language. The weights are fitted on a bounded sample of whole texts: of
    each language the sample / languages rows with the smallest hash of order_by (ties by the text's hash). One pass over the hashes
    finds how far each language's sample goes; of a sampled text the driver gets its n-gram counts, 2**BITS numbers at most
    however long it is. A fifth of the sample sets the temperature alone. No row with a language: None."""
    known = docs.filter(F.col(lang).isNotNull()).select(F.col(text).alias("_text"), F.col(lang).alias("lang"), F.xxhash64(order_by, F.lit(5)).alias("place"))

    def frequencies(batches):
        total, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for part in _small(batch, "_text"):
                total += (gram_counts(part.column("_text")) > 0).sum(0)
                n += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total) + 1, dtype=np.int32)), pa.array(np.r_[total, n])], ["i", "n"])

    df = np.zeros((1 << BITS) + 1)
    for row in known.select("_text").mapInArrow(frequencies, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        df[row["i"]] = row["n"]
    if not df[-1]:
        return None
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1).astype(np.float32)
    languages = sorted(r[0] for r in known.select("lang").distinct().collect())
    share = max(1, sample // len(languages))
    by = Window.partitionBy("lang").orderBy("place")
    # each task keeps the first places of a language before any is shuffled
    last = known.select("lang", "place").withColumn("r", F.row_number().over(by)).filter(F.col("r") <= share).groupBy("lang").agg(F.max("place")).collect()
    upto = F.coalesce(*(F.when(F.col("lang") == one, F.lit(place)) for one, place in last))

    def sampled(batches):
        for batch in batches:
            for part in _small(batch, "_text"):
                counts = gram_counts(part.column("_text"))
                cells = [np.flatnonzero(c) for c in counts]
                packed_cells = pa.array([i.astype("<u2").tobytes() for i in cells], pa.binary())
                packed_counts = pa.array([c[i].astype("<f4").tobytes() for c, i in zip(counts, cells)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("place"), part.column("tie"), packed_cells, packed_counts], ["lang", "place", "tie", "cells", "counts"])

    got = known.filter(F.col("place") <= upto).withColumn("tie", F.xxhash64("_text")).mapInArrow(sampled, "lang string, place long, tie long, cells binary, counts binary")
    got = got.withColumn("r", F.row_number().over(by.orderBy("place", "tie"))).filter(F.col("r") <= share).drop("r")
    rows = sorted(got.collect(), key=lambda r: (r["lang"], r["place"], r["tie"]))
    order = np.random.default_rng(3).permutation(len(rows))
    rows = [rows[i] for i in order]
    model = LanguageModel(languages, idf, np.zeros((1 << BITS, len(languages)), np.float32), np.zeros(len(languages), np.float32), 1.0)
    x, y = [], np.array([languages.index(r["lang"]) for r in rows])
    for r in rows:
        i = np.frombuffer(r["cells"], "<u2").astype(np.int64)
        v = np.log1p(np.frombuffer(r["counts"], "<f4")) * idf[i]
        x.append((i, (v / max(np.linalg.norm(v), 1e-12)).astype(float)))
    cut = max(1, len(x) * 4 // 5)
    w, b = ftrl(x[:cut], y[:cut], 1 << BITS, len(languages), passes, alpha, beta, l1, l2)
    model.weights, model.bias = w.astype(np.float32), b.astype(np.float32)
    held, labels = x[cut:] or x, y[cut:] if len(x) > cut else y
    z = np.stack([v @ w[i] + b for i, v in held])
    grid = np.geomspace(0.05, 20, 60)
    loss = [-(np.log(np.maximum(softmax(z / t)[np.arange(len(z)), labels], 1e-12))).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    return model


def identify(docs: DataFrame, keep: list[str], model: LanguageModel | None, text: str = "text") -> DataFrame:
    """docs' columns `keep`, lang_pred and score (its calibrated probability). `und` with score 0 where the text is null, has no
    letter, or nothing was learned. Columns of docs with these two names are replaced; other names are free."""
    slim = packed(docs, keep, _text=F.col(text))

    def run(batches):
        for whole in batches:
            for part in _small(whole, "_text"):
                texts = part.column("_text")
                # \p{L} as the regex engine of Arrow knows it
                letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                p = softmax(model.logits(model.vectors(texts))) if model else np.zeros((len(texts), 1))
                best, score = p.argmax(1), p.max(1).astype(float)
                pred = [model.languages[b] if ok and model else "und" for b, ok in zip(best, letters)]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(pred, pa.string()), pa.array(np.where(letters, score, 0.0))], ["row", "lang_pred", "score"])

    return unpacked(slim.mapInArrow(run, StructType([slim.schema["row"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])), "lang_pred", "score")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: held_out, lang_pred, score. Learns from the documents whose crc32(doc_id as text) mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)))
    model = train(docs.filter(~F.col("held_out") & F.col("doc_id").isNotNull()), "text", "lang", "doc_id")
    return identify(docs, ["doc_id", "held_out"], model)
