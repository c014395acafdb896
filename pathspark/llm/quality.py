"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import as_array, gram_hashes, packed, pieces, stored, table, unpacked, word_hashes, words_of

STATISTICS = (
    "log words", "log mean word length", "spread of word lengths", "distinct words", "upper case", "digits", "stops", "exclamations", "other marks", "line breaks",
    "repeated lines", "repeated word triples", "byte entropy", "most frequent word", "words without a letter", "outside ASCII",
)
#: Byte classes: 0 other, 1 lower, 2 upper, 3 digit, 4 stop, 5 exclamation, 6 other mark, 7 newline, 8 outside ASCII
_CLASS = np.zeros(256, np.uint8)
for _k, _chars in ((1, b"abcdefghijklmnopqrstuvwxyz"), (2, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (3, b"0123456789"), (4, b".,;:'\"-()"), (5, b"!?"), (6, b"#$%&*+/<=>@[\\]^_`{|}~"), (7, b"\n")):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 8


def _repeats(owner: np.ndarray, values: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document: how many values, how many distinct ones, and the count of its most frequent one."""
    keys = np.sort((owner.astype(np.uint64) << np.uint64(44)) | (values >> np.uint64(20)))  # a slice has far fewer than 2**20 texts
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    o = (keys >> np.uint64(44)).astype(np.int64)
    top = np.zeros(docs, np.int64)
    np.maximum.at(top, o[first], np.diff(np.r_[first, len(o)]))
    return np.bincount(owner, minlength=docs), np.bincount(o[first], minlength=docs), top


def statistics(texts: pa.Array) -> np.ndarray:
    """array[texts, statistics] of transformed statistics of the whole texts; shares go through a square root, counts through a
    logarithm. A null text counts as an empty one, whose statistics are 0."""
    texts = as_array(pc.fill_null(texts, "")).cast(pa.large_string())
    docs = len(texts)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + docs + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    sizes = np.diff(at)
    owner = np.repeat(np.arange(docs), sizes)
    hist = np.bincount(owner * 256 + data, minlength=docs * 256).reshape(docs, 256)
    kinds = np.zeros((docs, 9))
    for k in range(9):
        kinds[:, k] = hist[:, _CLASS == k].sum(1)
    some = np.maximum(sizes, 1)
    wide = sizes + 60  # shares of short texts are drawn to 0, as a few marks say little there
    with np.errstate(divide="ignore", invalid="ignore"):
        p = hist / some[:, None]
        entropy = -np.where(p > 0, p * np.log2(p), 0).sum(1)
    flat, n = words_of(texts)
    lengths = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(float)
    who = np.repeat(np.arange(docs), n)
    m = np.maximum(n, 1)
    mean = np.bincount(who, lengths, docs) / m
    spread = np.sqrt(np.maximum(np.bincount(who, lengths**2, docs) / m - mean**2, 0))
    hashes = word_hashes(flat)
    _, distinct, top = _repeats(who, hashes, docs)
    no_letter = np.bincount(who, pc.match_substring_regex(flat, r"^[\x00-\x40\x5B-\x60\x7B-\x7F]*$").to_numpy(zero_copy_only=False).astype(float), docs) / (n + 10)
    grams = gram_hashes(hashes, 3)
    inside = who[: len(grams)] == who[2 : 2 + len(grams)]
    total3, distinct3, _ = _repeats(who[: len(grams)][inside], grams[inside], docs)
    lines = pc.split_pattern(texts, "\n")
    line_owner = np.repeat(np.arange(docs), pc.list_value_length(lines).to_numpy(zero_copy_only=False))
    flat_lines = lines.flatten()
    full = pc.greater(pc.binary_length(flat_lines), 0).to_numpy(zero_copy_only=False)
    total_l, distinct_l, _ = _repeats(line_owner[full], word_hashes(flat_lines.filter(pa.array(full))), docs)
    letters = np.maximum(kinds[:, 1] + kinds[:, 2] + kinds[:, 8], 1)
    return np.column_stack(
        [
            np.log1p(n), np.log1p(mean), np.log1p(spread), distinct / m, np.sqrt(kinds[:, 2] / (letters + 60)), np.sqrt(kinds[:, 3] / wide), np.sqrt(kinds[:, 4] / wide), np.sqrt(kinds[:, 5] / wide), np.sqrt(kinds[:, 6] / wide),
            np.sqrt(kinds[:, 7] / wide), np.sqrt((total_l - distinct_l) / (total_l + 3)), np.sqrt((total3 - distinct3) / (total3 + 20)), entropy, np.sqrt(top / (n + 10)), np.sqrt(no_letter), np.sqrt(kinds[:, 8] / wide),
        ]
    )


def document_statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """docs' columns `keep` and `stats` (array<float> in the order of STATISTICS)."""
    from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

    schema = StructType([docs.schema[c] for c in keep] + [StructField("stats", ArrayType(FloatType()))])
    slim = docs.select(*(F.col(c) for c in keep), F.col(text).alias("_text"))

    def run(batches):
        for whole in batches:
            for batch in pieces(whole, "_text"):
                x = statistics(batch.column("_text")).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [lists], [*keep, "stats"])

    return slim.mapInArrow(run, schema)


@dataclass
class Discriminant:
    """Two Gaussians. `factors` are the Cholesky factors of the shrunken covariances, made once and kept with the model."""

    means: np.ndarray
    factors: np.ndarray
    log_norms: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    temperature: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        logs = []
        for mean, factor, norm in zip(self.means, self.factors, self.log_norms):
            y = np.linalg.solve(factor, (z - mean).T)
            logs.append(norm - 0.5 * (y**2).sum(0))
        return 1 / (1 + np.exp(-np.clip((logs[1] - logs[0]) / self.temperature, -40, 40)))


def fit(stats: DataFrame, label: str, shrink: float = 0.1, ridge: float = 0.02, temperature: float = 4.0) -> Discriminant:
    """Fits on all rows with label 0 or 1. Counts, sums and products of the standardised statistics are added up per partition and
    then over all of them; the driver gets these alone, some 2 x 16 x 16 numbers. Each class covariance is drawn by `shrink`
    to the pooled one and by `ridge` to its own mean variance, and a least variance is added: one row of a class is enough. `temperature` divides the log-density difference, as the
    statistics are no true Gaussians. Without rows of both classes every score is the share of label 1."""
    k = len(STATISTICS)
    rows = stats.filter(F.col(label).isin(0, 1)).select(F.col(label).cast("int").alias("c"), "stats")
    one = rows.agg(F.count(F.lit(1)), *(f(F.col("stats")[i]) for f in (F.avg, F.stddev_pop) for i in range(k))).first()
    if not one[0]:
        return Discriminant(np.zeros((2, k)), np.stack([np.eye(k)] * 2), np.zeros(2), np.zeros(k), np.ones(k), 1.0)
    centre, scale = np.round(one[1 : k + 1], 6), np.maximum(np.round(one[k + 1 :], 6), 1e-3)

    def moments(batches):
        total = np.zeros((2, 1 + k + k * k), np.int64)
        for batch in batches:
            c = batch.column("c").to_numpy()
            z = np.rint(1024 * np.clip((batch.column("stats").flatten().to_numpy().reshape(len(c), k).astype(float) - centre) / scale, -8, 8)).astype(np.int64)
            for label in (0, 1):
                own = z[c == label]
                total[label] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], total.shape[1]).astype(np.int32)), pa.array(np.tile(np.arange(total.shape[1]), 2).astype(np.int32)), pa.array(total.ravel())], ["c", "i", "v"])

    sums = np.zeros((2, 1 + k + k * k), object)
    # whole numbers of 1024ths add up to the same sums in any order, so reruns give the same model, and covariances are exact
    for row in rows.mapInArrow(moments, "c int, i int, v long").groupBy("c", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
        sums[row["c"], row["i"]] = int(row["v"])
    n = sums[:, 0].astype(float)
    if not n.all():
        flat = Discriminant(np.zeros((2, k)), np.stack([np.eye(k)] * 2), np.zeros(2), centre, scale, 1.0)
        flat.log_norms[1] = 40.0 if n[1] else -40.0
        return flat
    means = (sums[:, 1 : k + 1] / sums[:, :1] / 1024).astype(float)
    own = np.stack([((sums[c, 0] * sums[c, k + 1 :].reshape(k, k) - np.outer(sums[c, 1 : k + 1], sums[c, 1 : k + 1])) / sums[c, 0] ** 2 / 1024**2).astype(float) for c in (0, 1)])
    pooled = (own * n[:, None, None]).sum(0) / n.sum()
    factors, norms = [], []
    for c in (0, 1):
        cov = (1 - shrink) * own[c] + shrink * pooled
        cov = (1 - ridge) * cov + ridge * np.trace(cov) / k * np.eye(k) + 1e-4 * np.eye(k)
        factors.append(np.linalg.cholesky(cov))
        norms.append(np.log(n[c] / n.sum()) - np.log(np.diag(factors[-1])).sum())
    return Discriminant(means, np.stack(factors), np.array(norms), centre, scale, temperature)


def remainder(key: str, of: int):
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(of))


def score_quality(docs: DataFrame, labels: DataFrame, keep: list[str], key: str = "doc_id", text: str = "text", label: str = "quality", train_mod: int = 5) -> DataFrame:
    """docs' columns `keep` (with key), held_out and score, the probability that the label is 1. Learns from the labelled
    documents whose crc32(key as text) mod train_mod is not 0; a document with a null key teaches nothing, labels other than 0 and
    1 are ignored, several labels of a document each count. Scores are of whole texts alone. Null and empty texts are scored
    by their statistics, all 0. Repeated rows are scored each; an empty table gives no rows. Columns of docs named held_out or score
    are replaced; other names are free."""
    stats = stored(document_statistics(packed(docs, keep, k=F.col(key), text=F.col(text)), ["row", "k"]), "quality-stats")
    marks = labels.select(F.col(key).alias("_key"), F.col(label).alias("_label")).filter(remainder("_key", train_mod) != 0)
    model = fit(stats.select("k", "stats").join(marks, F.col("k") == F.col("_key")), "_label")

    from pyspark.sql.types import DoubleType, StructField, StructType

    rows = stats.withColumn("held_out", F.coalesce(remainder("k", train_mod) == 0, F.lit(False)))
    names = [c for c in rows.columns if c != "stats"]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column("stats").flatten().to_numpy().reshape(batch.num_rows, -1).astype(float)
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(model.score(x))], [*names, "score"])

    return unpacked(rows.mapInArrow(run, StructType([rows.schema[c] for c in names] + [StructField("score", DoubleType())])), "held_out", "score")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: held_out, score, predicted (score >= 0.3)."""
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def crc_remainder(doc_id: int, of: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % of
