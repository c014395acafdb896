"""Vector code compression: vectors are cut into parts, each part becomes the number of its nearest codebook entry.

Codebooks are refined in rounds over the whole table. Each round sends one kd-tree per codebook to the tasks (parts x entries vectors:
its size doesn't grow with the table), finds each part's nearest entry by branch and bound, and adds up integers: sums and counts of each
entry's parts within a task, then over all tasks by one small aggregate. All arithmetic is on integers, so that the result doesn't depend on
how the rows are dealt.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import as_array, packed, stored, table, unpacked

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components are below this after scaling, so that squared distances of 2**6 components stay below 2**63.
LARGEST = 1 << 27
#: Vectors that the search looks at together.
TOGETHER = 1 << 14


@dataclass
class Node:
    """A leaf with entries, or a split by one axis: left's values are at most `low`, right's at least `high`."""

    entries: tuple[int, ...] = ()
    axis: int = 0
    low: int = 0
    high: int = 0
    left: Node | None = None
    right: Node | None = None


def kd_tree(entries: np.ndarray, leaf: int = 2) -> Node:
    """The widest axis is split at its median; a leaf has `leaf` entries at most."""

    def grow(ids: np.ndarray) -> Node:
        if len(ids) <= leaf:
            return Node(tuple(int(i) for i in np.sort(ids)))
        axis = int(np.ptp(entries[ids], axis=0).argmax())
        ids = ids[np.lexsort((ids, entries[ids, axis]))]
        half = len(ids) // 2
        return Node((), axis, int(entries[ids[half - 1], axis]), int(entries[ids[half], axis]), grow(ids[:half]), grow(ids[half:]))

    return grow(np.arange(len(entries)))


def nearest(tree: Node, entries: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest entry and its squared distance; of entries at one distance the lowest number. Vectors go down the tree in
    groups, the nearer side first; the other side is searched by those for which its bound is not above the best distance so far: a side at
    just that distance may hold a lower number."""
    best = np.full(len(vectors), np.iinfo(np.int64).max, np.int64)
    which = np.zeros(len(vectors), np.int64)

    def visit(node: Node, who: np.ndarray) -> None:
        if not len(who):
            return
        if node.left is None:
            for e in node.entries:
                away = vectors[who] - entries[e]
                d = np.einsum("ij,ij->i", away, away)
                better = (d < best[who]) | ((d == best[who]) & (e < which[who]))
                best[who[better]], which[who[better]] = d[better], e
            return
        x = vectors[who, node.axis]
        to_low, to_high = np.maximum(x - node.low, 0), np.maximum(node.high - x, 0)
        first_left = to_low <= to_high
        for side, near, far, away in ((first_left, node.left, node.right, to_high), (~first_left, node.right, node.left, to_low)):
            some, bound = who[side], away[side] ** 2
            visit(near, some)
            visit(far, some[bound <= best[some]])

    visit(tree, np.arange(len(vectors)))
    return which, best


def scaled(vectors: pa.Array, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """floor(scale * x) of all components one after another, each vector's length, and whether it can be coded: it is not null, and
    all components are finite numbers, below LARGEST after scaling."""
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(vectors.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(flat * scale)
        bad = ~(np.abs(x) < LARGEST)
    wrong = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[bad], minlength=len(sizes)) > 0
    return np.where(bad, 0, x).astype(np.int32), sizes, vectors.is_valid().to_numpy(zero_copy_only=False) & ~wrong & (sizes > 0)


def _matrix(column, width: int) -> np.ndarray:
    """Packed integers of one length as a matrix, computed on in 64 bits."""
    flat = as_array(column)
    return np.frombuffer(b"".join(x.as_buffer() for x in flat), "<i4").reshape(len(flat), width).astype(np.int64)


def integers(df: DataFrame, vector: str = "vector", parts: int = PARTS, scale: int = SCALE) -> tuple[DataFrame, int]:
    """df's rows that can be coded, with `ints`, the scaled components packed, in place of the vector; and their length. Vectors are of
    one length: the most frequent that `parts` divides (of two, the shorter)."""
    rest = [f for f in df.schema if f.name != vector]

    def scale_rows(batches):
        for batch in batches:
            ints, sizes, good = scaled(as_array(batch.column(vector)), scale)
            ends = np.cumsum(sizes)
            raw = ints.astype("<i4").tobytes()
            keep = np.flatnonzero(good)
            made = pa.array([raw[4 * (ends[i] - sizes[i]) : 4 * ends[i]] for i in keep], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name).take(pa.array(keep)) for f in rest), made], [*(f.name for f in rest), "ints"])

    kept = df.mapInArrow(scale_rows, df.select(*(f.name for f in rest)).withColumn("ints", F.lit(None).cast("binary")).schema)
    kept = stored(kept, "integers")
    length = F.length("ints") / F.lit(4)
    found = kept.groupBy(length.cast("long").alias("n")).count().filter(F.col("n") % parts == 0).orderBy(F.desc("count"), "n").first()
    width = found["n"] if found else parts
    return kept.filter(F.length("ints") == 4 * width), width


def first_entries(rows: DataFrame, key: str, width: int, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """Codebooks (part, entry, component) of the vectors with the `entries` smallest keys, ascending; null counts as the largest key, and
    of vectors with one key the smallest in order of bytes counts. A fixed number of rows, whatever the table's size."""
    one = rows.groupBy(key).agg(F.min("ints").alias("ints")).orderBy(F.col(key).asc_nulls_last()).limit(entries)
    start = _matrix(pa.array([bytes(r["ints"]) for r in one.collect()], pa.binary()), width)
    return start.reshape(-1, parts, width // parts).transpose(1, 0, 2).copy()


def _assigned(batch: pa.RecordBatch, codebooks: np.ndarray, trees: list[Node]):
    """For each part of a batch: its vectors, their entries and distances."""
    parts, _, size = codebooks.shape
    vectors = _matrix(batch.column("ints"), parts * size)
    for p in range(parts):
        own = np.ascontiguousarray(vectors[:, p * size : (p + 1) * size])
        yield own, *nearest(trees[p], codebooks[p], own)


def refine(rows: DataFrame, codebooks: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks after so many rounds: each entry becomes floor(sum / count) of the parts that are nearest to it; an entry without any
    stays. A round brings one row per used entry to the driver."""
    parts, entries, size = codebooks.shape
    for _ in range(rounds):
        sent, trees = codebooks.copy(), [kd_tree(c) for c in codebooks]

        def add(batches, sent=sent, trees=trees):
            counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, size), np.int64)
            for batch in batches:
                for at in range(0, batch.num_rows, TOGETHER):
                    for p, (own, which, _) in enumerate(_assigned(batch.slice(at, TOGETHER), sent, trees)):
                        counts[p] += np.bincount(which, minlength=entries)
                        np.add.at(sums[p], which, own)
            for p, e in zip(*np.nonzero(counts)):
                yield pa.RecordBatch.from_pylist([{"part": int(p), "entry": int(e), "n": int(counts[p, e]), "sums": sums[p, e].tolist()}], schema)

        schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
        partial = rows.select("ints").mapInArrow(add, "part int, entry int, n long, sums array<bigint>")
        total = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(size)))
        codebooks = codebooks.copy()
        for row in total.collect():
            codebooks[row["part"], row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(size)]
    return codebooks


def encode(rows: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """rows with code (binary, one byte per part) and error (sum of the parts' squared distances) in place of ints."""
    trees = [kd_tree(c) for c in codebooks]
    rest = [c for c in rows.columns if c != "ints"]

    def assign(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(at, TOGETHER)
                codes, error = np.zeros((batch.num_rows, len(trees)), np.uint8), np.zeros(batch.num_rows, np.int64)
                for p, (_, which, d) in enumerate(_assigned(batch, codebooks, trees)):
                    codes[:, p] = which
                    error += d
                raw, n = codes.tobytes(), len(trees)
                made = [pa.array([raw[n * i : n * i + n] for i in range(batch.num_rows)], pa.binary()), pa.array(error)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *made], [*rest, "code", "error"])

    return rows.mapInArrow(assign, rows.select(*rest).withColumns({"code": F.lit(None).cast("binary"), "error": F.lit(None).cast("long")}).schema)


def decode(code: bytes, codebooks: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The vector that a code stands for."""
    return np.concatenate([codebooks[p, e] for p, e in enumerate(code)]) / scale


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", keep: list[str] | None = None, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """The rows of df with codes and errors in place of their vectors (columns `keep`, all by default, then code and error; columns
    of these names are replaced), and the codebooks (part, entry, component), integers of scale.

    Rows go whose vector is null, empty or holds a component that is null, not finite, or not below LARGEST / scale; so do those of another
    length than the most frequent one. Repeated rows are coded, and counted in the sums, each by itself; of rows with one key, one gives an
    initial entry. With fewer keys than entries the codebooks are smaller; without any row the result is empty. entries are 256 at most."""
    if not 0 < entries <= 256:
        raise ValueError("a code is a byte: 1 to 256 entries")
    rest = [c for c in (keep or df.columns) if c != vector]
    rows, width = integers(packed(df, rest, key=F.col(key), vector=F.col(vector)), "vector", parts, scale)
    start = first_entries(rows, "key", width, parts, entries)
    books = refine(rows, start, rounds) if start.shape[1] else start
    coded = encode(rows, books) if start.shape[1] else rows.limit(0).withColumns({"code": F.lit(None).cast("binary"), "error": F.lit(None).cast("long")})
    return unpacked(coded, F.col("code"), F.col("error")), books


def with_group_error(coded: DataFrame, label: str = "label", name: str = "label_error") -> DataFrame:
    """Adds the sum of error over rows of equal labels, nulls together: partial sums by label, joined back. The sums are a stored table, so
    that Spark broadcasts them if that table is small and splits a hot label's rows otherwise."""
    sums = stored(coded.groupBy(F.col(label).alias("_label")).agg(F.sum("error").alias(name)), "label-errors")
    return coded.join(sums, F.col(label).eqNullSafe(F.col("_label")), "left").drop("_label")


def op13_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error and the codebooks' digest of every vector that can be coded."""
    coded, books = compress(table(spark, sf_dir, "embeddings"), keep=["vec_id", "label"])
    digest = hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()
    out = with_group_error(stored(coded, "codes"))
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    floor = lambda s, n: f"(({s}) - ((({s}) % ({n})) + ({n})) % ({n})) // ({n})"
    away = " + ".join(f"(p.x[{i}] - b.x[{i}]) * (p.x[{i}] - b.x[{i}])" for i in range(1, 9))
    near = lambda b: f"SELECT p.vec_id, p.part, p.x, min({away}) AS d, arg_min(b.entry, ({away}) * 256 + b.entry) AS entry FROM parts p JOIN {b} b ON b.part = p.part GROUP BY p.vec_id, p.part, p.x"
    steps = []
    for r in range(ROUNDS):
        moved = ", ".join(floor(f"sum(x[{i}])::HUGEINT", "count(*)") + "::BIGINT" for i in range(1, 9))
        steps.append(f"near{r} AS MATERIALIZED ({near(f'book{r}')}), moved{r} AS (SELECT part, entry, [{moved}] AS x FROM near{r} GROUP BY part, entry), book{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN moved{r} m ON m.part = b.part AND m.entry = b.entry)")
    return f"""
WITH kept AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
parts AS MATERIALIZED (SELECT vec_id, part, list_transform(embedding[part * len(embedding) // 8 + 1 : (part + 1) * len(embedding) // 8], lambda x: floor(x::DOUBLE * 4096)::BIGINT) AS x FROM kept, range(8) t(part)),
firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 16)),
book0 AS MATERIALIZED (SELECT p.part, f.entry, p.x FROM parts p JOIN firsts f ON f.vec_id = p.vec_id),
{", ".join(steps)},
final AS MATERIALIZED ({near(f"book{ROUNDS}")}),
coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM final GROUP BY vec_id),
labels_ AS (SELECT k.label, sum(c.error)::BIGINT AS label_error FROM coded c JOIN kept k ON k.vec_id = c.vec_id GROUP BY k.label),
digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT c.vec_id, c.code, c.error, l.label_error, d.codebooks_sha256
FROM coded c JOIN kept k ON k.vec_id = c.vec_id JOIN labels_ l ON l.label IS NOT DISTINCT FROM k.label CROSS JOIN digest d"""


ORACLE = _sql()
