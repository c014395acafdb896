import hashlib
import math

import numpy as np
import pytest

from pathspark.llm.queries import QUERIES
from pathspark.llm.vectors import compress, decode, kd_tree, nearest, with_group_error


def coded(rows, parts=8, entries=16, rounds=6):
    """The contract by plain loops over Python's integers: {row number: (code, error)} and codebooks."""
    good = {i: [math.floor(4096 * x) for x in v] for i, (_, v, _) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v)}
    ids = sorted({rows[i][0] for i in good}, key=lambda k: (k is None, k))[:entries]
    size = len(next(iter(good.values()))) // parts
    first = [min((v for i, v in good.items() if rows[i][0] == k), key=lambda v: np.array(v, "<i4").tobytes()) for k in ids]
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[cut(v, p) for v in first] for p in range(parts)]

    def assign():
        out = {}
        for i, v in good.items():
            away = [[sum((a - b) ** 2 for a, b in zip(cut(v, p), e)) for e in books[p]] for p in range(parts)]
            out[i] = ([d.index(min(d)) for d in away], sum(map(min, away)))
        return out

    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v, p) for i, v in good.items() if got[i][0][p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    return assign(), books


def test_search_equals_brute_force():
    r = np.random.default_rng(1)
    for _ in range(150):  # few values, so that many distances tie
        entries = r.integers(-3, 4, (r.integers(1, 40), r.integers(1, 5)))
        vectors = r.integers(-4, 5, (200, entries.shape[1]))
        which, d = nearest(kd_tree(entries, int(r.integers(1, 4))), entries, vectors)
        every = ((vectors[:, None] - entries[None]) ** 2).sum(2)
        assert (which == every.argmin(1)).all() and (d == every.min(1)).all()


def table(seed, n, kinds):
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        v = [float(x) for x in (r.integers(-3, 4, 16) / 4096 if kinds == "ties" else r.normal(0, 1, 16))]
        out.append((i * 7 % n, v, None if i % 5 == 0 else int(i % 3)))
    bad = [None, [], [None] * 16, [float("nan")] + [0.0] * 15, [0.0] * 15 + [float("inf")], [0.0] * 15 + [-float("inf")], [0.5] * 15 + [None]]
    return out + [(1000 + k, v, 1) for k, v in enumerate(bad)] + [(-5, [float("nan")] * 16, 0)] + [out[3], out[3], (out[4][0], out[5][1], None), (None, out[6][1], 2)]


@pytest.mark.parametrize(("seed", "n", "kinds", "entries"), [(1, 300, "normal", 16), (2, 200, "ties", 16), (3, 9, "ties", 16), (4, 120, "normal", 5)])
def test_codes_equal_brute_force(spark, seed, n, kinds, entries):
    rows = table(seed, n, kinds)
    df = spark.createDataFrame([(*x, "old") for x in rows], "vec_id long, embedding array<double>, label int, code string").repartition(3)
    got, books = compress(df, entries=entries)
    want, codebooks = coded(rows, entries=entries)
    assert books.tolist() == codebooks and got.columns == ["vec_id", "label", "code", "error"]
    assert sorted(((i, lb, list(c), e) for i, lb, c, e in got.collect()), key=str) == sorted(((rows[i][0], rows[i][2], *x) for i, x in want.items()), key=str)
    sums = {}
    for i, (_, e) in want.items():
        sums[rows[i][2]] = sums.get(rows[i][2], 0) + e
    assert {(r["label"], r["label_error"]) for r in with_group_error(got).collect()} == set(sums.items())


def test_decoded_vectors_are_as_far_as_the_error_says(spark):
    rows = [(i, v, None) for i, v, _ in table(5, 100, "normal")[:100]]
    got, books = compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    vectors = dict((i, np.floor(4096 * np.array(v, np.float32).astype(float))) for i, v, _ in rows)
    for r in got.collect():
        assert ((decode(bytes(r["code"]), books) * 4096 - vectors[r["vec_id"]]) ** 2).sum() == r["error"]


def test_other_lengths_and_nothing(spark):
    schema = "vec_id long, embedding array<float>, label int"
    odd = [(1, [1.0] * 8, 1), (2, [2.0] * 8, 1), (3, [1.0] * 16, 1), (4, [1.0] * 3, 1), (5, [1e30] * 8, 1)]
    assert sorted(r["vec_id"] for r in compress(spark.createDataFrame(odd, schema))[0].collect()) == [1, 2]
    for rows in ([], [(1, None, 1)], [(1, [1.0] * 3, 1)]):
        got, books = compress(spark.createDataFrame(rows, schema))
        assert got.collect() == [] and books.size == 0 and got.columns == ["vec_id", "label", "code", "error"]
    with pytest.raises(ValueError, match="byte"):
        compress(spark.createDataFrame([], schema), entries=300)


def test_op13_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    want, books = coded(rows)
    sums = {}
    for i, (_, e) in want.items():
        sums[rows[i][2]] = sums.get(rows[i][2], 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    assert sorted(map(tuple, QUERIES["op13_vectors"](spark, d).collect())) == sorted((rows[i][0], bytes(c).hex(), e, sums[rows[i][2]], digest) for i, (c, e) in want.items())
