import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathspark.llm.periodic import find_runs, periodic_runs, repeated_from
from pathspark.llm.queries import QUERIES
from tests.llm import brute


def runs_of(w, least=24, periods=3):
    """By the definition: each maximal stretch of equal words at distance q, the smallest q of one stretch."""
    out = {}
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, periods * q):
                out.setdefault((i, j - i + q), q)
            i = j
    return sorted(((i, n, q) for (i, n), q in out.items()), key=lambda r: (r[0], r[2]))


def kept(w, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def texts(r):
    def fibonacci(k):
        a, b = [0], [0, 1]
        for _ in range(k):
            a, b = b, b + a
        return b

    for _ in range(r.choice([1, 3, 8])):
        match r.randrange(6):
            case 0:
                yield [r.randrange(r.choice([1, 2, 3])) for _ in range(r.choice([0, 1, 10, 100, 300]))]
            case 1:
                out = []
                while len(out) < 200:
                    u = [r.randrange(3) for _ in range(r.choice([1, 2, 3, 7, 15]))]
                    out += (u * 40)[: r.choice([24, 30, 50])] + [9] * r.randrange(2)
                yield out
            case 2:
                yield fibonacci(r.randrange(13))
            case 3:  # runs inside longer repeats: copied ones
                x = [r.randrange(50) for _ in range(100)]
                y = x[:5] * 10
                yield x + y + x[::-1] + [7] + y[1:-1] + x + [8] + y
            case 4:
                u = ([1] * 30 + [2]) * 3 + [3]
                yield u * r.choice([1, 3, 4]) + [5] + u * 2
            case _:
                d = [r.randrange(2000) for _ in range(r.choice([50, 400]))]
                a = r.randrange(len(d))
                p = 1 + (len(d) - a) // r.randrange(3, 11)
                yield [d[i] if i < a else d[a + (i - a) % p] for i in range(len(d))]


@pytest.mark.parametrize(("least", "periods"), [(24, 3), (6, 3), (1, 3), (10, 4)])
def test_runs_equal_brute_force(least, periods):
    r = random.Random(least)
    seen = 0
    for _ in range(60):
        docs = list(texts(r))
        want = [runs_of(d, least, periods) for d in docs]
        assert find_runs(np.array([x for d in docs for x in d], np.int64), np.array([len(d) for d in docs]), least, periods) == want
        seen += sum(map(len, want))
    assert seen > 100


def test_long_texts_take_little_time():
    assert find_runs(np.zeros(400_000, np.int64), np.array([400_000])) == [[(0, 400_000, 1)]]
    block = np.random.default_rng(1).integers(0, 10_000, 3000)
    assert find_runs(np.tile(block, 100), np.array([300_000])) == [[(0, 300_000, 3000)]]
    with pytest.raises(ValueError, match="three"):
        find_runs(block, np.array([3000]), 24, 2)


ROWS = [(1, None), (2, ""), (3, " \n\t "), (4, "a b " * 20), (4, "a b " * 20), (None, "x " * 30), (5, "q" * 1_000_000), (6, "a b c\x1fd"), (7, "w1 w2 " + "né, " * 24 + "w1"), (8, " ".join(f"w{i % 5000}" for i in range(200_000))), (9, "a b c"), (10, "y " * 23)]


def test_operator_equals_brute_force(spark):
    df = spark.createDataFrame([(i, t, "old", i) for i, t in ROWS], "doc_id long, text string, runs string, row long").repartition(3)
    got = periodic_runs(df)
    assert got.columns == ["doc_id", "text", "row", "n_words", "runs", "n_removed", "collapsed"]
    want = []
    for i, t in ROWS:
        w = brute.WORD.findall(t or "")
        found = runs_of(w) if len(w) < 1000 else [(0, len(w), 5000)]
        left = kept(w, found)
        want.append((i, len(w), found, len(w) - len(left), " ".join(left)))
    rows = got.select("doc_id", "n_words", F.col("runs"), "n_removed", "collapsed").collect()
    assert sorted(((d, n, [tuple(x) for x in f], m, c) for d, n, f, m, c in rows), key=str) == sorted(want, key=str)


def test_operator_on_nothing(spark):
    assert periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def contract(doc_id, text):
    w = brute.WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_repeated_texts(spark):
    rows = [(i, t) for i in range(300) for t in (None, "", "one", " a b\tc ", " ".join(f"w{k}" for k in range(i)))] + [(None, "a b c")]
    got = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", repeated_from(F.col("doc_id"), F.col("text")).alias("t")).collect()
    for doc_id, text, t in got:
        assert brute.WORD.findall(t or "") == (contract(doc_id, text) if doc_id is not None else brute.WORD.findall(text))


def test_op12_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for i, t in docs:
        w = contract(i, t)
        runs = runs_of(w)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None,) * 3
        want.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, brute.sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), brute.sha(" ".join(kept(w, runs)))))
    assert sorted(map(tuple, QUERIES["op12_runs"](spark, d).collect())) == sorted(want)
    assert sum(x[1] for x in want) > 10
