import glob
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from pathspark.functions import text as T
from pathspark.operators import curation as C
from pathspark.queries import ORACLES, QUERIES
from pathspark.sources import files

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got, want = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    rows = lambda all_, cols: sorted(str([round(r[cols.index(c)], 9) if isinstance(r[cols.index(c)], float) else r[cols.index(c)] for c in order]) for r in all_)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)


def values(spark, texts, f):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(f(F.col("t"))).collect()]


def test_instants_of_many_forms(spark):
    text = "at 2150-01-01T00:00:00Z. (2150-01-01T00:00:00.25-05:00) 2150-01-01T00:00:00 2150-01-01 2150-13-01T00:00:00Z x2150-01-01T00:00:00Z 2150-01-01T00:00:00Z,"
    assert spark.createDataFrame([(text,)], "s string").select(T.instants_in(F.col("s"))).first()[0] == ["2150-01-01T00:00:00Z", "2150-01-01T00:00:00.25-05:00", "2150-01-01T00:00:00Z"]


def test_tidy_punctuation(spark):
    assert values(spark, [" \n a \n b ]  }", "x 's 'sun ! ?", "1 .5 ; 2", "\t", "a\tb  \t c"], T.tidy_punctuation) == ["a \n b]}", "x's 'sun!?", "1 .5; 2", "", "a\tb c"]
    assert values(spark, ["a , b .", "the patient 's  note ( x )  ?", " .5 "], T.tidy_punctuation) == ["a, b.", "the patient's note ( x)?", ".5"]


def test_masks(spark):
    t = "Has {patient_id} [time_filter_global1] {drug_name1} {drug_name}?"
    assert values(spark, [t], T.mask) == ["Has X_PATIENT_ID_X X_TIME_FILTER_GLOBAL1_X X_DRUG_NAME1_X X_DRUG_NAME_X?"]
    assert values(spark, [t], lambda c: T.unmask(T.mask(c), c)) == [t]
    need = F.array(F.lit("X_A_X"), F.lit("X_B_X"))
    assert values(spark, ["X_A_X and X_B_X", "X_A_X X_C_X"], lambda c: C.slot_reason(c, need)) == [None, "lacks X_B_X; adds X_C_X"]


def test_distances(spark):
    far = lambda a, b: spark.range(1).select(C.different(F.lit(a), F.lit(b))).first()[0]
    assert not far("", "") and not far("abc", "abd") and far("a" * 20, "b" * 20) and not far("a" * 100, "a" * 90 + "b" * 10)


@pytest.mark.parametrize("block", [1, 3, 64])
def test_greedy_equals_the_sequential_fold(spark, block):
    r = random.Random(block)
    base = ["".join(r.choice("abcd ") for _ in range(r.choice([5, 12, 30, 60, 100]))) for _ in range(12)]
    rows = []
    for i in range(60):
        t = list(r.choice(base))
        for _ in range(r.choice([0, 1, 5, 15])):
            t[r.randrange(len(t))] = r.choice("xyz")
        rows.append((r.choice("gh"), i // 2, "".join(t)))
    rows += [("g", 3, ""), ("g", 4, None), (None, 1, "x" * 40), ("one", 1, "z" * 40), rows[0]]
    kept = {}
    for g, o, t in sorted((x for x in rows if x[0] is not None), key=lambda x: (x[0], x[1], x[2] is not None, x[2] or "")):
        have = kept.setdefault(g, [])
        far = lambda a, b: bool(a and b) and levenshtein(a, b) >= 10 and levenshtein(a, b) / max(len(a), len(b)) >= 0.15
        if all(far(t, k) for _, k in have):
            have.append((o, t))
    got = C.greedy_distinct(spark.createDataFrame(rows, "g string, o int, t string").repartition(3), "g", "o", "t", block)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((g, o, t) for g, have in kept.items() for o, t in have), key=str)
    assert C.greedy_distinct(got.limit(0), "g", "o", "t").count() == 0


def test_greedy_meets_near_texts_of_other_tiles_and_lengths(spark, monkeypatch):
    from pathspark.operators import tiles

    monkeypatch.setattr(tiles, "TILE", 8)
    r, rows, kept = random.Random(5), [], []
    for i in range(110):
        t = list("".join(r.choice("abcdeé😀 ") for _ in range(r.randrange(1, 130))) if i % 3 == 0 or not rows else r.choice(rows)[2])
        for _ in range(r.choice([1, 9, 10, 14, 20]) if i % 3 else 0):
            at = r.randrange(len(t) + 1)
            t[at : at + r.choice([0, 0, 1])] = r.choice(["x", "y", ""])
        rows.append(("g", i, "".join(t)))
    far = lambda a, b: bool(a and b) and levenshtein(a, b) >= 10 and levenshtein(a, b) / max(len(a), len(b)) >= 0.15
    for _, o, t in rows:
        if all(far(t, k) for _, k in kept):
            kept.append((o, t))
    got = C.greedy_distinct(spark.createDataFrame(rows, "g string, o int, t string"), "g", "o", "t", 16)
    assert 20 < len(kept) < 100 and sorted((x["o"], x["t"]) for x in got.collect()) == kept


def test_greedy_is_in_order(spark):
    df = spark.createDataFrame([("g", 1, "a" * 30), ("g", 2, "a" * 25 + "b" * 5), ("g", 3, "c" * 30), ("h", 1, "a" * 30)], "g string, o int, t string")
    assert sorted((r["g"], r["o"]) for r in C.greedy_distinct(df, "g", "o", "t").collect()) == [("g", 1), ("g", 3), ("h", 1)]


@pytest.mark.parametrize("n", [1, 2, 9, 25])
def test_split_sizes(spark, n):
    got = C.ranked_split(spark.range(n).select(F.lit("t").alias("g"), F.col("id").cast("string").alias("t")), "g", "t").groupBy("split").count().collect()
    sizes = {r["split"]: r["count"] for r in got}
    assert sum(sizes.values()) == n and sizes["test"] == -(-n * 12 // 100)


def test_last_wins_keeps_the_first_place(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, None)], "k string, o int, v string")
    assert sorted(map(tuple, C.last_wins(df, ["k"], "o").collect())) == [("a", 1, None), ("b", 2, "y")]


def test_numbered(spark):
    got = [(r["id"], r["index"]) for r in C.numbered(spark.range(100).repartition(7), "id").collect()]
    assert sorted(got) == [(i, i) for i in range(100)]


def test_cover_stops(spark):
    tracked = spark.createDataFrame([("t", i) for i in range(5)], "template_id string, text int")
    answer = lambda rows, r: rows.withColumn("answer", F.when(F.col("text") <= r, "[true]").otherwise("[]")).withColumn("question_id", F.col("text"))
    assert C.cover(tracked, answer, ["template_id", "text"], most=3).count() == 3


def test_files(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a":1}\n\n{bad\n{"a":2}\n')
    good, bad = files.read_jsonl(spark, str(p), "a int")
    assert sorted(r["a"] for r in good.collect()) == [1, 2] and bad.count() == 1
    v = tmp_path / "v"
    v.mkdir()
    (v / "drug.json").write_text('["A", "b"]')
    (v / "lab.json").write_text('{"values": ["C"]}')
    assert sorted(map(tuple, files.read_valuesets(spark, str(v)).collect())) == [("drug", "A"), ("drug", "b"), ("lab", "C")]
    (tmp_path / "s.json").write_text('{"t": {"x": "train", "y": "val"}}')
    assert files.read_split_map(spark, str(tmp_path / "s.json")).count() == 2 and files.read_split_map(spark, str(tmp_path / "none.json")).count() == 0
    assert files.jsonl_path("a.json") == files.jsonl_path("a") == "a.jsonl"
    df = spark.createDataFrame([("t", 'say "x", y')], "template_id string, paraphrase string")
    files.write_csv(df, str(tmp_path / "c"))
    assert files.read_review_csv(spark, str(tmp_path / "c")).first()["paraphrase"] == 'say "x", y'


def test_review_and_answers(spark):
    rows = spark.createDataFrame([("y",), (" Y",), ("n",), ("?",), (None,)], "good string")
    kept, counts = C.review(rows)
    assert kept.count() == 2 and counts.first()["unknown"] == 2
    assert values(spark, ["[]", "[0]", "[false]", "[1]"], C.null_answer) == [True, True, False, False]


def test_stream(spark, tmp_path):
    from pathspark.streaming.ingest import stream_ndjson

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.ndjson").write_text('{"resourceType":"Patient","id":"p","gender":"male"}\n{"resourceType":"Encounter","id":"e","subject":{"reference":"Patient/p"}}\n')
    stream_ndjson(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "Encounter")).first()["patient_id"] == "p"


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def table(name):
    return duckdb.connect().sql(f"SELECT * FROM '{SF}/{name}.parquet'").fetchall()


needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@needs_data
def test_instants_of_all_events(spark):
    con = duckdb.connect()
    want = {r[0] for r in con.sql(f"SELECT strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') FROM '{SF}/events.parquet'").fetchall()}
    got = [r["at"] for r in QUERIES["regex_datetime_extract"](spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_greedy_near_dup_judges_all_turns(spark, tmp_path):
    long_ = ["".join(chr(97 + (i * k + i * i) % 26) for i in range(400)) for k in (3, 5)]
    turns = [(1, 0, "user", long_[0]), (51, 0, "user", long_[0][:-5] + "?????"), (51, 1, "user", long_[1]), (101, 0, "user", "short"), (2, 0, "user", long_[0]), (1, 1, "system", long_[1])]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    kept = {}
    for c, t, role, text in sorted(turns):
        if role == "user":
            have = kept.setdefault(t, [])
            far = lambda a, b: levenshtein(a, b) >= 10 and levenshtein(a, b) / max(len(a), len(b)) >= 0.15
            if all(far(text, k) for _, k in have):
                have.append((c * 100 + t, text))
    want = sorted((g, o) for g, have in kept.items() for o, _ in have)
    assert want == [(0, 100), (0, 10100), (1, 5101)]
    assert sorted((r["g"], r["o"]) for r in QUERIES["greedy_near_dup"](spark, str(tmp_path)).collect()) == want


def test_near_dup_vs_original_has_texts_beyond_ascii(spark, tmp_path):
    items = [(1, "Größe und Gewicht"), (2, "Grösse und Gewicht"), (3, "naïve café"), (4, "日本語のテキストと長い文"), (6, "alone"), (7, "alone too")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    text = dict(items)
    d = {i: levenshtein(text[i], text[i + 1]) for i in text if i + 1 in text}
    want = sorted((i, i + 1, n, n >= 10 and n / max(len(text[i]), len(text[i + 1])) >= 0.15) for i, n in d.items())
    got = QUERIES["near_dup_vs_original"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.select("a", "b", "distance", "far").collect()) == want


@needs_data
def test_union_full_outer_merge_has_texts_beyond_ascii(spark):
    merged = {}
    for conv, role, text in duckdb.connect().sql(f"SELECT conv_id, role, text FROM '{SF}/conversations.parquet' WHERE role IN ('user', 'system')").fetchall():
        merged.setdefault(conv, {"user": set(), "system": set()})[role].add(text)
    one = lambda texts: "#".join(sorted(texts)) if texts else None
    got = QUERIES["union_full_outer_merge"](spark, SF).collect()
    assert {r["template_id"]: (r["clinical"], r["patient"]) for r in got} == {c: (one(m["user"]), one(m["system"])) for c, m in merged.items()}
    assert len(got) == len(merged)


@needs_data
def test_cross_has_all_templates(spark):
    patients, templates = sorted(r[0] for r in table("customer")), sorted(r[1] for r in table("nation"))
    want = [(p, t, i, k) for k, (p, t, i) in enumerate((p, t, i) for p in patients for t in templates for i in (1, 2))]
    got = QUERIES["cross_patients_templates"](spark, SF).select("patient", "template", "i", "index").collect()
    assert len(templates) == 25 and sorted(tuple(r) for r in got) == want


def test_paraphrases_of_a_split(spark):
    c = spark.createDataFrame([("t", 0, "b"), ("t", 1, "a"), ("u", 0, "x")], "key string, ord int, text string")
    p = spark.createDataFrame([("t", 0, "a"), ("v", 0, "y")], "key string, ord int, text string")
    s = spark.createDataFrame([("t", "a", "train"), ("t", "b", "train"), ("u", "x", "test"), ("t", "a", "train")], "template_id string, text string, split string")
    got = {r["template_id"]: (r["clinical"], r["patient"]) for r in C.paraphrases_of_split(c, p, s, "train").collect()}
    assert got == {"t": (["b", "a"], ["a"]), "u": ([], []), "v": ([], [])}


def test_extract_value_sets_leaves_out_patients_without_lines_and_keeps_numbers(spark, tmp_path):
    import duckdb

    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "part"):
        con.execute(f"CREATE TABLE {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    con.execute("DELETE FROM orders WHERE o_custkey = 1")
    con.execute("UPDATE part SET p_type = CASE p_type WHEN 'ECONOMY' THEN '12-3' WHEN 'PROMO' THEN ' x ' ELSE p_type END")
    for t in ("customer", "orders", "lineitem", "part"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    got = sorted(map(tuple, QUERIES["extract_value_sets"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.sql(ORACLES["extract_value_sets"]).fetchall()) and 1 not in dict(got)
