"""Secret scans: fixed patterns, and a battery of randomness tests for what no pattern names. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import packed, stored, table, unpacked

#: kind: (pattern, group whose length counts, least length), in the order in which equal starts are listed
PATTERNS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
#: What a hex match may start in: runs that are long enough; shorter ones are dropped anyway.
_SHORTCUT = {"hex": r"[0-9a-f]{16,}", "access": r"AKIA[A-Z0-9]{14,}"}
#: Encodings that a string is tried as, by the characters in it: (pattern of the whole string, alphabet size).
ENCODINGS = {"hex": (r"[0-9a-fA-F]+", 16), "base32": (r"[A-Z2-7]+", 32), "alnum": (r"[A-Za-z0-9]+", 62), "base64": (r"[A-Za-z0-9+/_=-]+", 64)}
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"


def spans(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """array<struct<start, end, match>> of a pattern's leftmost non-overlapping matches, in code points; those whose group is shorter
    than least are dropped after the search. The pieces between the matches give the places."""
    found, kept = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.split(text, pattern, -1)
    steps = F.zip_with(F.zip_with(between, found, lambda b, m: F.struct(F.length(b).alias("b"), m.alias("m"))), kept, lambda x, g: F.struct(x["b"].alias("b"), x["m"].alias("m"), g.alias("g")))
    walked = F.aggregate(
        F.filter(steps, lambda x: x["m"].isNotNull()),
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,match:string>>)").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["b"] + F.length(x["m"])).alias("at"),
            F.when(F.length(x["g"]) >= least, F.concat(acc["out"], F.array(F.struct((acc["at"] + x["b"]).alias("start"), (acc["at"] + x["b"] + F.length(x["m"])).alias("end"), x["m"].alias("match"))))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(text.rlike(pattern), walked).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,match:string>>)"))


def normal_tail(z: Column) -> Column:
    """P(|N| > z), by the approximation of Abramowitz and Stegun 7.1.26."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.greatest(poly * F.exp(-x * x), F.lit(1e-300))


def battery(token: Column) -> dict[str, Column]:
    """Tests of the hypothesis that a token's characters are drawn evenly and independently from the alphabet of the narrowest
    encoding that fits: p_chi (chi-squared uniformity; where a cell expects few, its normal form), p_runs (of characters above and
    below the alphabet's middle), p_serial (lag-1 correlation of the characters' ranks), and Fisher's combination of the three."""
    size = F.coalesce(*(F.when(token.rlike(f"^{p}$"), F.lit(float(k))) for p, k in ENCODINGS.values()), F.lit(64.0))
    chars = F.filter(F.split(token, ""), lambda c: c != "")
    n = F.size("chars").cast("double")
    rank = lambda c: (  # noqa: E731  digits, capitals, small letters, marks; capitals join small letters in hex, digits follow in base32
        F.when(c.between("0", "9"), F.ascii(c) - F.when(F.col("alphabet") == 32, 24).otherwise(48))
        .when(F.col("alphabet") == 16, F.ascii(F.upper(c)) - 55)
        .when(c.between("A", "Z"), F.ascii(c) - F.when(F.col("alphabet") == 32, 65).otherwise(55))
        .when(c.between("a", "z"), F.ascii(c) - 61)
        .when(c.isin("+", "-"), F.lit(62))
        .otherwise(F.lit(63))
    ).cast("double")
    k = F.col("alphabet")
    # sum over distinct characters of count squared
    squares = F.aggregate(F.transform(F.array_distinct("ranks"), lambda d: F.size(F.filter("ranks", lambda x: x == d)).cast("double")), F.lit(0.0), lambda a, x: a + x * x)
    # statistic and its exact mean and variance under uniformity: right for few characters too
    chi = k / n * squares - n
    chi_z = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    high = F.transform("ranks", lambda x: (x >= k / 2).cast("double"))
    runs = F.aggregate(F.zip_with(F.slice(high, 2, F.size("ranks")), high, lambda a, b: F.when(a != b, 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(0.0)), F.lit(1.0), lambda a, x: a + x)
    runs_z = (runs - (1 + (n - 1) / 2)) / F.sqrt((n - 1) / 4)
    mid = (k - 1) / 2
    serial = F.aggregate(F.zip_with(F.slice("ranks", 2, F.size("ranks")), "ranks", lambda a, b: F.coalesce((a - mid) * (b - mid), F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    serial_z = serial / ((k * k - 1) / 12 * F.sqrt(n - 1))
    fisher = -2 * (F.log("p_chi") + F.log("p_runs") + F.log("p_serial")) / 2
    return {
        "alphabet": size, "chars": chars, "ranks": F.transform("chars", rank), "p_chi": normal_tail(F.greatest(chi_z, F.lit(0.0))), "p_runs": normal_tail(runs_z), "p_serial": normal_tail(serial_z),
        "x": fisher, "p": F.exp(-F.col("x")) * (1 + F.col("x") + F.col("x") * F.col("x") / 2),
    }


#: What a value's characters are in a base match: after the sign of an assignment.
_VALUE = r"[A-Za-z0-9+/_.=-]+$"
#: Classes of length: from 20 x 2**(c / 2) characters on.
CLASSES = 12
#: With fewer ordinary strings of an encoding than this, those of all encodings of the length are the measure.
ENOUGH = 200


def tested(tokens: DataFrame) -> DataFrame:
    """token, alphabet, class, p (the battery's) and bin (of p, smaller for larger p) of distinct tokens."""
    for name, c in battery(F.col("token")).items():
        tokens = tokens.withColumn(name, c)
    tokens = tokens.withColumn("class", F.greatest(F.lit(0), F.least(F.floor(F.log2(F.length("token").cast("double") / 20) * 2), F.lit(CLASSES))))
    return tokens.select("token", "alphabet", "class", "p", F.floor(-F.log10(F.greatest("p", F.lit(1e-300))) * 8).alias("bin"))


def ordinary(texts: DataFrame, classes: list[int]) -> DataFrame:
    """(token): strings that ordinary text makes, of the least length of each class: from every text in _t, without what the scan looks at, a
    piece of its words run together at a place that its hash names, in one of five ways: nothing between them, _ between them, /
    between them, in capitals, and only what could be hex. Texts that are too short for a class give none for it."""
    bare = F.regexp_replace("_t", "|".join([CANDIDATE, *_SHORTCUT.values()]), " ")
    h = F.xxhash64("_t")
    way = F.pmod(h, F.lit(5))
    run = (
        F.when(way == 0, F.regexp_replace(bare, "[^A-Za-z0-9]+", "")).when(way == 1, F.regexp_replace(bare, "[^A-Za-z0-9]+", "_")).when(way == 2, F.regexp_replace(bare, "[^A-Za-z0-9]+", "/"))
        .when(way == 3, F.regexp_replace(F.upper(bare), "[^A-Z2-7]+", "")).otherwise(F.regexp_replace(bare, "[^0-9A-Fa-f]+", ""))
    )
    rows = texts.select(run.alias("run"), F.shiftrightunsigned(h, 3).alias("h"))
    sizes = [math.ceil(20 * 2 ** (c / 2)) for c in classes]
    room = lambda n: F.length("run") - n + 1
    pieces = F.array(*(F.when(room(n) > 0, F.col("run").substr((F.pmod(F.col("h"), room(n)) + 1).cast("int"), F.lit(n))) for n in sizes))
    return rows.select(F.explode(pieces).alias("token")).filter(F.col("token").isNotNull())


def discoveries(candidates: DataFrame, null: DataFrame, fdr: float) -> DataFrame:
    """(class, alphabet, bin) of the candidates (tested()) that are no ordinary strings. A candidate's p-value under the hypothesis that it is one
    is the share of ordinary strings (tested() too) of its encoding and length that look at least as random; Benjamini-Hochberg at
    level fdr goes through all candidates of a length. Both are computed from counts by bins, a few hundred for each class."""
    n = candidates.groupBy("class", "alphabet", "bin").agg(F.count(F.lit(1)).alias("n"))
    both = n.withColumn("n0", F.lit(0).cast("long")).unionByName(null.groupBy("class", "alphabet", "bin").agg(F.count(F.lit(1)).alias("n0")).withColumn("n", F.lit(0).cast("long")))
    both = both.groupBy("class", "alphabet", "bin").agg(F.sum("n").alias("n"), F.sum("n0").alias("n0"))
    own, pool = Window.partitionBy("class", "alphabet"), Window.partitionBy("class")
    upto = lambda w: F.sum("n0").over(w.orderBy("bin").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    share = lambda w: (upto(w) + 1) / (F.sum("n0").over(w) + 1)
    rows = both.withColumn("p0", F.when(F.sum("n0").over(own) >= ENOUGH, share(own)).otherwise(share(pool)))
    rank = F.sum("n").over(pool.orderBy("p0").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("good", F.col("p0") <= fdr * rank / F.sum("n").over(pool))
    rows = rows.withColumn("level", F.max(F.when(F.col("good"), F.col("p0"))).over(pool))
    return rows.filter((F.col("n") > 0) & (F.col("p0") <= F.col("level"))).select("class", "alphabet", "bin")


def scan(docs: DataFrame, keep: list[str], text: str = "text", fdr: float = 0.05) -> DataFrame:
    """docs' columns `keep` and found: array<struct<start, end, kind, p>> of all secrets of the whole text, sorted by start and then
    by kind in the order assign, access, hex, random; p is the battery's p-value of the secret's characters (of an assignment's
    value): small for what isn't drawn evenly, as passwords of words. Null texts count as empty. Each row of docs is one row of the result. A
    column named found is replaced; other names are free.

    `random` spans are maximal runs of 20 and more characters of an encoding's alphabet, whatever these are, which overlap no pattern's span,
    and of which it can be ruled out that they are ordinary: the null hypothesis is that a string is words run together, and its
    distribution is measured on the corpus itself (ordinary()), by encoding and length, as short strings look more random than long ones.
    Among the strings of a length that are named, the expected share of ordinary ones is fdr at most, as far as those measured stand
    for all. A corpus with little prose has nothing to rule it out by, and names none: with n ordinary strings no p-value is below 1 / (n + 1)."""
    empty = F.expr("cast(array() as array<struct<start:int,end:int,kind:string,p:double>>)")
    source = packed(docs, keep, _t=F.coalesce(F.col(text), F.lit("")))
    rows = source.select("row", *(spans(F.col("_t"), _SHORTCUT.get(kind, p), g, least).alias(f"_{kind}") for kind, (p, g, least) in PATTERNS.items()), spans(F.col("_t"), CANDIDATE).alias("_token"))
    free = lambda s: ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    rows = rows.withColumn("_base", F.concat(*(F.col(f"_{k}") for k in PATTERNS))).withColumn("_random", F.filter("_token", free))
    listed = lambda i, kind: F.transform(f"_{kind}", lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.regexp_extract(s["match"], _VALUE, 0).alias("token")))
    rows = rows.select("row", F.concat(*(listed(i, k) for i, k in enumerate([*PATTERNS, "random"]))).alias("_spans"), F.monotonically_increasing_id().alias("_row"))
    rows = stored(rows, "secret-spans")  # from here on _row is fixed

    each = rows.filter(F.size("_spans") > 0).select("_row", F.inline("_spans"))
    measured = stored(tested(each.select("token").distinct()), "secret-tests")
    open_ = each.filter("kind = 'random'").select("token").distinct()
    candidates = measured.join(open_, "token", "left_semi")
    classes = sorted(r[0] for r in candidates.select("class").distinct().collect())  # CLASSES + 1 at most
    if classes:
        null = stored(tested(ordinary(source, classes).distinct()), "secret-ordinary")
        measured = measured.join(discoveries(candidates, null, fdr).withColumn("_named", F.lit(True)), ["class", "alphabet", "bin"], "left")
    else:
        measured = measured.withColumn("_named", F.lit(False))
    # the same secret may be in a third of all rows: AQE can split that key, as each span meets one row of measured
    hits = each.join(measured.select(F.col("token").alias("_k"), "p", "_named"), F.col("token") == F.col("_k")).filter((F.col("kind") != "random") | F.coalesce("_named", F.lit(False)))
    hits = hits.groupBy(F.col("_row").alias("_r")).agg(F.array_sort(F.collect_list(F.struct("start", "order", "end", "kind", "p"))).alias("_hits"))
    rows = rows.join(hits, F.col("_row") == F.col("_r"), "left")
    return unpacked(rows, F.coalesce(F.transform("_hits", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["p"].alias("p"))), empty).alias("found"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how many spans of each pattern, the digest of those, all spans, the battery's `random` ones too, and the battery's
    p-value of each."""
    found = scan(table(spark, sf_dir, "documents"), ["doc_id"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, PATTERNS), F.sha2(listed(F.filter("found", lambda s: s["kind"] != "random")), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), F.array_join(F.transform("found", lambda s: F.format_string("%.3g", s["p"])), ",").alias("p_values"))
