"""N-gram Jaccard join with token-combination prefixes.

A document's set is that of its word shingles. Two documents link when their sets' Jaccard similarity reaches a threshold. A
global order puts rare shingles first. Sets that link share at least as many shingles as the threshold asks of the larger, so
some of them lie in the prefixes of both. Where a prefix holds rare shingles only, each of them is a signature. Where it
reaches the frequent ones, they are dealt into G sub-classes, the prefix is extended by G, and pairs of frequent
shingles of one sub-class are the signatures: of G + 1 common ones two are in the same sub-class.

Each bucket of a signature looks at its own sets: their sizes, the places of the signature in their orders, and parities of 256
bits, no more of which can differ than the sets differ in, tell most pairs that can't link. What may link becomes a forest of
edges, at most one less than the bucket has sets; a group of near copies never becomes its pairs. The forests' components hold
all links. The whole sets of a component then meet and are compared with each other, large ones in shares.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import cell_batches, gram_hashes, in_map, mix64, pair_keys, pieces, range_hashes, release, sketch, stored, table, word_hashes, words_of

#: Cells of the sketch of shingle counts as a power of 2, by the size of the table: about three for each word. Its two bitmaps, 2**bits / 8
#: bytes each, go to every executor.
LEAST_BITS, MOST_BITS = 28, 30
#: From so many documents on (or more, where the sketch is crowded) a shingle is frequent.
FREQUENT = 64
#: Shingles of one share of a component: two shares meet in one task.
SHARE = 1 << 20
#: Rows of one share of a bucket: two shares of a larger one meet in one task.
BUCKET = 1 << 15
#: Bits of a set's parity, in words of 64.
PARITY = 4


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: n consecutive words, lower-cased in A-Z; the whole text as one where it has
    fewer words; none without words."""
    words, per_text = words_of(pc.ascii_lower(pc.fill_null(texts, "")))
    hashes = word_hashes(words)
    grams = gram_hashes(hashes, n)
    ends = np.cumsum(per_text)
    begins = ends - per_text
    short = (per_text > 0) & (per_text < n)
    whole = np.zeros(len(per_text), np.uint64)
    whole[short] = range_hashes(hashes, begins[short], ends[short], 7)
    out = []
    for i, (a, b) in enumerate(zip(begins.tolist(), ends.tolist())):
        if b - a >= n:
            s = np.sort(grams[a : b - n + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        else:
            out.append(whole[i : i + 1] if b > a else whole[:0])
    return out


def set_keys(sets: list[np.ndarray]) -> pa.Array:
    """16 bytes that tell sets apart: two sums over mixed members."""
    flat = np.concatenate([*sets, np.zeros(1, np.uint64)])
    at = np.cumsum([0, *map(len, sets)])
    with np.errstate(over="ignore"):
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(flat + np.uint64(c)))]) for c in (0x1234567, 0x89ABCDEF01)]
    return pair_keys(*(s[at[1:]] - s[at[:-1]] for s in sums))


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def signatures(s: np.ndarray, twice: np.ndarray, often: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The signatures of a set whose members are certainly in one set (not `twice`), rare, or frequent (`often`), and with each a
    cap: how many members the set can share with another if this is the first signature that they share. None where it can't link."""
    n = len(s)
    o = least_overlap(n, percent)
    alone = n - int(twice.sum())
    if n - alone < o or (n < 2 and percent > 50):
        return None
    rare, common = s[twice & ~often], s[twice & often]
    room = n - o + 1 - alone  # the shingles that no other set has are the first of the order
    if room <= len(rare):
        return rare[:room], n - alone - np.arange(room)
    out, caps = [rare], [n - alone - np.arange(len(rare))]
    # a set joins the schemes of all octaves of size that can link with it, down from its own
    for q in range(o.bit_length() - 1, n.bit_length()):
        g = max(1, (1 << q) // 16)
        if least_overlap(1 << q, percent) <= g:  # so small sets may share a single shingle: each is a signature
            prefix = common[: room - len(rare)]
            with np.errstate(over="ignore"):
                out.append(mix64(prefix + np.uint64(q + 1)))
            caps.append(n - alone - len(rare) - np.arange(len(prefix)))
            continue
        prefix = common[: max(0, room + g - len(rare))]
        sub = (mix64(prefix) % np.uint64(g)).astype(np.int64)
        order = np.argsort(sub, kind="stable")
        sub, prefix = sub[order], prefix[order]
        for gap in range(1, len(prefix)):
            same = np.flatnonzero(sub[gap:] == sub[:-gap])
            if not len(same):
                break
            # inside a sub-class the order is kept: the pair's second member, before which at most g are shared
            low, high, place = prefix[same], prefix[same + gap], alone + len(rare) + order[same + gap]
            with np.errstate(over="ignore"):
                out.append(mix64(low * np.uint64(0x9E3779B97F4A7C15) + mix64(high + np.uint64(q))))
            caps.append(n - np.maximum(alone, place - g))
    return np.concatenate(out), np.concatenate(caps)


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """For each set PARITY words of 64 bits: a bit is set if an odd number of members fall on it. Each member that only one of two
    sets has flips one bit, so the sets differ in at least as many members as their parities in bits."""
    bits = 64 * PARITY
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    odd = np.bincount(owner * bits + (flat % np.uint64(bits)).astype(np.int64), minlength=bits * len(sets)) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8").reshape(len(sets), PARITY)


class Rows:
    """Rows of buckets: n (size of the set), cap, parity. may_link() is false only for pairs that can't reach the threshold with this as
    their first shared signature: by sizes, by caps, or as the parities differ in more bits than linked sets in members."""

    def __init__(self, n: np.ndarray, cap: np.ndarray, parity: np.ndarray, percent: int):
        self.n, self.cap, self.parity, self.percent = n.astype(np.int64), cap.astype(np.int64), parity, percent

    def may_link(self, x, y) -> np.ndarray:
        n, p = self.n[x] + self.n[y], self.percent
        ok = (100 * np.minimum(self.n[x], self.n[y]) >= p * np.maximum(self.n[x], self.n[y])) & ((100 + p) * np.minimum(self.cap[x], self.cap[y]) >= p * n)
        differ = np.bitwise_count(self.parity[x] ^ self.parity[y]).sum(-1, dtype=np.int64)
        return ok & (differ * (100 + p) <= n * (100 - p))


def forest(rows: Rows, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what may_link() connects, of rows in left with rows in right (the same array: all pairs), both in
    ascending order of size: at most one less than there are rows. Blocks of left rows meet the right ones together; those that are in
    one tree with all of the block already are passed over."""
    tree = {int(i): int(i) for i in np.concatenate([left, right])}

    def find(i):
        while tree[i] != i:
            tree[i] = tree[tree[i]]
            i = tree[i]
        return i

    label = np.zeros(len(rows.n), np.int64)
    label[left], label[right] = left, right
    same, edges, at = left is right, [], 0
    while at < len(left):
        step = max(1, min(64, (1 << 19) // len(right)))
        block = left[at : at + step]
        at += step
        top = np.searchsorted(rows.n[right], rows.n[block[-1]] * 100 // rows.percent, "right")
        low = np.searchsorted(rows.n[right], least_overlap(int(rows.n[block[0]]), rows.percent))
        other = right[(at - step if same else low) : top]
        if (label[block] == label[block[0]]).all():
            other = other[label[other] != label[block[0]]]
        if not len(other):
            continue
        x, y = np.nonzero(rows.may_link(block[:, None], other[None, :]))
        pairs = np.unique(np.column_stack([label[block[x]], label[other[y]], block[x], other[y]])[label[block[x]] != label[other[y]]], axis=0)
        new = pairs[np.r_[True, (pairs[1:, :2] != pairs[:-1, :2]).any(1)]] if len(pairs) else pairs
        for _, _, i, j in new.tolist():
            a, b = find(i), find(j)
            if a != b:
                tree[max(a, b)] = min(a, b)
                edges.append((i, j))
        if len(new):
            seen = np.unique(label[np.concatenate([left, right])])
            moved = np.arange(len(label))
            moved[seen] = [find(i) for i in seen.tolist()]
            label = moved[label]
    return edges


def possible(group: np.ndarray, side: np.ndarray, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
    """Edges (x, y) between rows of the same group, in order of group and size, that connect what may link. side: 0 where a group's rows
    all meet each other, else 1 and 2 for the rows of two shares, of which only those of different ones do."""
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, len(group)])
    of = np.repeat(np.arange(len(first)), size)
    begin = first[of]
    whole = side[begin] == 0
    # most buckets: all may link with their first
    star = rows.may_link(np.arange(len(of)), begin)
    full = np.minimum.reduceat(star, first) & whole[first] if len(first) else np.zeros(0, bool)
    is_star = full[of] & (begin != np.arange(len(of)))
    x, y = [begin[is_star]], [np.flatnonzero(is_star)]
    # small ones: all pairs, by distance
    left = np.flatnonzero((~full & (size > 2) & (size <= 64) & whole[first])[of])
    for gap in range(1, 64):
        left = left[left + gap < first[of[left]] + size[of[left]]]
        if not len(left):
            break
        ok = left[rows.may_link(left, left + gap)]
        x.append(ok)
        y.append(ok + gap)
    for k in np.flatnonzero((~full & (size > 64)) | ~whole[first]).tolist():
        here = np.arange(first[k], first[k] + size[k])
        one, two = (here, here) if whole[first[k]] else (here[side[here] == 1], here[side[here] == 2])
        if len(one) and len(two) and len(here) > 1:
            got = np.array(forest(rows, one, two), np.int64).reshape(-1, 2)
            x.append(got[:, 0])
            y.append(got[:, 1])
    return np.concatenate(x), np.concatenate(y)


def _sets_of(batch: pa.RecordBatch, shingle: int):
    for part in pieces(batch, "text"):
        sets = shingle_sets(part.column("text"), shingle)
        yield part, sets, set_keys(sets)


@dataclass
class Join:
    """members: key (of a distinct set), doc, n. linked: key, component (the least key of its component), and linked, how many rows of
    the table have another set that links with it; of the keys with links. candidates: key, component, of the sets
    that may link, which hold every link inside a component. sets: key, members, in which a key may stand several times."""

    members: DataFrame
    linked: DataFrame
    candidates: DataFrame
    sets: DataFrame
    percent: int


def components(links: DataFrame) -> DataFrame:
    """(key, component) of all keys in links (a, b). Each key takes the least label around it, then its label's label, until nothing
    changes; the rounds grow with the logarithm of the longest chain. Every round is a table in the shared folder."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.distinct(), "edges")
    fresh = stored(both.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("near")).select("key", F.least("key", "near").alias("component")), "labels")
    while True:
        near = both.join(fresh.withColumnRenamed("key", "b"), "b").groupBy(F.col("a").alias("key")).agg(F.min("component").alias("near"))
        closer = fresh.join(near, "key").select("key", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        jumped = closer.join(closer.select(F.col("key").alias("k"), F.col("component").alias("c")), F.col("component") == F.col("k"))
        now = stored(jumped.select("key", F.least("component", "c").alias("component"), "was"), "labels")
        fresh = now.select("key", "component")
        if now.filter(F.col("component") != F.col("was")).isEmpty():
            return fresh


def _shares(rows: DataFrame, of: list[str], shares: str, by: str) -> DataFrame:
    """rows with share, one, two: a group `of` with several shares has each row in one of them by the hash of `by`, and a copy of it for
    each meeting of its share with another, or with itself."""
    rows = rows.withColumn("share", F.pmod(F.xxhash64(by), F.col(shares)).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), (F.col(shares) - 1).cast("int"))))
    return rows.withColumn("one", F.least("share", "with")).withColumn("two", F.greatest("share", "with")).drop("with")


def _edges(made: DataFrame, percent: int, bucket: int) -> DataFrame:
    """(a, b): edges between keys that may link, from all buckets of signatures. A sketch finds the signatures that one set alone has,
    which stay at home, and those of more than `bucket` rows, which are dealt into shares."""
    spark = made.sparkSession
    signed = made.filter(F.col("kind") == 1).select("sig", "key", "n", "cap", "parity")
    bits = min(28, max(20, (8 * signed.count()).bit_length()))

    def cells(batches):
        yield from cell_batches((b.column("sig").to_numpy().view(np.uint64) for b in batches), bits)

    twice, often, _ = sketch(signed.select("sig").mapInArrow(cells, "block int, cells binary"), bits, bucket + 1)
    maps = spark.sparkContext.broadcast((twice, often))

    def shared(batches):
        for batch in batches:
            sig = batch.column("sig").to_numpy().view(np.uint64)
            batch = batch.append_column("hot", pa.array(in_map(maps.value[1], sig, bits)))
            yield batch.filter(pa.array(in_map(maps.value[0], sig, bits)))

    rows = signed.mapInArrow(shared, "sig long, key binary, n int, cap int, parity binary, hot boolean")
    zero = [F.lit(0).alias(k) for k in ("share", "one", "two")]
    if often.any():
        many = rows.filter("hot").groupBy(F.col("sig").alias("s")).agg(F.ceil(F.count(F.lit(1)) / bucket).cast("int").alias("shares"))
        hot = _shares(rows.filter("hot").join(many, F.col("sig") == F.col("s")), ["sig"], "shares", "key")
        columns = ["sig", "key", "n", "cap", "parity", "share", "one", "two"]
        rows = rows.filter("not hot").select(*columns[:5], *zero).unionByName(hot.select(*columns))
    else:
        rows = rows.select("sig", "key", "n", "cap", "parity", *zero)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            names = ("sig", "one", "two")
            group = np.column_stack([batch.column(k).to_numpy() for k in names])
            at = 0
            if held and len(group) and size >= 1 << 16 and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in names):
                yield from judge(held)
                held, size = [], 0
            for end in [*(np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1).tolist(), len(group)] if len(group) else []:
                if end - at + size >= 1 << 16 or end == len(group):
                    held.append(batch.slice(at, end - at))
                    size += end - at
                    at = end
                    if size >= 1 << 16 and end != len(group):
                        yield from judge(held)
                        held, size = [], 0
        if held:
            yield from judge(held)

    def judge(held):
        t = pa.Table.from_batches(held).combine_chunks()
        sig, n, cap, share, one, two = (t.column(k).to_numpy() for k in ("sig", "n", "cap", "share", "one", "two"))
        keys, parity = as_words(t.column("key"), 2), as_words(t.column("parity"), PARITY)
        order = np.lexsort((keys[:, 1], keys[:, 0], n, two, one, sig))
        sig, n, cap, share, one, two, keys, parity = (v[order] for v in (sig, n, cap, share, one, two, keys, parity))
        # several tasks may send a set
        fresh = np.r_[True, (keys[1:] != keys[:-1]).any(1) | (sig[1:] != sig[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])]
        sig, n, cap, share, one, two, keys, parity = (v[fresh] for v in (sig, n, cap, share, one, two, keys, parity))
        group = np.cumsum(np.r_[True, (sig[1:] != sig[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
        x, y = possible(group, np.where(one == two, 0, np.where(share == one, 1, 2)), Rows(n, cap, parity, percent))
        if len(x):
            pairs = np.unique(np.column_stack([keys[x], keys[y]]), axis=0)
            yield pa.RecordBatch.from_arrays([pair_keys(pairs[:, 0], pairs[:, 1]), pair_keys(pairs[:, 2], pairs[:, 3])], ["a", "b"])

    return rows.repartition("sig", "one", "two").sortWithinPartitions("sig", "one", "two").mapInArrow(run, "a binary, b binary")


def as_words(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A column of byte strings of one length as rows of `width` words of 64 bits."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    _, _, data = column.buffers()
    return np.frombuffer(data, "<u8", count=width * (column.offset + len(column))).reshape(-1, width)[column.offset :]


def _sets(rows: DataFrame, candidates: DataFrame, shingle: int) -> DataFrame:
    """(key, members) of the sets in candidates, and of the few that share a cell of a bitmap with one. They are made from the texts again:
    most sets of a large table have signatures, but few have candidates, and a set is larger than its text."""
    bits = min(28, max(16, (16 * candidates.count()).bit_length()))

    def cells(batches):  # twice each, as a sketch marks what comes twice
        yield from cell_batches((np.repeat(as_words(b.column("key"), 2)[:, 0], 2) for b in batches), bits)

    known = rows.sparkSession.sparkContext.broadcast(sketch(candidates.select("key").mapInArrow(cells, "block int, cells binary"), bits, 1 << 30)[0])

    def made(batches):
        seen: set[bytes] = set()
        for batch in batches:
            for _, sets, keys in _sets_of(batch, shingle):
                key_list = keys.to_pylist()
                some = np.flatnonzero(in_map(known.value, as_words(keys, 2)[:, 0], bits)).tolist()
                some = [i for i in some if len(sets[i]) and key_list[i] not in seen and not seen.add(key_list[i])]
                if some:
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(some)), pa.array([sets[i].tobytes() for i in some], pa.binary())], ["key", "members"])

    return rows.mapInArrow(made, "key binary, members binary")


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, percent: int = 85, bits: int | None = None, frequent: int = FREQUENT, bucket: int = BUCKET, share: int = SHARE) -> Join:
    """Joins all whole texts of docs with each other. Equal sets are one key, so copies are never paired. All links are found and
    counted, and the components are exact; pairs are never rows of a table.

    Null and empty texts have empty sets, which link with nothing. Null keys are members like others. An empty table gives empty
    results. Other columns of docs are not looked at, whatever their names. percent is from 1 to 100."""
    spark = docs.sparkSession
    rows = docs.select(F.col(text).alias("text"))
    if bits is None:  # a word is some 6 characters
        bits = min(MOST_BITS, max(LEAST_BITS, (rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // 2).bit_length()))

    def count(batches):
        def found():
            seen: set[bytes] = set()  # copies in a task count once
            for batch in batches:
                for _, sets, keys in _sets_of(batch, shingle):
                    fresh = [s for s, k in zip(sets, keys.to_pylist()) if k not in seen and not seen.add(k)]
                    yield np.concatenate([*fresh, np.zeros(0, np.uint64)])

        yield from cell_batches(found(), bits)

    twice, often, _ = sketch(rows.mapInArrow(count, "block int, cells binary"), bits, frequent)
    maps = spark.sparkContext.broadcast((twice, often))
    doc_type = docs.schema[key].dataType.simpleString()
    names = ["key", "doc", "n", "sig", "cap", "parity", "kind"]

    def sign(batches):
        twice, often = maps.value
        seen: set[bytes] = set()
        for batch in batches:
            for part, sets, keys in _sets_of(batch, shingle):
                n = np.array([len(s) for s in sets], np.int32)

                def rows(kind, keys, n, part=part, **given):
                    kinds = {"doc": part.column("doc").type, "sig": pa.int64(), "cap": pa.int32(), "parity": pa.binary()}
                    columns = {k: given.get(k, None) for k in kinds}
                    columns = {k: pa.nulls(len(n), kinds[k]) if v is None else v for k, v in columns.items()}
                    columns |= {"key": keys, "n": pa.array(n), "kind": pa.array(np.full(len(n), kind, np.int8))}
                    return pa.RecordBatch.from_arrays([columns[k] for k in names], names)

                yield rows(0, keys, n, doc=part.column("doc"))
                flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
                two, many = in_map(twice, flat, bits), in_map(often, flat, bits)
                at = np.cumsum([0, *n])
                key_list = keys.to_pylist()
                found, kept = [], []
                for i in np.flatnonzero(n).tolist():
                    if key_list[i] in seen:
                        continue
                    seen.add(key_list[i])
                    got = signatures(sets[i], two[at[i] : at[i + 1]], many[at[i] : at[i + 1]], percent)
                    if got is not None and len(got[0]):
                        found.append(got)
                        kept.append(i)
                if kept:
                    own = [sets[i] for i in kept]
                    parity = parities(own)
                    parity = pa.array([p.tobytes() for p in parity], pa.binary())
                    owner = np.repeat(np.arange(len(kept)), [len(s) for s, _ in found])
                    their, size = keys.take(pa.array(kept)), n[kept]
                    sig, cap = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                    yield rows(1, their.take(pa.array(owner)), size[owner], sig=pa.array(sig.view(np.int64)), cap=pa.array(cap.astype(np.int32)), parity=parity.take(pa.array(owner)))

    made = stored(docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).mapInArrow(sign, f"key binary, doc {doc_type}, n int, sig long, cap int, parity binary, kind tinyint"), "signatures")
    members = made.filter(F.col("kind") == 0).select("key", "doc", "n")
    edges = stored(_edges(made, percent, bucket), "edges")
    release(spark)
    candidates = components(edges)
    join = Join(members, None, candidates, _sets(rows, candidates, shingle), percent)
    join.linked = _linked(join, share)
    return join


def component_ids(join: Join, *more: str) -> DataFrame:
    """(doc, n_shingles, component_id), and members' columns `more`, per row of the joined table: the smallest doc reachable by links, itself included. Documents
    with empty sets are alone; a component of null docs only has a null id."""
    least = join.members.filter(F.col("n") > 0).groupBy("key").agg(F.min("doc").alias("least"))
    least = least.join(join.linked.select("key", "component"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    of = least.groupBy("component").agg(F.min("least").alias("component_id"))
    of = least.join(of, "component").select(F.col("key").alias("k"), "component_id")
    rows = join.members.join(of, (F.col("key") == F.col("k")) & (F.col("n") > 0), "left")
    return rows.select(*more, "doc", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc")).alias("component_id"))


def _meetings(join: Join, share: int) -> DataFrame:
    """The sets of each candidate component, for the tasks that compare them: no link is elsewhere. A large component is dealt into shares
    of about `share` shingles, and each two of them (one, two) meet, as each with itself."""
    copies = join.members.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"))
    known = join.candidates.join(copies, "key")
    shares = known.groupBy("component").agg(F.ceil(F.sum("n") / share).cast("int").alias("shares"))
    held = join.sets.join(known.join(shares, "component").select("component", "key", "copies", "shares"), "key")
    return _shares(held, ["component"], "shares", "key").select("component", "one", "two", "share", "shares", "key", "copies", "members")


def linked_in(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int):
    """For each of the sets numbered in left: its number, and the numbers of those in right that reach the threshold with it. Where left
    and right are the same, each pair comes once. All are compared that the sizes allow."""
    size = np.array([len(s) for s in sets], np.int64)
    same = left is right
    right = right[np.argsort(size[right], kind="stable")]
    left = right if same else left
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ids = np.split(ids.astype(np.int32), np.cumsum(size)[:-1])
    flat = np.concatenate([ids[i] for i in right])
    sizes = size[right]
    at = np.concatenate([[0], np.cumsum(sizes)])
    mine = np.zeros(int(flat.max()) + 1 if same else max(int(i.max()) for i in ids) + 1, bool)
    for place, i in enumerate(left.tolist()):
        n = int(size[i])
        low = max(int(np.searchsorted(sizes, least_overlap(n, percent))), place + 1 if same else 0)
        high = int(np.searchsorted(sizes, 100 * n // percent, "right"))
        if low >= high:
            continue
        mine[ids[i]] = True
        common = np.add.reduceat(mine[flat[at[low] : at[high]]], at[low:high] - at[low], dtype=np.int64)
        mine[ids[i]] = False
        found = right[low:high][100 * common >= percent * (n + sizes[low:high] - common)]
        if len(found):
            yield i, found


def _compare(join: Join, share: int, report, schema: str) -> DataFrame:
    """report(keys, copies, shares, linked pairs by number) of every meeting, as rows of schema."""
    percent = join.percent

    def run(batches):
        def meetings():
            now, rows = None, {}
            for batch in batches:
                for c, one, two, s, shares, key, copies, members in zip(*(batch.column(k).to_pylist() for k in ("component", "one", "two", "share", "shares", "key", "copies", "members"))):
                    if (c, one, two) != now:
                        if len(rows) > 1:
                            yield now, rows
                        now, rows = (c, one, two), {}
                    rows[key] = s, copies, np.frombuffer(members, np.uint64), shares  # several tasks may have sent a set
            if len(rows) > 1:
                yield now, rows

        for (_, one, two), rows in meetings():
            keys = sorted(rows)
            of = np.array([rows[k][0] for k in keys])
            left = np.flatnonzero(of == one)
            right = left if one == two else np.flatnonzero(of == two)
            if len(left) and len(right):
                yield from report(keys, np.array([rows[k][1] for k in keys], np.int64), rows[keys[0]][3], linked_in([rows[k][2] for k in keys], left, right, percent))

    met = _meetings(join, share)
    return met.repartition("component", "one", "two").sortWithinPartitions("component", "one", "two").mapInArrow(run, schema)


def all_links(join: Join, share: int = SHARE) -> DataFrame:
    """(a, b), a < b: every pair of different sets that reaches the threshold, once. Copies of a set are one key in members. Its size is
    that of all links, which in a group of near copies grow with the square."""

    def report(keys, _copies, _shares, linked):
        for i, found in linked:
            yield pa.RecordBatch.from_arrays([pa.array([min(keys[i], keys[j]) for j in found], pa.binary()), pa.array([max(keys[i], keys[j]) for j in found], pa.binary())], ["a", "b"])

    return _compare(join, share, report, "a binary, b binary")


def _linked(join: Join, share: int) -> DataFrame:
    """Join.linked. Links are counted where they are found and never written: a meeting gives each of its sets that has links their number
    and the least key of its tree. That is the component where the candidates had one share; else trees are joined."""

    def report(keys, copies, shares, linked):
        n = np.zeros(len(keys), np.int64)
        label = np.arange(len(keys))
        for i, found in linked:
            n[i] += copies[found].sum()
            n[found] += copies[i]
            met = np.unique(label[np.append(found, i)])
            if len(met) > 1:
                label[np.isin(label, met)] = met[0]
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in some], pa.binary()), pa.array([keys[i] for i in label[some]], pa.binary()), pa.array(n[some]), pa.array(np.full(len(some), shares == 1))], ["key", "near", "linked", "ready"])

    found = stored(_compare(join, share, report, "key binary, near binary, linked long, ready boolean"), "linked")
    ready = found.filter("ready").select("key", F.col("near").alias("component"), "linked")
    rest = found.filter("not ready")
    if rest.isEmpty():
        return ready
    trees = components(rest.filter(F.col("key") != F.col("near")).select(F.col("key").alias("a"), F.col("near").alias("b")))
    return ready.unionByName(rest.groupBy("key").agg(F.sum("linked").alias("linked")).join(trees, "key").select("key", "component", "linked"))


def with_links(join: Join) -> DataFrame:
    """component_ids() with n_links: how many other rows each row links with, copies of its own text included."""
    copies = join.members.filter(F.col("n") > 0).groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    n = copies.join(join.linked, "key", "left").select(F.col("key").alias("k"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    rows = component_ids(join, "key")
    return rows.join(n, F.col("key") == F.col("k"), "left").select("doc", "n_shingles", "component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, n_links, for shingles of 4 words and a similarity of 0.85."""
    return with_links(jaccard_join(table(spark, sf_dir, "documents"))).withColumnRenamed("doc", "doc_id")
