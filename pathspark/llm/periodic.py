"""Periodic runs in the words of a text: suffix array, LCP, longest previous factors, LZ blocks, boundary extensions, copied runs.

A run is a stretch of words that repeats with smallest period q and that no neighbouring word extends. All texts of a slice are handled
together: NumPy sorts their suffixes by prefix doubling, and keeps the class of each substring of 2**k words, which gives the
common extension of any two places, forwards and backwards, in one pass over the k. Only texts with a repeated stretch long
enough for a run go on to longest previous factors and LZ blocks.

Why the block borders suffice. Let a run [s, t) have period q and length L >= 3q, and let block [b, e) hold word s + q. Words from s + q on
repeat those q earlier, so a block that begins in (s + q, t) reaches t at least: one border at most lies in there. (1) e >= t: if s < b the block
has at least L - q words, if s = b or e = t it has the whole run, and else the run is strictly inside it and is a copy of one in the block's
source. (2) e < t: either the next block has q words or more, or t - e < q, and then [b, e) has more than q. So each run that isn't a copy
touches a border with a neighbouring block of q words or more, and the two blocks there have L - q words or more together.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import as_array, packed, pieces, spaced, table, unpacked, words_of

#: A run has this many words, and this many periods, at least.
LEAST, PERIODS = 24, 3


class Suffixes:
    """Sorted suffixes of several texts of word numbers, one after another: no suffix goes beyond its text, and none equals one of another."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        n = len(words)
        self.n, self.ends = n, np.cumsum(sizes)
        self.text = np.repeat(np.arange(len(sizes)), sizes)
        self.begin, self.end = np.repeat(self.ends - sizes, sizes), np.repeat(self.ends, sizes)
        #: levels[k][i]: where the class of the 2**k words from i on begins among all sorted suffixes.
        self.levels: list[np.ndarray] = []
        rank = np.zeros(n, np.int64)
        left, k = np.arange(n), 0
        key = self.text * (int(words.max(initial=0)) + 1) + words
        while len(left):
            order = np.argsort(key)
            left, key = left[order], key[order]
            new = np.r_[True, key[1:] != key[:-1]]
            # the class of a place so far begins where it did; its parts begin one after another from there
            place = np.arange(len(left))
            before = rank[left]
            outer = np.r_[True, before[1:] != before[:-1]]
            rank[left] = before + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(outer, place, 0))
            self.levels.append(rank.astype(np.int32 if n < 1 << 31 else np.int64))
            alone = new & np.r_[new[1:], True]
            left = left[~alone]
            step = 1 << k
            k += 1
            after = left + step
            inside = after < self.end[left]
            second = np.where(inside, rank[np.where(inside, after, 0)] + 1, 0)
            key = rank[left] * (n + 1) + second
        self.rank = rank

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words are equal from places i and j on, in their texts (i != j)."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            a, b, level = i + out, j + out, self.levels[k]
            ok = (a < self.n) & (b < self.n)
            out += np.where(ok & (level[np.where(ok, a, 0)] == level[np.where(ok, b, 0)]), 1 << k, 0)
        return out

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words are equal up to and without places i and j (i < j, of one text)."""
        out = np.zeros(len(i), np.int64)
        least = self.begin[np.minimum(i, self.n - 1)]
        for k in range(len(self.levels) - 1, -1, -1):
            a, b, level = i - out - (1 << k), j - out - (1 << k), self.levels[k]
            ok = a >= least
            out += np.where(ok & (level[np.where(ok, a, 0)] == level[np.where(ok, b, 1)]), 1 << k, 0)
        return out


def previous_factors(order: np.ndarray, lcp: np.ndarray) -> tuple[list[int], list[int]]:
    """From sorted suffixes (places 0 to n-1 in order) and the LCP of each with the one before it: for each place the length of the longest
    factor that also begins somewhere earlier, and where. Places leave the sorted list from the last to the first, so those that are left
    are the earlier ones, and the two neighbours have the longest common beginnings with the one that leaves."""
    n = len(order)
    sorted_place = np.empty(n, np.int64)
    sorted_place[order] = np.arange(n)
    at, where = order.tolist(), sorted_place.tolist()
    common = [*lcp.tolist(), 0]
    before, after = list(range(-1, n)), list(range(1, n + 1))
    length, source = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        r = where[i]
        a, b = before[r], after[r]
        x, y = common[r], common[b]
        if x >= y:
            common[b] = y
            if x:
                length[i], source[i] = x, at[a]
        else:
            common[b] = x
            length[i], source[i] = y, at[b]
        before[b] = a
        if a >= 0:
            after[a] = b
    return length, source


def blocks(length: list[int], ends: list[int]) -> list[int]:
    """Where LZ blocks begin: a block is the longest previous factor at its place, or one new word; texts end at `ends`."""
    out, i = [], 0
    for end in ends:
        while i < end:
            out.append(i)
            i += length[i] or 1
    return out


def border_runs(s: Suffixes, starts: np.ndarray, sizes: np.ndarray, least: int, periods: int, together: int = 1 << 20) -> dict[tuple[int, int], int]:
    """{(begin, end): period} of the runs that touch a border of blocks: for each period up to the longer of the two blocks there, the
    words from the border on, and before it, are compared with those one period later and with those one period earlier. A stretch with
    several periods has the smallest."""
    runs: dict[tuple[int, int], int] = {}
    text = s.text[starts]
    last = np.flatnonzero(np.r_[text[1:] != text[:-1], True])  # a text's end is a border too
    former = np.where(np.r_[False, text[1:] == text[:-1]], np.r_[0, sizes[:-1]], 0)
    border, low, high = (np.r_[x, y] for x, y in ((starts, s.end[starts[last]]), (s.begin[starts], s.begin[starts[last]]), (s.end[starts], s.end[starts[last]])))
    longer, both = np.r_[np.maximum(former, sizes), sizes[last]], np.r_[former + sizes, sizes[last]]
    some = np.flatnonzero(both >= least - least // periods)
    border, low, high = border[some], low[some], high[some]
    n = np.minimum(longer[some], (high - low) // periods)
    until = np.cumsum(n)
    words = s.levels[0]
    for at in range(0, int(n.sum()), together):
        number = np.arange(at, min(at + together, int(until[-1])))
        which = np.searchsorted(until, number, side="right")
        period = number - (until[which] - n[which]) + 1
        for shift in (0, 1):
            i = border[which] - shift * period
            j = i + period
            fits = (i >= low[which]) & (j <= high[which])
            right = fits & (j < high[which])
            right &= words[np.where(right, i, 0)] == words[np.where(right, j, 0)]
            left = fits & (i > low[which])
            left &= words[np.where(left, i, 1) - 1] == words[np.where(left, j, 1) - 1]
            kept = np.flatnonzero(right | left)
            a, q, right, left = i[kept], period[kept], right[kept], left[kept]
            to, back = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
            to[right] = s.ahead(a[right], a[right] + q[right])
            back[left] = s.behind(a[left], a[left] + q[left])
            good = to + back + q >= np.maximum(least, periods * q)
            for begin, end, p in zip((a - back)[good].tolist(), (a + q + to)[good].tolist(), q[good].tolist()):
                if runs.get((begin, end), p) >= p:
                    runs[begin, end] = p
    return runs


def copy_runs(runs: dict[tuple[int, int], int], starts: list[int], length: list[int], source: list[int], least: int) -> None:
    """Adds the runs that lie strictly inside a block: those of its source, kept in buckets by where they begin. Blocks go from left to
    right, and begins too, so what was copied is there to be copied again, within the same block if it overlaps its source."""
    buckets: dict[int, list[tuple[int, int]]] = {}
    for (a, b), q in runs.items():
        buckets.setdefault(a, []).append((b, q))
    begins = sorted(buckets)
    for b in starts:
        if length[b] < least + 2:
            continue
        away, e = b - source[b], b + length[b]
        k = bisect_right(begins, source[b])
        while k < len(begins) and begins[k] + away < e:
            x = begins[k]
            for end, q in buckets[x]:
                if end + away < e and (x + away, end + away) not in runs:
                    runs[x + away, end + away] = q
                    if x + away not in buckets:
                        insort(begins, x + away)
                    buckets.setdefault(x + away, []).append((end + away, q))
            k += 1


def find_runs(words: np.ndarray, sizes: np.ndarray, least: int = LEAST, periods: int = PERIODS) -> list[list[tuple[int, int, int]]]:
    """For each text of word numbers (texts one after another, of these sizes) all its runs of at least `least` words and `periods` periods:
    begin, length, period, by begin, then period."""
    if periods < 3:
        raise ValueError("runs of fewer than three periods are not supported")
    out: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    if not len(words):
        return out
    s = Suffixes(words, sizes)
    order = np.empty(s.n, np.int64)
    order[s.rank] = np.arange(s.n)
    # a run has least - least / periods words, or more, in common with itself one period later: only texts in which neighbours among the
    # suffixes have nearly so many (2**k) can have runs
    k = min(len(s.levels), (least - least // periods).bit_length()) - 1
    near = s.levels[k][order[1:]] == s.levels[k][order[:-1]]
    some = np.unique(s.text[order[1:][near]])
    if not len(some):
        return out
    chosen = np.zeros(len(sizes), bool)
    chosen[some] = True
    mine = chosen[s.text]
    place, number = np.flatnonzero(mine), np.cumsum(mine) - 1  # from places in these texts alone to places in all, and back
    order = order[mine[order]]
    lcp = np.r_[0, s.ahead(order[:-1], order[1:])]
    length, source = previous_factors(number[order], lcp)
    ends = np.cumsum(sizes[some])
    starts = blocks(length, ends.tolist())
    at = np.array(starts)
    found = border_runs(s, place[at], np.maximum(np.array(length)[at], 1), least, periods)
    runs = {(int(number[a]), int(number[b - 1]) + 1): q for (a, b), q in found.items()}
    copy_runs(runs, starts, length, source, least)
    text, base = np.repeat(np.arange(len(some)), sizes[some]), ends - sizes[some]
    for (a, b), q in sorted(runs.items(), key=lambda r: (r[0][0], r[1])):
        t = text[a]
        out[some[t]].append((a - int(base[t]), b - a, q))
    return out


RUN = "struct<start: bigint, length: bigint, period: bigint>"


def periodic_runs(docs: DataFrame, text: str = "text", keep: list[str] | None = None, least: int = LEAST, periods: int = PERIODS) -> DataFrame:
    """Each row of docs (columns `keep`, all by default) with n_words, runs (array of start, length, period in words from 0, by start, then
    period: stretches of `least` words and `periods` periods or more), n_removed and collapsed: the words, joined by one space, without
    those that some run contains after its first period.

    A null or empty text has no words, no runs and an empty collapsed text. Rows are handled one by one, so repeated rows stay, a null id
    too; an empty table gives an empty one; columns of docs with the names of the four results are replaced. A text is handled whole, in
    memory that grows with it: some 100 bytes per word, and 4 more for each doubling of its longest repeat."""
    rows = packed(docs, keep or docs.columns, text=F.col(text))

    def work(batches):
        for whole in batches:
            for batch in pieces(whole, "text"):
                words, sizes = words_of(as_array(batch.column("text")))
                numbers = pc.dictionary_encode(words).indices.to_numpy(zero_copy_only=False).astype(np.int64)
                runs = find_runs(numbers, sizes, least, periods)
                ends = np.cumsum(sizes)
                cover = np.zeros(len(numbers) + 1, np.int64)
                for base, found in zip(ends - sizes, runs):
                    for start, n, q in found:
                        cover[base + start + q] += 1
                        cover[base + start + n] -= 1
                stays = np.cumsum(cover[:-1]) == 0
                raw, at = spaced(words)
                kept = raw[np.repeat(stays, np.diff(at))].tobytes()
                cuts = np.r_[0, np.cumsum(np.diff(at) * stays)][np.r_[0, ends]]
                texts = pa.array([kept[a : max(a, b - 1)] for a, b in zip(cuts, cuts[1:])], pa.binary()).cast(pa.string())
                flat = np.array([r for found in runs for r in found], np.int64).reshape(-1, 3)
                listed = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(r) for r in runs])], pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], ["start", "length", "period"]))
                removed = sizes - np.diff(np.r_[0, np.cumsum(stays)][np.r_[0, ends]])
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sizes), listed, pa.array(removed), texts], ["row", "n_words", "runs", "n_removed", "collapsed"])

    schema = rows.select("row", F.lit(None).cast("long").alias("n_words"), F.lit(None).cast(f"array<{RUN}>").alias("runs"), F.lit(None).cast("long").alias("n_removed"), F.lit(None).cast("string").alias("collapsed")).schema
    return unpacked(rows.mapInArrow(work, schema), "n_words", "runs", "n_removed", "collapsed")


def strongest(runs: Column) -> Column:
    """The run with the most periods, exactly; of several the first. Null without runs."""
    return F.reduce(runs, F.get(runs, 0), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def repeated_from(doc_id: Column, text: Column) -> Column:
    """The contract's input: with h = crc32(doc_id) and g = h div 10, the words of one document in ten repeat with period p from word a on;
    a = g mod n, p = 1 + (n - a) div (3 + g mod 8). Other texts stay as they are."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, "[ \t\n\x0B\f\r]+"), lambda w: w != "")
    n = F.size(words)
    a = F.pmod(g, n).cast("int")
    p = (F.floor((n - a) / (g % 8 + 3)) + 1).cast("int")
    period = F.slice(words, a + 1, p)
    body = F.slice(F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), body), " ")).otherwise(text)


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document's words, as the contract repeats them: their number, the strongest one, and digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", repeated_from(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs(docs, keep=["doc_id"]).withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
