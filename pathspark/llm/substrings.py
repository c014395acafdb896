"""Substring dedup by super-k-mer partitioning.

A window is `window` consecutive words. Its minimiser is the `gram` consecutive words inside it that hash lowest. Consecutive
windows of a document that share a minimiser travel as one packed string to the minimiser's bucket, where sorting counts
all windows exactly: equal windows have equal minimisers, so they meet in one bucket.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from ._common import cell_batches, gram_hashes, in_map, packed, pair_keys, pieces, range_hashes, release, sketch, spaced, stored, table, unpacked, word_hashes, words_of

#: Bounds of the counting sketch: cells as a power of 2. Its bitmap, at most 2**31 / 8 bytes, goes to every executor.
LEAST_BITS, MOST_BITS = 20, 31
#: Super-k-mers whose keys a task remembers before it starts anew.
MOST_SEEN = 1 << 19


def least_places(hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window (by its first word) the place of its minimiser, and all grams' hashes."""
    g = gram_hashes(hashes, gram)
    reach = window - gram + 1
    # the 32 highest bits order the grams, the place breaks ties towards the left: the same choice wherever a window stands
    least = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
    step = 1
    while step * 2 <= reach:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if reach > step:
        least = np.minimum(least[: len(least) - (reach - step)], least[reach - step :])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64), g


def windows_of(per_text: np.ndarray, words: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The first words of all windows, and their texts."""
    owner = np.repeat(np.arange(len(per_text)), per_text)
    starts = np.flatnonzero(owner[: max(0, words - window + 1)] == owner[window - 1 :]) if words >= window else np.zeros(0, np.int64)
    return starts, owner[starts]


def long_minimisers(hashes: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """For each window the hash of its minimiser of four fifths of its words, and where it stands. A window that repeats has one that
    repeats; few others do."""
    place, g = least_places(hashes, window, max(1, window * 4 // 5))
    return place[starts], g


def super_kmers(hashes: np.ndarray, starts: np.ndarray, owner: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows (among starts) that share a minimiser: first and last window, text, minimiser hash. A new one begins
    where the place of the minimiser changes, so two windows that are equal are never in the same one."""
    place, g = least_places(hashes, window, gram)
    place = place[starts]
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1) | (owner[1:] != owner[:-1])])
    last = np.r_[new[1:] - 1, len(starts) - 1]
    return starts[new], starts[last], owner[new], g[place[new]]


def repeated_windows(docs: DataFrame, text: str = "text", window: int = 35, gram: int = 6, bits: int | None = None) -> DataFrame:
    """(text_key, spans): for each distinct text (md5 of its UTF-8 bytes) with windows that start more than once in all texts, the runs of
    such windows as flat pairs: places (from 0, in words) of a run's first and last window.

    A first pass counts long minimisers (of four fifths of a window) in a sketch of 8 cells for each, up to 2**31 cells. Windows
    whose long minimiser stands at one place alone can't repeat, and stay at home. (Where the corpus is so large that the
    sketch is crowded, more windows travel; the result is the same.)
    Equal super-k-mers of a task travel once, with their number, and so do the places of equal texts: a text that a
    third of all rows repeat is no hot bucket."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))

    if bits is None:  # a word is some 6 characters, a long minimiser serves some 4 windows
        chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
        bits = min(MOST_BITS, max(LEAST_BITS, (8 * chars // 24).bit_length()))

    def count(batches):
        def found():
            for batch in batches:
                for part in pieces(batch, "text"):
                    words, n = words_of(part.column("text"))
                    starts, owner = windows_of(n, len(words), window)
                    if len(starts):
                        place, g = long_minimisers(word_hashes(words), starts, window)
                        yield g[place[np.r_[True, (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])]]]

        yield from cell_batches(found(), bits)

    twice = spark.sparkContext.broadcast(sketch(rows.mapInArrow(count, "block int, cells binary"), bits, 1 << 30)[0])

    def chosen(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                words, n = words_of(part.column("text"))
                starts, owner = windows_of(n, len(words), window)
                if not len(starts):
                    continue
                hashes = word_hashes(words)
                place, g = long_minimisers(hashes, starts, window)
                repeated = in_map(twice.value, g[place], bits)
                if repeated.any():
                    first, last, owner, low = super_kmers(hashes, starts[repeated], owner[repeated], window, gram)
                    yield part.column("text"), words, n, first, last, owner, low, [range_hashes(hashes, first, last + window, seed) for seed in (1, 2)]

    def strings(batches):
        """Super-k-mers to their buckets, equal ones of a task once; rows without a string say how often it came again."""
        seen: set[bytes] = set()
        again: dict[bytes, list[int]] = {}
        names = ["low", "part_key", "packed", "times"]

        def rest():
            k = list(again)
            yield pa.RecordBatch.from_arrays([pa.array([again[i][0] for i in k], pa.int64()), pa.array(k, pa.binary()), pa.nulls(len(k), pa.binary()), pa.array([again[i][1] for i in k], pa.int64())], names)

        for _, words, _, first, last, _, low, keys in chosen(batches):
            raw, at = spaced(words)
            buffer = raw.tobytes()
            kept, times = _unique(*keys)
            part_keys = pair_keys(*keys).take(pa.array(kept))
            lows = low.view(np.int64)[kept]
            fresh = []
            for i, (k, n) in enumerate(zip(part_keys.to_pylist(), times.tolist())):
                if k in seen:
                    again.setdefault(k, [int(lows[i]), 0])[1] += n
                else:
                    seen.add(k)
                    fresh.append(i)
            if fresh:
                own = kept[fresh]
                string = [buffer[a:b] for a, b in zip(at[first[own]].tolist(), (at[last[own] + window] - 1).tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(lows[fresh]), part_keys.take(pa.array(fresh)), pa.array(string, pa.binary()), pa.array(times[fresh].astype(np.int64))], names)
            if len(seen) > MOST_SEEN:
                yield from rest()
                seen.clear()
                again.clear()
        yield from rest()

    def places(batches):
        """Where super-k-mers stand, each text of a task once."""
        seen: set[bytes] = set()
        for texts, _, n, first, _, owner, _, keys in chosen(batches):
            ids = {int(i): hashlib.md5(texts[int(i)].as_buffer()).digest() for i in np.unique(owner)}
            own = [i for i, k in ids.items() if k not in seen and not seen.add(k)]
            here = np.flatnonzero(np.isin(owner, own))
            begins = np.cumsum(n) - n
            yield pa.RecordBatch.from_arrays([pair_keys(*keys).take(pa.array(here)), pa.array([ids[i] for i in owner[here].tolist()], pa.binary()), pa.array((first - begins[owner])[here].astype(np.int32))], ["part_key", "text_key", "place"])

    def judge(batches):
        """Buckets come one after another, sorted by minimiser; whole buckets are put together until they hold enough."""
        held, size = [], 0
        for batch in batches:
            at, low = 0, batch.column("low").to_numpy()
            borders = np.flatnonzero(low[1:] != low[:-1]) + 1 if len(low) else []
            if held and len(low) and held[-1].column("low")[-1].as_py() != low[0] and size > 4 << 20:
                yield from _judge(held, window)
                held, size = [], 0
            for end in [*borders, len(low)]:
                piece = batch.slice(at, end - at)
                held.append(piece)
                size += int(pc.sum(pc.binary_length(piece.column("packed"))).as_py() or 0)
                at = end
                if size > 4 << 20 and end != len(low):
                    yield from _judge(held, window)
                    held, size = [], 0
        if held:
            yield from _judge(held, window)

    dealt = rows.mapInArrow(strings, "low long, part_key binary, packed binary, times long").repartition("low").sortWithinPartitions("low", "part_key", F.col("packed").isNull())
    repeated = stored(dealt.mapInArrow(judge, "part_key binary, runs array<int>"), "repeated")
    del dealt
    release(spark)  # the strings have been judged; their shuffle files can go
    found = rows.mapInArrow(places, "part_key binary, text_key binary, place int").join(repeated, "part_key").select("text_key", F.transform("runs", lambda r: r + F.col("place")).alias("runs"))
    return found.groupBy("text_key").agg(F.flatten(F.collect_list("runs")).alias("spans"))


def _unique(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((two, one))
    new = np.flatnonzero(np.r_[True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])])
    return order[new], np.diff(np.r_[new, len(order)])


def _judge(held: list[pa.RecordBatch], window: int):
    rows = pa.Table.from_batches(held).combine_chunks()
    keys = rows.column("part_key").combine_chunks()
    times = rows.column("times").to_numpy()
    # equal strings of several tasks are next to each other, and the first row of them has the string
    raw = np.frombuffer(keys.buffers()[2], "<u8", count=2 * (keys.offset + len(keys))).reshape(-1, 2)[keys.offset :]
    new = np.flatnonzero(np.r_[True, (raw[1:] != raw[:-1]).any(1)])
    times = np.add.reduceat(times, new)
    words, n = words_of(rows.column("packed").combine_chunks().take(pa.array(new)).cast(pa.string()))
    hashes = word_hashes(words)
    begins = np.cumsum(n) - n
    windows = n - window + 1
    owner = np.repeat(np.arange(len(n)), windows)
    starts = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + begins[owner]
    one, two = (range_hashes(hashes, starts, starts + window, seed) for seed in (3, 4))
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    group = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    sums = np.add.reduceat(times[owner[order]], group)
    often = np.zeros(len(order), bool)
    often[order] = np.repeat(sums >= 2, np.diff(np.r_[group, len(order)]))
    # runs of repeated windows, which end with their string
    edge = np.r_[True, owner[1:] != owner[:-1]]
    begin = np.flatnonzero(often & (edge | ~np.r_[False, often[:-1]]))
    end = np.flatnonzero(often & (np.r_[edge[1:], True] | ~np.r_[often[1:], False]))
    if len(begin):
        rel = np.column_stack([starts[begin], starts[end]]) - begins[owner[begin]][:, None]
        who, first = np.unique(owner[begin], return_index=True)
        offsets = np.r_[first, len(begin)] * 2
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(new[who])), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(rel.ravel().astype(np.int32)))], ["part_key", "runs"])


def remove_repeats(docs: DataFrame, text: str = "text", window: int = 35, gram: int = 6, bits: int | None = None) -> DataFrame:
    """docs with the words removed that a window covers whose word sequence starts at another place too, in the same or another
    document; windows are judged on the input. `text` becomes the words that are left, joined by one space; n_words and n_removed
    are added (a column of docs with one of these names is replaced).

    Words are runs without ASCII white space, unchanged. Null and empty texts have no words and become ''. Texts of fewer words than
    a window lose nothing; equal rows of at least one window lose everything; an empty table gives no rows. Other names of columns
    are free.

    A bitmap of fixed size knows the texts that have spans; only those (and the few that share a cell with one) are shuffled to
    meet them, the others are read in place."""
    spark = docs.sparkSession
    spans = stored(repeated_windows(docs, text, window, gram, bits), "spans")
    keep = [c for c in docs.columns if c not in (text, "n_words", "n_removed")]
    rows = packed(docs, keep, _text=F.coalesce(F.col(text), F.lit("")))
    rows = rows.withColumn("_key", F.md5(F.col("_text").cast("binary")))
    size = min(28, max(16, (16 * spans.count()).bit_length()))
    number = F.conv(F.substring(F.hex("text_key"), 1, 15), 16, 10).cast("long")

    def cells(batches):  # twice each, as a sketch marks what comes twice
        yield from cell_batches((np.repeat(b.column("number").to_numpy().astype(np.uint64) << np.uint64(4), 2) for b in batches), size)

    known = spark.sparkContext.broadcast(sketch(spans.select(number.alias("number")).mapInArrow(cells, "block int, cells binary"), size, 1 << 30)[0])

    def marked(batches):
        for batch in batches:
            hashes = np.array([int(k[:15], 16) << 4 for k in batch.column("_key").to_pylist()], np.uint64)
            yield batch.append_column("_some", pa.array(in_map(known.value, hashes, size)))

    def run(batches):
        for whole in batches:
            for part in pieces(whole, "_text"):
                words, n = words_of(part.column("_text"))
                ends = np.cumsum(n)
                begins = ends - n
                lists = part.column("_spans")
                size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                pairs = pc.drop_null(lists).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 2) + np.repeat(begins, size // 2)[:, None]
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, pairs[:, 0], 1)
                np.add.at(cover, pairs[:, 1] + window, -1)
                left = np.cumsum(cover)[:-1] == 0
                raw, at = spaced(words.filter(pa.array(left)))
                count = np.concatenate([[0], np.cumsum(left)])
                lo, hi = at[count[begins]], at[count[ends]]
                buffer = raw.tobytes()
                texts = pa.array([buffer[a : max(a, b - 1)] for a, b in zip(lo.tolist(), hi.tolist())], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column("row"), texts, pa.array(n), pa.array(n - (count[ends] - count[begins]))], ["row", "left", "n_words", "n_removed"])

    tested = rows.mapInArrow(marked, StructType([*rows.schema.fields, StructField("_some", BooleanType())]))
    met = tested.filter("_some").withColumn("_key", F.unhex("_key")).join(spans, F.col("_key") == F.col("text_key"), "left").select("row", "_text", F.col("spans").alias("_spans"))
    alone = tested.filter("not _some").select("row", "_text", F.lit(None).cast("array<int>").alias("_spans"))
    schema = StructType([rows.schema["row"], StructField("left", StringType()), StructField("n_words", LongType()), StructField("n_removed", LongType())])
    return unpacked(met.mapInArrow(run, schema).unionByName(alone.mapInArrow(run, schema)), F.col("left").alias(text), "n_words", "n_removed")


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_words, n_removed, and the digest of the words that are left, for windows of 35 words."""
    left = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
