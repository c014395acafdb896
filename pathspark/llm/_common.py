"""Helpers that the training-data operators share: shared-folder tables, word hashing, counting sketches."""

from __future__ import annotations

import atexit
import contextlib
import gc
import hashlib
import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words: what ASCII white space separates. The characters are listed one by one: such a class is a bitmap for Java, faster than a range.
WORD = "[^\\x20\\x09\\x0A\\x0B\\x0C\\x0D]+"
#: Bytes of text that the vectorised code looks at together; it bounds a Python worker's memory.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where none is set, one of our own, but only if driver and executors
    are one process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        path = os.path.join(tempfile.gettempdir(), f"pathspark-{os.getpid()}")
    return path.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may be gone by now
        pass


_owner: list[str | None] = [None]
_owned: dict[str, list[str]] = {}


@contextlib.contextmanager
def tables_of(spark: SparkSession, owner: str):
    """Tables that are stored inside belong to owner. Those that it had before are removed first: a stage of a pipeline begins when
    all that the stages before it have returned is written."""
    for path in _owned.pop(owner, []):
        _remove(spark, path)
    _owner[0] = owner
    try:
        yield
    finally:
        _owner[0] = None


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed when the process ends, or by tables_of()."""
    path = f"{shared_dir(spark)}/pathspark-llm/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    if _owner[0]:
        _owned.setdefault(_owner[0], []).append(path)
    return path


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back. This cuts the lineage; a lost executor
    loses nothing, as the files are not its own. The table is removed when the session's process ends."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    for k, v in options.items():
        writer = writer.option(k, v)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, keep: list[str], **more) -> DataFrame:
    """`row`, a struct of df's columns `keep`, and the expressions in more: so that no name of df's meets one of an operator's own.
    unpacked() is the way back."""
    return df.select(F.struct(*(F.col(c) for c in keep)).alias("row"), *(c.alias(k) for k, c in more.items()))


def unpacked(df: DataFrame, *made) -> DataFrame:
    """The columns in `row` and then those in made; a column of row with the name of one of those is replaced by it."""
    names = set(df.select(*made).columns)
    return df.select(*(F.col("row")[c].alias(c) for c in df.schema["row"].dataType.names if c not in names), *made)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are done: it does so when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def pieces(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Slices of a batch with at most about `limit` bytes of text each; a longer text comes alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > limit:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield batch.slice(at)


def give_back() -> None:
    """Large arrays that are freed go back to the system at once, those of Arrow too: a Python worker serves many tasks, and would keep the
    most that any of them has held. Where the C library isn't GNU's, nothing changes."""
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):
        import ctypes

        mallopt = ctypes.CDLL(None).mallopt
        mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD
        mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD


give_back()


def as_array(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words (runs without space and \\t to \\r) of the texts, one after another, and how many each text has.
    A null text has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    per_text = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    keep = pc.greater(pc.binary_length(flat), 0)
    mask = keep.to_numpy(zero_copy_only=False)
    if mask.all():
        return flat, per_text
    owner = np.repeat(np.arange(len(per_text)), per_text)
    return flat.filter(keep), np.bincount(owner[mask], minlength=len(per_text)).astype(np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Words of more bytes are hashed one by one.
LONG_WORD = 256


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same in every process: eight bytes at a time, all words at once; a long word by a digest
    of its own, so that one blob doesn't cost a round for each eight bytes of it."""
    if not len(words):
        return np.zeros(0, np.uint64)
    wide = pa.types.is_large_string(words.type) or pa.types.is_large_binary(words.type)
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw = np.concatenate([np.frombuffer(data, np.uint8)[at[0] : at[-1]], np.zeros(8, np.uint8)])
    at = at - at[0]
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    starts, left = at[:-1], np.diff(at)
    long = np.flatnonzero(left > LONG_WORD)
    digests = [int.from_bytes(hashlib.blake2b(raw[a : a + n].data, digest_size=8).digest(), "little") for a, n in zip(starts[long], left[long])]
    left = np.where(left > LONG_WORD, 0, left)
    with np.errstate(over="ignore"):
        out = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        who: np.ndarray | slice = slice(None)
        while len(left):
            chunk = eight[starts] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.minimum(left, 8).astype(np.uint64) * np.uint64(8)))
            out[who] = mix64((out[who] ^ chunk) + np.uint64(0xD6E8FEB86659FD93))
            more = np.flatnonzero(left > 8)
            who = more if isinstance(who, slice) else who[more]
            starts, left = starts[more] + 8, left[more] - 8
    out[long] = np.array(digests, np.uint64)
    return out


def gram_hashes(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of n consecutive word hashes, at each position where n words follow (document borders are the caller's)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        base = mix64(words + np.uint64(0x9E3779B97F4A7C15 * (2 * seed + 1) & 0xFFFFFFFFFFFFFFFF))
        out = np.zeros(len(words) - n + 1, np.uint64)
        for i in range(n):
            out *= np.uint64(0x9FB21C651E98DF25)
            out += base[i : i + len(out)]
        return mix64(out)


# A counting sketch: one exact counter for each of 2**bits cells, dealt into blocks of 2**16 cells. Mappers send each
# block's cell numbers as packed 16-bit integers, reducers add them up, and only bitmaps come back; their size is fixed
# by `bits`, whatever the input.
BLOCK_BITS = 16


def cell_rows(cells: np.ndarray, bits: int) -> pa.RecordBatch:
    cells = np.sort(cells)
    blocks = cells >> np.uint32(BLOCK_BITS)
    starts = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]]) if len(cells) else np.zeros(0, np.int64)
    low = (cells & np.uint32((1 << BLOCK_BITS) - 1)).astype("<u2").tobytes()
    ends = np.r_[starts[1:], len(cells)] if len(starts) else starts
    return pa.RecordBatch.from_arrays(
        [pa.array(blocks[starts].astype(np.int32)), pa.array([low[2 * a : 2 * b] for a, b in zip(starts, ends)], pa.binary())],
        ["block", "cells"],
    )


def sketch(cells: DataFrame, bits: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
    """From rows of cell_rows(): bitmaps of the cells counted twice or more and of the frequent ones, and the
    total. A cell is frequent from `least` or, where the cells are crowded, from 8 standard deviations above their
    mean load. Two bitmaps of 2**bits bits reach the driver: 2**(bits-2) bytes, a bound that no input changes."""
    spark = cells.sparkSession

    def add(batches):
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, low in zip(batch.column("block").to_pylist(), batch.column("cells")):
                add_to = counts.setdefault(block, np.zeros(1 << BLOCK_BITS, np.uint32))
                add_to += np.bincount(np.frombuffer(low.as_buffer(), "<u2"), minlength=1 << BLOCK_BITS).astype(np.uint32)
        for block, n in counts.items():
            used = np.flatnonzero(n >= 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([int(n.sum(dtype=np.int64))], pa.int64()), pa.array([used.astype("<u2").tobytes()], pa.binary()), pa.array([n[used].astype("<u4").tobytes()], pa.binary())],
                ["block", "total", "cells", "counts"],
            )

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    summed = stored(cells.repartition(parts, "block").mapInArrow(add, "block int, total long, cells binary, counts binary"), "sketch")
    total = summed.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    load = total / 2**bits
    high = max(least, int(load + 8 * load**0.5) + 1)

    def maps(batches):
        for batch in batches:
            for block, low, n in zip(batch.column("block").to_pylist(), batch.column("cells"), batch.column("counts")):
                low, n = np.frombuffer(low.as_buffer(), "<u2"), np.frombuffer(n.as_buffer(), "<u4")
                both = []
                for chosen in (low, low[n >= high]):
                    bit = np.zeros(1 << BLOCK_BITS, bool)
                    bit[chosen] = True
                    both.append(np.packbits(bit, bitorder="little").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([both[0]], pa.binary()), pa.array([both[1] if (n >= high).any() else b""], pa.binary())], ["block", "twice", "often"])

    width = 1 << (BLOCK_BITS - 3)
    twice, often = np.zeros(1 << (bits - 3), np.uint8), np.zeros(1 << (bits - 3), np.uint8)
    for row in summed.mapInArrow(maps, "block int, twice binary, often binary").toLocalIterator():
        for to, got in ((twice, row["twice"]), (often, row["often"])):
            if got:
                to[row["block"] * width : (row["block"] + 1) * width] = np.frombuffer(got, np.uint8)
    return twice, often, total


def in_map(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    cells = hashes >> np.uint64(64 - bits)
    return (bitmap[(cells >> np.uint64(3)).astype(np.int64)] >> (cells & np.uint64(7)).astype(np.uint8)) & 1 == 1


def range_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each range of word hashes, by what two prefix sums differ in; equal word sequences hash alike
    wherever they stand."""
    ratio = 0x9FB21C651E98DF25 + (seed << 33)
    inverse = pow(ratio, -1, 1 << 64)
    with np.errstate(over="ignore"):
        power = np.full(len(words) + 1, ratio, np.uint64)
        back = np.full(len(words) + 1, inverse, np.uint64)
        power[0] = back[0] = 1
        power, back = np.cumprod(power), np.cumprod(back)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(words + np.uint64(seed)) * power[:-1])])
        return mix64((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def pair_keys(one: np.ndarray, two: np.ndarray) -> pa.Array:
    """Two arrays of 64 bits as an array of 16-byte keys."""
    both = np.column_stack([one, two]).astype("<u8").tobytes()
    return pa.Array.from_buffers(pa.binary(), len(one), [None, pa.py_buffer(np.arange(0, 16 * len(one) + 1, 16, dtype=np.int32)), pa.py_buffer(both)])


def spaced(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes with one space after each, and where each word begins (and the last one's end)."""
    if not len(words):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = words.buffers()
    wide = pa.types.is_large_string(words.type)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw, at = np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]
    out = np.full(len(raw) + len(words), 32, np.uint8)
    out[np.arange(len(raw)) + np.repeat(np.arange(len(words)), np.diff(at))] = raw
    return out, at + np.arange(len(words) + 1)


def cell_batches(hashes, bits: int, most: int = 6_000_000):
    """cell_rows() of many arrays of hashes, put together until there are `most` of them: fewer and longer rows."""
    held, n = [], 0
    for h in hashes:
        held.append((h >> np.uint64(64 - bits)).astype(np.uint32))
        n += len(h)
        if n >= most:
            yield cell_rows(np.concatenate(held), bits)
            held, n = [], 0
    if n:
        yield cell_rows(np.concatenate(held), bits)
