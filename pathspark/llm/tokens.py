"""Token-ID output: Parquet list columns with chosen encodings, row groups and page indexes."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import new_path, pieces, table, word_hashes, words_of

FILE_SCHEMA = "part int, doc_id long, local_start long, n_tokens int, ids array<int>"
#: ids: dictionary pages (a vocabulary fits one); the counters, which rise or are small: delta pages, which need the v2 writer.
#: parquet-mr writes column and offset indexes by itself; short pages make them selective.
LAYOUT = {
    "parquet.writer.version": "v2", "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": "true", "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(32 << 20), "parquet.page.size": str(64 << 10), "parquet.page.row.count.limit": "2000", "compression": "zstd",
}


class Encoder:
    """Encodes texts word by word, with a bounded cache. A word is what lies between ASCII white space; so this is for tokenizers
    that drop white space and join nothing across it, as word_bpe_49k.json does, which also splits letters from marks and
    lower-cases: a word of letters and then ASCII marks is looked up as its lower-cased letters and its marks. The ids are
    those of the whole text. The cache knows words by 64-bit hashes."""

    def __init__(self, path: str, most: int = 700_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.clear()
        for text, parts in (("ab  cd\tEf.,", ("ab", "cd", "ef", ".,")), ("a1 \n b", ("a1", "b"))):
            if self.tokenizer.encode(text, add_special_tokens=False).ids != sum((self.tokenizer.encode(p, add_special_tokens=False).ids for p in parts), []):
                raise ValueError("this tokenizer keeps white space or joins words across it; Encoder is for those that don't")

    def clear(self) -> None:
        self.hashes, self.starts, self.sizes, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _look_up(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where in self.ids the ids of each string begin, and how many they are."""
        hashes = word_hashes(parts)
        found = np.searchsorted(self.hashes, hashes)
        new = np.flatnonzero(self.hashes[np.minimum(found, len(self.hashes) - 1)] != hashes) if len(self.hashes) else np.arange(len(hashes))
        if len(new):
            _, first = np.unique(hashes[new], return_index=True)
            new = new[first]
            fresh = parts.take(pa.array(new))
            simple = pc.match_substring_regex(fresh, "^[a-z]+$").to_numpy(zero_copy_only=False)
            new = np.concatenate([new[simple], new[~simple]])
            coded, sizes = self._together(fresh.filter(pa.array(simple)).to_pylist())
            rest = fresh.filter(pa.array(~simple))
            for at in range(0, len(rest), 5_000):
                one = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(rest[at : at + 5_000].to_pylist(), add_special_tokens=False)]
                coded += one
                sizes += map(len, one)
            sizes = np.array(sizes, np.int32)
            begin = len(self.ids) + np.cumsum(sizes, dtype=np.int64) - sizes
            all_hashes = np.concatenate([self.hashes, hashes[new]])
            order = np.argsort(all_hashes, kind="stable")
            self.hashes = all_hashes[order]
            self.starts, self.sizes = np.concatenate([self.starts, begin])[order], np.concatenate([self.sizes, sizes])[order]
            self.ids = np.concatenate([self.ids, *coded])
            found = np.searchsorted(self.hashes, hashes)
        return self.starts[found], self.sizes[found].astype(np.int64)

    def _together(self, words: list[str], each: int = 500) -> tuple[list[np.ndarray], list[int]]:
        """The ids of words of small letters, and how many each has. Such a word is one word of the tokenizer's too, so many of them are
        encoded as one text, and its word numbers tell the ids apart: that takes half the time."""
        coded, sizes = [], []
        for at in range(0, len(words), 40 * each):
            some = words[at : at + 40 * each]
            for k, e in enumerate(self.tokenizer.encode_batch([" ".join(some[i : i + each]) for i in range(0, len(some), each)], add_special_tokens=False)):
                n = np.bincount(e.word_ids)
                assert len(n) == min(each, len(some) - k * each) and n.all(), "the tokenizer joins or splits words of small letters"
                coded.append(np.array(e.ids, np.int32))
                sizes += n.tolist()
        return coded, sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and how many each text has."""
        words, per_text = words_of(texts)
        if not len(words):
            return np.zeros(0, np.int32), np.zeros(len(per_text), np.int64)
        if len(self.hashes) > self.most:
            self.clear()
        _, first, index = np.unique(word_hashes(words), return_index=True, return_inverse=True)
        unique = words.take(pa.array(first))
        split = pc.extract_regex(unique, r"^(?P<letters>\p{L}+)(?P<marks>[!-;=?-@\[-`{-~]+)$")
        marked = split.is_valid().to_numpy(zero_copy_only=False)
        plain = pc.match_substring_regex(unique, r"^\p{L}+$")
        heads = pc.if_else(split.is_valid(), pc.struct_field(split, 0), unique)
        heads = pc.if_else(pc.or_(plain, split.is_valid()), pc.ascii_lower(heads), heads)
        tails = pc.struct_field(split, 1).filter(split.is_valid())
        starts, sizes = self._look_up(pa.concat_arrays([heads, tails]))
        m, sizes_of_tails = len(unique), np.zeros(len(unique), np.int64)
        starts_of_tails = np.zeros(m, np.int64)
        starts_of_tails[marked], sizes_of_tails[marked] = starts[m:], sizes[m:]
        # each word's ids are its head's and then its tail's
        n = np.column_stack([sizes[:m], sizes_of_tails])[index].ravel()
        begin = np.column_stack([starts[:m], starts_of_tails])[index].ravel()
        ends = np.cumsum(n)
        out = self.ids[np.repeat(begin - (ends - n), n) + np.arange(ends[-1])]
        upto = np.concatenate([[0], ends[1::2]])[np.cumsum(per_text)]
        return out, np.diff(np.concatenate([[0], upto]))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process: its cache serves all tasks that the process runs."""
    return _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(path))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, key: str = "doc_id", text: str = "text", **layout: str) -> None:
    """Encodes each whole text (null: empty), appends end_id and writes FILE_SCHEMA in ascending order of key (nulls first;
    ties by text) over all files: a range shuffle of the texts, which are smaller than their ids. `part` numbers the files;
    local_start counts the ids before a row in its file."""

    def encode(batches):
        coder, at, part = encoder(tokenizer), 0, TaskContext.get().partitionId()
        for whole in batches:
            for batch in pieces(whole, "text", 1 << 20):
                ids, n = coder.encode(batch.column("text"))
                ends = np.cumsum(n)
                ids, n = np.insert(ids, ends, end_id), n + 1
                offsets = np.concatenate([[0], np.cumsum(n)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, np.int32)), batch.column("doc_id"), pa.array(at + offsets[:-1]), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))],
                    ["part", "doc_id", "local_start", "n_tokens", "ids"],
                )
                at += int(offsets[-1])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    writer = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(encode, FILE_SCHEMA).write
    for k, v in (LAYOUT | layout).items():
        writer = writer.option(k, v)
    writer.parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Selective read of the metadata: doc_id, part, start (ids of all documents before it), n_tokens; the ids' pages stay
    unread. Only one row per file meets in one task."""
    rows = spark.read.schema(FILE_SCHEMA).parquet(path).select("part", "doc_id", "local_start", "n_tokens")
    return _global(rows, spark, path).select("part", "doc_id", "start", F.col("n_tokens").cast("long").alias("n_tokens"))


def _global(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.schema(FILE_SCHEMA).parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("held"))
    base = files.select(F.col("part").alias("p"), F.coalesce(F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return rows.join(base, F.col("part") == F.col("p")).withColumn("start", F.col("base") + F.col("local_start")).drop("p", "base")


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids of the documents from first to last; the range reaches the row groups' and pages' statistics."""
    rows = spark.read.schema(FILE_SCHEMA).parquet(path)
    rows = rows if first is None else rows.filter(F.col("doc_id") >= first)
    rows = rows if last is None else rows.filter(F.col("doc_id") <= last)
    return _global(rows, spark, path).select("doc_id", "start", F.col("n_tokens").cast("long").alias("n_tokens"), "ids")


def token_checksums(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit)."""

    def crc(batches):
        for batch in batches:
            lists = batch.column("ids")
            ids, at = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            n = at[1:] - at[:-1]
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:])]
            assert (n == batch.column("n_tokens").to_numpy()).all(), "a file's ids and counts differ"
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("part", "doc_id", "local_start")] + [pa.array(n.astype(np.int64)), pa.array(sums, pa.int64())], ["part", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    rows = spark.read.schema(FILE_SCHEMA).parquet(path).mapInArrow(crc, "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    return _global(rows, spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_output(docs: DataFrame, name: str = "tokens") -> DataFrame:
    """Writes docs' tokens into the shared folder and returns token_checksums() of the files."""
    spark = docs.sparkSession
    path = new_path(spark, name)
    write_tokens(docs, path, tokenizer_path())
    return token_checksums(spark, path)


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, read back from its token file: start, n_tokens, ids_crc32."""
    return token_output(table(spark, sf_dir, "documents"))
