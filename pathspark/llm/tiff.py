"""Media columns: TIFF. A decoder that walks image directories and yields one row per page, and the encoder that
stores payloads as TIFF samples."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import pieces, table

# Fixed values of the TIFF 6.0 format: tags, bytes per field type, compression schemes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
TYPE_CODE = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 13: "I", 16: "Q", 17: "q", 18: "Q"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773


class TiffError(ValueError):
    """The bytes are not a TIFF file that this decoder reads."""


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i, n = [], 0, 0
    while n < size and i < len(data):
        k = data[i]
        if k < 128:
            out.append(data[i + 1 : i + 2 + k])
            i, n = i + 2 + k, n + k + 1
        elif k > 128:
            out.append(data[i + 1 : i + 2] * (257 - k))
            i, n = i + 2, n + 257 - k
        else:
            i += 1
    return b"".join(out)[:size]


def pack_bits(row: bytes) -> bytes:
    """Runs of three bytes or more as repeats, the rest as literals."""
    a = np.frombuffer(row, np.uint8)
    edges = np.flatnonzero(np.r_[True, a[1:] != a[:-1], True])
    out, literal = [], 0
    for at, end in zip(edges[:-1][np.diff(edges) >= 3].tolist(), edges[1:][np.diff(edges) >= 3].tolist()):
        _literals(row, literal, at, out)
        for k in range(at, end, 128):
            n = min(128, end - k)
            out.append(bytes((257 - n, row[at])) if n > 1 else bytes((0, row[at])))
        literal = end
    _literals(row, literal, len(row), out)
    return b"".join(out)


def _literals(row: bytes, at: int, end: int, out: list[bytes]) -> None:
    for k in range(at, end, 128):
        part = row[k : min(k + 128, end)]
        out += [bytes((len(part) - 1,)), part]


def unlzw(data: bytes, size: int) -> bytes:
    table, out, n, width, bits, held, last = [bytes((i,)) for i in range(256)] + [b"", b""], [], 0, 9, 0, 0, b""
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 256:
            del table[258:]
            width, last = 9, b""
            continue
        if code == 257 or n >= size:
            break
        if code < len(table):
            entry = table[code]
        elif last and code == len(table):
            entry = last + last[:1]
        else:
            raise TiffError("LZW code out of range")
        if last:
            table.append(last + entry[:1])
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        out.append(entry)
        n, last = n + len(entry), entry
    return b"".join(out)[:size]


def lzw(data: bytes) -> bytes:
    codes, widths, table, width, now = [256], [9], {}, 9, b""
    fresh, top = {bytes((i,)): i for i in range(256)}, 258
    table = dict(fresh)
    for i in range(len(data)):
        longer = now + data[i : i + 1]
        if longer in table:
            now = longer
            continue
        codes.append(table[now])
        widths.append(width)
        table[longer] = top
        top += 1
        if top >= (1 << width) and width < 12:
            width += 1
        if top >= 4094:
            codes.append(256)
            widths.append(width)
            table, top, width = dict(fresh), 258, 9
        now = data[i : i + 1]
    if now:
        codes.append(table[now])
        widths.append(width)
        top += 1
        if top >= (1 << width) and width < 12:
            width += 1
    codes.append(257)
    widths.append(width)
    total = np.array(widths)
    bits = (np.repeat(np.array(codes), total) >> (np.repeat(np.cumsum(total), total) - 1 - np.arange(total.sum()))) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def decompress(data: bytes, scheme: int, size: int) -> bytes:
    if scheme == NONE:
        got = data[:size]
    elif scheme == PACKBITS:
        got = unpack_bits(data, size)
    elif scheme == LZW:
        got = unlzw(data, size)
    elif scheme in (DEFLATE, OLD_DEFLATE):
        got = zlib.decompressobj().decompress(data, size)
    else:
        raise TiffError(f"compression {scheme}")
    if len(got) != size:
        raise TiffError("a strip or tile is too short")
    return got


def compress(data: bytes, scheme: int, row: int) -> bytes:
    if scheme == PACKBITS:  # each row by itself, as the format asks
        return b"".join(pack_bits(data[i : i + row]) for i in range(0, len(data), row))
    return {NONE: bytes, LZW: lzw, DEFLATE: lambda d: zlib.compress(d, 1)}[scheme](data)


def directories(data: bytes) -> Iterator[dict[int, tuple]]:
    """The tags of each image directory, in the order of the chain."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or len(data) < 8:
        raise TiffError("no byte order mark")
    magic = struct.unpack_from(order + "H", data, 2)[0]
    if magic not in (42, 43):
        raise TiffError("no TIFF magic number")
    count, word, entry = ("H", "I", 12) if magic == 42 else ("Q", "Q", 20)
    at, seen = struct.unpack_from(order + word, data, 4 if magic == 42 else 8)[0], set()
    while at:
        if at in seen:
            raise TiffError("image directories form a circle")
        seen.add(at)
        try:
            n = struct.unpack_from(order + count, data, at)[0]
            tags: dict[int, tuple] = {0: (order,)}
            for i in range(n):
                p = at + struct.calcsize(count) + entry * i
                tag, kind, many = struct.unpack_from(order + "HH" + word, data, p)
                inline = p + 4 + struct.calcsize(word)
                if kind in TYPE_CODE:
                    where = inline if many * TYPE_BYTES[kind] <= struct.calcsize(word) else struct.unpack_from(order + word, data, inline)[0]
                    tags[tag] = struct.unpack_from(f"{order}{many}{TYPE_CODE[kind]}", data, where)
            yield tags
            at = struct.unpack_from(order + word, data, at + struct.calcsize(count) + entry * n)[0]
        except struct.error as e:
            raise TiffError(f"truncated directory: {e}") from e


def _undo(raw: bytes, rows: int, width: int, samples: int, dtype: np.dtype, predictor: int) -> np.ndarray:
    a = np.frombuffer(raw, dtype).reshape(rows, width, samples)
    if predictor == 2:
        a = np.cumsum(a, axis=1, dtype=a.dtype.newbyteorder("="))
    elif predictor != 1:
        raise TiffError(f"predictor {predictor}")
    return a


def page(data: bytes, tags: dict[int, tuple]) -> np.ndarray:
    """The samples of a page: array[height, width, samples], 8, 16 or 32 bits each, chunky or planar, strips or tiles."""
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, samples, scheme, predictor = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1)
    bits = set(tags.get(BITS, (1,)))
    if len(bits) != 1 or (b := bits.pop()) not in (8, 16, 32):
        raise TiffError(f"bits per sample {bits or b}")
    dtype = np.dtype(f"{tags[0][0]}u{b // 8}")
    planes, each = (samples, 1) if one(PLANAR, 1) == 2 else (1, samples)
    out = np.zeros((height, width, samples), dtype.newbyteorder("="))
    tiled = TILE_OFFSETS in tags
    tw, th = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    offsets, counts = (tags.get(TILE_OFFSETS), tags.get(TILE_COUNTS)) if tiled else (tags.get(STRIP_OFFSETS), tags.get(STRIP_COUNTS))
    if not offsets or not counts or not tw or not th:
        raise TiffError("no strips or tiles")
    across, down = -(-width // tw), -(-height // th)
    if len(offsets) < across * down * planes:
        raise TiffError("strips or tiles are missing")
    for k in range(across * down * planes):
        plane, cell = divmod(k, across * down)
        y, x = cell // across * th, cell % across * tw
        rows = th if tiled else min(th, height - y)
        raw = decompress(data[offsets[k] : offsets[k] + counts[k]], scheme, rows * tw * each * dtype.itemsize)
        got = _undo(raw, rows, tw, each, dtype, predictor)
        out[y : y + th, x : x + tw, plane if planes > 1 else slice(None)] = got[: height - y, : width - x, 0] if planes > 1 else got[: height - y, : width - x]
    return out


def write_tiff(pages: list[dict]) -> bytes:
    """pages: dicts of pixels (array[height, width] of bytes), scheme, predictor, and rows (per strip) or tile (width, height)."""
    out, link = [b"II*\0\0\0\0\0"], 4
    at = 8
    links: list[tuple[int, int]] = []
    for p in pages:
        pixels = p["pixels"]
        height, width = pixels.shape
        if tile := p.get("tile"):
            tw, th = tile
            full = np.zeros((-(-height // th) * th, -(-width // tw) * tw), np.uint8)
            full[:height, :width] = pixels
            cells = [full[y : y + th, x : x + tw] for y in range(0, height, th) for x in range(0, width, tw)]
        else:
            cells = [pixels[y : y + p["rows"]] for y in range(0, height, p["rows"])]
        coded = []
        for c in cells:
            if p["predictor"] == 2:
                c = np.concatenate([c[:, :1], np.diff(c, axis=1)], axis=1)
            coded.append(compress(c.tobytes(), p["scheme"], c.shape[1]))
        offsets = at + np.cumsum([0] + [len(c) for c in coded[:-1]])
        out += coded
        at += sum(map(len, coded))
        if at % 2:
            out.append(b"\0")
            at += 1
        counts = [len(c) for c in coded]
        fields = {WIDTH: width, HEIGHT: height, BITS: 8, COMPRESSION: p["scheme"], PHOTOMETRIC: 1, SAMPLES: 1, PREDICTOR: p["predictor"]}
        fields |= {TILE_WIDTH: tile[0], TILE_HEIGHT: tile[1], TILE_OFFSETS: offsets, TILE_COUNTS: counts} if tile else {STRIP_OFFSETS: offsets, ROWS_PER_STRIP: p["rows"], STRIP_COUNTS: counts}
        extra, entries = b"", b""
        end = at + 2 + 12 * len(fields) + 4
        for tag in sorted(fields):
            v = np.atleast_1d(np.asarray(fields[tag])).astype("<u4")
            if len(v) == 1:
                entries += struct.pack("<HHI", tag, 4, 1) + v.tobytes()
            else:
                entries += struct.pack("<HHII", tag, 4, len(v), end + len(extra))
                extra += v.tobytes()
        links.append((link, at))
        link = at + 2 + 12 * len(fields)
        out += [struct.pack("<H", len(fields)), entries, b"\0\0\0\0", extra]
        at = end + len(extra)
    whole = bytearray(b"".join(out))
    for where, to in links:
        struct.pack_into("<I", whole, where, to)
    return bytes(whole)


def store_payload(payload: bytes, width: int = 576, page_rows: int = 256) -> bytes:
    """A payload of a multiple of `width` bytes as a TIFF file of 8-bit grey pages of at most page_rows rows. What is in the page
    picks its layout: PackBits or LZW strips, deflate strips or deflate tiles, the latter two with horizontal differencing."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, width)
    pages = []
    for y in range(0, len(pixels), page_rows):
        part = pixels[y : y + page_rows]
        kind = zlib.crc32(part[-1].tobytes()) % 32
        how: dict = {"scheme": DEFLATE, "predictor": 2, "rows": 64} if kind < 14 else {"scheme": DEFLATE, "predictor": 2, "tile": (192, 64)} if kind < 27 else {"scheme": PACKBITS, "predictor": 1, "rows": 64} if kind < 31 else {"scheme": LZW, "predictor": 1, "rows": 16}
        pages.append(how | {"pixels": part})
    return write_tiff(pages)


PAGE_SCHEMA = "page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, pixels binary, error string"


def decode_pages(data: bytes | None) -> Iterator[tuple]:
    """A tuple of PAGE_SCHEMA per page. What can't be read ends the walk with one row that has `error`; null and empty bytes give none."""
    if not data:
        return
    n = 0
    try:
        for tags in directories(data):
            a = page(data, tags)
            one = lambda tag, default: int(tags.get(tag, (default,))[0])  # noqa: B023, E731
            yield n, a.shape[1], a.shape[0], a.shape[2], a.itemsize * 8, one(COMPRESSION, NONE), one(PREDICTOR, 1), TILE_OFFSETS in tags, a.tobytes(), None
            n += 1
    except (TiffError, zlib.error, struct.error, IndexError, ValueError, MemoryError) as e:
        yield n, None, None, None, None, None, None, None, None, str(e)


def tiff_pages(df: DataFrame, column: str) -> DataFrame:
    """One row per page of the TIFF files in a binary column: all other columns, then PAGE_SCHEMA's (a column of df with one of
    those names is left out). Files that are null or empty have no rows; damaged ones have a last row with `error`."""
    from pyspark.sql.types import StructType

    made = StructType.fromDDL(PAGE_SCHEMA)
    keep = [c for c in df.columns if c != column and c not in made.names]
    types = [f.dataType for f in made]

    def decode(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            for i, data in enumerate(batch.column(column)):
                for row in decode_pages(data.as_py()):
                    left = [batch.column(c).slice(i, 1) for c in keep]
                    yield pa.RecordBatch.from_arrays(left + [pa.array([v], to_arrow_type(t)) for v, t in zip(row, types)], keep + made.names)

    return df.mapInArrow(decode, StructType([df.schema[c] for c in keep] + made.fields))


FEATURES = "n_pages, mean, standard deviation, entropy in bits, share of equal neighbours"


def features(pages: list[tuple]) -> str:
    pixels = np.concatenate([np.frombuffer(p[8], np.uint8) for p in pages])
    counts = np.bincount(pixels, minlength=256)
    share = counts[counts > 0] / len(pixels)
    return f"{len(pages)},{pixels.mean():.4f},{pixels.std():.4f},{-(share * np.log2(share)).sum():.4f},{(pixels[1:] == pixels[:-1]).mean():.4f}"


def op5_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text as the bytes of a TIFF file, which is then decoded: digests of what was read back. A map over the rows: text, file and
    pages of a row are in memory one document at a time, and nothing is shuffled."""

    def store(batches):
        for whole in batches:
            for batch in pieces(whole, "text"):
                rows = []
                for text in batch.column("text"):
                    raw = (text.as_py() or "").encode()
                    media = store_payload(raw + b"\xff" * (-len(raw) % 576 if raw else 576))
                    pages = list(decode_pages(media))
                    if pages[-1][9]:
                        raise TiffError(pages[-1][9])
                    back = b"".join(p[8] for p in pages)
                    rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(pages)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")] + [pa.array(c, t) for c, t in zip(zip(*rows), schema.types[1:])], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64() if c in ("n_bytes", "payload_bytes", "tail_crc32", "media_bytes") else pa.string()) for c in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"))])
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text").mapInArrow(store, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
