"""Text functions over columns: slots, masks, punctuation, formats."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, MapType, NumericType, StructType, TimestampNTZType, TimestampType

#: The forms of slots and of masked slots.
SLOT = r"\{[a-z_0-9]+\}|\[[a-z_0-9]+\]"
MASK = r"X_[A-Z_0-9]+_X"


# Marks that take no space before them unless a word character follows, brackets that take none, and what is an ending of the
# word before.
_MARKS = ",.;:!?"
_CLOSING = ")]}"
_ENDING = "'s"


def tidy_punctuation(s: Column) -> Column:
    """The text, cut at white space and put together again: a piece that begins with a mark, a closing bracket or an ending goes on the
    piece before, all others after what stood between them, one blank for several. So "a , b" is "a, b", ".5" stays apart, nothing is
    left at the ends."""
    pieces, gaps = F.filter(F.split(s, r"\s+"), lambda p: p != ""), F.regexp_extract_all(F.trim(s, F.lit(" \t\n\r\f\x0b")), F.lit(r"\s+"), F.lit(0))
    marked = lambda p: F.contains(F.lit(_MARKS), F.substring(p, 1, 1)) & ~F.substring(p, 2, 1).rlike(r"\w")
    joins = lambda p: marked(p) | F.contains(F.lit(_CLOSING), F.substring(p, 1, 1)) | p.startswith(_ENDING) & ~F.substring(p, 3, 1).rlike(r"\w")
    gap = lambda g: F.regexp_replace(F.coalesce(g, F.lit("")), r"[ \t][ \t]+", " ")
    both = F.zip_with(pieces, F.concat(F.array(F.lit("")), gaps), lambda p, g: F.when(p.isNotNull(), F.when(joins(p), p).otherwise(F.concat(gap(g), p))))
    return F.when(s.isNotNull(), F.array_join(both, ""))


def strip_context_prefix(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"^Context: patient [^.]+\.", ""))


def fill_slots(text: Column, slots: dict[str, Column], brackets: bool = False) -> Column:
    """Puts values into {slots}, or [slots]; unknown ones stay, and null values leave their slot."""
    for name, value in slots.items():
        slot = F.lit(f"[{name}]" if brackets else "{" + name + "}")
        text = F.replace(text, slot, F.coalesce(value.cast("string"), slot))
    return text


def slots(text: Column, pattern: str = SLOT) -> Column:
    """The distinct slots of a text, sorted; with pattern MASK, of a masked one."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))


def mask(text: Column) -> Column:
    """{name} and [name] as X_NAME_X."""
    found = F.regexp_extract_all(text, F.lit(SLOT), F.lit(0))
    return F.aggregate(found, text, lambda acc, s: F.replace(acc, s, F.concat(F.lit("X_"), F.upper(F.substring(s, F.lit(2), F.length(s) - 2)), F.lit("_X"))))


def unmask(masked: Column, original: Column) -> Column:
    """The masked text with the slots of the original, longest first."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(original, F.lit(SLOT), F.lit(0))), lambda a, b: F.length(b) - F.length(a))
    return F.aggregate(found, masked, lambda acc, s: F.replace(acc, F.concat(F.lit("X_"), F.upper(F.substring(s, F.lit(2), F.length(s) - 2)), F.lit("_X")), s))


def one_decimal(x: Column) -> Column:
    """Half to even, as %.1f of most languages gives for exact halves."""
    return F.format_string("%.1f", F.bround(x, 1))


def parse_local_datetime(s: Column) -> Column:
    """A dateTime whose offset is dropped, not applied; 'Z' is no offset and gives null."""
    return F.when(~s.endswith("Z"), F.try_to_timestamp(F.regexp_replace(s, r"[+-]\d{2}:\d{2}$", "")))


def normalised_levenshtein(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b) / F.nullif(F.greatest(F.length(a), F.length(b)), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def instants_in(s: Column) -> Column:
    """All instants written in a text: pieces between what no instant holds that have a T after the date, end with a zone, and that the
    timestamp parser takes."""
    pieces = F.transform(F.split(s, r"[^0-9A-Za-z:.+-]+"), lambda p: F.rtrim(p, F.lit(".:+-")))
    zoned = lambda p: p.endswith("Z") | (F.substring(p, -3, 1) == ":") & F.substring(p, -6, 1).isin("+", "-")
    return F.filter(pieces, lambda p: (F.length(p) >= 20) & (F.substring(p, 11, 1) == "T") & zoned(p) & F.try_to_timestamp(p).isNotNull())


def content_hash(*columns: str) -> Column:
    """SHA-256 of the compact JSON of the columns in sorted order; nulls are kept as null."""
    return F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"}), 256)


_ESCAPES = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def quoted(s: Column) -> Column:
    """A text as a JSON string of ASCII characters: others are written as \\u and four small hex digits, twice for those that take two."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))

    def one(c: Column) -> Column:
        n = F.ascii(c)
        out = F.when((n >= 32) & (n < 127), c).when(n < 65536, unit(n)).otherwise(F.concat(unit(F.shiftright(n - 65536, 10) + 0xD800), unit((n - 65536).bitwiseAND(F.lit(0x3FF)) + 0xDC00)))
        for k, v in _ESCAPES.items():
            out = F.when(c == k, v).otherwise(out)
        return out

    escaped = F.array_join(F.transform(F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0)), one), "")
    return F.concat(F.lit('"'), F.when(s.rlike(r'["\\]|[^\x20-\x7e]'), escaped).otherwise(s), F.lit('"'))


def canonical_json(c: Column, kind: DataType) -> Column:
    """Compact JSON with the keys of all structs and maps in order, inner ones too; nulls are kept, text is ASCII, instants and dates are ISO
    texts. Equal data of one type has one text, whatever the order of its maps."""
    match kind:
        case StructType():
            fields = [F.concat(F.lit(json.dumps(f.name) + ":"), canonical_json(c[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
            out = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
        case MapType():
            entries = F.array_sort(F.map_entries(c), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
            out = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["key"].cast("string")), F.lit(":"), canonical_json(e["value"], kind.valueType))), ","), F.lit("}"))
        case ArrayType():
            out = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: canonical_json(x, kind.elementType)), ","), F.lit("]"))
        case TimestampType() | TimestampNTZType():
            part = F.date_format(c, "SSSSSS")
            out = F.concat(F.lit('"'), F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.when(part != "000000", F.concat(F.lit("."), part)).otherwise(""), F.lit('"'))
        case NumericType() | BooleanType():
            out = c.cast("string")
        case _:
            out = quoted(c.cast("string"))
    return F.when(c.isNull(), "null").otherwise(out)


def record_hash(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """SHA-256 of the canonical JSON of a row, or of some of its columns."""
    columns = list(columns or df.columns)
    kind = StructType([df.schema[c] for c in columns])
    return F.sha2(canonical_json(F.struct(*columns), kind), 256)


def json_strings(s: Column) -> Column:
    """All strings that are values in a JSON text, at any depth, unescaped; names are none."""
    text = r'"((?:[^"\\]|\\.)*+)"'
    found = F.regexp_extract_all(s, F.lit(rf"{text}\s*+:|{text}"), F.lit(2))  # one after another, so that no match begins inside a string
    plain = F.transform(found, lambda v: F.when(F.contains(v, F.lit("\\")), F.get(F.from_json(F.concat(F.lit('["'), v, F.lit('"]')), "array<string>"), F.lit(0))).otherwise(v))
    return F.filter(plain, lambda v: v != "")
