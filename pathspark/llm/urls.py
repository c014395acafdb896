"""URL filters: glob rules in one bit-parallel automaton.

Each rule is a run of states, one bit per character it consumes and one before the first, packed into 64-bit words one rule after
another. A byte c of a URL moves all rules at once: D = ((D << 1) & step[c]) | (D & stay[c]), where step has the states that c enters
and stay those that a wildcard keeps. A rule fits where its last state is set at the end. NumPy holds D of many URLs as one matrix;
the few longest URLs of a batch go on one by one as Python's long integers, so a URL of any length costs a step per byte.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import as_array, packed, table, unpacked

#: States of all rules together. It bounds what travels to the executors: two tables of 256 rows, 64 MB.
MOST_STATES = 1 << 20
#: Numbers of 64 bits in one matrix of states.
BLOCK = 1 << 18
#: With fewer URLs than this left in a block, each goes on alone.
FEW = 12


@dataclass(frozen=True)
class Glob:
    """A pattern over host and path: `?` is one character but no /, `*` any run of such, `**` any run at all, and a backslash takes the
    next character as it is. verdict is what it says of URLs that it fits; name is how results call it."""

    pattern: str
    verdict: str = "block"
    name: str | None = None


@dataclass(frozen=True)
class SiteRule:
    """A rule of a host with all its subdomains, and the beginning of a path."""

    host: str
    path: str
    verdict: str

    def globs(self) -> tuple[Glob, ...]:
        mask = lambda s: "".join("\\" + c if c in "*?\\" else c for c in s)
        name = self.host + self.path
        rest = mask(self.host) + mask(self.path) + "**"
        return Glob(rest, self.verdict, name), Glob("*." + rest, self.verdict, name)


def tokens(pattern: str) -> list[tuple[str, str]]:
    """The pattern's parts: ("is", character), ("any", ""), ("run", "*" or "**"); neighbouring runs are one."""
    out: list[tuple[str, str]] = []
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            n = i
            while i < len(pattern) and pattern[i] == "*":
                i += 1
            out.append(("run", "**" if i - n > 1 else "*"))
            continue
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(("is", pattern[i]))
        else:
            out.append(("any", "") if c == "?" else ("is", c))
        i += 1
    return out


class Automaton:
    """The packed rules. An earlier rule wins over a later one. Texts are UTF-8, and `?` is a whole character: its state is entered by
    a character's first byte and kept by those that follow."""

    def __init__(self, patterns: Sequence[str]):
        start, final, step, stay = [], [], [], []  # bits, and (byte values, bit)
        every, inside, follow = np.arange(256), np.array([b for b in range(256) if b != 0x2F]), np.arange(0x80, 0xC0)
        first = np.array([b for b in range(256) if b != 0x2F and not 0x80 <= b < 0xC0])
        bit = 0
        for pattern in patterns:
            start.append(bit)
            for kind, what in tokens(pattern):
                if kind == "run":
                    stay.append((every if what == "**" else inside, bit))
                    continue
                for b in [first] if kind == "any" else [np.array([x]) for x in what.encode()]:
                    bit += 1
                    step.append((b, bit))
                if kind == "any":
                    stay.append((follow, bit))
            final.append(bit)
            bit += 1
        if bit > MOST_STATES:
            raise ValueError(f"the rules have {bit} states; {MOST_STATES} are the most")
        self.words = max(1, -(-bit // 64))
        self.step, self.stay = (np.zeros((256, self.words), np.uint64) for _ in "ab")
        for table_, entries in ((self.step, step), (self.stay, stay)):
            for values, at in entries:
                table_[values, at // 64] |= np.uint64(1 << at % 64)
        self.start, self.final = (self._bits(x) for x in (start, final))
        self.rule_at = np.array(final, np.int64)

    def _bits(self, at: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for b in at:
            out[b // 64] |= np.uint64(1 << b % 64)
        return out

    def first_fit(self, texts: pa.Array) -> np.ndarray:
        """For each text the first rule that fits it, or -1. A null text fits none."""
        out = np.full(len(texts), -1, np.int64)
        raw = texts.cast(pa.binary())
        offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64) if len(raw) else np.zeros(1, np.int64)
        data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
        starts, sizes = offsets[:-1], np.diff(offsets)
        order = np.argsort(-sizes, kind="stable")
        order = order[raw.is_valid().to_numpy(zero_copy_only=False)[order]]
        size = max(1, BLOCK // self.words)
        for at in range(0, len(order), size):
            block = order[at : at + size]
            out[block] = self._block(data, starts[block], sizes[block])
        return out

    def _block(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The texts' sizes fall, so those that are not at their end are always the first ones."""
        states = np.broadcast_to(self.start, (len(starts), self.words)).copy()
        one, carry = np.uint64(1), np.uint64(63)
        left, done = len(starts), 0
        while left:
            left = int(np.searchsorted(-sizes[:left], -done, side="left"))  # those with more than `done` bytes
            if left <= FEW:
                break
            now = states[:left]
            c = data[starts[:left] + done]
            moved = now << one
            if self.words > 1:
                moved[:, 1:] |= now[:, :-1] >> carry
            moved &= self.step[c]
            now &= self.stay[c]
            now |= moved
            done += 1
        if left:
            step, stay = ([int.from_bytes(row.tobytes(), "little") for row in t] for t in (self.step, self.stay))
            for i in range(left):
                d = int.from_bytes(states[i].tobytes(), "little")
                for c in data[starts[i] + done : starts[i] + sizes[i]].tobytes():
                    d = ((d << 1) & step[c]) | (d & stay[c])
                    if not d:
                        break
                states[i] = np.frombuffer(d.to_bytes(8 * self.words, "little"), np.uint64)
        fits = states & self.final
        word = (fits != 0).argmax(1)
        lowest = fits[np.arange(len(fits)), word]
        lowest = lowest & (~lowest + one)
        found = np.flatnonzero(lowest)
        out = np.full(len(starts), -1, np.int64)
        bit = word[found] * 64 + np.log2(lowest[found].astype(np.float64)).astype(np.int64)
        out[found] = np.searchsorted(self.rule_at, bit)
        return out


#: Production globs for what no site rule decides, the first that fits: sites of gambling, of medicine without a prescription, of
#: adult content, link farms, log-in and shop pages, and files that are no text.
DEFAULT_GLOBS = tuple(
    Glob(p)
    for p in (
        "*casino*/**", "*casino*", "*free-bets*/**", "*free-bets*", "*poker*/**", "*poker*", "*cheap-pills*/**", "*cheap-pills*", "*adult-x*/**", "*adult-x*", "*porn*/**", "*porn*", "*link-farm*/**", "*link-farm*",
        "ads.*/**", "*.ads.*/**", "tracker.*/**", "*/login**", "*/wp-admin/**", "*/cart/**", "*/checkout/**", "**.exe", "**.zip", "**.tar.gz", "**.jpg", "**.png", "**.gif", "**.mp4", "**.mp3", "**.pdf",
    )
)
#: The rules of the registered query, as its contract has them.
SITE_RULES = (SiteRule("com", "/", "allow"), SiteRule("example.com", "/en/", "block"), SiteRule("www.example.com", "/en/", "allow"), SiteRule("net", "/es/", "block"), SiteRule("net", "/fr/", "block"))


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z in lower case; empty without ://, and of null."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; empty without ://, and of null."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def filter_urls(pages: DataFrame, sites: Sequence[SiteRule] = SITE_RULES, globs: Sequence[Glob] = DEFAULT_GLOBS, default: str = "allow", url: str = "url") -> DataFrame:
    """Each row of pages with host, path, rule, glob_rule and verdict. The canonical URL is host and path: the scheme, query and fragment are
    not matched. rule is the longest site rule that fits (of two as long, the one with the longer host, then the earlier); glob_rule is the
    first glob that fits where no site rule does; verdict is that one's, or default's. Rules travel to the tasks as one automaton
    whose size MOST_STATES bounds.

    A null or empty url, or one without ://, has empty host and path: rule is null, and the globs judge the empty text. Repeated rows stay,
    each judged by itself; an empty table gives an empty one. Columns of pages with the names of the five results are replaced."""
    ranked = sorted(enumerate(sites), key=lambda x: (-len(x[1].host + x[1].path), -len(x[1].host), x[0]))
    every = [(g, True) for _, s in ranked for g in s.globs()] + [(g, False) for g in globs]
    automaton = Automaton([g.pattern for g, _ in every])
    said = pa.StructArray.from_arrays(
        [
            pa.array([g.name or g.pattern if site else None for g, site in every] + [None], pa.string()),
            pa.array([None if site else g.name or g.pattern for g, site in every] + [None], pa.string()),
            pa.array([g.verdict for g, _ in every] + [default], pa.string()),
        ],
        ["rule", "glob", "verdict"],
    )

    @F.arrow_udf("struct<rule: string, glob: string, verdict: string>")
    def judge(texts: pa.Array) -> pa.Array:
        found = automaton.first_fit(as_array(texts))
        return said.take(pa.array(np.where(found < 0, len(every), found)))

    rows = packed(pages, pages.columns, host=host_of(F.col(url)), path=path_of(F.col(url)))
    judged = rows.withColumn("said", judge(F.concat("host", "path")))
    return unpacked(judged, F.col("host"), F.col("path"), F.col("said.rule").alias("rule"), F.col("said.glob").alias("glob_rule"), F.col("said.verdict").alias("verdict"))


def op11_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page, and the glob that decided where no rule did."""
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "glob_rule", "verdict")


def _regex(pattern: str) -> str:
    """The pattern as a regular expression, for SQL and tests."""
    plain = lambda c: c if c.isalnum() else "\\" + c
    return "^" + "".join(plain(w) if k == "is" else "[^/]" if k == "any" else ".*" if w == "**" else "[^/]*" for k, w in tokens(pattern)) + "$"


def _sql() -> str:
    ranked = sorted(SITE_RULES, key=lambda s: -len(s.host + s.path))
    fits = lambda s: f"((host = '{s.host}' OR host LIKE '%.{s.host}') AND starts_with(path, '{s.path}'))"
    rule = "CASE " + " ".join(f"WHEN {fits(s)} THEN '{s.host + s.path}'" for s in ranked) + " END"
    glob = "CASE " + " ".join(f"WHEN regexp_matches(host || path, '{_regex(g.pattern)}') THEN '{g.pattern}'" for g in DEFAULT_GLOBS) + " END"
    verdict = "CASE rule " + " ".join(f"WHEN '{s.host + s.path}' THEN '{s.verdict}'" for s in SITE_RULES) + " ELSE CASE WHEN glob_rule IS NULL THEN 'allow' ELSE 'block' END END"
    return f"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
ruled AS (SELECT *, {rule} AS rule FROM parts),
judged AS (SELECT *, CASE WHEN rule IS NULL THEN {glob} END AS glob_rule FROM ruled)
SELECT page_id, host, path, rule, glob_rule, {verdict} AS verdict FROM judged"""


ORACLE = _sql()
