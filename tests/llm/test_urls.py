import random
import re

import pyarrow as pa
import pytest

from pathspark.llm import urls
from pathspark.llm.queries import QUERIES
from pathspark.llm.urls import Automaton, Glob, SiteRule, filter_urls


def judged(url, sites, globs, default="allow"):
    """Plain Python version of the operator."""
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    fits = [(len(s.host + s.path), len(s.host), -i, s) for i, s in enumerate(sites) if (host == s.host or host.endswith("." + s.host)) and path.startswith(s.path)]
    if fits:
        s = max(fits, key=lambda x: x[:3])[3]
        return host, path, s.host + s.path, None, s.verdict
    g = next((g for g in globs if re.fullmatch(urls._regex(g.pattern), host + path, re.S)), None)
    return (host, path, None, g.name or g.pattern, g.verdict) if g else (host, path, None, None, default)


@pytest.mark.parametrize("seed", range(3))
def test_automaton_equals_regular_expressions(seed):
    r = random.Random(seed)
    texts = ["".join(r.choice("ab/.é?*\n") for _ in range(r.choice([0, 1, 3, 8, 40]))) for _ in range(3000)] + ["a" * 5000 + "b", "ab" * 4000]
    for size in (1, 5, 90):
        patterns = ["".join(r.choice(["a", "b", "/", ".", "é", "?", "*", "**", "\\*", "\\?", "日"]) for _ in range(r.choice([1, 2, 4, 9]))) for _ in range(size)]
        patterns = [p for p in patterns if p != "**"]
        rx = [re.compile(urls._regex(p), re.S) for p in patterns]
        want = [next((i for i, x in enumerate(rx) if x.fullmatch(t)), -1) for t in texts]
        assert Automaton(patterns).first_fit(pa.array([*texts, None])).tolist() == [*want, -1]


def test_blocks_and_slices_of_urls(monkeypatch):
    monkeypatch.setattr(urls, "BLOCK", 40)
    a = Automaton(["a*", "*/b**"])
    texts = pa.array(["zz", "abc", "x/b/c", None, "", "a/b"] * 30)
    assert a.first_fit(texts.slice(6)).tolist() == [-1, 0, 1, -1, -1, 1] * 29
    assert a.first_fit(texts.slice(0, 0)).tolist() == []


def test_too_many_states():
    with pytest.raises(ValueError, match="states"):
        Automaton(["a" * (urls.MOST_STATES + 1)])


URLS = [
    "http://a.com/x", "http://com/", "http://com", "https://EXAMPLE.com/en/1", "https://www.example.com/en/1", "https://x.www.example.com/en/", "http://b.net/es/1?q=/fr/", "http://b.net/es", "http://net/fr/#x", "http://badnet/fr/", "http://b.net/ES/",
    "b.net/es/", "://b.net/es/", "http://x.org/a?u=http://b.net/es/", "http://x.org?y", "http://x.org#y", "http:///p", "", None, "http://free-bets.org/a", "ftp://É.org/É", "http://x.org/login", "http://x.org/a/login?next", "http://x.org/f.EXE", "http://x.org/f.exe", "a\nb://x.net/es/\nz",
    "http://x.org/" + "y" * 1_500_000 + ".zip", "http://" + "h" * 1_200_000 + ".net/es/",
]


@pytest.mark.parametrize(("sites", "globs", "default"), [(urls.SITE_RULES, urls.DEFAULT_GLOBS, "allow"), ((SiteRule("a.com", "/x", "one"), SiteRule("com", "/xx", "two"), SiteRule("com", "/", "three"), SiteRule("x.org", "", "four")), (Glob("*.net/**", "five", "nets"), Glob("??", "six")), "none"), ((), (), "all")])
def test_urls_equal_brute_force(spark, sites, globs, default):
    rows = [(i, u, "old", "old", b"x") for i, u in enumerate([*URLS, *URLS[:4], "http://a.com/xx"])] + [(None, URLS[0], None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string, said string, host binary")
    got = filter_urls(df, sites, globs, default)
    assert got.columns == ["page_id", "url", "said", "host", "path", "rule", "glob_rule", "verdict"]
    want = [(i, u, "old" if i is not None else None, *judged(u, sites, globs, default)) for i, u, *_ in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_urls_of_nothing(spark):
    assert filter_urls(spark.createDataFrame([], "url string")).collect() == []


def test_op11_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url").collect()
    want = sorted((p, *judged(u, urls.SITE_RULES, urls.DEFAULT_GLOBS)) for p, u in pages)
    assert sorted(map(tuple, QUERIES["op11_urls"](spark, d).collect())) == want
