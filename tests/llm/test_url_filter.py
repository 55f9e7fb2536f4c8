import random
from fnmatch import fnmatchcase

import numpy as np

from tessera.llm import url_filter as uf

SCHEMA = "page_id long, url string, html string, host string, rule string"


def judged(spark, urls):
    df = spark.createDataFrame([(i, u, "h", "clash", "clash") for i, u in enumerate(urls)], SCHEMA)
    return [(r["host"], r["path"], r["rule"], r["verdict"]) for r in uf.url_filter(df).orderBy("page_id").collect()]


def test_automaton_equals_glob_matching():
    rng = random.Random(0)
    pick = lambda s, n: "".join(rng.choice(s) for _ in range(n))
    globs = [pick("abc*?", rng.randint(0, 9)) for _ in range(150)] + ["*", "", "*a*b*c*", "a" * 130, "*" + "ab" * 70]
    texts = [pick("abc", rng.randint(0, 14)) for _ in range(300)] + ["a" * 130, "c" + "ab" * 70, ""]
    got = uf.Automaton.of([uf.glob_symbols(g) for g in globs]).accepts([list(t.encode()) for t in texts])
    want = np.array([[fnmatchcase(t, g) for g in globs] for t in texts])
    assert (got == want).all()


def test_contract_rules(spark):
    urls = ["http://A.Example.NET/en/x?y", "https://example.net/fr/", "http://net/", "http://net", "http://xnet/", "http://a.example.com/de/1#z", "http://example.com/DE/1", "http://b.org/fr/", "http://org/en/", "http://evil.com/.net/", None, "no scheme", "http://cheap-pills.com/", "x://y://z.net/a", "http://b.org?/fr/", "ftp://é.net/ü"]
    assert judged(spark, urls) == [
        ("a.example.net", "/en/x", "example.net/en/", "allow"), ("example.net", "/fr/", "net/", "block"), ("net", "/", "net/", "block"), ("net", "", None, "allow"), ("xnet", "/", None, "allow"),
        ("a.example.com", "/de/1", "example.com/de/", "block"), ("example.com", "/DE/1", None, "allow"), ("b.org", "/fr/", "org/fr/", "allow"), ("org", "/en/", None, "allow"), ("evil.com", "/.net/", None, "allow"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("cheap-pills.com", "/", None, "block"), ("y:", "//z.net/a", None, "allow"), ("b.org", "", None, "allow"), ("é.net", "/ü", "net/", "block"),
    ]


def test_long_and_no_urls(spark):
    assert judged(spark, ["http://a.net/" + "x" * 20000, "http://a.net/" + "x" * 20000])[0][3] == "block"
    assert judged(spark, []) == []


def test_ids_beyond_doubles_beside_nulls(spark):
    df = spark.createDataFrame([(2**53 + 1, "http://a.net/"), (None, "http://b.org/fr/")], "page_id long, url string")
    assert {r["page_id"] for r in uf.url_filter(df).collect()} == {2**53 + 1, None}
