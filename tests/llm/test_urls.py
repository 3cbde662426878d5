import pytest

from veinstone.llm import urls as U

CASES = [
    ("http://WWW.Example.ORG/es/1?x", "www.example.org", "/es/1", "example.org/es/", "block"),
    ("https://a.example.org/en/12", "a.example.org", "/en/12", "example.org/en/1", "block"),
    ("https://a.example.org/en/2", "a.example.org", "/en/2", "org/", "allow"),
    ("https://notorg/x", "notorg", "/x", None, "allow"),
    ("https://x.org", "x.org", "", None, "allow"),
    ("https://x.com/fr/casino", "x.com", "/fr/casino", "com/fr/", "allow"),
    ("https://x.com/de/", "x.com", "/de/", "com/de/", "block"),
    ("https://casino-win.example.net/", "casino-win.example.net", "/", None, "block"),
    ("https://cheapcasinox.net/", "cheapcasinox.net", "/", None, "allow"),
    ("https://free.net/free", "free.net", "/free", None, "allow"),
    ("https://free.net/bets?q#f", "free.net", "/bets", None, "block"),
    ("//free.net/Bets", "", "", None, "block"),
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("http://É.net/ß#x://y", "É.net", "/ß", None, "allow"),
    ("a://b://c", "b:", "//c", None, "allow"),
]


@pytest.mark.parametrize(("url", "host", "path", "rule", "verdict"), CASES)
def test_cases(spark, url, host, path, rule, verdict):
    rows = spark.createDataFrame([(1, url, "clash", "clash")], "page_id long, url string, host string, rule string")
    out = U.filter_urls(rows).collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in out] == [(host, path, rule, verdict)]


def test_counts():
    v = U.Vocabulary([U.Term("bad", 2, "x"), U.Term("a", 1, "x"), U.Term("ab", 1, "x")])
    assert v.hits("bad.bad-xbad a ab a") == (2, 2, 2)
    assert v.hits("aab") == (0, 0, 0) and U.Vocabulary([]).hits("bad") == (0, 0, 0)


def test_weights_add_up(spark):
    terms = [U.Term("one", 1, "x"), U.Term("two", 2, "x"), U.Term("five", 5, "x")]
    rows = spark.createDataFrame([(1, "a://h.net/one/two"), (2, "a://h.net/two/two"), (3, "a://h.net/five"), (4, "a://h.net/one/two/other")], "page_id long, url string")
    out = {r.page_id: (r.verdict, r.strict_hits, r.soft_hits) for r in U.filter_urls(rows, terms=terms, limit=3).collect()}
    assert out == {1: ("block", 0, 2), 2: ("allow", 0, 1), 3: ("block", 1, 0), 4: ("block", 0, 2)}


def test_vocabulary_is_a_table():
    terms = U.read_terms()
    assert len({t.term for t in terms}) == len(terms) > 150 and len({t.language for t in terms}) >= 8 and {t.weight for t in terms} == {1, 2}


def test_long_repeated_and_empty(spark):
    rows = [(1, "http://x.net/" + "free" * 50000), (2, "http://x.net/a"), (2, "http://x.net/a"), (None, "http://x.net/a")]
    assert len(U.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()) == 4
    assert U.filter_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []
