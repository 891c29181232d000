from hypothesis import given, settings
from hypothesis import strategies as st

from tests.oracle import assert_same, connect
from tracemill.llm import queries, url_filter


def brute(url, strict, soft):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in url)
    edge = lambda i: not (0 <= i < len(low) and low[i].isascii() and low[i].isalnum())
    count = lambda terms: sum(any(low.startswith(t, i) and edge(i - 1) and edge(i + len(t)) for i in range(len(low))) for t in terms)
    return count(strict), count(soft)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["xxx", "free", "bet", "a", "-", "/", "é", "FREE", "1", "win"]), max_size=12).map("".join))
def test_counts(url):
    low = url.encode().translate(url_filter.LOWER_BYTES).decode()
    assert url_filter.count_terms(low, ("xxx",), ("free", "bet", "win", "a-a")) == brute(url, ("xxx",), ("free", "bet", "win", "a-a"))


def test_query_equals_its_sql(spark, sf_dir):
    assert_same(queries.op7_url_filter(spark, sf_dir), connect(sf_dir), queries.SQL["op7_url_filter"])


def test_rules_and_odd_rows(spark):
    rows = [
        (1, "http://EN.Example.ORG/en/12?x", "en.example.org", "/en/12", "example.org/en/1", "block"), (2, "https://example.org/es", "example.org", "/es", "org/", "allow"),
        (3, "https://example.org/es/", "example.org", "/es/", "example.org/es/", "block"), (4, "ftp://x.com/de/viagra", "x.com", "/de/viagra", "com/de/", "block"), (5, "http://x.com/fr/viagra", "x.com", "/fr/viagra", "com/fr/", "allow"),
        (6, "http://notorg#/y", "notorg", "", None, "allow"), (7, None, "", "", None, "allow"), (8, "no scheme", "", "", None, "allow"), (9, "http://x.net/viagra", "x.net", "/viagra", None, "block"),
        (10, "http://x.net/free-poker", "x.net", "/free-poker", None, "block"), (11, "http://x.net/free/free", "x.net", "/free/free", None, "allow"), (12, "http://a.org", "a.org", "", None, "allow"), (None, "", "", "", None, "allow"),
        (13, "x://" + "free/" * 20000 + "win", "free", "/" + "free/" * 19999 + "win", None, "block"), (14, "http://a.net/\n://b?c", "a.net", "/\n://b", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u, 1, 2) for i, u, *_ in rows], "page_id bigint, url string, host int, n_soft int")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages).collect()]
    assert sorted(got, key=str) == sorted(((i, h, p, r, v) for i, _, h, p, r, v in rows), key=str)
    assert url_filter.judge(pages.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, rules=(), strict=(), soft=()).collect()} == {"allow"}
