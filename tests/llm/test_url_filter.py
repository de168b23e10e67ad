import pytest

from cellweave.llm import url_filter as op

SCHEMA = "page_id long, url string, html string, verdict string, node string"


def judged(spark, rows, **options):
    pages = spark.createDataFrame([(i, u, h, "x", "y") for i, (u, h) in enumerate(rows)], SCHEMA)
    return {r.page_id: tuple(r)[1:] for r in op.judge(pages, **options).collect()}


@pytest.mark.parametrize(("url", "answer"), [
    (None, ("", "", None, "allow")), ("", ("", "", None, "allow")), ("example.org/es/", ("", "", None, "allow")), ("://", ("", "", None, "allow")),
    ("http://EXAMPLE.org/es/1?x#y", ("example.org", "/es/1", "example.org/es/", "block")), ("http://a.example.org/en/1x", ("a.example.org", "/en/1x", "example.org/en/1", "block")),
    ("http://badexample.org/es/", ("badexample.org", "/es/", "org/", "allow")), ("http://x.org", ("x.org", "", None, "allow")), ("http://x.com/de/a", ("x.com", "/de/a", "com/de/", "block")),
    ("http://x.com?q=/de/", ("x.com", "", None, "allow")), ("x\n://h.com/fr/#://", ("h.com", "/fr/", "com/fr/", "allow")), ("http://a.net/b://c.org/", ("a.net", "/b://c.org/", None, "allow"))])
def test_rules(spark, url, answer):
    assert judged(spark, [(url, None)])[0] == answer


def canonical(target):
    return f"<html><LINK href='{target}' rel=\"Canonical\"></html>"


def refresh(target):
    return f'<meta http-equiv="refresh" content="0; URL={target}">'


def test_blocks_reach_aliases_and_explicit_allow_goes_first(spark):
    rows = [("http://a.net/1", canonical("http://b.net/2")), ("http://b.net/2#top", refresh("//x.com/de/9")), ("http://c.net/3", canonical("/4")), ("http://c.net/4", ""),
            ("http://d.net/1", canonical("http://x.com/de/1")), ("http://d.net/2", canonical("http://d.net/1")), ("http://y.org/1", canonical("http://d.net/2")),
            ("http://e.net/p/q", canonical("r")), ("http://e.net/p/r", refresh("http://x.com/de/1b")), ("http://f.net", None), ("http://a.net/1", None), ("http://x.com/de/9", None)]
    got = judged(spark, rows)
    assert [got[i][3] for i in range(len(rows))] == ["block", "block", "allow", "allow", "allow", "allow", "allow", "block", "block", "allow", "block", "block"]
    assert got[6][2] == "org/" and got[0][2] is None


def test_given_redirects_and_a_hot_alias(spark):
    rows = [(f"http://h{i}.net/", canonical("http://hub.net/")) for i in range(300)] + [("http://hub.net/", None)]
    assert {v[3] for v in judged(spark, rows).values()} == {"allow"}
    more = spark.createDataFrame([("http://hub.net/", "http://x.com/de/"), (None, "http://q.net/"), ("http://h1.net/", "http://h1.net/")], "source_url string, target_url string")
    assert {v[3] for v in judged(spark, rows, redirects=more).values()} == {"block"}


def test_empty_table(spark):
    assert op.judge(spark.createDataFrame([], SCHEMA)).count() == 0
