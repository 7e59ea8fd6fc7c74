from urllib.parse import urljoin

from pyspark.sql import functions as F

from linewright.llm import url_filter

PAGES = "page_id long, url string, html string"


def judged(spark, rows, links=None, rules=url_filter.RULES):
    pages = spark.createDataFrame([r if len(r) == 3 else (*r, None) for r in rows], PAGES).withColumn("verdict", F.lit("clash"))
    table = url_filter.rule_table(spark, rules)
    more = spark.createDataFrame(links, "url string, target string") if links else None
    return {r["page_id"]: tuple(r)[1:] for r in url_filter.judge(pages, table, more).collect()}


def test_parts_and_rules(spark):
    urls = {
        1: ("HTTP://WWW.Example.ORG/es/x?y#z", ("www.example.org", "/es/x", "example.org/es/", "block")),
        2: ("https://example.org/en/12", ("example.org", "/en/12", "example.org/en/1", "block")),
        3: ("https://example.org/en/2", ("example.org", "/en/2", "org/", "allow")),
        4: ("https://notexample.org/es/", ("notexample.org", "/es/", "org/", "allow")),
        5: ("http://a.com/de/1", ("a.com", "/de/1", "com/de/", "block")),
        6: ("http://a.com/fr/", ("a.com", "/fr/", "com/fr/", "allow")),
        7: ("http://a.com/en/", ("a.com", "/en/", None, "allow")),
        8: ("http://a.org", ("a.org", "", None, "allow")),
        9: ("http://a.org?x=/", ("a.org", "", None, "allow")),
        10: (None, ("", "", None, "allow")),
        11: ("a.org/es/", ("", "", None, "allow")),
        12: ("", ("", "", None, "allow")),
        13: ("x://y.org://z/", ("y.org:", "//z/", None, "allow")),
        14: ("http:///path", ("", "/path", None, "allow")),
        15: ("http://É.org/Ä", ("É.org", "/Ä", "org/", "allow")),
        16: ("http://user@a.org:80/x", ("user@a.org:80", "/x", None, "allow")),
    }
    assert judged(spark, [(i, u) for i, (u, _) in urls.items()]) == {i: e for i, (_, e) in urls.items()}


def link(kind, target):
    if kind == "canonical":
        return f"<html><head><LINK href='{target}' rel=\"canonical\"></head>"
    return f'<meta http-equiv="refresh" content="0; URL={target}">'


def test_block_reaches_aliases_but_not_allowed_pages(spark):
    rows = [
        (1, "http://a.com/de/1", None),
        (2, "http://b.net/x", link("canonical", "http://a.com/de/1")),
        (3, "http://c.net/x", link("refresh", "http://b.net/x")),
        (4, "http://d.org/x", link("canonical", "http://c.net/x")),  # an explicit allow stands
        (5, "http://e.net/x", link("canonical", "/y")),
        (6, "http://f.net/x", "<link rel=stylesheet href='http://a.com/de/1'>"),
        (7, "http://g.net/x", link("canonical", "http://seen.com/de/nowhere")),  # the target is no page
    ]
    verdicts = {k: v[-1] for k, v in judged(spark, rows).items()}
    assert verdicts == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "block"}


def test_relative_targets_resolve_as_browsers_do(spark):
    bases = ["http://a.net/x/y/z.html?q=1", "http://a.net", "https://A.net/", "http://a.net/x?u=/b/c", "http://a.net/x/y/"]
    targets = ["page.html", "../p", "../../../p?a=b", "./", "..", "?id=1", "/", "/a/../b", "/a/./b/", "//c.net/d/e", "http://d.net", "p?x=../y", "a/b/../../c"]
    rows = [(b, t) for b in bases for t in targets]
    found = spark.createDataFrame(rows, "base string, target string").withColumn("got", url_filter.resolved(F.col("base"), F.col("target"))).collect()
    assert {(r["base"], r["target"]): r["got"] for r in found} == {(b, t): urljoin(b, t) for b, t in rows}
    dots = spark.createDataFrame([("https://a.net/", "//c.net/d/../e?x"), ("https://a.net/", "http://c.net/./d/..")], "base string, target string")
    assert [r[0] for r in dots.select(url_filter.resolved(F.col("base"), F.col("target"))).collect()] == ["https://c.net/e?x", "http://c.net/"]
    none = spark.createDataFrame([("http://a.net/", t) for t in ("", "#x", "mailto:a@b.net", None)] + [("x", "p")], "base string, target string")
    assert [r[0] for r in none.select(url_filter.resolved(F.col("base"), F.col("target"))).collect()] == [None] * 5


def test_relative_base_case_and_fragment_links(spark):
    rows = [
        (1, "http://a.com/de/1", None),
        (2, "http://B.net/x/y", link("canonical", "z.html")),
        (3, "http://b.net/x/z.html#part", link("refresh", "HTTP://A.com/de/1#top")),
        (4, "http://c.net/p/q", "<base href='/r/s/'>" + link("canonical", "../t?a=1&amp;b=2")),
        (5, "http://c.net/r/t?a=1&b=2", link("canonical", "//A.COM/de/1")),
        (6, "http://c.net/r/t?a=1", link("canonical", "#here")),
        (7, "http://c.net/r/q?n=2", link("canonical", "?n=1")),
        (8, "http://c.net/r/q?n=1", link("refresh", "../../de/./x/../1")),
        (9, "http://c.net/de/1#f", link("canonical", "http://a.com/x/../de/1")),
        (10, "http://c.net/de/1?", link("canonical", "mailto:x@a.com")),
    ]
    verdicts = {k: v[-1] for k, v in judged(spark, rows).items()}
    assert [k for k, v in verdicts.items() if v == "allow"] == [6, 10]


def test_given_redirects_chain(spark):
    rows = [(i, f"http://h{i}.net/") for i in range(40)] + [(99, "http://x.com/de/")]
    links = [(f"http://h{i}.net/", f"http://h{i + 1}.net/") for i in range(29)] + [("http://x.com/de/", "http://h0.net/"), (None, "http://h35.net/")]
    verdicts = {k: v[-1] for k, v in judged(spark, rows, links).items()}
    assert [k for k, v in verdicts.items() if v == "allow"] == list(range(30, 40))


def test_longest_rule_and_ties(spark):
    rules = [("allow", "a.b/cc/"), ("block", "x.a.b/c"), ("block", "b/"), ("allow", "b/")]
    found = judged(spark, [(1, "http://x.a.b/cc/"), (2, "http://q.b/")], rules=rules)
    assert found[1][2:] == ("x.a.b/c", "block") and found[2][2:] == ("b/", "block")


def test_repeats_and_none(spark):
    pages = spark.createDataFrame([(1, "http://a.com/de/", None)] * 2, PAGES)
    rules = url_filter.rule_table(spark, url_filter.RULES)
    assert [r["verdict"] for r in url_filter.judge(pages, rules).collect()] == ["block", "block"]
    assert url_filter.judge(spark.createDataFrame([], PAGES), rules).collect() == []
