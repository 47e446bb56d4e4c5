from lociweave.llm import url_filter as u
from lociweave.llm.queries import RULES


def run(spark, rows, redirects=None):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    red = spark.createDataFrame(redirects, "src string, dst string") if redirects else None
    return {r.id: (r.host, r.path, r.rule, r.verdict) for r in u.judge(df, RULES, red).collect()}


def test_rules_and_parts(spark):
    got = run(
        spark,
        [(1, "http://A.Example.ORG/es/x?q#f", ""), (2, "https://b.org", None), (3, "nothing", ""), (4, None, ""), (5, "http://com/de/", ""), (6, "http://acom/de/", ""), (7, "x://example.org/en/12?y", ""), (8, "x://example.org/en/2", ""), (9, "http://h.net#a/b", ""), (10, "http://h.com/fr/\n1", "")],
    )
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[2] == ("b.org", "", None, "allow")
    assert got[3] == got[4] == ("", "", None, "allow")
    assert got[5] == ("com", "/de/", "com/de/", "block")
    assert got[6] == ("acom", "/de/", None, "allow")
    assert got[7][2:] == ("example.org/en/1", "block") and got[8][2:] == ("org/", "allow")
    assert got[9] == ("h.net", "", None, "allow")
    assert got[10] == ("h.com", "/fr/\n1", "com/fr/", "allow")


def test_blocks_follow_aliases(spark):
    canon = '<html><head><link href="{}" rel="canonical"></head></html>'
    rows = [
        (1, "http://a.net/1", canon.format("http://bad.com/de/x")),
        (2, "http://b.net/2#top", "<meta http-equiv=refresh content='0; url=http://a.net/1'>"),
        (3, "http://c.net/3", canon.format("/4")),
        (4, "http://c.net/4", ""),
        (5, "http://d.com/fr/5", canon.format("http://bad.com/de/x")),
        (6, "http://e.net/6", canon.format("http://a.org/")),
    ]
    got = {k: v[3] for k, v in run(spark, rows).items()}
    # An allowed alias comes before the block of the same component.
    assert got == {1: "allow", 2: "allow", 3: "allow", 4: "allow", 5: "allow", 6: "allow"}
    got = {k: v[3] for k, v in run(spark, rows[:4] + rows[5:]).items()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 6: "allow"}


def test_given_redirects_and_odd_rows(spark):
    rows = [(1, "http://p.net/", None), (1, "http://p.net/", None), (None, None, None)]
    got = run(spark, rows, [("http://p.net/", "http://q.net/"), ("http://q.net/", "http://r.com/de/"), (None, "http://x.com/de/")])
    assert got[1][3] == "block" and got[None][3] == "allow"
    assert run(spark, []) == {}
    df = spark.createDataFrame([(1, "http://p.net/", "", "x", 1)], "page_id long, url string, html string, host string, verdict int")
    assert [tuple(r) for r in u.judge(df, RULES).collect()] == [(1, "p.net", "/", None, "allow")]


def test_addresses(spark):
    F = __import__("pyspark.sql.functions", fromlist=["col"])
    want = {
        "HTTP://A.Net/x": "http://a.net/x", "http://a.net": "http://a.net/", "http://a.net:80/b/../c?q=../d#f": "http://a.net/c?q=../d", "https://a.net:443/./x/.": "https://a.net/x/", "http://a.net/../../x": "http://a.net/x",
        "http://a.net/a/b/..": "http://a.net/a/", "http://a.net/.hidden/..x": "http://a.net/.hidden/..x", "no url": None, None: None,
    }
    df = spark.createDataFrame([(k,) for k in want], "u string")
    assert {r.u: r.a for r in df.select("u", u.address(F.col("u")).alias("a")).collect()} == want
    base = "http://a.net/x/y?z"
    links = {"../f": "http://a.net/x/../f", "?q": "http://a.net/x/y?q", "#t": base, "g": "http://a.net/x/g", "/h": "http://a.net/h", "//b.org/i": "http://b.org/i", "http://c.org": "http://c.org"}
    df = spark.createDataFrame([(k,) for k in links], "l string")
    assert {r.l: r.a for r in df.select("l", u.absolute(F.lit(base), F.col("l")).alias("a")).collect()} == links


def test_links_are_resolved(spark):
    canon = '<html><head>{}<link href="{}" rel="canonical"></head></html>'
    rows = [
        (1, "http://A.net/x/1", canon.format("", "../f")),
        (2, "http://a.net/f", canon.format("", "HTTP://bad.COM:80/de/x")),
        (3, "http://c.net/3", canon.format('<base href="http://bad.com/de/">', "x")),
        (4, "http://d.net/4?a", canon.format("", "?b")),
        (5, "http://d.net/4?b", canon.format("", "http://bad.com/de/x")),
    ]
    assert {k: v[3] for k, v in run(spark, rows).items()} == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block"}


def test_many_rules_are_joined(spark, monkeypatch):
    import random

    r = random.Random(2)
    rules = [u.Rule(r.choice(["allow", "block"]), r.choice(["org", "a.org", "b.a.org", "com", "x.com"]), "/" + "".join(r.choice("ab/") for _ in range(r.randint(0, 3)))) for _ in range(60)]
    rows = [(k, f"http://{r.choice(['a.org', 'q.b.a.org', 'com', 'y.x.com', 'axcom', 'net'])}/{''.join(r.choice('ab/') for _ in range(r.randint(0, 5)))}", "") for k in range(200)] + [(500, None, None), (501, "http://org", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    told = lambda: sorted(tuple(x) for x in u.judge(df, rules).collect())
    want = told()
    monkeypatch.setattr(u, "_MOST_RULES", 1)
    assert told() == want and len(want) == 202


def test_a_long_page_and_a_long_url(spark):
    far = "http://p.net/" + "a/" * 50_000
    rows = [(1, far, " " * 3_000_000 + '<link rel="canonical" href="http://q.com/de/z">'), (2, "http://q.com/de/z", None)]
    assert {k: v[3] for k, v in run(spark, rows).items()} == {1: "block", 2: "block"}
