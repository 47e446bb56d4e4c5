from lociweave.llm import html_extract as h


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.id: (r.text, r.n_chars) for r in h.extract(df, **kw).collect()}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>x";</script></head><body><nav><ul><li><a href="/a">menu</a></li></ul></nav>
<!-- <article>no</article> --><div class="ad">Buy <b>this</b></div><article><h1>A &amp; B</h1><p><b>One  two<br>three<p>Four &#233;&nbsp;five<aside>side</aside></p><div class="comments">rude</div><form>f</form></article><footer>&copy; x</footer></body></html>"""


def test_article(spark):
    got = run(spark, [(1, "http://a.org/1", PAGE), (2, "http://a.org/2", None), (3, None, ""), (4, "http://a.org/4", "plain &lt;text&gt; here")])
    assert got[1] == ("A & B\n\nOne two three\n\nFour é five", len("A & B\n\nOne two three\n\nFour é five"))
    assert got[2] == got[3] == ("", 0)
    assert got[4][0] == "plain <text> here"


def test_suffix_array_finds_repeats_over_pages(spark):
    boiler = "all rights reserved by the owner of this site and its partners"
    rows = [(k, "http://x.org/" + str(k), f"<body><div>{boiler}</div><div>page {k} says {' '.join(f'u{k}w{j}' for j in range(9))}</div></body>") for k in range(5)]
    rows.append((9, "http://other.org/", f"<body><div>{boiler}</div></body>"))
    got = run(spark, rows)
    for k in range(5):
        assert got[k][0] == f"page {k} says {' '.join(f'u{k}w{j}' for j in range(9))}"
    assert got[9][0] == boiler  # nothing repeats on that host


def test_repeats_over_shards(spark):
    boiler = "all rights reserved by the owner of this site and its partners"
    rows = [(k, "http://x.org/" + str(k), f"<body><div>{boiler}</div><div>only on {' '.join(f'v{k}x{j}' for j in range(7))}</div></body>") for k in range(12)]
    got = run(spark, rows, shard_pages=1)
    assert all(got[k][0] == f"only on {' '.join(f'v{k}x{j}' for j in range(7))}" for k in range(12))


def test_suffix_array_against_brute_force():
    import random

    import numpy as np

    r = random.Random(3)
    streams = [np.array([r.randrange(4) for _ in range(r.randint(0, 40))], np.int64) for _ in range(6)]
    got = h.repeated(streams, 4)
    for i, s in enumerate(streams):
        want = [False] * len(s)
        for a in range(len(s) - 3):
            part = s[a : a + 4].tolist()
            if any(t[b : b + 4].tolist() == part for j, t in enumerate(streams) if j != i for b in range(len(t) - 3)):
                for k in range(a, a + 4):
                    want[k] = True
        assert got[i].tolist() == want


def test_order_of_suffixes():
    import numpy as np

    t = np.array([2, 1, 2, 1, 0, 2, 2], np.int64)
    order, rank = h.suffix_order(t)
    assert order.tolist() == sorted(range(7), key=lambda i: t[i:].tolist())
    lcp = h.neighbours_share(t, order, rank)
    assert lcp.tolist()[0] == 0 and max(lcp) == 2


def test_odd_tables(spark):
    assert run(spark, []) == {}
    df = spark.createDataFrame([(1, "http://a.org", PAGE, "h", 3), (1, "http://a.org", PAGE, "h", 3), (None, None, None, None, None)], "page_id long, url string, html string, host string, shard int")
    assert sorted(len(r.text) for r in h.extract(df).collect()) == [0, 33, 33]


def test_test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = {r.page_id: r.html for r in pages.collect()}
    for r in h.extract(pages).collect():
        assert r.text and "<" not in r.text and "track(" not in r.text
        assert r.text.split("\n\n")[0] in rows[r.id].replace("&amp;", "&")


def text_of(page):
    return h._text(page, None, frozenset(), 6, frozenset(), 24)


def test_what_belongs_to_an_article():
    assert text_of('<article><header class="entry-header"><h1>Title</h1></header><p>x</p></article>') == "Title\n\nx"
    assert text_of('<article><div class="article-header">a</div><p class="market-share">b</p><p class="sub header">c</p></article>') == "a\n\nb\n\nc"
    assert text_of('<main><p>a</p><article class="comment">rude</article><div id="post-comments">ruder</div><article class="card">b</article></main>') == "a\n\nb"
    assert text_of('<article>a<script src="a.js"/>var x=1;</script> b<style/>p{}</style></article>') == "a b"
    assert text_of("<article><math><mi>x</mi></math> <object>o</object> <canvas>c</canvas><svg/> d<svg><text>no</text></svg></article>") == "x o c d"
    assert text_of('<article><p>a</p><div class="ad-slot">no</div><div class="cookie-notice">no</div><div role="alert">no</div><button>no</button><div class="share">no</div><p hidden>no</p><form>no</form></article>') == "a"


NOTICE = " ".join(f"notice{k}" for k in range(30))


def own(k, n=60):
    return " ".join(f"p{k}w{j}" for j in range(n))


def test_repeats_in_main_content(spark):
    page = "<article><p>{}</p><p>{}</p></article>".format
    rows = [(k, f"http://a.org/{k}", page(own(k), NOTICE)) for k in range(8)]  # on all pages: goes
    rows += [(20 + k, f"http://b.org/{k}", page(own(k), NOTICE if k < 4 else own(100 + k))) for k in range(8)]  # on half: stays
    rows += [(40 + k, f"http://c.org/{k}", page(own(7) if k < 6 else own(k), f"end {k}")) for k in range(8)]  # copies: stay
    rows += [(60 + k, f"http://d.org/{k}", page(own(k), NOTICE)) for k in range(4)]  # too few pages: stays
    want = {i: own(k) if i < 20 else None for i, k in ((r[0], r[0]) for r in rows)}
    for shard_pages in (500, 2):
        got = run(spark, rows, shard_pages=shard_pages)
        for i, _, page_html in rows:
            assert got[i][0] == (want[i] or "\n\n".join(page_html.replace("</p></article>", "").replace("<article><p>", "").split("</p><p>")))


def plain_extract(rows, least):
    """Open text without what another page of the host has, token by token."""
    parsed = {i: (url.split("/")[2], h.blocks(page)[0]) for i, url, page in rows}
    out = {}
    for i, (host, blocks) in parsed.items():
        words = [(k, w) for k, (_, t) in enumerate(blocks) for w in t.split()]
        others = [[w for _, t in b for w in t.split()] for j, (o, b) in parsed.items() if j != i and o == host]
        seen = {tuple(o[a : a + least]) for o in others for a in range(len(o) - least + 1)}
        gone = set()
        for a in range(len(words) - least + 1):
            if tuple(w for _, w in words[a : a + least]) in seen:
                gone.update(range(a, a + least))
        left = []
        for k, (state, _) in enumerate(blocks):
            at = [n for n, (b, _) in enumerate(words) if b == k]
            cut, n = set(), 0
            while n < len(at):
                m = n
                while m < len(at) and at[m] in gone:
                    m += 1
                if m - n >= min(least, len(at)):
                    cut.update(at[n:m])
                n = max(m, n + 1)
            kept = [words[n][1] for n in at if n not in cut]
            if state == h.OPEN and kept:
                left.append(" ".join(kept))
        out[i] = "\n\n".join(left)
    return out


def test_hosts_against_plain_python(spark):
    import random

    r = random.Random(5)
    some = [" ".join(r.choice("abcdefgh") for _ in range(r.randint(3, 9))) for _ in range(12)]
    rows = []
    for k in range(40):
        parts = "".join(f"<{t}>{r.choice(some)} {' '.join(r.choice('abcdefghijklmnop') for _ in range(r.randint(0, 12)))}</{t}>" for t in r.choices(["div", "p", "footer", "nav"], [4, 4, 1, 1], k=6))
        rows.append((k, f"http://h{k % 3}.org/{k}", f"<body>{parts}</body>"))
    want = plain_extract(rows, 4)
    for shard_pages in (500, 3):
        assert {i: t for i, (t, _) in run(spark, rows, least=4, shard_pages=shard_pages).items()} == want
