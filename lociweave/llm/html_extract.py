"""Main text of web pages by repetition over their host.

A page is read into blocks of text. The token streams of a host's pages are
laid end to end, the suffixes sorted, and substrings that neighbours in the
order share across distinct pages are boilerplate; their tokens are removed,
and the runs left are unique. What the markup says is evidence beside it:

* On a page without explicit main content (``article``, ``main``), substrings
  of ``least`` tokens or more that another page of the host has too go. The
  unique runs outside furniture (menus, headers, footers, forms, adverts,
  comments of readers ...) are the text.
* Explicit main content is the text of a page that has it, without the
  furniture inside. Articles quote and copy each other, so in it only
  substrings of ``main_least`` tokens or more go that more than half of the
  host's distinct pages have (and five pages at least), and none where more
  than half of the page's own text would go: that is a copy, not boilerplate.

A host's pages are dealt into shards of bounded size, each with its own array,
so that a host with a third of all pages is no single task. What repeats only
across shards is found through hashes of ``least`` tokens, counted over the
host's shards. Main content enters an array only on hosts where that can
matter: of each page's windows the least hash of every ``main_least -
_WINDOW + 1`` neighbours is counted, so no passage of ``main_least`` tokens can
be on pages without being counted on each of them.
"""

from __future__ import annotations

import html as html_lib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, input_bytes, mix64, prepare
from .shingles import word_hashes
from .url_filter import host_of

_WINDOW = 8  # tokens of the windows that are counted in main content
_LEAST_PAGES = 5

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIP = frozenset("script style noscript template svg iframe head title select textarea option".split())
_FURNITURE = frozenset("nav header footer aside form menu dialog button".split())
_MAIN = frozenset("article main".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - frozenset("body html caption legend option optgroup tbody td tfoot th thead tr li dd dt summary".split())
# Names of classes and ids that mark furniture: as a whole, or as the first or
# last part of a name (cookie-notice, post-comments) ...
_PARTS = frozenset("ad ads advert adverts advertisement advertisements adsense sponsor sponsored promo promoted sidebar nav navbar navigation menu breadcrumb breadcrumbs cookie cookies consent gdpr newsletter popup modal comment comments disqus pagination".split())
# ... as a whole only ...
_WHOLE = frozenset("banner notice share sharing social subscribe related recommended widget pager toolbar respond side-bar".split())
# ... and as a whole, or after site-, page- or global-, outside main content only.
_OUTER = frozenset("header footer masthead".split())
_OF_READERS = frozenset("comment comments reply disqus".split())
_ROLE = frozenset("navigation banner contentinfo complementary search form dialog menu menubar alert".split())
_TAG = re.compile(r"<(?:!--.*?(?:-->|$)|!\[CDATA\[.*?(?:\]\]>|$)|[!?][^>]*(?:>|$)|(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>)", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.S)
_WHITE = re.compile(r"\s+")

_AFTER = {"head": re.compile(r"<body\b", re.I), "option": re.compile(r"<", re.S)}

SETTLED, OPEN, DROPPED, OUTSIDE = 0, 1, 2, 3


@lru_cache(maxsize=64)
def _ends(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I)


def _named(value: str, in_main: bool, parts: frozenset = _PARTS, whole: frozenset = _WHOLE, outer: frozenset = _OUTER) -> bool:
    for name in value.lower().split():
        ends = re.split("[-_]", name)
        if name in whole or ends[0] in parts or ends[-1] in parts:
            return True
        if not in_main and (name in outer or ends[0] in ("site", "page", "global") and ends[-1] in outer):
            return True
    return False


def _furniture(name: str, attrs: str, in_main: bool) -> bool:
    if name in _FURNITURE and not (name == "header" and in_main):
        return True
    if not attrs:
        return False
    lower = attrs.lower()
    if not any(k in lower for k in ("class", "id", "role", "hidden", "style")):
        return False
    if name not in ("body", "html", "main"):
        for k, *v in _ATTR.findall(attrs):
            k, v = k.lower(), "".join(v)
            if k in ("class", "id"):
                if name == "article" and _named(v, True, _OF_READERS, frozenset(), frozenset()) or name != "article" and _named(v, in_main):
                    return True
            elif k == "role" and v.lower() in _ROLE:
                return True
    return _hidden(attrs)


def _hidden(attrs: str) -> bool:
    for k, *v in _ATTR.findall(attrs):
        k, v = k.lower(), "".join(v).lower()
        if k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v):
            return True
    return False


def blocks(page: str) -> tuple[list[tuple[int, str]], bool]:
    """(state, text) of the blocks in page order; whether the page has explicit
    main content. A block is OPEN where no main content holds it, OUTSIDE where
    furniture does besides: that counts for repetition but is never kept."""
    out: list[tuple[int, str]] = []
    text: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, furniture begins, main begins
    furniture = main = 0
    has_main = False

    def flush() -> None:
        if text:
            t = _WHITE.sub(" ", html_lib.unescape("".join(text))).strip()
            text.clear()
            if t:
                out.append(((DROPPED if furniture else SETTLED) if main else (OUTSIDE if furniture else OPEN), t))

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if not any(s[0] == name for s in stack):
                if name in _BLOCK:
                    flush()
                continue
            while stack:
                top = stack[-1]
                if top[0] in _BLOCK or top[1] or top[2]:
                    flush()
                stack.pop()
                furniture -= top[1]
                main -= top[2]
                if top[0] == name:
                    break
            continue
        if name in _SKIP:
            # Only in foreign elements does a slash close the tag.
            if name == "svg" and m[3].endswith("/"):
                continue
            end = _ends(name).search(page, at)
            if end is None and name in ("head", "option"):
                stop = _AFTER[name].search(page, at)
                at = stop.start() if stop else at
            else:
                at = end.end() if end else n
            continue
        if name in _BLOCK:
            flush()
            if name in _CLOSES_P:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        for top in stack[k:]:
                            furniture -= top[1]
                            main -= top[2]
                        del stack[k:]
                        break
                    if stack[k][0] in _BLOCK:
                        break
        elif name == "br":
            text.append(" ")
        if name in _VOID:
            continue
        f, mn = _furniture(name, m[3], main > 0), name in _MAIN
        if f or mn:
            flush()
        has_main |= mn and not furniture
        stack.append((name, f, mn))
        furniture += f
        main += mn
    flush()
    return out, has_main


_WORD = re.compile(r"\S+")


def _ids(words: list[str]) -> np.ndarray:
    return np.unique(np.array(words, dtype=object).astype(str), return_inverse=True)[1].astype(np.int64)


def suffix_order(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array by prefix doubling, and the rank of each suffix."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        step = np.concatenate(([0], (np.diff(key[order]) != 0).astype(np.int64)))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        if rank[order[-1]] == n - 1 or k >= n:
            return order, rank
        k *= 2


def neighbours_share(tokens: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Tokens that each suffix shares with the one before it in the order (Kasai)."""
    n, h = len(tokens), 0
    t, r, o = tokens.tolist(), rank.tolist(), order.tolist()
    out = [0] * n
    for i in range(n):
        if r[i]:
            j = o[r[i] - 1]
            while i + h < n and j + h < n and t[i + h] == t[j + h]:
                h += 1
            out[r[i]] = h
            if h:
                h -= 1
        else:
            h = 0
    return np.array(out, np.int64)


def repeated(streams: list[np.ndarray], least: int) -> list[np.ndarray]:
    """For each page's token stream, which tokens lie in a substring of at least
    ``least`` tokens that another page has too."""
    if not streams:
        return []
    # A token of its own after each page keeps substrings inside pages.
    top = max((int(s.max()) for s in streams if len(s)), default=0) + 1
    tokens = np.concatenate([np.append(s, top + k) for k, s in enumerate(streams)])
    page = np.repeat(np.arange(len(streams)), [len(s) + 1 for s in streams])
    order, rank = suffix_order(tokens)
    lcp = neighbours_share(tokens, order, rank)
    # Runs of suffixes that share ``least`` tokens; those over two pages cover.
    run = np.cumsum(lcp < least)
    pages = page[order]
    lo, hi = np.full(run[-1] + 1, len(streams)), np.full(run[-1] + 1, -1)
    np.minimum.at(lo, run, pages)
    np.maximum.at(hi, run, pages)
    starts = order[(lo < hi)[run]]
    delta = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, np.minimum(starts + least, len(tokens)), -1)
    covered = np.cumsum(delta[:-1]) > 0
    ends = np.cumsum([len(s) + 1 for s in streams])
    return [covered[e - len(s) - 1 : e - 1] for s, e in zip(streams, ends, strict=True)]


_BITS = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("host", pa.string()), ("kept", pa.bool_()), ("covered", pa.binary()), ("seeds", pa.list_(pa.int64())), ("shared", pa.list_(pa.int64()))])
_BITS_SQL = "id long, row long, host string, kept boolean, covered binary, seeds array<long>, shared array<long>"


def _streams(batches: Iterator[pa.RecordBatch], main_least: int) -> Iterator[pa.RecordBatch]:
    """The undecided words of each page; ``kept``: they could be main text;
    ``main``: windows of its main content that are counted."""
    for batch in batches:
        words, kept, main = [], [], []
        for page in batch.column(3).to_pylist():
            own, has_main = blocks(page)
            words.append("\n".join(t for s, t in own if s in (OPEN, OUTSIDE)))
            kept.append(not has_main and any(s == OPEN for s, _ in own))
            main.append(_counted([t for s, t in own if s == SETTLED], main_least))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(kept), pa.array(words, pa.string()), pa.array(main, pa.list_(pa.int64()))], ["id", "row", "host", "kept", "words", "main"])


def _main_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = ["\n".join(t for s, t in blocks(page)[0] if s == SETTLED) for page in batch.column(4).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(words, pa.string())], ["id", "row", "host", "shards", "words"])


_SHARED = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("host", pa.string()), ("shared", pa.list_(pa.int64()))])


def _main_shard(table: pa.Table, least: int) -> pa.Table:
    """Of each page's main content, the windows of ``least`` tokens that other
    pages of the shard share, or could share with other shards."""
    texts = [_WORD.findall(t) for t in table.column("words").to_pylist()]
    alone = table.num_rows and table.column("shards")[0].as_py() == 1
    shared = []
    for words, covered in zip(texts, _covered(texts, least), strict=True):
        shared.append(_seeds(words, covered, least)[1] if alone else np.unique(_windows(_hashes(words), least)))
    return pa.Table.from_pydict({"id": table.column("id"), "row": table.column("row"), "host": table.column("host"), "shared": [x.tolist() for x in shared]}, schema=_SHARED)


def _covered(texts: list[list[str]], least: int) -> list[np.ndarray]:
    flat = _ids([w for t in texts for w in t]) if any(texts) else np.zeros(0, np.int64)
    ends = np.cumsum([len(t) for t in texts]).tolist()
    return repeated([flat[e - len(t) : e] for t, e in zip(texts, ends, strict=True)], least)


def _shard(table: pa.Table, least: int) -> pa.Table:
    texts = [_WORD.findall(t) for t in table.column("words").to_pylist()]
    covered = _covered(texts, least)
    told = [_seeds(t, c, least) for t, c in zip(texts, covered, strict=True)]
    seeds, shared = [x for x, _ in told], [[] for _ in texts]
    if texts and table.column("shards")[0].as_py() > 1:
        # What pages of this shard share is told once, for pages of other shards. A
        # window that a page also has uncovered is in that page alone.
        whole = np.unique(np.concatenate([y for _, y in told]))
        shared[0] = np.setdiff1d(whole, np.concatenate(seeds)).tolist()
    return pa.Table.from_pydict(
        {"id": table.column("id"), "row": table.column("row"), "host": table.column("host"), "kept": table.column("kept"), "covered": [np.packbits(c).tobytes() for c in covered], "seeds": [x.tolist() for x in seeds], "shared": shared},
        schema=_BITS,
    )


def _hashes(words: list[str]) -> np.ndarray:
    """A hash of each word, with its length."""
    return mix64(np.array([zlib.crc32(w.encode()) | len(w) << 32 for w in words], np.uint64))


def _windows(h: np.ndarray, least: int) -> np.ndarray:
    """Hashes of ``least`` tokens from each place."""
    total = np.zeros(max(0, len(h) - least + 1), np.uint64)
    for k in range(least if len(total) else 0):
        total = mix64(total * np.uint64(31) + h[k : k + len(total)])
    return total.astype(np.int64)


def _seeds(words: list[str], covered: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``least`` tokens from each place that is not wholly covered, and
    from those that are."""
    if len(words) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = _windows(_hashes(words), least)
    whole = np.convolve(covered, np.ones(least, int), "valid") == least
    return np.unique(total[~whole]), np.unique(total[whole])


def _counted(texts: list[str], main_least: int) -> np.ndarray:
    """Of the windows of main content, those that stand for their neighbours."""
    data = np.frombuffer("\n".join(texts).encode(), np.uint8)
    h = _windows(word_hashes(data, np.zeros(1, np.int64))[0], _WINDOW)
    n = main_least - _WINDOW + 1
    if len(h) < n:
        return np.zeros(0, np.int64)
    return np.unique(np.lib.stride_tricks.sliding_window_view(h, n).min(axis=1))


_MAIN_TEXT = pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _without(own: list[tuple[int, str]], words: list[tuple[int, str]], gone: np.ndarray, state: int, least: int) -> str:
    """The blocks in ``state``, without the words that are ``gone``."""
    runs: dict[int, list[str]] = {}
    of = np.array([k for k, _ in words], np.int64)
    for k in np.unique(of[[own[k][0] == state for k in of]]) if len(of) else ():
        at = np.flatnonzero(of == k)
        out = gone[at]
        # A repeat that only reaches into the block from a neighbour takes no part of it.
        edge = np.flatnonzero(np.diff(np.concatenate(([0], out.astype(np.int8), [0]))))
        for a, b in edge.reshape(-1, 2):
            if b - a < min(least, len(out)):
                out[a:b] = False
        left = [words[i][1] for i, g in zip(at, out, strict=True) if not g]
        if left:
            runs[int(k)] = left
    return "\n\n".join(" ".join(v) for _, v in sorted(runs.items()))


def _marked(words: list[tuple[int, str]], windows: frozenset, least: int) -> np.ndarray:
    """Which words lie in one of the windows."""
    gone = np.zeros(len(words), bool)
    if windows and len(words) >= least:
        total = _windows(_hashes([w for _, w in words]), least)
        for i in np.flatnonzero(np.isin(total, np.fromiter(windows, np.int64, len(windows)))):
            gone[i : i + least] = True
    return gone


def _text(page: str, covered: bytes | None, more: frozenset, least: int, main: frozenset, main_least: int) -> str:
    own, has_main = blocks(page)
    if has_main:
        if main:
            words = [(k, w) for k, (s, t) in enumerate(own) if s == SETTLED for w in _WORD.findall(t)]
            gone = _marked(words, main, main_least)
            if 0 < gone.sum() <= len(gone) / 2:
                return _without(own, words, gone, SETTLED, main_least)
        return "\n\n".join(t for s, t in own if s == SETTLED)
    words = [(k, w) for k, (s, t) in enumerate(own) if s in (OPEN, OUTSIDE) for w in _WORD.findall(t)]
    gone = _marked(words, more, least)
    if covered:
        gone |= np.unpackbits(np.frombuffer(covered, np.uint8))[: len(words)].astype(bool)
    return _without(own, words, gone, OPEN, least)


def _extract(batches: Iterator[pa.RecordBatch], least: int, main_least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            b = batch.slice(lo, 256)
            texts = [_text(p, c, frozenset(m or ()), least, frozenset(x or ()), main_least) for p, c, m, x in zip(*(b.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=_MAIN_TEXT)


def _main_repeats(src: DataFrame, streams: DataFrame, sizes: DataFrame, main_least: int) -> DataFrame | None:
    """(i, r, main): the windows of a page's main content that go; null where no
    host has any."""
    host = F.xxhash64("host")
    counted = streams.select(host.alias("h"), F.explode("main").alias("w")).groupBy("h", "w").agg(F.count("*").alias("n")).where(f"n >= {_LEAST_PAGES}")
    hosts = cut(counted.join(sizes.select(host.alias("h"), "host", "pages"), "h").where("2 * n > pages").select("host").distinct(), "main-hosts")
    if hosts.isEmpty():
        return None
    found = src.withColumn("host", host_of(F.col("url"))).join(hosts, "host", "left_semi").dropDuplicates(["id", "row"])
    found = found.join(sizes.select("host", "shards"), "host").select("id", "row", "host", "shards", "html").mapInArrow(_main_words, "id long, row long, host string, shards int, words string")
    found = found.withColumn("shard", F.pmod("row", F.col("shards").cast("long"))).repartition("host", "shard")
    found = cut(found.groupBy("host", "shard").applyInArrow(lambda t: _main_shard(t, main_least), "id long, row long, host string, shared array<long>"), "main-repeats")
    each = found.select("host", "id", "row", F.explode("shared").alias("w"))
    often = each.groupBy("host", "w").agg(F.count("*").alias("n")).where(f"n >= {_LEAST_PAGES}").join(sizes.select("host", "pages"), "host").where("2 * n > pages").select("host", "w")
    return cut(each.join(often, ["host", "w"]).groupBy(F.col("id").alias("i"), F.col("row").alias("r")).agg(F.collect_set("w").alias("main")), "main-marks")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 6, main_least: int = 24, shard_pages: int = 500) -> DataFrame:
    """-> (id, url, text, n_chars), one row per row of ``pages``.

    Character references are decoded, white space in a block becomes one space,
    blocks are joined by two line feeds in page order. Null or empty html gives
    "". A null url has the empty host. Ids may be null or repeat: a row is known
    by id and content, so repeated rows get the same text (and, as they are one
    page, do not make each other boilerplate). ``shard_pages`` moves work between
    tasks, never a result. Html is read whole, however long. Only the three named
    columns are read, so others may have any name. An empty table gives an empty
    table.
    """
    spark = pages.sparkSession
    prepare(spark)
    page = F.coalesce(F.col(html_col), F.lit(""))
    src = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), page.alias("html")).withColumn("row", F.xxhash64("url", "html"))
    streams = src.select("id", "row", host_of(F.col("url")).alias("host"), "html").mapInArrow(partial(_streams, main_least=main_least), "id long, row long, host string, kept boolean, words string, main array<long>")
    n = max(64, input_bytes(pages, html_col) // (4 << 20))
    # Pages of a host are dealt into shards by content; a host with few pages has few.
    streams = cut(streams.dropDuplicates(["id", "row"]), "streams")
    shards = F.least(F.lit(int(n)), F.greatest(F.ceil(F.count("*") / shard_pages), F.ceil(F.sum(F.length("words")) / (16 << 20)))).cast("int")
    sizes = cut(streams.groupBy("host").agg(shards.alias("shards"), F.countDistinct("row").alias("pages")), "hosts")
    dealt = streams.drop("main").join(sizes, "host").withColumn("shard", F.pmod("row", F.col("shards").cast("long")))
    # Without this the join's partitioning by host would do for the grouping, and
    # all shards of a host would be one task.
    dealt = dealt.repartition("host", "shard")
    found = cut(dealt.groupBy("host", "shard").applyInArrow(lambda t: _shard(t, least), _BITS_SQL), "repeats")
    useful = found.where("kept")
    # Only hosts with several shards and pages that may keep something need seeds from other shards.
    wide = useful.select("host").distinct().join(sizes.where("shards > 1"), "host", "left_semi")
    seeds = found.join(wide, "host", "left_semi").select("host", "id", "row", F.explode("seeds").alias("seed"))
    shared = found.join(wide, "host", "left_semi").select("host", F.explode("shared").alias("seed"))
    common = seeds.select("host", "seed").unionByName(shared).groupBy("host", "seed").agg(F.count("*").alias("n")).where("n > 1").select("host", "seed")
    more = seeds.join(common, ["host", "seed"]).groupBy("id", "row").agg(F.collect_set("seed").alias("more"))
    marks = useful.join(more, ["id", "row"], "left").select(F.col("id").alias("i"), F.col("row").alias("r"), "covered", "more")
    marks = cut(marks, "marks")
    told = src.join(marks, F.col("id").eqNullSafe(F.col("i")) & (F.col("row") == F.col("r")), "left").drop("i", "r")
    main = _main_repeats(src, streams, sizes, main_least)
    if main is None:
        told = told.withColumn("main", F.lit(None).cast("array<long>"))
    else:
        told = told.join(main, F.col("id").eqNullSafe(F.col("i")) & (F.col("row") == F.col("r")), "left").drop("i", "r")
    return told.select("id", "url", "html", "covered", "more", "main").mapInArrow(partial(_extract, least=least, main_least=main_least), "id long, url string, text string, n_chars long")
