import base64
import fnmatch
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
import zstandard

from loomgraph.llm import html_extract, url_filter, warc
from loomgraph.plans.scratch import Scratch

PAGES = "page_id long, url string, html string"
ODD_PAGES = [
    (1, "http://WWW.Example.com/en/1?x#y", "<p>one</p>"), (2, "https://a.net/es/", "<p>one</p>"), (3, None, None), (4, "no scheme", ""), (5, "http://example.com", ""), (5, "http://example.com", ""),
    (None, "http://x.net/fr/é", "<p>null</p>"), (6, "ftp://net/fr/#a", "<p>" + "long " * 50_000 + "</p>"), (7, "a://b://example.com/en/", "\x00\r\nbad"), (8, "http://evilexample.com/en/", "<p>one</p>"), (9, "http://x.org/\n/en/", "<"),
]


def judge(url):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = []
    for verdict, rule in url_filter.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow"


def test_url_rules(spark):
    rng = random.Random(1)
    rows = [*ODD_PAGES, *((100 + i, "".join(rng.choice(["http", "://", "net", "com", "example", "www", ".", "/", "en/", "es/", "?", "#", "X"]) for _ in range(9)), "") for i in range(300))]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' as host", "'y' as rule")
    found = sorted((tuple(r) for r in url_filter.filter_urls(df).collect()), key=repr)
    assert found == sorted(((i, *judge(u)) for i, u, _ in rows), key=repr)
    assert url_filter.filter_urls(df.where("false")).collect() == []


def test_automaton_over_several_words():
    rng = random.Random(2)
    globs = ["".join(rng.choice("ab*?/") for _ in range(rng.randrange(1, 14))).replace("**", "*").replace("*", "**") for _ in range(40)]
    texts = ["".join(rng.choice("abc/") for _ in range(rng.randrange(12))) for _ in range(300)]
    hits = url_filter.GlobAutomaton.build(globs).match(texts)
    want = [[fnmatch.fnmatchcase(t, g.replace("**", "*")) for g in globs] for t in texts]
    assert len(url_filter.GlobAutomaton.build(globs).start) > 1 and (hits == np.array(want)).all()


def test_warc_round_trip(spark):
    df = spark.createDataFrame(ODD_PAGES, PAGES).selectExpr("*", "'x' as digest", "1 as n", "'p' as payload")
    scratch = Scratch(spark)
    path = scratch.path("archives")
    warc.write_archives(df, path)
    found = sorted((tuple(r) for r in warc.read_archives(spark, path).drop("url").collect()), key=repr)
    first = {}
    for i, _, h in ODD_PAGES:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in ODD_PAGES:
        body = (h or "").encode()
        later = (h or "") in first and i != first[h or ""]
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if later else "response", first[h or ""] if later else None))
    assert found == sorted(want, key=repr)
    empty = scratch.path("archives")
    warc.write_archives(df.where("false"), empty)
    assert warc.read_archives(spark, empty).collect() == []


def test_archives_are_of_bounded_size(spark, monkeypatch):
    assert warc.archive_count(0, 8) == 8 and warc.archive_count(10 << 40, 8) == 40960
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    rows = [(None if i % 3 == 0 else i, f"http://h/{i}", "<p>same</p>" * 20 if i % 2 else f"<p>{i}</p>" * 30) for i in range(900)]
    scratch = Scratch(spark)
    path = scratch.path("archives")
    warc.write_archives(spark.createDataFrame(rows, PAGES), path)
    files = spark.read.format("binaryFile").load(path).collect()
    counts = [sum(len(b) for _, b in warc.parse_archive(bytes(r.content))) for r in files if r.length]
    assert len(counts) > 8 and max(counts) < 30_000
    found = warc.read_archives(spark, path).collect()
    assert len(found) == 900 and sum(r.record_type == "revisit" for r in found) == 449 and {r.refers_to for r in found} == {None, 1}


def test_archive_is_a_dictionary_frame_and_single_records(spark):
    scratch = Scratch(spark)
    path = scratch.path("archives")
    rows = [(i, f"http://h/{i}", f"<p>{'common words of all pages ' * 20}{i}</p>") for i in range(60)]
    warc.write_archives(spark.createDataFrame(rows, PAGES).coalesce(1), path)
    contents = [bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect() if r.length]
    assert contents
    for content in contents:
        assert int.from_bytes(content[:4], "little") == warc.DICTIONARY_MAGIC
        size = int.from_bytes(content[4:8], "little")
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content[8 : 8 + size]))
        rest = content[8 + size :]
        frames = [f for f in rest.split(warc.SEPARATOR.encode()) if f]
        assert all(unpack.decompress(f).startswith(b"WARC/1.1\r\n") for f in frames)
    assert sum(len(list(warc.parse_archive(c))) for c in contents) == 60


ARTICLE = """<html><head><title>T</title><script>if (a < b) "</p>"</script><style>p{}</style></head><body class="page content-wide">
<header><h1>The Site</h1><p>A welcome to all the readers of this site, today and on every other day of the year.</p></header>
<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><div class="cookie-notice">We use cookies, and we would like you to accept every one of them right now.</div>
<article><h1>Title &amp; more</h1><p>First   paragraph with <a href="x">a link</a>
and text.<p>Short.<div class="ad">Buy this great thing now, it is cheap and very good indeed, really.</div><ul><li>one<li>two &lt;b&gt;</ul>
<form><p>Subscribe to our newsletter</p><input></form><section class="comments"><p>I liked this very much, thank you for the nice text, it was good to read.</p></section></article>
<aside><p>Other stories that you may like as well, here they are, more of them every day.</p></aside><footer>&copy; us</footer></body></html>"""


def test_extraction(spark):
    assert html_extract.extract_text(ARTICLE) == "Title & more\nFirst paragraph with a link and text.\nShort.\none\ntwo <b>"
    assert html_extract.extract_text("<article><p>cut off &am") == "cut off &am"
    assert html_extract.extract_text("<main>a < b and <3 c</main>") == "a < b and <3 c"
    df = spark.createDataFrame(ODD_PAGES, PAGES).selectExpr("*", "'x' as text")
    rows = html_extract.extract_pages(df).collect()
    assert len(rows) == len(ODD_PAGES) and all(r.n_chars == len(r.text) for r in rows)
    assert {r.text for r in rows if r.page_id in (3, 4, 5)} == {""}
    assert html_extract.extract_pages(df.where("false")).collect() == []


def test_the_tree_fits_its_labelled_pages():
    assert html_extract.LABELLED.count("|") < 300 and len(html_extract.LABELLED.strip().split("\n")) < 40
    x, y = zip(*html_extract.labelled_pages())
    assert (html_extract.classify(np.vstack(x)) == np.concatenate(y)).mean() > 0.95
    used = set()

    def walk(node):
        if node.low is not None:
            used.add(html_extract.FEATURES[node.feature])
            walk(node.low)
            walk(node.high)

    walk(html_extract.tree())
    assert html_extract.FEATURES[html_extract.tree().feature] == "link_density" and {"words", "links_before", "words_after", "links_after"} <= used


def test_blocks_of_held_out_pages():
    """Pages of another scale factor than the labelled ones, with their elements and with plain ones in their place."""
    pages = [h for (h,) in duckdb.sql("select html from '/root/testdata/sf0.1/pages.parquet' where page_id >= 250 and page_id % 7 = 1").fetchall()]
    assert len(pages) > 300
    hits = extra = missed = same = 0
    for page in pages:
        blocks = html_extract.blocks_of(page)
        real = np.array([b.main for b in blocks]) == 1
        x = html_extract.features_of(blocks)
        for kept in (html_extract.classify(x), html_extract.classify(html_extract.without_marks(x))):
            hits, extra, missed = hits + (kept & real).sum(), extra + (kept & ~real).sum(), missed + (~kept & real).sum()
        plain = re.sub(r'<(/?)(nav|article|footer|div)\b[^>]*>', r"<\1div>", page)
        same += html_extract.extract_text(plain) == html_extract.extract_text(page)
    assert same >= 0.75 * len(pages)
    assert 2 * hits / (2 * hits + extra + missed) > 0.985


BODY = "<h1>A title of words</h1><p>" + "word " * 40 + "</p><p>" + "more " * 30 + "</p>"
TEXT = "A title of words\n" + ("word " * 40).strip() + "\n" + ("more " * 30).strip()


@pytest.mark.parametrize(
    "around",
    [
        "%s", '<div style="overflow:hidden"><article>%s</article></div>', '<main aria-hidden="false">%s</main>', '<div class="layout has-sidebar"><article>%s</article></div>',
        '<div class="post category-legal">%s</div>', '<div id="menu-wrapper"><article>%s</article></div>', "<form id=all><div>%s</div></form>", '<article data-hidden-by="hidden">%s</article>',
        '<article>%s</article><div class="comments"><article><p>I liked this very much, it was good to read, thank you all.</p></article></div>',
        '<article>%s<div hidden><p>Nobody sees this line of text that stands here.</p></div><p style="display: none">Nor this one, which is a long line as well.</p></article>',
        '<div class="sidebar-layout"><div class="content">%s</div><div class="sidebar"><p>What else is there to see on this site today</p></div></div>',
    ],
)
def test_wrappers_leave_the_article(around):
    assert html_extract.extract_text(around % BODY) == TEXT


def test_long_and_broken_pages():
    many = "".join(f"<p>paragraph {i} " + "word " * (i % 30 + 5) for i in range(20_000))
    text = html_extract.extract_text(f"<nav><a href=x>home</a></nav><article><h1>Long one</h1>{many}")
    assert text.count("\n") == 20_000 and text.startswith("Long one\nparagraph 0 word")
    assert html_extract.extract_text("<article>" + "<div>" * 50_000 + "deep in it") == "deep in it"
    assert html_extract.extract_text("<article><p>" + "x" * 3_000_000) == "x" * 3_000_000
    for broken in ("<", "<a", "<article", "</", "</p></p>", "<p class='", "<!--", "<script>x", "&#xffffffff;&#0;", "<p><<>>", "\ud800".encode("utf-8", "replace").decode()):
        assert isinstance(html_extract.extract_text(broken), str)
    assert html_extract.extract_text("<article><p>a &lt; b<p>c &#233; &amp;d; \u00a0 e</article></article></div>") == "a < b\nc é &d; e"
