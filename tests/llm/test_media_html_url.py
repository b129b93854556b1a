"""Media containers, HTML extraction and URL rules against plain readings of their contracts."""

from __future__ import annotations

import collections
import hashlib
import html
import json
import math
import random
import re
import struct
import time
import zlib

import pytest
from odd import ODD_TEXTS, docs, empty
from pyspark.sql import functions as F

from tephra.llm import html_extract, media, url_filter


@pytest.mark.parametrize("text", ODD_TEXTS)
def test_container_round_trip(text):
    raw = (text or "").encode()
    stored = media.mux(raw)
    movie = media.demux(stored)
    track = movie.tracks[0]
    payload = media.payload_of(stored, track)
    assert payload == media.padded(raw) and len(payload) % 64 == 0 and payload and movie.n_bytes == len(raw)
    assert (track.codec, track.timescale, track.durations) == ("raw ", media.RATE, len(payload) // 64)
    for i, (at, n) in enumerate(track.key_ranges()):
        assert stored[at : at + n] == payload[i * media.KEY_EVERY * 64 :][:64]


def test_foreign_and_broken_containers():
    wide = media.box(b"mdat", b"12345678")
    stbl = media.box(b"stbl", media.full_box(b"stsd", struct.pack(">I", 1), media.box(b"avc1", bytes(78))), media.full_box(b"stts", struct.pack(">IIIII", 2, 2, 10, 1, 5)), media.full_box(b"stsc", struct.pack(">IIIIIII", 2, 1, 2, 1, 2, 1, 1)), media.full_box(b"stsz", struct.pack(">IIIII", 0, 3, 2, 1, 3)), media.full_box(b"co64", struct.pack(">IQQ", 2, 8, 12)))
    mdhd = media.full_box(b"mdhd", struct.pack(">QQIQHH", 0, 0, 100, 25, 0, 0), version=1)
    raw = wide + media.box(b"moov", media.box(b"trak", media.box(b"mdia", mdhd, media.box(b"minf", stbl)))) + struct.pack(">I4s", 0, b"free") + b"rest"
    t = media.demux(raw).tracks[0]
    assert (t.codec, t.timescale, t.duration, t.durations) == ("avc1", 100, 25, 25)
    assert t.key_ranges() == [(8, 2), (10, 1), (12, 3)]  # without a table every sample is a key frame
    assert media.payload_of(raw, t) == b"123567"
    good = media.mux(b"x" * 500)
    for bad in (b"", b"abc", good[:-5], good[:40], good.replace(b"stsz", b"free"), bytes(100), b"\xff" * 64):
        with pytest.raises(ValueError):
            media.demux(bad)


def test_features_of_all_tracks():
    one = media.mux(b"x" * 100)
    movie = media.demux(one)
    sound, video = media.demux(one).tracks[0], media.demux(one).tracks[0]
    sound.handler, video.codec = "soun", "avc1"
    movie.tracks[:] = [sound, video]
    video.handler = "vide"
    got = json.loads(media.feature(movie))
    assert got["codec"] == "avc1" and [t["handler"] for t in got["tracks"]] == ["soun", "vide"] and got["tracks"][0]["keyframes"]
    for box, why in ((b"moof", "fragmented"),):
        with pytest.raises(ValueError, match=why):
            media.demux(one + struct.pack(">I4s", 8, box))


def test_op2(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for got, source in ((media.op2_media(spark, sf_dir), d), (media.media_features(media.store_media(docs(spark))), docs(spark))):
        got = sorted(got.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
        want = sorted(source.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
        assert len(got) == len(want)
        for g, w in zip(got, want):
            raw = (w["text"] or "").encode()
            payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
            assert (g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
            assert json.loads(g["feature"])["codec"] == "raw"
    broken = spark.createDataFrame([(1, None), (2, bytearray(b"x"))], "doc_id long, media binary")
    assert [r["error"] is not None for r in media.media_features(broken).collect()] == [True, True]
    assert media.media_features(media.store_media(empty(spark))).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header class="site"><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<main><article class="post"><header><h1>Title &amp; more</h1><p>by someone</p></header><p>First   <b>bold</b><br>line &lt;x&gt; &#233;&nbsp;end.<p>Second<ul><li>one<li>two</ul>
<div class="ad">Buy</div><aside>Side</aside><form><input><button>Send</button></form><blockquote>Quote</blockquote>
<section class="comments"><article class="comment"><p>I disagree</p></article></section></article></main>
<aside id="sidebar">Links</aside><footer>&copy; Site</footer></body></html>"""


def plain(source):
    return html_extract.Page(None, source, True).text({})


def test_extraction():
    assert plain(PAGE) == "Title & more\nFirst bold line <x> é end.\nSecond\none\ntwo\nQuote"
    for source, want in ((None, ""), ("", ""), ("no markup &amp; all", "no markup & all"), ("<p>a<p>b", "a\nb"), ("<body><div>x<script>1</script></div>", "x"), ("<article><p>x", "x"), ("<<<>>> <p", "<<<>>> <p"), ("<div>" * 3000 + "deep", "deep"), ("<script>never closed", ""), ("<body><header><h1>Site</h1></header><div class='page-header'>x</div><p>Text", "Text"), ("<form><article><div class='entry-header'><h2>A</h2>by b</div><p>c</p></article></form>", "A\nc"), ("<body><p>x</p><div class='Ad-Slot'>y</div><div hidden>z</div><p role='note'>w</p><div role='navigation'>v</div>", "x\nw"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<dl><dt>a<dd>b<dt>c</dl>", "a\nb\nc"), ("<!-- never closed", "")):
        assert plain(source) == want


def _pages(spark, n=12):
    rows = []
    for i in range(n):
        box = "<div class='x1'><p>Follow this site</p></div>"
        rows.append((i, f"http://a.example/{i}", f"<body><div>Top of site</div>{box}<div><p>Text number {i} of all.</p><p>Shared line.</p></div></body>"))
        rows.append((100 + i, f"http://b.example/{i}", f"<body><article><p>Text {i}.</p><p>Shared line.</p>{box}</article></body>"))
    rows += [(50, None, "<p>x</p>"), (51, "nothing", None), (None, "http://a.example/", ""), rows[0], (60, "http://c.example/1", "<body><div>Top of site</div><p>Only page.</p></body>")]
    return spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, key string, h long")


def test_templates_are_removed(spark):
    pages = _pages(spark)
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    for i in range(12):
        assert got[i] == f"Text number {i} of all."  # no article: a line on every page is a template
        assert got[100 + i] == f"Text {i}.\nShared line."  # in an article running text stays, the recurring box goes
    assert got[60] == "Top of site\nOnly page." and got[50] == "x" and got[51] == "" and got[None] == ""
    joined = sorted((tuple(r) for r in html_extract.extract(pages, broadcast_templates=-1).collect()), key=repr)
    assert joined == sorted((tuple(r) for r in html_extract.extract(pages).collect()), key=repr) and len(joined) == pages.count()
    assert html_extract.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("piece", ["<a ", '<a "', '<div class="', "<!", "<!-- ", "</", "<", "<b>", "<b><p>", "<p>", "<li>", "<b></i>", "<table><b><p>", "<a \">", "<script>", "<article>", "<header><h1>", "<div></div>", "&", "x > \"", "<td>", "<a '\"", "<form>"])
def test_a_megabyte_of_broken_markup(piece):
    source = "<p>text" + piece * ((1 << 20) // len(piece))
    began = time.perf_counter()
    for clues in (True, False):
        page = html_extract.Page("http://a.b/", source, clues)
        list(page.hashes())
        page.text({i: {html_extract.SHAPE, html_extract.MAIN} for i in page.candidates})
    assert time.perf_counter() - began < 30


def test_tokens_cover_the_source():
    for source in ('a<b c="x>y">d</b >e', "<p>1<!-- <p> -->2<![CDATA[<x>]]>3", "a < b <c", '<a href="x>t', "<a 'b>c</a>", "<script>if (a<b) '</p>'</script>x", "<!doctype html><p>x", "</>x"):
        tree = html_extract.parse(source)
        assert "x" not in source or any("x" in t for n in [tree, *html_extract.nodes(tree)] for t in [*n.items, *n.attrs.values(), *n.attrs] if isinstance(t, str))
    assert plain('<article><p>1 <b title="a>b">2</b></p><div class="ad-hoc-report">3</div><div class="ad-box">4</div></article>') == "1 2\n3"
    assert plain("<body><form action=x><div class=menu>m</div><p>long text of a page in a form</p></form></body>") == "long text of a page in a form"


def test_counts_alone_find_the_article(spark, sf_dir):
    """Without clues inside the page, menus, adverts and footers go by their shapes on hosts with enough pages; without the counts they stay."""
    pages = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/pages.parquet")
    full = {r["page_id"]: r for r in html_extract.extract(pages).collect()}
    counted = {r["page_id"]: r["text"] for r in html_extract.extract(pages, clues=False).collect()}
    uncounted = {r["page_id"]: r["text"] for r in html_extract.extract(pages, clues=False, min_pages=10**9).collect()}
    sizes = collections.Counter(html_extract.host_of(r["url"]) for r in full.values())
    often = [k for k, r in full.items() if sizes[html_extract.host_of(r["url"])] >= 2 * html_extract.MIN_PAGES]
    assert len(often) > 50
    assert all(uncounted[k] != full[k]["text"] for k in often)
    assert all(counted[k] == full[k]["text"] for k in often)
    assert html_extract.templates(pages).count() > 0


def test_op3(spark, sf_dir):
    source = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = html_extract.op3_html(spark, sf_dir).collect()
    assert len(rows) == len(source)
    for r in rows:
        h = source[r["page_id"]]
        a = re.sub(r"</?(p|h1)>", "\n", h[h.index("<article>") : h.index("</article>")])
        lines = (" ".join(x.split()) for x in html.unescape(re.sub(r"<[^>]*>", " ", a)).split("\n"))
        assert r["text"] == "\n".join(x for x in lines if x) and r["n_chars"] == len(r["text"])


def _judge(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    best = None
    for verdict, rule in url_filter.RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


def test_url_rules(spark, sf_dir):
    odd = [None, "", "nothing", "://", "HTTP://WWW.Example.NET/en/x", "http://example.net/en", "http://example.net?x=/en/", "http://net", "http://net/", "http://xnet/", "a://b.example.com/de/#f", "http://org/fr/", "http://É.ORG/fr/1", "x://y://z.net/", "http://a.net/\nen", "http://" + "a" * 5000 + ".net/"]
    rows = spark.createDataFrame([(i, u, "k", "h") for i, u in enumerate([*odd, *odd])], "page_id long, url string, key string, host string")
    both = rows.select("page_id", "url").union(spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("page_id + 1000", "url"))
    for frame in (rows, both):
        urls = {r["page_id"]: r["url"] for r in frame.collect()}
        got = url_filter.judge_urls(frame).collect()
        assert len(got) == len(urls)
        for r in got:
            host, path, best = _judge(urls[r["page_id"]])
            assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[1])
            assert r["verdict"] == (best[0] if best else "block" if r["score"] >= 0.5 else "allow")
    assert url_filter.judge_urls(rows.limit(0)).count() == 0


def test_trees_learn(spark):
    rows = spark.createDataFrame([(i, f"http://{'x' * (i % 9)}-{i}.example.{'net/a' if i % 2 else 'org/fr/b'}") for i in range(300)], "page_id long, url string")
    model = url_filter.train(rows, trees=3)
    assert len(model.trees) == 3
    got = url_filter.judge_urls(rows).collect()
    assert sum((r["score"] >= 0.5) == (r["rule"] == "net/") for r in got) >= 295


def plain_boost(rows, n_features, base, trees, depth):
    """The same booster over rows (bins, y, n) in plain Python; the margin of each row."""
    margin = [base] * len(rows)
    for t in range(trees):
        prob = [1 / (1 + math.exp(-m)) for m in margin]
        g, h = [r[1] - r[2] * p for r, p in zip(rows, prob)], [r[2] * p * (1 - p) for r, p in zip(rows, prob)]
        leaf = [0] * len(rows)
        for _ in range(depth):
            chosen = {}
            for own in set(leaf):
                at = [i for i in range(len(rows)) if leaf[i] == own]
                G, H = sum(g[i] for i in at), sum(h[i] for i in at)
                best = (1e-8, None)
                for f in sorted(url_filter.allowed(t, n_features)):
                    for b in sorted({rows[i][0][f] for i in at})[:-1]:
                        lg, lh = sum(g[i] for i in at if rows[i][0][f] <= b), sum(h[i] for i in at if rows[i][0][f] <= b)
                        gain = lg**2 / (lh + url_filter.L2) + (G - lg) ** 2 / (H - lh + url_filter.L2) - G**2 / (H + url_filter.L2)
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, b))
                chosen[own] = best[1]
            leaf = [2 * own + (chosen[own] is not None and r[0][chosen[own][0]] > chosen[own][1]) for own, r in zip(leaf, rows)]
        for own in set(leaf):
            at = [i for i in range(len(rows)) if leaf[i] == own]
            value = url_filter.RATE * sum(g[i] for i in at) / (sum(h[i] for i in at) + url_filter.L2)
            for i in at:
                margin[i] += value
    return margin


def test_trees_are_those_of_a_plain_booster(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(120):
        bins = [rng.randrange(5) for _ in range(6)]
        n = rng.randrange(1, 4)
        rows.append((bins, float(sum(rng.random() < (0.9 if bins[0] + bins[3] > 4 else 0.2) for _ in range(n))), n))
    frame = spark.createDataFrame(rows, "bins array<int>, y double, n long")
    trees = url_filter.boost(frame, 6, 0.1, trees=5, depth=3)
    model = url_filter.UrlModel([], [], 0.1, trees)
    got = [r[0] for r in frame.select(url_filter._score(F.col("bins"), model)).collect()]
    assert got == pytest.approx(plain_boost(rows, 6, 0.1, 5, 3), rel=1e-9)
    assert len({s[0] for t, _ in trees for s in t if s}) > 2


def test_held_out_urls_and_scores_of_one_suffix(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/pages.parquet")
    model = url_filter.train(pages.where("page_id % 2 = 0"))
    judged = url_filter.judge_urls(pages, model=model).collect()
    held = [r for r in judged if r["page_id"] % 2 and r["rule"]]
    by = {}
    for r in held:
        by.setdefault(r["rule"], []).append((r["score"] >= 0.5) == (r["verdict"] == "block"))
    assert held and sum(map(sum, by.values())) / len(held) > 0.9, {k: sum(v) / len(v) for k, v in by.items()}
    unruled = {}
    for r in judged:
        if not r["rule"]:
            unruled.setdefault(r["host"].rsplit(".", 1)[-1], set()).add(round(r["score"], 6))
    assert all(len(v) > 3 for v in unruled.values() if v)
    assert len({s[0] for t, _ in model.trees for s in t if s}) > 3  # not the suffix alone
