"""WARC (3), URL lists (4) and page text (8)."""

from __future__ import annotations

import gzip
import hashlib
import html
import re
from collections import Counter
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orbweave.llm import extraction, urls, warc
from orbweave.llm.shared import new_path

PAGES = "page_id long, url string, html string"


def odd_pages() -> list[tuple]:
    big = "".join(f"<p>line {i} é\r\n\r\n</p>" for i in range(40_000))
    same = "x" * 100
    return [
        (5, "http://a.b/c d?e=é", same), (3, None, same), (4, "", same), (9, "http://a", "y" * 99), (8, "http://a", "y" * 99), (1, "u", None), (2, "u", ""), (10, "u", big), (11, "u", big), (3, "again", same),
        (None, "u", same), (12, "u", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 9), (13, "u", "\r\n\r\n"), (14, "u", "ends\r\n\r"), (15, "u", "HTTP/1.1 200 OK\r\n\r\nbody"), (16, "u", "\U0001f600" * 200_000),
    ]


def round_trip(spark, rows, name):
    path = new_path(spark, name)
    warc.write_archives(spark.createDataFrame(rows, PAGES), path)
    return path, warc.read_archives(spark, path)


def test_warc_equals_brute_force(spark):
    rows = odd_pages()
    _, found = round_trip(spark, rows, "warc-test")
    got = Counter((r["id"] and int(r["id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] and int(r["refers_to"])) for r in found.where("last").collect())
    firsts: dict = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        if len(raw) >= 100 and i is not None:
            firsts[raw] = min(firsts.get(raw, i), i)
    want = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        first = firsts.get(raw)
        revisit = first is not None and first != i
        want[i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None] += 1
    assert got == want


def test_chunks_carry_digests_of_what_came(spark):
    text = "é" * (warc.CHUNK * 2 + 5)
    _, found = round_trip(spark, [(1, "u", text)], "warc-chunks")
    rows = found.orderBy("chunk").collect()
    assert [r["last"] for r in rows] == [False, False, True]
    for k, r in enumerate(rows):
        assert r["payload_digest"] == hashlib.sha256(text[: (k + 1) * warc.CHUNK].encode()).hexdigest()


def test_archives_are_plain_warc(spark):
    path, _ = round_trip(spark, [(1, "http://a/b", "<p>hi</p>" * 20), (2, "http://a/c", "<p>hi</p>" * 20)], "warc-plain")
    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted(Path(path.removeprefix("file://")).glob("part*.gz")))
    kinds, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
        kinds.append(head["WARC-Type"])
        at = end + 4 + int(head["Content-Length"]) + 4
        assert data[at - 4 : at] == b"\r\n\r\n"
    assert sorted(kinds) == ["response", "revisit"]


def read_parts(records: list[bytes]) -> list[tuple]:
    parser = warc.Parser()
    rows = [r for x in records for r in parser.feed(x + warc.END.encode())]
    parser.finish()
    return rows


def test_damaged_archives_are_errors(spark):
    """A lost, moved or changed segment and an archive that ends early are told."""
    pages = spark.createDataFrame([(1, "u", "é" * (warc.CHUNK * 2 + 5)), (2, "http://a/b", "short")], PAGES)
    parts = [r["text"].encode() for r in warc.chunk_rows(warc.described(pages)).orderBy("id", "chunk").collect()]
    assert [r[-1] for r in read_parts(parts)] == [False, False, True, True] and b"WARC-Segment-Total-Length" in parts[2] and b"WARC-Target-URI: http://a/b\r\n" in parts[3]
    changed = parts[1][:-2] + "è".encode()
    for damaged in (parts[:1] + parts[2:], parts[:2] + parts[3:], [parts[1], parts[0], *parts[2:]], parts[:2], [*parts[:3], parts[3][:-2]], [parts[0], changed, *parts[2:]], parts[1:]):
        with pytest.raises(ValueError, match="segment|record"):
            read_parts(damaged)


def test_warc_of_nothing(spark):
    path = new_path(spark, "warc-none")
    warc.write_archives(spark.createDataFrame([], PAGES), path)
    assert warc.read_archives(spark, path).count() == 0


# URL lists.

EVENTS = [("l", "bad.com", "add", "2024-02-01"), ("l", "bad.com", "remove", "2024-03-01"), ("l", "bad.com", "add", "2024-05-01"), ("l", "ok.com/Path", "add", "2024-01-01"), ("l", "ok.com/Path", "add", "2024-02-01"), ("l", "gone.com", "remove", "2024-01-01"), ("m", "bad.com", "add", "2024-02-15"), ("l", "day.com", "add", "2024-01-05"), ("l", "day.com", "remove", "2024-01-05"), ("l", None, "add", "2024-01-01"), ("l", "void.com", "add", None)]


def events(spark):
    return spark.createDataFrame(EVENTS, "list string, entry string, event string, day string")


def test_intervals(spark):
    rows = {(r["list"], r["entry"], str(r["since"]), r["until"] and str(r["until"])) for r in urls.intervals(events(spark)).collect()}
    assert rows == {("l", "bad.com", "2024-02-01", "2024-03-01"), ("l", "bad.com", "2024-05-01", None), ("l", "ok.com/path", "2024-01-01", None), ("m", "bad.com", "2024-02-15", None)}


@pytest.mark.parametrize("limit", [16 << 20, 0])
def test_as_of(spark, monkeypatch, limit):
    monkeypatch.setattr(urls, "BROADCAST", limit)
    captures = [
        (1, "http://bad.com/x", "2024-01-31"), (2, "http://bad.com/x", "2024-02-01"), (3, "https://u@Sub.BAD.com:80/x?y", "2024-02-20"), (4, "http://bad.com", "2024-03-01"), (5, "http://notbad.com/", "2024-02-02"), (6, "http://ok.com/path/deep", "2024-04-01"),
        (7, "http://ok.com/pathology", "2024-04-01"), (8, "http://x.ok.com/path?q", "2024-04-01"), (9, None, "2024-04-01"), (10, "http://bad.com", None), (11, "mailto:bad.com", "2024-02-02"), (12, "", "2024-02-02"), (2, "http://bad.com/x", "2024-02-01"), (13, "http://day.com/", "2024-01-05"), (14, "http://bad.com./", "2024-06-01"),
    ]
    rows = spark.createDataFrame([(*c, "x") for c in captures], "page_id long, url string, fetched string, day string").withColumn("fetched", F.col("fetched").cast("date")).withColumn("blocked_by", F.lit(1))
    got = urls.judged(rows, events(spark))
    assert {r["page_id"]: (r["blocked"], r["n_entries"]) for r in got.collect()} == {1: (False, 0), 2: (True, 1), 3: (True, 2), 4: (True, 1), 5: (False, 0), 6: (True, 1), 7: (False, 0), 8: (True, 1), 9: (False, 0), 10: (False, 0), 11: (False, 0), 12: (False, 0), 13: (False, 0), 14: (True, 2)}
    assert got.count() == len(captures)
    kept = urls.filter_urls(rows, events(spark))
    assert sorted(r["page_id"] for r in kept.collect()) == [1, 5, 7, 9, 10, 11, 12, 13] and kept.columns == rows.columns


def test_long_urls(spark):
    """60 KB of host labels or path parts: keys are as few as the list's shapes, and matches are the same."""
    long_path, long_host = "/a" * 30_000, "a." * 30_000 + "com"
    rows = [(1, f"http://x.org{long_path}", "2024-03-01"), (2, f"http://{long_host}/p/q", "2024-03-01"), (3, "http://b.x.org/a/a/b?c#d", "2024-03-01"), (4, "http://x.org:80//a//a", "2024-03-01"), (5, "http://x.organ/a", "2024-03-01")]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched string")
    events = spark.createDataFrame([("l", e, "add", "2024-01-01") for e in ("x.org/a/a", "a.com", "a.a.com/p", "x.org/b", "org/a")], "list string, entry string, event string, day string")
    got = {r["page_id"]: r["n_entries"] for r in urls.judged(captures, events).collect()}
    assert got == {1: 2, 2: 2, 3: 2, 4: 2, 5: 0}
    shapes = urls.shapes_of(urls.intervals(events))
    assert shapes == [(1, 1), (2, 0), (2, 1), (2, 2), (3, 1)]
    assert max(len(r[0]) for r in captures.select(urls.keys(F.col("url"), shapes)).collect()) <= len(shapes)


def test_no_captures_or_no_list(spark):
    none = spark.createDataFrame([], "page_id long, url string, fetched date")
    assert urls.judged(none, events(spark)).count() == 0
    one = spark.createDataFrame([(1, "http://a/")], "page_id long, url string").withColumn("fetched", F.current_date())
    assert urls.filter_urls(one, events(spark).limit(0)).count() == 1


# Page text.

NAV = "<nav><ul><li><a href=/>Home</a></li><li><a href=/x>Other</a></li></ul></nav>"


def page(body: str, head: str = "") -> str:
    return f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script>{head}</head><body>{NAV}{body}<footer>&copy; all</footer></body></html>'


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (None, ""), ("", ""), ("   ", ""), ("just text &amp; more", "just text & more"), ("<p>a<p>b", "a\n\nb"), (page("<article><h1>H</h1><p>One\n two<br>three</p></article>"), "H\n\nOne two three"),
        (page('<div class="ad">buy</div><article><p>x</p><div class="share-buttons">s</div></article><div id="comments"><p>c</p></div>'), "x"), (page("<main><p>m</p><aside>no</aside></main><p>out</p>"), "m"),
        (page('<article><header><h1>Title</h1></header><p>b</p></article><article class="comment">reply</article>'), "Title\n\nb"), ("<article><p>un<b>closed <i>tags<p>go on", "unclosed tags\n\ngo on"), ('<div style="display: none">h</div><div hidden>h</div><p>v</p>', "v"),
        ("<p>a</p><!-- <p>no</p> --><p>b &lt;c&gt; &eacute;&#233;&#xe9; &bogus;</p>", "a\n\nb <c> ééé &bogus;"), ("<form><p>f</p></form><p>t <select><option>o</select>u</p>", "t u"), ("<article>cut in a tag <p cl", "cut in a tag"), ("<p title=\"a>b\">q</p><p title='x'>r</p>", "q\n\nr"),
        ("<div class='content with-sidebar'><p>kept</p></div>", "kept"), ("<nav><a href=x>menu</a><article><p>never closed nav</p></article>", "never closed nav"), ("a < b and c > d", "a < b and c > d"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n\n2\n\n3"), ("<p><a href=x>link farm of words</a></p><p>text</p>", "text"),
        ("<div class='cookie-notice'>c</div><section><h2>S</h2><p>t</p></section>", "S\n\nt"), ("<script>if (a</b/.test(x)) {}</script>ok<script>never closed", "ok"), ("<textarea>t</textarea><noscript><p>n</p></noscript>z", "z"),
    ],
)
def test_extraction(source, want):
    assert extraction.extract(source) == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/!-\"'= &;abp", max_size=60))
def test_any_soup_is_read(soup):
    extraction.extract(soup)


def test_long_pages_are_read_fast():
    for soup in ("<" * 200_000, '<a "' * 50_000, "<!--" * 50_000, "<div>" * 20_000, "&" * 200_000):
        extraction.extract(soup)


def test_templates_of_a_host(spark):
    """Pages without article elements: what all pages of a host share goes, even without a telling name."""
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rows = [(i, f"http://h.x/{i}", f"<body><div>Big Site Of Things</div><div><p>{words[i]} story number {i}</p><p>second {i}</p></div><div>Made by hand</div></body>") for i in range(8)]
    rows += [(100 + i, "http://copies.x/", "<body><p>one page</p><p>many times</p></body>") for i in range(9)] + [(200, "http://single.x", "<body><div>Big Site Of Things</div><p>a</p></body>"), (201, None, None), (202, "http://h.x/none", "")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, c0 string")
    done = extraction.main_text(docs)
    got = {r["page_id"]: r["text"] for r in done.collect()}
    assert done.columns == ["page_id", "url", "host", "c0", "text"]
    assert all(got[i] == f"{words[i]} story number {i}\n\nsecond {i}" for i in range(8))
    assert all(got[100 + i] == "one page\n\nmany times" for i in range(9))
    assert got[200] == "Big Site Of Things\n\na" and got[201] == "" and got[202] == ""


def test_templates_by_a_shuffle_are_the_same(spark, sf, monkeypatch):
    one = {tuple(r) for r in extraction.op8_html(spark, sf).collect()}
    monkeypatch.setattr(extraction, "BROADCAST", 0)
    assert {tuple(r) for r in extraction.op8_html(spark, sf).collect()} == one


def test_all_pages_against_their_articles(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = extraction.op8_html(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = re.sub(r"^.*?<article>|</article>.*$", "", pages[r["page_id"]], flags=re.S)
        parts = re.sub(r"<[^>]*>?", " ", re.sub(r"</?(?:p|h1)\b[^>]*>", "\0", body)).split("\0")
        want = "\n\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)
        assert r["text"] == want and r["n_chars"] == len(want)


def test_no_pages(spark):
    assert extraction.main_text(spark.createDataFrame([], PAGES)).count() == 0
