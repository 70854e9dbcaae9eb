"""Main text of web pages by equivalence classes of tokens across the pages of a host.

A page is a sequence of tokens: tags and blocks of text, each in its path of open elements. A token's occurrence vector says
how often each page of the host holds it; it is summed up in a commutative signature, so vectors are never held. Tokens of
equal signatures are an equivalence class. A class is valid if it has CLASS tokens at least, and stands in SUPPORT of the
host's pages and of its distinct pages (by a bitmap of their hashes, so that copies of one page make no template), and the host has
MIN_PAGES distinct pages. As a path holds a token's ancestors, classes nest by their paths. The valid classes of a host, in the
order of mean places, are its template; a page's tokens are aligned to it by a longest increasing subsequence, and blocks that align are template text.
The slots that remain hold data. Those in elements that are menus, headers, footers, sidebars, notices, adverts, forms,
scripts or comments by name, role, class or id are left out; of the others those in article or main elements are the text,
and where a page has none, all that aren't mostly links.

Only figures of tokens are shuffled, combined by task first. A host's template is bounded by the length of its pages; templates are
broadcast up to BROADCAST bytes, and joined by a shuffle beyond that.

Defined cases. Null or empty html, or nothing but markup: empty text. Null or odd urls: host unknown, no template. Repeated rows: each
gives a row. Unclosed tags: elements end with their parents or with the page. Broken references stay as they are. Other columns are ignored. An empty
table: no rows. Very long pages: parsed whole, one at a time; templates are aligned in time n log n.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import saved, table

SUPPORT, CLASS, MIN_PAGES = 0.8, 3, 8
#: Bytes of all templates up to which they are broadcast; entries of a task's token table.
BROADCAST, ENTRIES = 16 << 20, 200_000
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"

TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'<]++|"[^"<]*+"|'[^'<]*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = {x: re.compile(rf"</{x}\b[^>]*(?:>|\Z)", re.I) for x in "script style textarea title iframe xmp noembed noframes".split()}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
#: Elements that never hold main text, whatever their classes.
DROPPED = frozenset("nav footer aside form button select option datalist head script style noscript template svg math canvas object audio video iframe dialog menu search textarea title".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar tooltip".split())
#: Words of classes and ids that say the same.
WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising adsbygoogle sponsor sponsored sponsors promo promoted promotion cookie cookies consent gdpr notice notices notification disclaimer sidebar sidebars rail "
    "menu menus nav navbar navigation topnav breadcrumb breadcrumbs comment comments commentlist discussion disqus replies reply respond share sharing social related recommended recommendations newsletter subscribe subscription signup login paywall "
    "footer masthead topbar toolbar popup modal overlay pager pagination widget widgets teaser teasers skip".split()
)
#: Of these words, such as say it of an article element itself.
OF_ARTICLES = frozenset("ad ads advert advertisement sponsored promo comment reply related recommended teaser".split())
STARTS_ANEW = frozenset(("article", "main"))
UNTOLD = frozenset(("with", "has", "no", "without", "hide"))
SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
CLOSES_P = BLOCKS - {"body", "html", "head", "title"}
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


class Block(NamedTuple):
    text: str
    token: int
    dropped: bool
    scope: int  # 2: in an article, 1: in main, 0: elsewhere
    linked: float  # share of characters in links


class _Open(NamedTuple):
    name: str
    path: int
    dropped: bool
    scope: int
    muted: bool  # a dropped element inside a line, and all in it: the block around it goes on


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)} if raw.strip(" /\n\t") else {}


def _says_dropped(name: str, at: dict[str, str], scope: int) -> bool:
    if name in ("html", "body", "main"):
        return False
    if name == "header":
        return not scope
    if name in DROPPED:
        return True
    if not at:
        return False
    if "hidden" in at or at.get("aria-hidden", "").lower() == "true" or "display:none" in at.get("style", "").replace(" ", "").lower():
        return True
    if at.get("role", "").lower() in ROLES:
        return True
    for value in (at.get("class", ""), at.get("id", "")):
        for part in value.split():
            words = [w.lower() for w in SPLIT.split(part) if w]
            if UNTOLD.intersection(words):
                continue
            found = set(words)
            if found & (OF_ARTICLES if name == "article" else WORDS) or "header" in found and not scope and name != "article":
                return True
    return False


def parse(page: str) -> tuple[list[Block], list[tuple[int, int]]]:
    """Blocks of text in page order, and tokens (hash, place) of tags and blocks."""
    stack = [_Open("", 0, False, 0, False)]
    blocks: list[Block] = []
    tokens: list[tuple[int, int]] = []
    words: list[str] = []
    links, chars, in_link = 0, 0, 0
    digest = xxhash.xxh64_intdigest

    def text(raw: str) -> None:
        nonlocal links, chars
        if raw and not stack[-1].muted:
            words.append(raw)
            n = len(raw.strip())
            chars += n
            links += n if in_link else 0

    def flush() -> None:
        nonlocal links, chars
        if stack[-1].muted:
            return
        if words:
            whole = " ".join(unescape("".join(words)).split())
            if whole:
                top = stack[-1]
                token = digest(whole.encode("utf-8", "surrogatepass"), top.path)
                tokens.append((token, len(tokens)))
                blocks.append(Block(whole, token, top.dropped, top.scope, links / max(chars, 1)))
            words.clear()
        links = chars = 0

    def close(to: int) -> None:
        while len(stack) > to:
            flush()
            tokens.append((stack.pop().path ^ 1, len(tokens)))

    def find(names: tuple[str, ...], until: tuple[str, ...] = ()) -> int:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                return i
            if stack[i].name in until:
                break
        return 0

    at = 0
    while m := TAG.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if name == "a":
                in_link = max(0, in_link - 1)
            if i := find((name,)):
                close(i)
            elif name in BLOCKS:
                flush()
            continue
        raw = m[3] or m[6] or ""
        if name in RAW and not raw.endswith("/"):
            end = RAW[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        if name == "br" or name == "wbr":
            words.append(" " if name == "br" else "")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        is_block = name in BLOCKS
        if is_block:
            flush()
            if name in CLOSES_P and stack[-1].name == "p":
                close(len(stack) - 1)
            if name in SAME and (i := find(SAME[name], ("ul", "ol", "dl", "table", "select", "menu"))):
                close(i)
            if name in STARTS_ANEW and (i := find(("nav", "header", "footer"))):
                close(i)  # one that was never closed
        if name == "a":
            in_link += 1
        attributes, top = _attributes(raw), stack[-1]
        dropped = top.dropped or _says_dropped(name, attributes, top.scope)
        role = attributes.get("role", "").lower()
        scope = top.scope if dropped else max(top.scope, 2 if name == "article" or role == "article" or "articlebody" in attributes.get("itemprop", "").lower() else 1 if name == "main" or role == "main" else 0)
        if is_block or dropped and not top.dropped or scope > top.scope:
            if raw.endswith("/") and not is_block:
                continue
            if not is_block and not dropped:
                flush()
            path = digest(f"{name} {attributes.get('class', '')}".encode("utf-8", "surrogatepass"), top.path) & ~1
            stack.append(_Open(name, path, dropped, scope, top.muted or dropped and not is_block))
            tokens.append((path, len(tokens)))
    text(page[at:] if not re.match(r"<[a-zA-Z/!?]", page[at:]) else "")
    close(1)
    flush()
    return blocks, tokens


def _aligned(tokens: list[tuple[int, int]], rank: dict[int, int]) -> set[int]:
    """Tokens that a longest increasing subsequence of template ranks passes through."""
    own, seen = [], set()
    for token, _ in tokens:
        if token in rank and token not in seen:
            seen.add(token)
            own.append(token)
    tails, places, before = [], [], [-1] * len(own)
    for i, token in enumerate(own):
        k = bisect_right(tails, rank[token])
        if k:
            before[i] = places[k - 1]
        tails[k : k + 1], places[k : k + 1] = [rank[token]], [i]
    found, i = set(), places[-1] if places else -1
    while i >= 0:
        found.add(own[i])
        i = before[i]
    return found


def extract(page: str | None, template: list[int] | None = None) -> str:
    """The main text: blocks in page order, joined by empty lines."""
    if not page:
        return ""
    blocks, tokens = parse(page)
    fixed = _aligned(tokens, {t: i for i, t in enumerate(template)}) if template else set()
    left = [b for b in blocks if not b.dropped and b.token not in fixed]
    scope = max((b.scope for b in left), default=0)
    return "\n\n".join(b.text for b in left if (b.scope >= scope if scope else b.linked <= 0.5))


def host(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url.cast("string")), HOST, 1), F.lit(""))


FIGURES = "host string, token long, pages long, hits long, signature long, bits long, place double"
MIX = 0x9E3779B97F4A7C15
FULL = (1 << 64) - 1


def _signed(x: int) -> int:
    x &= FULL
    return x - (1 << 64) if x >> 63 else x


def token_figures(pages: DataFrame) -> DataFrame:
    """pages: host, html. Figures of a host's tokens, in parts that remain to be added up. Token 0 stands for the page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list] = {}

        def out() -> pa.RecordBatch:
            rows = [(h, _signed(t), n, hits, _signed(s), _signed(bits), place) for (h, t), (n, hits, s, bits, place) in found.items()]
            found.clear()
            return pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=[x.split()[0] for x in FIGURES.split(", ")]), preserve_index=False)

        for b in batches:
            for own, page in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                page = page.as_py() or ""
                mark = xxhash.xxh64_intdigest(page.encode("utf-8", "surrogatepass"))
                counts: dict[int, list] = {0: [1, 0]}
                for token, place in parse(page)[1]:
                    if token in counts:
                        counts[token][0] += 1
                    else:
                        counts[token] = [1, place]
                for token, (n, place) in counts.items():
                    entry = found.get((own, token))
                    if entry is None:
                        entry = found[own, token] = [0, 0, 0, 0, 0.0]
                    entry[0] += 1
                    entry[1] += n
                    entry[2] += (mark ^ n * MIX) * MIX & FULL
                    entry[3] |= 1 << (mark & 63)
                    entry[4] += place
                if len(found) > ENTRIES:
                    yield out()
        if found:
            yield out()

    return pages.where("host <> ''").select("host", "html").mapInArrow(run, FIGURES)


def templates(pages: DataFrame) -> DataFrame:
    """host, template: its tokens of valid classes, in order."""
    # Signatures are sums of 64-bit numbers that may wrap; halves are summed apart, as sums that overflow raise.
    low, high = F.col("signature").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftright("signature", 32)
    wrapped = (F.sum(high) + F.shiftright(F.sum(low), 32)).bitwiseAND(F.lit(0xFFFFFFFF))
    each = token_figures(pages).groupBy("host", "token").agg(F.sum("pages").alias("pages"), F.sum("hits").alias("hits"), wrapped.alias("s1"), F.sum(low).bitwiseAND(F.lit(0xFFFFFFFF)).alias("s2"), F.bit_or("bits").alias("bits"), F.sum("place").alias("place"))
    each = saved(each.where(F.col("pages") >= MIN_PAGES), "page-tokens")
    whole = each.where("token = 0").select("host", F.col("pages").alias("all_pages"), F.bit_count("bits").alias("all_bits")).where(F.col("all_bits") >= MIN_PAGES)
    whole = saved(whole, "page-hosts")  # a row for each host, so that a hot one's tokens needn't meet in one task
    size = whole.select(F.sum(F.octet_length("host") + 16)).first()[0] or 0
    frequent = each.where("token <> 0").join(F.broadcast(whole) if size <= BROADCAST else whole, "host").where((F.col("pages") >= SUPPORT * F.col("all_pages")) & (F.bit_count("bits") >= SUPPORT * F.col("all_bits")))
    classes = frequent.withColumn("size", F.count("*").over(Window.partitionBy("host", "s1", "s2", "pages", "hits"))).where(F.col("size") >= CLASS)
    order = F.sort_array(F.collect_list(F.struct((F.col("place") / F.col("pages")).alias("at"), "token")))
    return classes.groupBy("host").agg(order.getField("token").alias("template"))  # at most a page's tokens / SUPPORT


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", text_col: str = "text") -> DataFrame:
    """pages without html_col, with text_col."""
    names = [n for n in pages.columns if n not in (html_col, text_col)]
    plain = pages.select(*(F.col(n).alias(f"c{i}") for i, n in enumerate(names)), host(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))
    found = saved(templates(plain), "page-templates")
    size = found.select(F.sum(8 * F.size("template") + F.octet_length("host"))).first()[0] or 0
    rows = plain.join(F.broadcast(found) if size <= BROADCAST else found, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for page, template in zip(b.column(len(names)), b.column(len(names) + 1), strict=True):
                template = [x & FULL for x in template.as_py()] if template.is_valid else None
                out.append(extract(page.as_py(), template))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(out, pa.string())], names=[*(f"c{i}" for i in range(len(names))), "text"])

    kinds = ", ".join(f"c{i} {pages.schema[n].dataType.simpleString()}" for i, n in enumerate(names))
    done = rows.select(*(f"c{i}" for i in range(len(names))), "html", "template").mapInArrow(run, f"{kinds}, text string")
    return done.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)), F.col("text").alias(text_col))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = main_text(table(spark, sf_dir, "pages"))
    return done.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
