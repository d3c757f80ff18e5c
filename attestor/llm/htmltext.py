"""HTML main-text extraction by nearest-URL page differencing.

A page becomes lines: its blocks in page order, character references decoded,
white space inside a block one space. Pages of one host with equal lines are
one page, that of the first path. Pages of a host are ordered by URL path, and
each is paired with the neighbour in that order whose path shares
the longer beginning. The lines of the two are aligned by longest common
subsequence; shared lines are what the site repeats, and go. Of those, lines
that at most FEW_PAGES different pages of the host have stay if they have
LONG_WORDS words or the host has many more pages: they are text that the site
carries in several versions, or short lines that are equal by chance.

Markup comes in where differencing cannot tell. Lines inside an element that a
page marks as its article or main part are protected: a site may carry an
article twice. On such a page, other lines that are not shared stay if they
have LONG_WORDS words; short ones go, as do lines inside menus, headers,
footers, sidebars, notices, adverts, forms and reader comments (by tag, role,
or the whole or the beginning of a class or id), which sites draw from pools,
so that neighbours need not share them. An element that goes by class, id or
role, or is a form, may be the page's layout: a main part in it stays, an
article if the page has no other and no more text outside it, and all of it if
the page marks no main part and has less text elsewhere, but for adverts,
comments and notices on cookies.

What is ordered, exchanged and aligned is one row a page with 64-bit hashes of
its lines. Neighbours are found in ranges of the order with the borders of
ranges handed over, so a host with a third of all pages is spread like others.
A page is parsed twice, for its hashes and for its text: keeping the text of
all pages between would add about half the input to the disk that is needed.
Parsing takes time in proportion to the page, whatever its markup.
"""

from __future__ import annotations

import html as htmllib
import re
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import Workspace, read_table, ship_code

_TAG = re.compile(r"""<!--|<!\[CDATA\[|<[!?]|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript template".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody tfoot thead tr ul".split()
)
_SPACED = frozenset("br td th".split())
_DROPPED = frozenset("aside button canvas datalist dialog footer form head map menu meter nav noscript object optgroup option progress search select svg video audio math".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status tablist toolbar".split())
_WORDS = frozenset(
    "ad ads adbox adsense advert advertisement adverts alert aside banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form gdpr hidden login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination paywall popup promo promotion recommended related replies reply respond search share sharing sidebar signin signup skip social sponsor sponsored subscribe subscription tagcloud toolbar widget widgets".split()
)
#: Of these, what is no page's layout.
_NOISE = frozenset("ad ads adbox adsense advert advertisement adverts comment comments consent cookie cookies disqus gdpr replies reply respond sponsor sponsored".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_NEVER_DROPPED = frozenset("html body article main".split())
_NAME = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
PLAIN, MAIN, DROPPED, LAYOUT, RESCUED, NOISE = 0, 1, 2, 3, 4, 5
LONG_WORDS, FEW_PAGES, MANY_PAGES = 20, 5, 50
_UNTAGGED = re.compile(r"<!--|<!\[CDATA\[|<[!?]")
_CONTAINERS = {tag: (tag, "ul", "ol", "dl", "table", "select") for tag in ("li", "dd", "dt", "option", "tr")}


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): htmllib.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)} if raw.strip(" /\t\n") else {}


def _names(at: dict[str, str]) -> set[str]:
    """Each name in class and id without its separators, and its first part."""
    parts = [[x.lower() for x in _NAME.findall(name)] for c in ("class", "id") for name in at.get(c, "").split()]
    return {x for p in parts if p for x in (p[0], "".join(p))}


def _kind(tag: str, raw: str, inside_main: bool) -> tuple[int, bool]:
    """What an element's markup makes of it, and whether it is a page header
    (of which an article keeps the headings)."""
    if tag in _DROPPED and tag != "form":
        return DROPPED, False
    at = _attributes(raw)
    if not at:
        return (MAIN if tag in ("article", "main") else LAYOUT if tag == "form" else PLAIN), tag == "header"
    role = at.get("role", "").lower()
    if "hidden" in at or at.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(at.get("style", "")):
        return DROPPED, False
    if tag not in _NEVER_DROPPED:
        names = _names(at)
        if tag == "form" or role in _ROLES or names & _WORDS:
            return (NOISE if names & _NOISE else LAYOUT), False
        if tag == "header" or "header" in names:
            return PLAIN, True
    elif tag == "article" and _names(at) & {"comment", "comments", "reply"}:
        return DROPPED, False
    main = tag in ("article", "main") or role in ("main", "article") or at.get("itemprop", "").lower() == "articlebody"
    return (MAIN if main else PLAIN), False


def blocks(page: str | None) -> list[tuple[str, int]]:
    """The blocks with text of one page, each PLAIN, MAIN or DROPPED."""
    page, at, out, text = page or "", 0, [], []
    last = page.rfind(">")  # no tag ends after it
    # open elements: (tag, in main, PLAIN or how it is dropped, in a page header)
    stack: list[tuple[str, bool, int, bool]] = [("", False, PLAIN, False)]
    headings = 0
    places: dict[str, list[int]] = {}  # of open elements in the stack, by tag

    def close() -> None:
        if text:
            joined = " ".join(htmllib.unescape("".join(text)).split())
            text.clear()
            if joined:
                _, main, dropped, header = stack[-1]
                if header and not (main and headings):
                    dropped = DROPPED
                out.append((joined, dropped or (MAIN if main else PLAIN)))

    def pop(n: int) -> None:
        nonlocal headings
        for tag, *_ in reversed(stack[n:]):
            headings -= tag in _HEADINGS
            places[tag].pop()
        del stack[n:]

    while at < len(page):
        m = (_TAG if at <= last else _UNTAGGED).search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at, lead = m.end(), m[0]
        if lead == "<!--":
            end = page.find("-->", at)
            at = len(page) if end < 0 else end + 3
            continue
        if lead == "<![CDATA[":
            end = page.find("]]>", at)
            text.append(htmllib.escape(page[at : None if end < 0 else end]))
            at = len(page) if end < 0 else end + 3
            continue
        if lead in ("<!", "<?"):
            end = page.find(">", at)
            at = len(page) if end < 0 else end + 1
            continue
        closing, tag, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        tag = tag.lower()
        if tag in _RAW:
            if not closing:
                end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
                at = len(page) if end is None else end.end()
            continue
        if tag in _BLOCK:
            close()
        elif tag in _SPACED:
            text.append(" ")
        if closing:
            n = places[tag][-1] if places.get(tag) else 0
            if n:
                _, _, dropped, _ = stack[n]
                if dropped != stack[n - 1][2]:
                    close()
                pop(n)
            continue
        if tag in _VOID:
            continue
        if tag in _BLOCK and stack[-1][0] == "p":
            pop(len(stack) - 1)
        elif tag in _CONTAINERS:
            n = max((places[t][-1] for t in _CONTAINERS[tag] if places.get(t)), default=0)
            if n and stack[n][0] == tag:
                pop(n)
        _, main, dropped, header = stack[-1]
        kind, heads = _kind(tag, raw, main)
        now = dropped
        if DROPPED in (kind, dropped):
            now = DROPPED
        elif kind in (LAYOUT, NOISE):
            now = NOISE if NOISE in (kind, dropped) else LAYOUT
        elif kind == MAIN and not main:
            header = False
            if dropped in (LAYOUT, NOISE):
                now = PLAIN if tag == "main" or _attributes(raw).get("role", "").lower() == "main" else RESCUED
        if now != dropped:
            close()
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, main or kind == MAIN, now, header or heads))
        headings += tag in _HEADINGS
    close()
    size = {k: sum(len(t) for t, kind in out if kind == k) for k in (PLAIN, MAIN, RESCUED, LAYOUT)}
    is_main = not size[MAIN] and size[RESCUED] >= size[PLAIN] and size[RESCUED] > 0
    whole = not size[MAIN] and not is_main and size[LAYOUT] > size[PLAIN]
    final = {PLAIN: PLAIN, MAIN: MAIN, RESCUED: MAIN if is_main else DROPPED, LAYOUT: PLAIN if whole else DROPPED}
    return [(t, final.get(kind, DROPPED)) for t, kind in out]


def shared_lines(a: list, b: list) -> list[int]:
    """Places in a of one longest common subsequence of a and b."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    found = [*range(low), *range(len(a) - high, len(a))]
    both = set(a[low : len(a) - high]) & set(b[low : len(b) - high])
    x = [i for i in range(low, len(a) - high) if a[i] in both]
    y = [b[j] for j in range(low, len(b) - high) if b[j] in both]
    if not x:
        return sorted(found)
    # One bit a line of b: a zero in row i's bits [0, j) for each unit of the
    # length of the subsequence of a's first i lines and b's first j.
    where: dict = {}
    for j, line in enumerate(y):
        where[line] = where.get(line, 0) | 1 << j
    every = (1 << len(y)) - 1
    rows = [every]
    for i in x:
        v = rows[-1]
        u = v & where[a[i]]
        rows.append(((v + u) | (v - u)) & every)
    i, j = len(x), len(y)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif (~rows[i - 1] & ((1 << j) - 1)).bit_count() == (~rows[i] & ((1 << j) - 1)).bit_count():
            i -= 1
        else:
            i, j = i - 1, j - 1
            found.append(x[i])
    return sorted(found)


def address(url: str | None) -> tuple[str, str]:
    """Host and path, with query, for the order of pages."""
    try:
        parts = urlsplit((url or "").strip())
        return (parts.netloc.rpartition("@")[2].lower().removesuffix(":80").removesuffix(":443"), f"{parts.path}?{parts.query}" if parts.query else parts.path)
    except ValueError:
        return "", url or ""


_HASHED = "page_id long, th long, host string, path string, seq long, lines array<long>, long array<long>"


def _hashed(batches):
    for batch in batches:
        out = []
        for page, th, url, source in zip(*(batch.column(c) for c in ("page_id", "th", "url", "html")), strict=True):
            texts = [t for t, _ in blocks(source.as_py())]
            lines = np.array([xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t in texts], np.uint64)
            long = np.unique(lines[[len(t.split()) >= LONG_WORDS for t in texts]]) if texts else lines
            seq = np.array([xxh64_intdigest(lines.tobytes())], np.uint64).view(np.int64)[0]
            out.append((page.as_py(), th.as_py(), *address(url.as_py()), seq, lines.view(np.int64), long.view(np.int64)))
        columns = list(zip(*out, strict=True)) or [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "th", "host", "path", "seq", "lines", "long"])


def _common(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def _aligned(batches):
    for batch in batches:
        rows, gone = batch.to_pylist(), []
        for r in rows:
            near = [n for n in (r["before"], r["after"]) if n and n["host"] == r["host"]]
            pick = max(near, key=lambda n: _common(n["path"] or "", r["path"] or ""), default=None)  # the one before, of equals
            kept = set(r["kept"] or ())
            gone.append([i for i in shared_lines(r["lines"], pick["lines"]) if r["lines"][i] not in kept] if pick else [])
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("seq"), pa.array(gone, pa.list_(pa.int32()))], ["host", "seq", "gone"])


def differences(pages: DataFrame) -> DataFrame:
    """(page_id, th, gone): the lines of each distinct page that its nearest
    different page shares, without long ones of few pages; th is a hash of its
    url and html. A page alone on its host, but for copies, shares none."""
    spark = pages.sparkSession
    ws = Workspace(spark, "htmltext")
    hashed = ws.write(pages.select("page_id", "th", "url", "html").mapInArrow(_hashed, _HASHED), "hashed")
    order = ["host", "path", "page_id", "th"]
    first = F.min_by(F.struct("path", "page_id", "th", "lines", "long"), F.struct("path", "page_id", "th")).alias("page")
    different = ws.write(hashed.groupBy("host", "seq").agg(first).select("host", "seq", "page.*"), "different")
    ranged = ws.write(different.drop("long").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()), "ranges")
    # The lines that few pages of a host have, of long ones or on large hosts.
    # Tables between, so that a line that is on very many pages is split.
    each = different.select("host", "seq", "long", F.explode(F.array_distinct("lines")).alias("line"))
    each = each.select("host", "seq", "line", F.array_contains("long", F.col("line")).alias("is_long")).withColumn("at", F.xxhash64("host", "line"))
    few = each.groupBy("at").agg(F.count("*").alias("n")).where(F.col("n").between(2, FEW_PAGES)).select("at")
    versions = ws.write(each.join(ws.write(few, "few"), "at", "left_semi").drop("at"), "versions")
    large = ws.write(different.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") >= MANY_PAGES).select("host"), "large")
    stay = versions.where("is_long").unionByName(versions.where("not is_long").join(large, "host", "left_semi"))
    kept = stay.groupBy("host", "seq").agg(F.collect_set("line").alias("kept"))
    near = F.struct("host", "path", "lines")
    inside = Window.partitionBy("range").orderBy(*order)
    rows = ranged.withColumns({"before": F.lag(near).over(inside), "after": F.lead(near).over(inside)})
    # Borders: each range's first and last row, one row a range, to the next.
    key = F.struct(*order)
    borders = ranged.groupBy("range").agg(F.max_by(near, key).alias("last"), F.min_by(near, key).alias("first"))
    along = Window.orderBy("range")
    borders = borders.select(F.col("range").alias("_range"), F.lag("last").over(along).alias("_before"), F.lead("first").over(along).alias("_after"))
    rows = rows.join(borders, F.col("range") == F.col("_range")).withColumns({"before": F.coalesce("before", "_before"), "after": F.coalesce("after", "_after")})
    rows = rows.select("host", "seq", "path", "lines", "before", "after").join(kept, ["host", "seq"], "left")
    gone = ws.write(rows.mapInArrow(_aligned, "host string, seq long, gone array<int>"), "gone")
    # Rows equal in page_id and th are one page.
    found = ws.write(hashed.select("page_id", "th", "host", "seq").distinct().join(gone, ["host", "seq"]).select("page_id", "th", "gone"), "pages")
    for table in (hashed, different, ranged, versions, large, gone):
        ws.drop(table)
    return found


def main_text(page: str | None, gone: list[int] | np.ndarray | None) -> str:
    """The text of one page whose nearest page shares the lines gone."""
    found = blocks(page)
    shared = set() if gone is None else set(map(int, gone))
    marked = any(kind == MAIN for _, kind in found)

    def stays(i: int, text: str, kind: int) -> bool:
        return kind == MAIN or kind == PLAIN and i not in shared and (not marked or len(text.split()) >= LONG_WORDS)

    return "\n".join(t for i, (t, kind) in enumerate(found) if stays(i, t, kind))


def _texts(pages: pd.Series, gone: pd.Series) -> pd.Series:
    return pd.Series([main_text(p, g) for p, g in zip(pages, gone, strict=True)], dtype=object)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages.

    text is the page's main text, one block a line, and empty if there is
    none, as for a null html. A null or malformed url counts as a host of its
    own name, the empty one. n_chars counts code points.
    """
    ship_code(pages.sparkSession)
    url, source = F.col("url").cast("string"), F.col("html").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), source.alias("html")).withColumn("th", F.xxhash64("url", "html"))
    gone = differences(rows).select(F.col("page_id").alias("_page"), F.col("th").alias("_th"), "gone")
    # A merge join at every size, as with many pages.
    both = rows.join(gone.hint("merge"), F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("th") == F.col("_th")), "left")
    return both.select("page_id", "url", F.pandas_udf(_texts, "string")("html", "gone").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
