"""HTML main-text extraction with nearest-URL page differencing.

Each page is paired with the page of the same host whose path is nearest in path order, their text lines (one a
block) are aligned by longest common subsequence, and the lines that both have are the site's frame, unless they
are so much of the page (SAME of its characters or more) that the pair are copies; then the neighbour on the other
side is asked.  Every page with a neighbour goes through this.

What is deleted is decided with the page's markup as further evidence.  Menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments are known by element, role or class and always deleted, as on
pages whose frame differs from page to page differencing can't see it.  Text of a marked article (``article``,
``main``) without such evidence is kept, though a neighbour has it too: articles quote the same passages.  All
other text, which is that of pages without a marked article and of parts of an article with a doubtful class name,
is deleted if it is shared or mostly links.

Pages are read twice, so that only hashes of lines are sorted, by host and path; a host with a third of all pages
is spread over as many range partitions as it fills, and the pages at partition borders are passed over the borders.
A page is scanned in one pass, in time that grows with its length whatever is in it.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiscope.llm.runtime import by_value, discard, materialize

by_value(__name__)

SAME, MOSTLY = 0.8, 0.5
#: A tag; quotes count only behind an equals sign.  The second one, for pages with an unfinished tag, knows no quotes.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?>[^>=]+|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
BROKEN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>?+")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label",
    "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "td", "th", "time", "tt", "u", "var", "wbr",
}
ROOTS = {"article", "main"}
#: Elements whose text is never the article's.
DROPPED = {
    "aside", "button", "canvas", "dialog", "footer", "form", "head", "iframe", "menu", "nav", "noscript", "object", "script", "select", "style", "svg", "template",
    "textarea", "title",
}
RAW = {"script", "style", "textarea", "title"}
ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search", "toolbar"}
COMMENTS = {"comment", "comments", "commentlist", "disqus", "replies", "respond"}
NAMED = COMMENTS | {
    "ad", "ads", "advert", "advertisement", "advertising", "adverts", "banner", "breadcrumb", "breadcrumbs", "consent", "cookie", "cookies", "footer", "gdpr",
    "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "pagination", "popup", "promo",
    "related", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
#: Words of NAMED that an article's own parts may have in their names, and elements that are such parts.
DOUBTFUL = {"banner", "notification", "promo", "related", "search", "share", "sharing", "social", "sponsor", "subscribe", "toolbar", "widget"}
PARTS = {"blockquote", "dd", "dl", "dt", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ol", "p", "pre", "section", "table", "tr"}
#: Where an element that is never closed ends.
NEXT_PART = {"article", "main", "section", "footer", "body"}
#: Elements that hold the whole page; their classes say nothing about a part of it.
FRAMES = {"html", "body"}


#: What speaks for a block: it is in a marked article; in one, but under a doubtful name; elsewhere; in the frame.
ARTICLE, DOUBT, ELSEWHERE, FRAME = range(4)


def _against(tag: str, attributes: str, in_root: bool) -> int | None:
    """FRAME or DOUBT if an element's name, role or class speaks against its text, else None."""
    if tag in DROPPED or tag == "header" and not in_root:
        return FRAME
    if not attributes or tag in FRAMES:
        return None
    found = {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
    if "hidden" in found or re.search(r"display\s*:\s*none", found.get("style", "")):
        return FRAME
    if found.get("role", "").lower() in ROLES:
        return FRAME
    names = re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{found.get('class', '')} {found.get('id', '')}").lower()
    words = set(re.split(r"[^a-z]+", names))
    if tag in ROOTS:
        return FRAME if words & COMMENTS else None
    known = words & NAMED
    if known:
        whole = set(names.split())
        return DOUBT if in_root and known <= DOUBTFUL and (tag in PARTS or not known & whole) else FRAME
    return FRAME if "header" in words and not in_root and tag in ("div", "section") else None


class _Region:
    """An element with evidence against its text: the pieces and tags from its opening to its end."""

    def __init__(self, kind: int, piece: int, tag: int, soft: bool, depth: int):
        self.kind, self.first, self.opened, self.soft, self.depth = kind, piece, tag, soft, depth
        self.last = self.closed = None


def parse(html: str | None) -> list[tuple[str, int, bool]]:
    """The page's text blocks in order: text, evidence, and whether the text is mostly that of links."""
    html = html or ""
    pieces: list[str] = []
    inside: list[bool] = []
    linked: list[bool] = []
    cuts = [0]
    regions: list[_Region] = []
    active: dict[str, list[tuple[int, _Region]]] = {}
    count: dict[str, int] = {}
    roots: list[int] = []
    parts: list[tuple[int, int]] = []
    endless: set[str] = set()
    depth = at = tags = 0
    link = broken = False

    def add(text: str) -> None:
        if text:
            pieces.append(html_lib.unescape(text) if "&" in text else text)
            inside.append(depth > 0)
            linked.append(link)

    def flush() -> None:
        if cuts[-1] < len(pieces):
            cuts.append(len(pieces))

    while True:
        lt = html.find("<", at)
        add(html[at : lt if lt >= 0 else len(html)])
        if lt < 0:
            break
        after = html[lt + 1 : lt + 3]
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = end + 3 if end >= 0 else len(html)
            continue
        if after[:1] in ("!", "?") or after[:1] == "/" and not after[1:2].isalpha():
            end = -1 if ">" in endless else html.find(">", lt)
            if end < 0:
                endless.add(">")
                add("<")
                at = lt + 1
            else:
                at = end + 1
            continue
        m = None if broken else TAG.match(html, lt)
        if m is None and after[:1].isascii() and (after[:1].isalpha() or after[:1] == "/"):
            broken = True
            m = BROKEN_TAG.match(html, lt)
        if m is None:
            add("<")
            at = lt + 1
            continue
        at = m.end()
        tags += 1
        closing, tag = bool(m[1]), m[2].lower()
        if tag == "a":
            link = not closing
        if not closing and tag in NEXT_PART:
            flush()
            parts.append((tags, len(pieces)))
        against = None if closing else _against(tag, m[3], depth > 0)
        if tag not in INLINE:
            flush()
        elif tag in ("br", "td", "th", "img"):
            add(" ")
        if against is not None:
            if tag in VOID or m[3].rstrip().endswith("/") and tag not in RAW:
                continue
            if tag in RAW and tag not in endless:
                end = re.compile(rf"</{tag}[^>]*>", re.I).search(html, at)
                if end:
                    at = end.end()
                    continue
                endless.add(tag)
            region = _Region(against, len(pieces), tags, not depth and tag not in DROPPED, depth)
            regions.append(region)
            count[tag] = count.get(tag, 0) + 1 if tag in active else 1
            active.setdefault(tag, []).append((count[tag], region))
            if tag in ROOTS:
                depth += 1
            continue
        if tag in active:
            if not closing:
                count[tag] += tag not in VOID
            else:
                level, region = active[tag][-1]
                if count[tag] == level:
                    region.last, region.closed, depth = len(pieces), tags, region.depth
                    active[tag].pop()
                    if not active[tag]:
                        del active[tag]
                    count[tag] -= 1
                    continue
                count[tag] -= 1
        if tag in ROOTS:
            if not closing:
                roots.append(tags)
            depth = max(0, depth + (-1 if closing else 1))
    flush()

    n = len(pieces)
    bounds = {kind: [0] * (n + 1) for kind in (FRAME, DOUBT)}
    for r in regions:
        last = r.last
        if last is None:  # never closed: up to the next part of the page
            nxt = bisect_right(parts, (r.opened, n))
            last = parts[nxt][1] if nxt < len(parts) else n
        elif r.soft and bisect_right(roots, r.closed) > bisect_right(roots, r.opened):
            continue  # a wrapper around the article, whatever its name
        bounds[r.kind][r.first] += 1
        bounds[r.kind][last] -= 1
    frame, doubt = (list(accumulate(bounds[kind])) for kind in (FRAME, DOUBT))
    out = []
    for a, b in zip(cuts, cuts[1:]):
        own = [k for k in range(a, b) if not frame[k]]
        text = " ".join("".join(pieces[k] for k in own).split())
        if text:
            kind = (DOUBT if doubt[own[0]] else ARTICLE) if inside[own[0]] else ELSEWHERE
            out.append((text, kind, sum(len(pieces[k]) for k in own if linked[k]) >= MOSTLY * sum(len(pieces[k]) for k in own)))
        elif text := " ".join("".join(pieces[a:b]).split()):
            out.append((text, FRAME, False))
    return out


def decide(found: list[tuple[str, int, bool]], shared: set[int] = frozenset()) -> list[str]:
    """The article's blocks, given which of the page's blocks its neighbour shares."""
    marked = any(kind in (ARTICLE, DOUBT) for _, kind, _ in found)
    if marked:
        return [t for i, (t, kind, links) in enumerate(found) if kind == ARTICLE or kind == DOUBT and not links and i not in shared]
    rest = [(i, t, links) for i, (t, kind, links) in enumerate(found) if kind == ELSEWHERE]
    only_links = all(links for _, _, links in rest)
    return [t for i, t, links in rest if i not in shared and (only_links or not links)]


def blocks(html: str | None) -> list[str]:
    """The article's blocks of a page without neighbours."""
    return decide(parse(html))


def common_lines(a: list[int], b: list[int]) -> list[bool]:
    """For each line of ``a``, whether it is in a longest common subsequence of ``a`` and ``b``."""
    shared = [False] * len(a)
    low = 0
    while low < len(a) and low < len(b) and a[low] == b[low]:
        shared[low] = True
        low += 1
    i, j = len(a), len(b)
    while i > low and j > low and a[i - 1] == b[j - 1]:
        i, j = i - 1, j - 1
        shared[i] = True
    x, y = a[low:i], b[low:j]
    if not x or not y:
        return shared
    where: dict[int, int] = {}
    for k, line in enumerate(y):
        where[line] = where.get(line, 0) | 1 << k
    full = (1 << len(y)) - 1
    row, rows = full, []  # a zero bit k: the length grows at column k
    for line in x:
        hit = where.get(line, 0)
        u = row & hit
        row = ((row + u) | (row - u)) & full
        rows.append(row)
    k = len(y)
    for r in range(len(x) - 1, -1, -1):
        if not k:
            break
        before = rows[r - 1] if r else full
        mask = (1 << k) - 1
        if (rows[r] & mask).bit_count() == (before & mask).bit_count():
            continue  # the subsequence is as long without this line
        grown = ~rows[r] & mask
        k = grown.bit_length() - 1
        while y[k] != x[r]:
            k -= 1
        shared[low + r] = True
    return shared


def _host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1), F.lit(""))


def with_neighbours(pages: DataFrame) -> DataFrame:
    """``pages(host, path, page_id, hashes, ...)`` with the path and hashes of the pages before and after each
    in the order of (host, path, page_id), where they are of the same host."""
    order = ["host", "path", "page_id"]
    dealt = materialize(pages.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "pages-in-order")
    within = W.partitionBy("part").orderBy(*order)
    entry = F.struct("host", "path", "hashes")
    rows = dealt.withColumn("before", F.lag(entry).over(within)).withColumn("after", F.lead(entry).over(within))
    # One row per partition; what a partition lacks at its ends comes from the nearest partitions that have rows.
    place = F.struct(*order)
    ends = dealt.groupBy("part").agg(F.min_by(entry, place).alias("head"), F.max_by(entry, place).alias("tail"))
    parts = W.partitionBy(F.lit(0)).orderBy("part")
    ends = ends.select("part", F.lag("tail").over(parts).alias("tail"), F.lead("head").over(parts).alias("head"))
    rows = rows.join(ends, "part").withColumn("before", F.coalesce("before", "tail")).withColumn("after", F.coalesce("after", "head"))
    same = lambda c: F.when(F.col(f"{c}.host") == F.col("host"), F.struct(f"{c}.path", f"{c}.hashes"))
    return rows.withColumn("before", same("before")).withColumn("after", same("after")).drop("part", "head", "tail")


def shared_lines(own: list[int], sizes: list[int], path: str, before: dict | None, after: dict | None) -> list[int]:
    """Which lines the page has in common with its nearest neighbour; none if both neighbours are copies of it."""
    for near in _nearest(path, before, after):
        shared = common_lines(own, near)
        if sum(n for n, s in zip(sizes, shared) if s) < SAME * sum(sizes):
            return [i for i, s in enumerate(shared) if s]
    return []


def _nearest(path: str, before: dict | None, after: dict | None) -> list[list[int]]:
    """Hashes of the neighbours' lines, that with the longer common beginning of the path first, the one before in a tie."""

    def common(other: dict) -> int:
        n = 0
        for x, y in zip(path, other["path"]):
            if x != y:
                break
            n += 1
        return n

    return [x["hashes"] for x in sorted((x for x in (before, after) if x), key=common, reverse=True)]


def page_lines(pages: DataFrame) -> DataFrame:
    """``(k1, k2, page_id, url, hashes, sizes)`` of each distinct page that has text; ``k1`` and ``k2`` are hashes of
    the whole row, ``hashes`` those of its lines, ``sizes`` their characters."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [parse(h) for h in part.column(4).to_pylist()]
                hashes = pa.array([[(xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) + (1 << 63)) % (1 << 64) - (1 << 63) for t, _, _ in b] for b in found], pa.list_(pa.int64()))
                sizes = pa.array([[len(t) for t, _, _ in b] for b in found], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], hashes, sizes], ["k1", "k2", "page_id", "url", "hashes", "sizes"])

    lines = _keyed(pages).mapInArrow(run, "k1 long, k2 long, page_id long, url string, hashes array<long>, sizes array<int>")
    return lines.filter("size(hashes) > 0").dropDuplicates(["k1", "k2"])


def _keyed(pages: DataFrame) -> DataFrame:
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    row = [F.xxhash64(*(F.lit(k),) * k, "page_id", "url", "html", F.col("url").isNull()) for k in (0, 1)]
    return narrow.select(row[0].alias("k1"), row[1].alias("k2"), "page_id", "url", "html")


def page_differences(pages: DataFrame) -> DataFrame:
    """``(k1, k2, shared)`` for each distinct page that has lines in common with its nearest neighbour, written;
    ``shared`` are the lines' numbers."""

    def differ(batches):
        for batch in batches:
            rows = batch.select(["hashes", "sizes", "path", "before", "after"]).to_pylist()
            shared = pa.array([shared_lines(*r.values()) for r in rows], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), shared], ["k1", "k2", "shared"])

    lines = page_lines(pages).withColumn("host", _host(F.col("url"))).withColumn("path", _path(F.col("url"))).drop("url")
    lines = materialize(lines, "page-lines")
    found = with_neighbours(lines).filter("before is not null or after is not null")
    out = materialize(found.mapInArrow(differ, "k1 long, k2 long, shared array<int>").filter("size(shared) > 0"), "page-shared")
    discard(lines)
    return out


def extract_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages(page_id, url, html)``.

    Null and empty html, and html without text, give the empty text; a null or odd url belongs to the host
    without a name; pages without a neighbour on their host share no lines; repeated rows are one page for their
    neighbours and come out repeated; an empty table gives no rows.  Other columns are not read.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = ["\n\n".join(decide(parse(h), set(s or ()))) for h, s in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    shared = page_differences(pages)
    rows = _keyed(pages).join(shared, ["k1", "k2"], "left").select("page_id", "url", "html", "shared")
    return rows.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
