"""Operator 5: main text of HTML pages by markup and nearest-URL page differencing.

A page is parsed into text lines, one per block, each in a zone: what menus, headers, footers, sidebars, notices, adverts,
forms, scripts and comments hold is out, what an article or main element holds is the article, the rest is open. Pages are
paired with the nearest page of their host: of the two neighbours in the order of URL paths, that with more leading path
segments in common. All lines of both, of every page that has a neighbour, are aligned by their longest common
subsequence. A shared line that lies outside the neighbour's article belongs to the site, not to the page, and is deleted,
wherever it stands in this page; what both hold in an article is kept, since articles of one host share passages and whole
copies. Where the neighbour marks no article, its open lines may be prose, and only open lines are deleted. Of a page with
an article element the lines inside it are the text. Lines are compared by 64-bit hashes, so that no text is joined.

Neighbours come from a range partition of the URLs alone; only the first and last row of each partition meet on the
driver, to close the gaps between partitions. So a host with any share of all pages is spread over many tasks.

Cases: null html is empty; text that is only white space makes no line; a null URL is a host of its own without
neighbours; a page whose text would be empty, since all of it is shared, keeps it; pages that repeat an id or URL are
pages of their own; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from html.parser import HTMLParser
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import join_counted
from sensorloom.session import spool

OPEN, ARTICLE = 1, 2

_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
_OUT = set("head script style noscript template svg math iframe object canvas audio video select button textarea form nav footer aside dialog menu".split())
_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices notification alert sidebar widget widgets related recommended recommendations share sharing social comment comments "
    "disqus reply replies respond discussion nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer header masthead "
    "newsletter subscribe subscription signup login popup modal overlay copyright toolbar skip teaser trending popular".split()
)
_CLOSED_BY_BLOCK = "p"
_ALONE = {"li": {"ul", "ol", "menu"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}


class _Lines(HTMLParser):
    """Collects (text, zone) of each block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int]] = []
        self.stack: list[tuple[str, int]] = []  # open elements with the zone inside them
        self.text: list[str] = []

    @property
    def zone(self) -> int:
        return self.stack[-1][1] if self.stack else OPEN

    def flush(self) -> None:
        line = " ".join("".join(self.text).split())
        self.text = []
        if line and self.zone:
            self.lines.append((line, self.zone))

    def _inside(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        now = self.zone
        if not now or tag in _OUT or (tag in ("header", "hgroup") and now != ARTICLE):
            return 0
        a = dict(attrs)
        role = (a.get("role") or "").lower()
        if role in _ROLES or "hidden" in a or (a.get("aria-hidden") or "").lower() == "true":
            return 0
        if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style") or ""):
            return 0
        if tag not in ("html", "body", "article", "main", "h1"):
            names = re.split(r"[^a-z0-9]+", f"{a.get('class') or ''} {a.get('id') or ''}".lower())
            if not _WORDS.isdisjoint(names):
                return 0
        return ARTICLE if tag in ("article", "main") or role in ("main", "article") else now

    def _pop_to(self, place: int) -> None:
        del self.stack[place:]

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            if tag in ("br", "hr"):
                self.text.append("\n")
            return
        if tag not in _INLINE:
            self.flush()
            for place in range(len(self.stack) - 1, -1, -1):  # an open paragraph ends where a block begins
                name = self.stack[place][0]
                if name == _CLOSED_BY_BLOCK:
                    self._pop_to(place)
                    break
                if name not in _INLINE:
                    break
            if tag in _ALONE:
                for place in range(len(self.stack) - 1, -1, -1):
                    name = self.stack[place][0]
                    if name == tag or {name, tag} == {"dt", "dd"} or {name, tag} == {"td", "th"}:
                        self._pop_to(place)
                        break
                    if name in _ALONE[tag]:
                        break
        elif self._inside(tag, attrs) != self.zone:
            self.flush()
        self.stack.append((tag, self._inside(tag, attrs)))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        place = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag), None)
        if tag not in _INLINE:
            self.flush()
        if place is None:
            return
        below = self.stack[place - 1][1] if place else OPEN
        if below != self.zone:
            self.flush()
        self._pop_to(place)

    def handle_data(self, data):
        if self.zone:
            self.text.append(data)


def all_lines(html: str | None) -> list[tuple[str, int]]:
    """Text lines of a page with their zone; without those that its markup puts out."""
    parser = _Lines()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.lines


def _kept_zone(zones: Iterable[int]) -> int:
    """The zone that the text of a page comes from."""
    return ARTICLE if ARTICLE in zones else OPEN


def page_lines(html: str | None) -> list[tuple[str, int]]:
    """The lines that make up a page by its markup alone: its article, or all open lines."""
    lines = all_lines(html)
    kept = _kept_zone([z for _, z in lines])
    return [x for x in lines if x[1] == kept]


def place_of(url: str | None) -> tuple[str | None, str]:
    """Host and path of a URL."""
    try:
        parts = urlsplit(url or "")
        return (parts.netloc.lower() or None) if url else None, parts.path
    except ValueError:
        return None, url or ""


def shared_lines(mine: Sequence, other: Sequence) -> set[int]:
    """Places in `mine` of a longest common subsequence of both."""
    return set(aligned(mine, other))


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of `a` and each beginning of `b`."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        step = np.where(b == x, row[:-1] + 1, 0)
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], step))
    return row


def _pairs(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A longest common subsequence as pairs of places, by halving `a`: its memory grows with the lines, not their product."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 == a1 or b0 == b1:
            continue
        if a1 - a0 == 1:
            at = np.flatnonzero(b[b0:b1] == a[a0])
            found += [(a0, b0 + int(at[0]))] if len(at) else []
            continue
        half = (a0 + a1) // 2
        ahead = _lengths(a[a0:half], b[b0:b1])
        back = _lengths(a[half:a1][::-1], b[b0:b1][::-1])[::-1]
        cut = b0 + int(np.argmax(ahead + back))
        todo += [(a0, half, b0, cut), (half, a1, cut, b1)]
    return found


def aligned(mine: Sequence, other: Sequence) -> dict[int, int]:
    """A longest common subsequence of both: places in `mine` with their places in `other`."""
    both = set(mine) & set(other)
    at = [i for i, x in enumerate(mine) if x in both]
    to = [j for j, x in enumerate(other) if x in both]
    head, end = 0, min(len(at), len(to))
    while head < end and mine[at[head]] == other[to[head]]:
        head += 1
    tail = 0
    while tail < end - head and mine[at[-1 - tail]] == other[to[-1 - tail]]:
        tail += 1
    kept = dict(zip(at[:head], to[:head], strict=True))
    kept.update(zip(at[len(at) - tail :], to[len(to) - tail :], strict=True))
    at, to = at[head : len(at) - tail], to[head : len(to) - tail]
    code = {x: n for n, x in enumerate(both)}
    left, right = (np.array([code[x[i]] for i in places], np.int64) for x, places in ((mine, at), (other, to)))
    kept.update((at[i], to[j]) for i, j in _pairs(left, right))
    return kept


def site_lines(mine: Sequence, zones: Sequence[int], other: Sequence, other_zones: Sequence[int]) -> list[int]:
    """Places in `mine` that the nearest page shows to be the site's."""
    article = ARTICLE in other_zones
    pairs = aligned(mine, other).items()
    gone = {i for i, j in pairs if other_zones[j] == OPEN and (zones[i] == OPEN or article)}
    kept = _kept_zone(zones)
    text = {i for i, z in enumerate(zones) if z == kept}
    return sorted(gone & text) if text - gone else []


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a.split("/"), b.split("/"), strict=False):
        if x != y:
            break
        n += 1
    return n


_LINES = pa.list_(pa.struct([("text", pa.string()), ("zone", pa.int32())]))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            lines = [[{"text": t, "zone": z} for t, z in all_lines(h)] for h in some["html"].to_pylist()]
            hosts, paths = zip(*(place_of(u) for u in some["url"].to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays(
                [some["page_id"], some["url"], pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(lines, _LINES)],
                ["page_id", "url", "host", "path", "lines"],
            )


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The better neighbour of each row inside its sorted partition, and the partition's ends."""
    rows = (r for batch in batches for r in zip(*(batch[c].to_pylist() for c in ("part", "row", "host", "path")), strict=True))
    names = ["row", "mate", "score", "part", "host", "path"]

    def out(buffer):
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*buffer, strict=True), kinds, strict=True)], names)

    before, now, buffer = None, next(rows, None), []
    first = True
    while now is not None:
        after = next(rows, None)
        best = (-1, None)
        for near in (before, after):
            if near is not None and now[2] is not None and near[2] == now[2]:
                best = max(best, (_common(near[3], now[3]), near[1]), key=lambda x: x[0])
        end = first or after is None
        buffer.append((now[1], best[1], best[0], now[0] if end else None, now[2] if end else None, now[3] if end else None))
        first, before, now = False, now, after
        if len(buffer) >= 5000:
            yield out(buffer)
            buffer = []
    if buffer:
        yield out(buffer)


def nearest_pages(places: DataFrame) -> DataFrame:
    """row and mate for rows (row, host, path) that have a neighbour on their host."""
    spark = places.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = places.repartitionByRange(parts, "host", "path", "row").sortWithinPartitions("host", "path", "row")
    dealt = dealt.select(F.spark_partition_id().alias("part"), "row", "host", "path")
    near = spool(dealt.mapInArrow(_neighbours, "row long, mate long, score int, part int, host string, path string"))
    ends = near.where("part is not null").collect()  # two rows per partition
    by_part: dict[int, list] = {}
    for r in ends:
        by_part.setdefault(r.part, []).append(r)
    order = [sorted(by_part[p], key=lambda r: (r.host or "", r.path.encode("utf-8", "surrogatepass"), r.row)) for p in sorted(by_part)]
    better: dict[int, tuple[int, int]] = {}
    for left, right in zip(order[:-1], order[1:], strict=True):
        a, b = left[-1], right[0]
        if a.host is not None and a.host == b.host:
            n = _common(a.path, b.path)
            for me, other in ((a, b), (b, a)):
                if n > better.get(me.row, (me.score, None))[0]:
                    better[me.row] = n, other.row
    fixed = spark.createDataFrame([(r, m) for r, (_, m) in better.items()], "row long, better long")
    out = near.join(F.broadcast(fixed), "row", "left").select("row", F.coalesce("better", "mate").alias("mate"))
    return out.where("mate is not null")


def _differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with places of lines that belong to the site, from the marks of both pages."""
    for batch in batches:
        columns = [batch[c] for c in ("mine", "zones", "other", "other_zones")]
        rows, gone = [], []
        for at in range(0, batch.num_rows, 1024):
            some = zip(batch["row"].slice(at, 1024).to_pylist(), *(c.slice(at, 1024).to_pylist() for c in columns), strict=True)
            for row, *marks in some:
                places = site_lines(*marks)
                if places:
                    rows.append(row)
                    gone.append(places)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], ["row", "gone"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of `pages` (page_id, url, html)."""
    parsed = pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(
        _parse, "page_id long, url string, host string, path string, lines array<struct<text:string,zone:int>>"
    )
    parsed = spool(parsed.withColumn("row", F.monotonically_increasing_id()))
    mates = spool(nearest_pages(parsed.select("row", "host", "path")))
    # Every page with a neighbour is held against it, by hashes of lines.
    marks = parsed.select("row", F.transform("lines", lambda x: F.xxhash64(x["text"])).alias("mine"), F.col("lines.zone").alias("zones"))
    others = marks.select(F.col("row").alias("mate"), F.col("mine").alias("other"), F.col("zones").alias("other_zones"))
    pairs = join_counted(marks, mates, "row", "inner").join(others, "mate")
    gone = spool(pairs.select("row", "mine", "zones", "other", "other_zones").mapInArrow(_differ, "row long, gone array<int>"))
    whole = join_counted(parsed, gone, "row", "left")
    kept_zone = F.when(F.exists("lines", lambda x: x["zone"] == ARTICLE), ARTICLE).otherwise(OPEN)
    places = F.coalesce("gone", F.array().cast("array<int>"))
    kept = F.filter("lines", lambda x, i: (x["zone"] == F.col("kept_zone")) & ~F.array_contains(places, i))
    text = F.array_join(F.transform(kept, lambda x: x["text"]), " ")
    return whole.withColumn("kept_zone", kept_zone).select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
