"""Main text of web pages by differencing with the page of the nearest URL.

1. *Lines.* A page becomes text lines, one for each block. Markup tells some of
   them apart: those inside an article or main element belong to the text;
   those inside menus, headers, footers, sidebars, notices, adverts, forms and
   reader comments, told by element, role, class or id, don't. The rest is open,
   whatever its class says.
2. *Pairs.* Pages with open lines are sorted by host and path. Neighbours that
   share nearly all their open text (``COPY``) are copies and make a run. A page
   is paired with the page before or after its run, on the same host, that
   shares more leading path segments, the one before if both share as many. The
   sort runs over ranges of (host, path, id); runs across ranges are found from
   one row for each range, so pairs don't depend on how the rows are dealt.
3. *Differencing.* The open lines of a pair are aligned by their longest common
   subsequence (a line that repeats is aligned by its number among its equals),
   and shared lines are deleted: a template writes them, not the page. Only
   hashes of the neighbour's lines travel.
4. The text is the lines of articles and the open lines that are left.

Character references are decoded; white space in a block becomes one space;
lines are joined by one line feed in page order.

Nulls and edge cases: a null or empty html has no text (the empty string); a
page whose url is null or has no host, one with a null id, and one whose host
has only copies of it, has no neighbour and is judged by its markup; of rows that repeat an id one serves as
a neighbour; texts are taken whole; an empty table gives no rows; other columns
are not looked at.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from growthcast.session import materialise

#: Named lines are open lines inside an element whose class or id tells an article.
BOILERPLATE, MAIN, OPEN, NAMED = 0, 1, 2, 3
#: Two pages are copies if they share this part of the characters of their open lines.
COPY = 0.9

#: Elements that end a line before and after them.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
#: Elements without an end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the article.
DROPPED = frozenset(
    "aside audio button canvas datalist dialog embed fieldset footer form head iframe input label map math menu nav noscript object option script search "
    "select style svg template textarea title video".split())
MAIN_NAMES = frozenset("article content main post entry story maincontent articlebody".split())
#: Words of a class or id that tell boilerplate.
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner billboard "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay disclaimer paywall "
    "nav navbar navigation menu menubar topbar toolbar breadcrumb breadcrumbs pagination pager tabs skip toc "
    "sidebar sidebars aside rail widget widgets related recommended recommendations trending popular "
    "share sharing social follow subscribe subscription newsletter signup login register search "
    "comment comments commentlist disqus reply replies respond responses discussion reviews "
    "footer foot copyright colophon header masthead sitelogo logo form".split())
#: Of those, the words that also tell for an article or main element.
DROPPED_MAIN = frozenset("ad ads advert adverts advertisement sponsored promo comment comments reply replies related recommended teaser notice".split())
DROPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Lines(HTMLParser):
    """Collects (text, kind) of the blocks of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = []
        self.kind, self.text, self.lines = OPEN, [], []

    def of(self, html: str) -> list[tuple[str, int]]:
        self.reset()
        self.open, self.kind, self.text, self.lines = [], OPEN, [], []
        self.feed(html)
        if re.match("<(!|/?[A-Za-z])", self.rawdata):  # a comment or tag that never ends
            self.rawdata = ""
        self.close()
        self.end_line()
        return self.lines

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """The end of a section; one that is malformed goes up to its first >."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.rawdata.find(">", i) + 1 or -1

    def end_line(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.lines.append((text, self.kind))
            self.text = []

    def handle_data(self, data: str) -> None:
        self.text.append(data)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.end_line()
            if tag in BLOCKS - {"blockquote", "div"} and self.open and self.open[-1][0] == "p":
                self.leave("p")
            if tag in ("li", "tr", "td", "th", "dt", "dd", "option") and self.open and self.open[-1][0] == tag:
                self.leave(tag)
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        kind = self.kind_of(tag, attrs)
        if kind != self.kind:
            self.end_line()
        self.open.append((tag, self.kind))
        self.kind = kind

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_line()
        if any(t == tag for t, _ in self.open):
            self.leave(tag)

    def leave(self, tag: str) -> None:
        """Closes the innermost element of this name and all inside it."""
        while self.open:
            t, before = self.open.pop()
            if before != self.kind:
                self.end_line()
                self.kind = before
            if t == tag:
                break

    def kind_of(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        if self.kind == BOILERPLATE:
            # a heading in an article's own header is its title
            titled = tag in ("h1", "h2") and self.open[-1][0] == "header" and self.open[-1][1] in (MAIN, NAMED)
            return self.open[-1][1] if titled else BOILERPLATE
        if tag in DROPPED or tag == "header":
            return BOILERPLATE
        if tag in ("html", "body") or not attrs and tag not in ("article", "main"):
            return self.kind
        values = dict(attrs)
        if "hidden" in values or values.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", values.get("style") or ""):
            return BOILERPLATE
        role = (values.get("role") or "").lower()
        if role in DROPPED_ROLES:
            return BOILERPLATE
        names = [[w.lower() for w in NAMES.findall(n)] for a in ("class", "id") for n in (values.get(a) or "").split()]
        words = {w for n in names if not {"has", "no", "with", "without"} & set(n) for w in n}
        article = tag in ("article", "main") or role in ("main", "article")
        if words & (DROPPED_MAIN if article or self.kind in (MAIN, NAMED) and tag in ("section",) else DROPPED_NAMES):
            return BOILERPLATE
        return MAIN if article else NAMED if self.kind == OPEN and words & MAIN_NAMES else self.kind


def shared(own: list[int], other: list[int]) -> np.ndarray:
    """Which of the own lines are in a longest common subsequence with the other lines, repeats taken by their number."""
    def numbered(lines: list[int]) -> list[tuple[int, int]]:
        seen: dict[int, int] = {}
        out = []
        for x in lines:
            seen[x] = seen.get(x, 0) + 1
            out.append((x, seen[x]))
        return out

    place = {x: j for j, x in enumerate(numbered(other))}
    # of distinct lines, the longest common subsequence is the longest increasing run of places
    ends: list[int] = []
    at: list[int] = []
    before: list[int] = []
    matched = [(i, place[x]) for i, x in enumerate(numbered(own)) if x in place]
    for k, (_, j) in enumerate(matched):
        n = bisect.bisect_left(ends, j)
        before.append(at[n - 1] if n else -1)
        ends[n:n + 1] = [j]
        at[n:n + 1] = [k]
    out = np.zeros(len(own), bool)
    k = at[-1] if at else -1
    while k >= 0:
        out[matched[k][0]] = True
        k = before[k]
    return out


def is_open(kind: int) -> bool:
    return kind in (OPEN, NAMED)


def main_text(lines: list[tuple[str, int]], both: np.ndarray) -> str:
    """Lines of articles and open lines; ``both`` tells of each open line whether it is shared."""
    common = iter(both.tolist())
    return "\n".join(t for t, kind in lines if kind == MAIN or is_open(kind) and not next(common))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    hosted = rows.where(F.col("page_id").isNotNull() & host_and_path(F.col("url"))[0].isNotNull())
    # html is parsed once for all that pairs need
    codes = materialise(hosted.select("page_id", "url", F.arrow_udf(_hashes, "array<long>")("html").alias("lines")).where("size(lines) > 0")
                        .groupBy("page_id").agg(F.min(F.struct("url", "lines")).alias("_r")).select("page_id", "_r.url", "_r.lines"), "codes")
    others = _nearest(codes).join(codes.select(F.col("page_id").alias("near"), F.col("lines").alias("other")), "near").select("page_id", "other")
    text = F.arrow_udf(_texts, "string")("html", "other")
    # a left join keeps pages without neighbour
    return (rows.join(others, "page_id", "left").select("page_id", "url", text.alias("text"))
            .withColumn("n_chars", F.char_length("text").cast("long")))


def host_and_path(url: Column) -> tuple[Column, Column]:
    parts = r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)(?::\d*)?([^?#]*)"
    return F.nullif(F.lower(F.regexp_extract(url, parts, 1)), F.lit("")), F.regexp_extract(url, parts, 2)


def _nearest(urls: DataFrame) -> DataFrame:
    """(page_id, near) for the pages that have a neighbour; pages with equal or nearly equal ``lines``, if given, are none."""
    host, path = host_and_path(F.col("url"))
    lines = F.col("lines") if "lines" in urls.columns else F.lit(None).cast("array<long>")
    keys = (urls.where("page_id IS NOT NULL").groupBy("page_id").agg(F.min(F.struct(F.col("url"), lines.alias("lines"))).alias("_r"))
            .select("page_id", "_r.url", "_r.lines").select("page_id", host.alias("host"), path.alias("path"), "lines").where("host IS NOT NULL"))
    kind = urls.schema["page_id"].dataType.simpleString()
    order = ["host", "path", "page_id"]
    side = f"struct<page_id:{kind},host:string,path:string>"
    # the ranges are drawn anew whenever this is computed, so it is computed once; a range's last row has no page_id and tells of the range
    dealt = materialise(keys.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _runs, f"part int, page_id {kind}, host string, path string, before {side}, after {side}, opens boolean, closes boolean, "
               f"first {side}, last {side}, first_lines array<long>, last_lines array<long>, whole boolean"), "neighbours")
    # one row of each range
    around = (dealt.where("page_id IS NULL").drop("page_id", "host", "path", "opens", "closes").repartition(1).sortWithinPartitions("part")
              .mapInArrow(_around, f"part int, outer_before {side}, outer_after {side}"))
    found = (dealt.where("page_id IS NOT NULL").join(F.broadcast(around), "part")
             .select(*order, F.when(F.col("opens"), F.col("outer_before")).otherwise(F.col("before")).alias("before"),
                     F.when(F.col("closes"), F.col("outer_after")).otherwise(F.col("after")).alias("after")))

    def common(c: str) -> Column:
        """Number of leading path segments in common; null for another host or none."""
        a, b = F.split("path", "/"), F.split(f"{c}.path", "/")
        same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
        length = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
                             lambda s, x: F.struct((s["n"] + F.when(s["on"] & x, 1).otherwise(0)).alias("n"), (s["on"] & x).alias("on")))["n"]
        return F.when(F.col(f"{c}.host") == F.col("host"), length)

    near = F.when(F.coalesce(common("before"), F.lit(-1)) >= F.coalesce(common("after"), F.lit(-1)), F.when(common("before").isNotNull(), F.col("before.page_id"))).otherwise(F.col("after.page_id"))
    return found.select("page_id", near.alias("near")).where("near IS NOT NULL")


def are_copies(a: np.ndarray | None, b: np.ndarray | None) -> bool:
    """Whether two pages share nearly all characters of their distinct open lines."""
    if a is None or b is None:
        return False
    a, b = np.unique(a), np.unique(b)
    chars = lambda codes: int((codes & LENGTH).sum())
    return 2 * chars(np.intersect1d(a, b, assume_unique=True)) >= COPY * (chars(a) + chars(b))


def _lines_of(x: pa.Scalar) -> np.ndarray | None:
    return x.values.to_numpy() if x.is_valid else None


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted range with the rows before and after their run of copies; the range's own row comes last.

    A range's keys are held, and the lines of its first and last row.
    """
    from pyspark import TaskContext

    names = ["page_id", "host", "path"]
    rows, heads, types, first, last = [], [], None, None, None
    for batch in batches:
        types = types or {n: batch.schema.field(n).type for n in names}
        for row, x in zip(batch.select(names).to_pylist(), batch.column("lines")):
            own = _lines_of(x)
            if not rows or rows[-1]["host"] != row["host"] or not are_copies(last, own):
                heads.append(len(rows))
            first = own if not rows else first
            last = own
            rows.append(row)
    if not rows:
        return
    side, part = pa.struct([(n, types[n]) for n in names]), TaskContext.get().partitionId()
    ends = [*heads[1:], len(rows)]
    n = len(rows) + 1
    before, after, opens, closes = [], [], [], []
    for start, end in zip(heads, ends):
        before += [rows[start - 1] if start else None] * (end - start)
        after += [rows[end] if end < len(rows) else None] * (end - start)
        opens += [start == 0] * (end - start)
        closes += [end == len(rows)] * (end - start)
    none = [None] * (n - 1)
    lines = pa.list_(pa.int64())
    # of the range: the row before its last run, the row after its first one, and its ends
    columns = [pa.array([part] * n, pa.int32()), *(pa.array([*(r[c] for r in rows), None], types[c]) for c in names),
               pa.array([*before, before[-1]], side), pa.array([*after, after[0]], side), pa.array([*opens, None], pa.bool_()), pa.array([*closes, None], pa.bool_()),
               pa.array([*none, rows[0]], side), pa.array([*none, rows[-1]], side), pa.array([*none, first], lines), pa.array([*none, last], lines),
               pa.array([*none, len(heads) == 1], pa.bool_())]
    yield pa.RecordBatch.from_arrays(columns, ["part", *names, "before", "after", "opens", "closes", "first", "last", "first_lines", "last_lines", "whole"])


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every range the row before the run that it begins with and the row after the run that it ends with."""
    ranges, linked, last, side = [], [], None, None
    for batch in batches:
        side = batch.schema.field("before").type
        for i, row in enumerate(batch.drop_columns(["first_lines", "last_lines"]).to_pylist()):
            # whether its first run goes on from the range before
            linked.append(bool(ranges) and ranges[-1]["last"]["host"] == row["first"]["host"] and are_copies(last, _lines_of(batch.column("first_lines")[i])))
            last = _lines_of(batch.column("last_lines")[i])
            ranges.append(row)
    if not ranges:
        return
    n = len(ranges)
    before, after, carried = [None] * n, [None] * n, None
    for k, r in enumerate(ranges):
        before[k] = carried if linked[k] else ranges[k - 1]["last"] if k else None
        carried = before[k] if r["whole"] else r["before"]
    carried = None
    for k in range(n - 1, -1, -1):
        after[k] = None if k == n - 1 else carried if linked[k + 1] else ranges[k + 1]["first"]
        carried = after[k] if ranges[k]["whole"] else ranges[k]["after"]
    yield pa.RecordBatch.from_arrays([pa.array([r["part"] for r in ranges], pa.int32()), pa.array(before, side), pa.array(after, side)],
                                     ["part", "outer_before", "outer_after"])


#: The low bits of a line's number hold its length, up to this.
LENGTH = (1 << 12) - 1


def _hash(lines: list[tuple[str, int]]) -> list[int]:
    """Numbers of the open lines."""
    return [((xxhash.xxh3_64_intdigest(t) & ~LENGTH) | min(len(t), LENGTH)) - (1 << 63) for t, kind in lines if is_open(kind)]


def _hashes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    parser = Lines()
    for batch in batches:
        yield pa.array([_hash(parser.of(x.as_py() or "")) for x in batch], pa.list_(pa.int64()))


def _texts(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    parser = Lines()
    for htmls, others in batches:
        out = []
        for html, other in zip(htmls, others):
            lines = parser.of(html.as_py() or "")
            out.append(main_text(lines, shared(_hash(lines), other.as_py() or [])))
        yield pa.array(out, pa.string())
