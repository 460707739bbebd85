"""Main text of web pages: structure first, then differencing against the nearest page.

A page is read into blocks of text, in order. Elements that never hold main text (menus,
headers, footers, sidebars, forms, scripts, adverts, notices, comments, by element, role or
class) are left out.

All pages of a host then stand in order of path; each is paired with the neighbour whose path
has the longer common beginning (the one before, if equal), and blocks on a longest common
subsequence of the pair's blocks are shared. Pages with the very same blocks are one page
here, since copies say nothing about furniture; so the partner always differs.

What a page shares is furniture, unless the page marks it as its article or main part: other
pages may well quote or copy that. The article's blocks are the main text, whole, or else those
of the main part. A mark does not hold where the text outside that is not shared is over ``FAR``
times as long, as with a teaser in an ``<article>`` beside the body: then the next lower mark
decides, if there is one. Where none holds, the main text is all that is marked or not shared.

Reading is done where pages lie, once for the hashes of blocks and once for their texts, so that
nothing as large as the pages is written. Differencing moves only hashes; ranges of (host, path)
are its partitions, so a host of any size is spread, and the pairs across a boundary come from
one row per host and range. Many copies of a page are spread by their ids when they meet what
is shared.

Defined cases: a NULL html has an empty text, as has a page without any text. A NULL url is
of the empty host and path. A page alone on its host keeps its blocks. Repeated rows repeat their
result. An empty table gives no rows. Only the columns named are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from os.path import commonprefix
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.llm.scratch import stored
from wayfare.llm.text import chunks
from wayfare.llm.urls import host_of, path_of
from wayfare.operators.skew import balanced_lookup

# Fixed values of the markup language: elements by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span "
    "strike strong sub sup time tt u var".split()
)
SPACING = frozenset(["br", "td", "th", "wbr"])
UNREAD = frozenset(["head", "noscript", "script", "style", "template", "title"])
FURNITURE = frozenset(
    "aside audio button canvas datalist dialog fieldset footer form iframe menu nav object "
    "search select svg textarea video".split()
)
RAW = frozenset(["iframe", "noembed", "noframes", "script", "style", "textarea", "title"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
FURNITURE_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation "
    "search toolbar".split()
)
# Words of a class or id that mark furniture, and those that mark the article's own parts.
FURNITURE_WORDS = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments "
    "consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation "
    "newsletter notice notices pager pagination popup promo promotion related respond share "
    "sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
ARTICLE_WORDS = frozenset("article body content entry main post story text".split())
COMMENT_WORDS = frozenset("comment comments disqus".split())
ADVERT_WORDS = frozenset("ad ads advert advertisement".split())
ALWAYS_FURNITURE = COMMENT_WORDS | ADVERT_WORDS

OPEN, MAIN, ARTICLE = 0, 1, 2
# Times its own text that a mark may leave out.
FAR = 4

_words = re.compile(r"[a-z]+")


def _named(attributes: dict[str, str]) -> set[str]:
    return set(_words.findall(f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()))


def _is_hidden(attributes: dict[str, str]) -> bool:
    style = attributes.get("style", "").replace(" ", "").lower()
    return "hidden" in attributes or "display:none" in style


def _is_furniture(tag: str, attributes: dict[str, str]) -> bool:
    if tag in FURNITURE or attributes.get("role", "").lower() in FURNITURE_ROLES:
        return True
    if _is_hidden(attributes):
        return True
    words = _named(attributes)
    if words & ALWAYS_FURNITURE:
        return True
    return bool(words & FURNITURE_WORDS) and not words & ARTICLE_WORDS


_name = re.compile(r"[^\t\n\f\r />]+")
_skipped = re.compile(r"[\t\n\f\r /]*")
_attribute = re.compile(r"[^\t\n\f\r />][^\t\n\f\r />=]*")
_equals = re.compile(r"[\t\n\f\r ]*=[\t\n\f\r ]*")
_unquoted = re.compile(r"[^\t\n\f\r >]*")
_raw_ends = {tag: re.compile(rf"</{tag}(?=[\t\n\f\r />])", re.I) for tag in RAW}


def _start_tag(html: str, at: int) -> tuple[str, dict[str, str], int]:
    """Name and attributes of the tag whose name starts at ``at``, and the place behind it; past
    the end if it is not closed. The first of equal attributes counts."""
    end = _name.match(html, at).end()
    name, attributes = html[at:end].lower(), {}
    while True:
        end = _skipped.match(html, end).end()
        if end >= len(html):
            return name, attributes, len(html) + 1
        if html[end] == ">":
            return name, attributes, end + 1
        key = _attribute.match(html, end)
        end, value = key.end(), ""
        equals = _equals.match(html, end)
        if equals:
            end = equals.end()
            quote = html[end : end + 1]
            if quote in ("'", '"'):
                close = html.find(quote, end + 1)
                if close < 0:
                    return name, attributes, len(html) + 1
                value, end = html[end + 1 : close], close + 1
            else:
                found = _unquoted.match(html, end)
                value, end = found.group(), found.end()
        attributes.setdefault(key.group().lower(), unescape(value))


def markup(html: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """Texts, start and end tags of a page in order, in time that grows with its length alone.

    As in browsers, a marked section or a declaration is a comment, what is not closed by the
    end of the page is dropped with the rest of it, and scripts, styles and the like end only
    at their own end tag.
    """
    at, size = 0, len(html)
    while at < size:
        tag = html.find("<", at)
        if tag < 0:
            tag = size
        if tag > at:
            yield "text", unescape(html[at:tag]), {}
        following = html[tag + 1 : tag + 2]
        if following.isascii() and following.isalpha():
            name, attributes, at = _start_tag(html, tag + 1)
            if at > size:
                return
            yield "start", name, attributes
            if name in RAW:
                end = _raw_ends[name].search(html, at)
                if not end:
                    return
                yield "text", html[at : end.start()], {}
                at = end.start()
        elif html.startswith("<!--", tag):
            # also <!--> and <!---> are whole comments
            end = tag + 2 if html.startswith(("<!-->", "<!--->"), tag) else tag + 4
            end = html.find(">", end) - 2 if end == tag + 2 else html.find("-->", end)
            if end < 0:
                return
            at = end + 3
        elif following in ("!", "?", "/"):
            end = html.find(">", tag)
            if end < 0:
                return
            name = _name.match(html, tag + 2)
            if following == "/" and name and name.group()[0].isalpha():
                yield "end", name.group().lower(), {}
            at = end + 1
        else:
            if tag < size:
                yield "text", "<", {}
            at = tag + 1


class _Open(NamedTuple):
    """An open element; what holds for all that is open is carried from one to the next."""

    tag: str
    left_out: bool
    level: int
    in_header: bool
    in_heading: bool


class _Reader:
    """Blocks of a page as (level, text), without furniture."""

    def __init__(self):
        self.blocks: list[tuple[int, str]] = []
        self.text: list[str] = []
        self.open = [_Open("", False, OPEN, False, False)]
        # how many elements of a name are open, so that stray end tags cost nothing
        self.names: Counter[str] = Counter()

    def read(self, html: str) -> None:
        for kind, value, attributes in markup(html):
            if kind == "text":
                self.data(value)
            elif kind == "start":
                self.start(value, attributes)
            else:
                self.end(value)
        self.end_block()

    def end_block(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.blocks.append((self.open[-1].level, text))
        self.text = []

    def push(self, tag: str, left_out: bool, level: int) -> None:
        above = self.open[-1]
        in_header = above.in_header or tag == "header"
        in_heading = above.in_heading or tag in HEADINGS
        self.open.append(_Open(tag, left_out, level, in_header, in_heading))
        self.names[tag] += 1

    def pop(self) -> None:
        self.names[self.open.pop().tag] -= 1

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        above = self.open[-1]
        if tag in INLINE:
            # within what is left out, to find the end of the element that it began with
            if above.left_out or _is_hidden(attributes) or _named(attributes) & ADVERT_WORDS:
                self.push(tag, True, above.level)
            return
        if tag in SPACING:
            self.text.append(" ")
        elif tag not in UNREAD:  # which may stand within a block
            self.end_block()
            if above.tag == "p" or (above.tag == "li" and tag == "li"):
                self.pop()  # which ends where the next block starts
        if tag in VOID:
            return
        _, left_out, level, _, _ = self.open[-1]
        if tag in ("p", "li"):
            # only those that are left out are followed, the rest change nothing
            if not left_out and _is_furniture(tag, attributes):
                self.push(tag, True, level)
            return
        if tag == "body":
            left_out = False
        elif tag in UNREAD:
            left_out = True
        elif tag == "header":
            # an article's header holds its heading, a site's does not
            left_out = left_out or level != ARTICLE
        elif tag == "article" or attributes.get("itemprop", "").lower() == "articlebody":
            left_out = left_out or bool(_named(attributes) & COMMENT_WORDS) or _is_hidden(attributes)
            level = ARTICLE if not left_out else level
        elif tag == "main" or attributes.get("role", "").lower() == "main":
            level = max(level, MAIN) if not left_out else level
        elif tag != "html":
            left_out = left_out or _is_furniture(tag, attributes)
        self.push(tag, left_out, level)

    def end(self, tag: str) -> None:
        if tag in VOID:
            return
        if tag in SPACING:
            self.text.append(" ")
        elif tag not in INLINE and tag not in UNREAD:
            self.end_block()
        if self.names[tag]:
            while self.open[-1].tag != tag:
                self.pop()
            self.pop()

    def data(self, text: str) -> None:
        here = self.open[-1]
        if not here.left_out and (not here.in_header or here.in_heading):
            self.text.append(text)


def blocks(html: str | None) -> tuple[list[tuple[int, str]], int]:
    """Blocks of a page with their levels, and the level from which on they are main text if
    the page shares none of them."""
    reader = _Reader()
    reader.read(html or "")
    sizes = [0, 0, 0]
    for level, text in reader.blocks:
        sizes[level] += len(text)
    best = max((level for level, _ in reader.blocks), default=OPEN)
    while best > OPEN and sum(sizes[:best]) > FAR * sum(sizes[best:]):
        best = max(level for level in range(best) if sizes[level])
    return reader.blocks, best


def _read(pages: DataFrame, with_texts: bool) -> DataFrame:
    """``page_id``, ``url`` and ``lines``, the hashes of all blocks; also their texts ``blocks``
    and their ``levels``, if wanted. To that, what differencing tells pages by."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches, "html"):
            found = [blocks(html)[0] for html in rows.column("html").to_pylist()]
            lines = [[xxhash.xxh64_intdigest(t) - (1 << 63) for _, t in page] for page in found]
            columns = {
                "page_id": rows.column("page_id"),
                "url": rows.column("url"),
                "lines": pa.array(lines, pa.list_(pa.int64())),
            }
            if with_texts:
                texts, levels = ([[block[k] for block in page] for page in found] for k in (1, 0))
                columns["blocks"] = pa.array(texts, pa.list_(pa.string()))
                columns["levels"] = pa.array(levels, pa.list_(pa.int8()))
            yield pa.RecordBatch.from_pydict(columns)

    texts = ", blocks array<string>, levels array<tinyint>" if with_texts else ""
    read = pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {kind}, url string, lines array<long>{texts}"
    )
    return read.withColumns({"host": host_of(F.col("url")), "sequence": F.xxhash64("lines")})


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` and each beginning of ``b``.

    Bit ``j`` of the row is 0 where one more item of ``b`` makes the sequence longer; a row
    follows from the one before by whole-number operations on all bits at once.
    """
    places: dict[int, int] = {}
    for j, item in enumerate(b):
        places[item] = places.get(item, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for item in a:
        shared = row & places.get(item, 0)
        row = ((row + shared) | (row - shared)) & full
    raw = np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8)
    bits = np.unpackbits(raw, bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence, in memory proportional to the input."""
    found, stack = [], [(0, len(a), 0, len(b))]
    while stack:
        low, high, first, last = stack.pop()
        while low < high and first < last and a[low] == b[first]:
            found.append(low)
            low, first = low + 1, first + 1
        while low < high and first < last and a[high - 1] == b[last - 1]:
            found.append(high - 1)
            high, last = high - 1, last - 1
        if low == high or first == last:
            continue
        if high - low == 1:
            found += [low] if a[low] in b[first:last] else []
            continue
        middle = (low + high) // 2
        ahead = _lengths(a[low:middle], b[first:last])
        behind = _lengths(a[middle:high][::-1], b[first:last][::-1])[::-1]
        split = first + int((ahead + behind).argmax())
        stack += [(low, middle, first, split), (middle, high, split, last)]
    return sorted(found)


def _kept(lines, path, before, path_before, after, path_after) -> np.ndarray:
    """For every block, whether the page does not share it with its partner."""
    kept = np.ones(len(lines), bool)
    if before is None and after is None:
        return kept
    nearness = lambda p: len(commonprefix([path, p])) if p is not None else -1
    partner = before if nearness(path_before) >= nearness(path_after) else after
    kept[common(lines.tolist(), partner.tolist())] = False
    return kept


def _differenced(pages: DataFrame) -> DataFrame:
    """``host``, ``sequence``, ``kept`` and the number of pages ``_n`` of every sequence of blocks."""
    place = F.struct("path", "row")
    distinct = pages.groupBy("host", "sequence").agg(
        F.min(F.struct("path", "row", "lines")).alias("first"), F.count(F.lit(1)).alias("_n")
    )
    ranged = stored(
        distinct.select("host", "sequence", "_n", "first.*")
        .repartitionByRange("host", "path", "row")
        .withColumn("range", F.spark_partition_id()),
        "ranged",
    )
    side = F.struct("path", "lines")
    ends = stored(
        ranged.groupBy("host", "range").agg(
            F.min_by(side, place).alias("head"), F.max_by(side, place).alias("tail")
        ),
        "ends",
    )
    by_range = Window.partitionBy("host").orderBy("range")
    beyond = ends.select(
        "host",
        "range",
        F.lag("tail").over(by_range).alias("tail_before"),
        F.lead("head").over(by_range).alias("head_after"),
    )
    in_range = Window.partitionBy("host", "range").orderBy("path", "row")
    paired = ranged.join(beyond, ["host", "range"]).select(
        "host",
        "sequence",
        "_n",
        "path",
        "lines",
        F.coalesce(F.lag(side).over(in_range), "tail_before").alias("before"),
        F.coalesce(F.lead(side).over(in_range), "head_after").alias("after"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            columns = (rows[c] for c in ("lines", "path", "before", "pb", "after", "pa"))
            rows["kept"] = [_kept(*row) for row in zip(*columns)]
            yield rows[["host", "sequence", "kept", "_n"]]

    return paired.select(
        "host",
        "sequence",
        "_n",
        "path",
        "lines",
        F.col("before.lines").alias("before"),
        F.col("before.path").alias("pb"),
        F.col("after.lines").alias("after"),
        F.col("after.path").alias("pa"),
    ).mapInPandas(run, "host string, sequence long, kept array<boolean>, _n long")


def _length(blocks: Column) -> Column:
    return F.aggregate(blocks, F.lit(0).cast("long"), lambda size, b: size + F.length(b["blocks"]))


def _main_text(entries: Column) -> Column:
    """The main text of a page's ``blocks`` with their ``levels`` and what it has ``kept``."""

    def marked(level: int) -> Column:
        return F.filter(entries, lambda b: b["levels"] >= level)

    def holds(level: int) -> Column:
        outside = F.filter(entries, lambda b: b["kept"] & (b["levels"] < level))
        return (F.size(marked(level)) > 0) & (_length(outside) <= FAR * _length(marked(level)))

    own = F.filter(entries, lambda b: b["kept"] | (b["levels"] > OPEN))
    joined = lambda blocks: F.array_join(F.transform(blocks, lambda b: b["blocks"]), "\n\n")
    return (
        F.when(holds(ARTICLE), joined(marked(ARTICLE)))
        .when(holds(MAIN), joined(marked(MAIN)))
        .otherwise(joined(own))
    )


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: ``page_id``, ``url``, ``text`` and its length ``n_chars``."""
    lines = _read(pages, with_texts=False).where(F.size("lines") > 0)
    placed = lines.withColumns(
        {"path": path_of(F.col("url")), "row": F.monotonically_increasing_id()}
    )
    kept = stored(_differenced(placed.select("host", "path", "row", "sequence", "lines")), "kept")
    page = ["host", "sequence"]
    read = _read(pages, with_texts=True).drop("lines")
    found = balanced_lookup(
        read,
        kept.select(*page, "kept"),
        on=page,
        spread_by="page_id",
        counts=kept.select(*page, "_n"),
        broadcast_rows=0,
    )
    entries = found.select("page_id", "url", F.arrays_zip("blocks", "levels", "kept").alias("entries"))
    # of a page without any text nothing is kept, nor lost
    text = F.coalesce(_main_text(F.col("entries")), F.lit(""))
    return entries.select("page_id", "url", text.alias("text")).withColumn(
        "n_chars", F.length("text").cast("long")
    )
