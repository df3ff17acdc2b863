"""Main text of web pages by nearest-URL page differencing (operator 7).

Pages are cut into lines, one for each block.  Every page is paired with the nearest different pages before and after
it by URL path within its host, and a line that is in a longest common subsequence with such a neighbour is shared.
Structure is evidence beside that: lines of elements that are boilerplate by name (menus, forms, scripts) go whatever
the neighbours have, as menus may differ from page to page; lines inside an article or main element stay, as articles
may repeat; for all other lines differencing decides.  Lines that only a class name calls boilerplate go unless
nothing else is left.  A line beside an article stays if a neighbour was there to compare with and lacks it.

Pages are different unless their lines are equal but for letter case and numbers, so copies do not delete each other.
Lines travel as 64-bit hashes; only pages with an undecided line meet the result again.

Null or empty html has an empty text.  Pages without a host pair with each other.  A host with one page, or with
copies of one page only, keeps its undecided lines where no article is.  Repeated rows are extracted alike.  Columns
besides page_id, url and html are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions

#: Fixed values of HTML: elements that start a block, that have no end tag, and boilerplate by name and class.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset("aside audio button canvas dialog footer form head header iframe input menu nav noscript object option script select style svg template textarea title video".split())
CLASSES = frozenset("ad ads adbox advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header menu menubar modal nav navbar navigation newsletter notice notices pagination popup promo promotion related responses share sharing sidebar sidebars social sponsor sponsored subscribe toolbar widget".split())
MAIN = frozenset(("article", "main"))
#: A class name with one of these says what is absent, or how the element is laid out.
NEGATIONS = frozenset("has no non not with without".split())
#: Grades of lines: boilerplate by class alone, undecided, inside an article or main element.
CLASSED, LOOSE, INSIDE = 0, 1, 2
_SPLIT = re.compile(r"[^a-z]+")
_SPACE = re.compile(r"\s+")


def _classed(attrs: list, inside: bool) -> bool:
    """Whether a class, id or role calls an element boilerplate; an article may have a header of its own."""
    for k, v in attrs:
        if k in ("hidden", "aria-hidden") and v != "false":
            return True
        for name in v.lower().split() if k in ("class", "id", "role") and v else ():
            words = set(_SPLIT.split(name))
            if words & CLASSES - ({"header"} if inside else set()) and not words & NEGATIONS:
                return True
    return False


class _Blocks(HTMLParser):
    """Collects (grade, text) of each block that is not boilerplate by its element."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int]] = []  # name, boilerplate by an element here or above, grade
        self.found: list[tuple[int, str]] = []
        self.text: list[str] = []

    def _flush(self) -> None:
        if self.text:
            text = _SPACE.sub(" ", "".join(self.text)).strip()
            if text:
                self.found.append((self.open[-1][2] if self.open else LOOSE, text))
            self.text = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self._flush()
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        if tag == "p" and self.open and self.open[-1][0] == "p":
            self.open.pop()
        _, bad, grade = self.open[-1] if self.open else ("", False, LOOSE)
        bad = bad or tag in BOILERPLATE and not (tag == "header" and grade == INSIDE)
        if tag == "main":
            grade = INSIDE
        elif grade != CLASSED and tag not in ("html", "body") and _classed(attrs, grade == INSIDE):
            grade = CLASSED
        elif grade == LOOSE and tag in MAIN:
            grade = INSIDE
        self.open.append((tag, bad, grade))

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        if not (self.open and self.open[-1][1]):
            self.text.append(data)

    def blocks(self, html: str) -> tuple[list[str], list[int]]:
        """Lines and their grades."""
        self.feed(html)
        self.close()
        self._flush()
        only = all(g == CLASSED for g, _ in self.found)  # no class name empties a page
        kept = [(LOOSE if only else g, t) for g, t in self.found if only or g != CLASSED]
        return [t for _, t in kept], [g for g, _ in kept]


def _scan(lines: Sequence, other: Sequence) -> Iterator[int]:
    """For each line of ``other``: which places of ``lines`` do not lengthen a common subsequence, as bits."""
    at: dict = {}
    for k, x in enumerate(lines):
        at[x] = at.get(x, 0) | 1 << k
    row = whole = (1 << len(lines)) - 1
    for x in other:
        hit = row & at.get(x, 0)
        row = (row + hit | row - hit) & whole
        yield row


def shared_lines(lines: Sequence, other: Sequence, most_bits: int = 1 << 29) -> set[int]:
    """Places of ``lines`` in a longest common subsequence with ``other``; memory stays below ``most_bits``."""
    n, head, tail = min(len(lines), len(other)), 0, 0
    while head < n and lines[head] == other[head]:
        head += 1
    while tail < n - head and lines[-1 - tail] == other[-1 - tail]:
        tail += 1
    found = {*range(head), *range(len(lines) - tail, len(lines))}
    a, b = lines[head : len(lines) - tail], other[head : len(other) - tail]
    if not a or not b:
        return found
    if len(a) * len(b) > most_bits and len(b) > 1:  # halve one side and find where the other one splits
        half = len(b) // 2
        size = (len(a) + 7) // 8
        lasts = []
        for x, y in ((a, b[:half]), (a[::-1], b[half:][::-1])):
            row = deque(_scan(x, y), 1).pop()
            bits = np.unpackbits(np.frombuffer(row.to_bytes(size, "little"), np.uint8), bitorder="little")[: len(a)]
            lasts.append(np.append(0, np.cumsum(1 - bits.astype(np.int64))))
        cut = int(np.argmax(lasts[0] + lasts[1][::-1]))
        found |= {head + k for k in shared_lines(a[:cut], b[:half], most_bits)}
        return found | {head + cut + k for k in shared_lines(a[cut:], b[half:], most_bits)}
    rows, col, row = list(_scan(a, b)), len(a), len(b)
    while row and col:
        if rows[row - 1] >> col - 1 & 1:
            col -= 1
        else:
            row -= 1
            if not row or rows[row - 1] >> col - 1 & 1:
                col -= 1
                found.add(head + col)
    return found


def _blocks_of(pages: DataFrame) -> DataFrame:
    """(row, page_id, url, lines, grades) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_Blocks().blocks(html) if html else ([], []) for html in batch.column(3).to_pylist()]
            lines, grades = (pa.array([x[k] for x in got], kind) for k, kind in ((0, pa.list_(pa.string())), (1, pa.list_(pa.int8()))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lines, grades], names=["row", "page_id", "url", "lines", "grades"])

    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "row long, page_id long, url string, lines array<string>, grades array<tinyint>")


def _outside(ends: list) -> list[tuple[int, int, int, str]]:
    """(range, -1 or 1, other range, its end): where the nearest page before or after a range is that differs from the range's end.

    ``ends`` has for each range, in order: part, the host and key of its first page, the key of the first different
    page of that host, and the same from its last page back.
    """
    found = []
    for side, own, near, far, back in ((1, "tail", "head", "head2", "tail"), (-1, "head", "tail", "tail2", "head")):
        row = sorted(ends, key=lambda r: side * r["part"])
        for k, r in enumerate(row):
            host, key = r[f"{own}_host"], r[f"{own}_near"]
            for x in row[k + 1 :]:
                if x[f"{near}_host"] != host:
                    break
                if x[f"{near}_near"] != key or x[f"{far}_near"] is not None:
                    found.append((r["part"], side, x["part"], near if x[f"{near}_near"] != key else far))
                    break
                if x[f"{back}_host"] != host:
                    break
    return found


def shared_with_neighbours(rows: DataFrame) -> DataFrame:
    """(row, gone, alone) of pages with undecided lines: places that the nearest different page before or after by
    URL path shares, and whether there is no such page."""
    spark = rows.sparkSession
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    near = F.xxhash64(F.transform("lines", lambda b: F.regexp_replace(F.lower(b), "[0-9]+", "0")))
    keyed = rows.select("row", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), "page_id", near.alias("near"), F.transform("lines", lambda b: F.xxhash64(b)).alias("lines"), F.array_contains("grades", F.lit(LOOSE).cast("tinyint")).alias("open"))
    order = ["host", "path", "page_id", "near", "lines"]
    ordered = keyed.repartitionByRange(shuffle_partitions(spark), *order[:3], "row").withColumn("part", F.spark_partition_id())
    ordered = materialize(ordered.select("part", "row", "open", *order), "ranges")

    place = F.struct(*order)
    ends = ordered.groupBy("part").agg(F.min(place).alias("head"), F.max(place).alias("tail"))
    ends = materialize(ends, "ends")
    keys = F.broadcast(ends.select("part", *[F.col(f"{e}.{c}").alias(f"{e}_{c}") for e in ("head", "tail") for c in ("host", "near")]))  # a row for each partition
    other = [F.when((F.col("host") == F.col(f"{e}_host")) & (F.col("near") != F.col(f"{e}_near")), place) for e in ("head", "tail")]
    seconds = ordered.join(keys, "part").groupBy("part").agg(F.min(other[0]).alias("head2"), F.max(other[1]).alias("tail2"))
    ends = materialize(ends.join(seconds, "part"), "ends")
    small = ends.select("part", *[F.col(f"{e}.{c}").alias(f"{e}_{c}") for e in ("head", "head2", "tail", "tail2") for c in ("host", "near")])
    links = spark.createDataFrame(_outside(small.collect()), "part int, side int, other int, end string")  # at most two for each range
    each = [ends.select(F.col("part").alias("other"), F.lit(e).alias("end"), F.col(e).alias("x")) for e in ("head", "head2", "tail", "tail2")]
    far = each[0].union(each[1]).union(each[2]).union(each[3]).join(F.broadcast(links), ["other", "end"])
    far = far.select("part", "side", F.lit(None).cast("long").alias("row"), F.lit(False).alias("open"), "x.*")
    both = ordered.withColumn("side", F.lit(0)).unionByName(far)
    both = both.repartition("part").sortWithinPartitions("part", "side", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ended(after: list[int] | None) -> list[tuple]:
            others = [x for x in (before, after) if x is not None]
            out, known = [], (None, None)
            for row, lines, loose in copies:
                if loose:
                    if known[0] is not lines:
                        known = lines, sorted(set().union(*(shared_lines(lines, x) for x in others)))
                    out.append((row, known[1], not others))
            return out

        before, group, key, copies = None, None, None, []
        for batch in batches:
            out = []
            for row, lines, loose, part, host, near in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if (part, host) != group:
                    out += ended(None)
                    before, copies = None, []
                elif near != key:
                    out += ended(lines)
                    before, copies = copies[-1][1], []
                group, key = (part, host), near
                if copies and copies[-1][1] == lines:
                    lines = copies[-1][1]
                copies.append((row, lines, loose))
                if len(copies) > 1 and not copies[-2][2]:  # only pages with undecided lines wait for what follows
                    del copies[-2]
            yield _rows(out)
        yield _rows(ended(None))

    return both.select("row", "lines", "open", "part", "host", "near").mapInArrow(run, "row long, gone array<int>, alone boolean")


def _rows(out: list) -> pa.RecordBatch:
    rows, gone, alone = zip(*out) if out else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(gone, pa.list_(pa.int32())), pa.array(alone, pa.bool_())], names=["row", "gone", "alone"])


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    rows = materialize(_blocks_of(pages), "blocks")
    open_ = F.array_contains("grades", F.lit(LOOSE).cast("tinyint"))
    found = rows.filter(open_).join(shared_with_neighbours(rows), "row")
    inside = F.array_contains("grades", F.lit(INSIDE).cast("tinyint"))
    stays = lambda i: (F.get("grades", i) == INSIDE) | ~F.array_contains("gone", i) & ~(F.col("alone") & inside)
    lines = F.filter("lines", lambda _, i: stays(i))
    both = rows.filter(~open_).select("page_id", "url", "lines").union(found.select("page_id", "url", lines.alias("lines")))
    text = F.array_join("lines", "\n")
    return both.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))
