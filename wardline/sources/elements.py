"""Pages to elements: the one stage that needs Python rows."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.sources.shared import give_back, leaner

ELEMENT = "array<struct<seq:int,tag:string,attrs:map<string,string>,text:string,parent:string,hidden:boolean,raw:boolean,form:int>>"
#: Elements without an end tag, and those whose text isn't shown.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript"}
PAGES, PAGE_BYTES = 64, 1 << 20  # read at a time
UNSEEN = re.compile(r"display:\s*none", re.I)


class Reader(HTMLParser):
    """One pass over a page; text is an element with the tag #text. No page raises; time is linear in it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.open = [], []  # found: tag, attrs, text, parent, hidden, raw, form; open: tag, hidden, raw, form
        self.opened = Counter()  # of open tags, by name
        self.unclosed = False  # a comment that nothing closes was met; those behind it aren't closed either

    def add(self, tag: str, attrs, text: str | None, hidden: bool, raw: bool, form: int) -> None:
        self.found.append((tag, attrs, text, self.open[-1][0] if self.open else None, hidden, raw, form))

    def handle_starttag(self, tag, attrs):
        own: dict[str, str] = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        _, hidden, raw, form = self.open[-1] if self.open else ("", False, False, -1)
        hidden = hidden or bool(UNSEEN.search(own.get("style", ""))) or own.get("aria-hidden") == "true"
        raw = raw or tag in RAW
        if tag == "form":
            form = len(self.found)
        self.add(tag, own, None, hidden, raw, form)
        if tag not in VOID:
            self.open.append((tag, hidden, raw, form))
            self.opened[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        """Closes the innermost open element of this name and all inside it; each is closed once, so all ends together are linear."""
        if self.opened[tag]:
            closed = None
            while closed != tag:
                closed = self.open.pop()[0]
                self.opened[closed] -= 1

    def handle_data(self, data):
        _, hidden, raw, form = self.open[-1] if self.open else ("", False, False, -1)
        self.add("#text", {}, data, hidden, raw, form)

    def parse_comment(self, i, report=True):
        if self.unclosed:
            return -1
        end = super().parse_comment(i, report)
        self.unclosed = end < 0
        return end

    def parse_marked_section(self, i, report=1):
        """<![ ... > is a comment up to the next >, whatever is in it."""
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else -1


def read_columns(html: str | None) -> list[tuple]:
    """Elements as tuples. Behind the last > no tag can end: if something there looks like one, all of it is one text."""
    html, reader = html or "", Reader()
    last = html.rfind(">") + 1
    if "<" not in html[last:]:
        last = len(html)
    reader.feed(html[:last])
    reader.close()
    if last < len(html):
        reader.handle_data(unescape(html[last:]))
    return reader.found


def read_page(html: str | None) -> list[dict]:
    """The page's elements, one by one."""
    names = ("tag", "attrs", "text", "parent", "hidden", "raw", "form")
    return [{"seq": i, **dict(zip(names, e, strict=True))} for i, e in enumerate(read_columns(html))]


def element_arrays(pages: list[str | None]) -> pa.ListArray:
    """The elements of some pages as one Arrow column."""
    read = [read_columns(html) for html in pages]
    sizes = [len(p) for p in read]
    at = np.append(0, np.cumsum(sizes)).astype(np.int32)
    tags, attrs, texts, parents, hidden, raw, forms = zip(*(e for p in read for e in p), strict=True) if at[-1] else [()] * 7
    ends = np.append(0, np.cumsum([len(a) for a in attrs])).astype(np.int32)
    maps = pa.MapArray.from_arrays(pa.array(ends), pa.array([k for a in attrs for k in a], pa.string()), pa.array([v for a in attrs for v in a.values()], pa.string()))
    seq = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]) if sizes else np.zeros(0, np.int32)
    columns = [pa.array(seq), pa.array(tags, pa.string()), maps, pa.array(texts, pa.string()), pa.array(parents, pa.string()), pa.array(hidden, pa.bool_()), pa.array(raw, pa.bool_()), pa.array(forms, pa.int32())]
    inner = pa.StructArray.from_arrays(columns, ["seq", "tag", "attrs", "text", "parent", "hidden", "raw", "form"])
    return pa.ListArray.from_arrays(pa.array(at), inner)


def page_slices(batch: pa.RecordBatch, most: int = PAGES, size: int = PAGE_BYTES):
    """batch in slices of at most so many pages, and of so many bytes of html unless one page has more."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch[batch.num_columns - 1]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        behind = int(ends[at - 1]) if at else 0
        end = min(max(at + 1, int(np.searchsorted(ends, behind + size, "right"))), at + most)
        yield batch.slice(at, end - at)
        at = end


def page_elements(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages, without the html, with their elements in order.

    They stay an array of the page's row: counting them takes no shuffle, and a page's elements are
    bounded by the page. exploded() gives one row per element. Any text is a page: what isn't markup is
    text, and broken markup is read as far as it goes.
    """
    kept = [c for c in pages.columns if c not in (html_col, "elements")]
    has = (F.col(html_col).isNotNull() & (F.length(F.trim(html_col)) > 0)).alias("html_available")
    source = pages.select(*kept, has, F.col(html_col).alias("elements"))

    def run(batches):
        for batch in batches:
            for part in page_slices(batch):
                cols = [part[c] for c in part.schema.names[:-1]]
                yield pa.RecordBatch.from_arrays([*cols, element_arrays(part["elements"].to_pylist())], part.schema.names)
            give_back()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(leaner(run), f"{schema}, elements {ELEMENT}")


def exploded(elements: DataFrame) -> DataFrame:
    """One row per element, with the page's other columns."""
    return elements.select(*(c for c in elements.columns if c != "elements"), F.explode("elements").alias("e")).select("*", "e.*").drop("e")
