"""Main content of web pages, page by page inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import fixed

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source",
         "track", "wbr"}
_HEADINGS, _BLOCKS = set(fixed.HTML_HEADINGS), set(fixed.HTML_TEXT_BLOCKS)
_DROPPED = set(fixed.HTML_DROPPED)
# Which open elements a start tag closes when their end tag was left out.
_IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"},
            "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "option": {"option"}}
_ENDS_PARAGRAPH = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset",
                   "figure", "footer", "form", "header", "hr", "main", "nav", "ol", "p", "pre",
                   "section", "table", "ul", *_HEADINGS}
_LIST_SCOPE = {"ul", "ol", "dl", "table"}


class _Blocks(HTMLParser):
    """Text blocks in document order with the elements around them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.roots: list[bool] = []
        self.title, self.in_title = [], False
        self.blocks: list[list] = []   # [tag, pieces, depth of main content or None, nested]
        self.active: list[list] = []
        self.main_found, self.main_depth = False, None

    def _close_to(self, index: int) -> None:
        while len(self.open) > index:
            tag = self.open.pop()
            if self.main_depth is not None and len(self.open) < self.main_depth:
                self.main_depth = None
            if self.active and self.active[-1][4] > len(self.open):
                self.active.pop()
                for block in self.active:
                    block[1].append(" ")
            if tag == "title":
                self.in_title = False

    def _close_implied(self, tag: str) -> None:
        if tag in _ENDS_PARAGRAPH and "p" in self.open:
            self._close_to(len(self.open) - 1 - self.open[::-1].index("p"))
        names = _IMPLIED.get(tag)
        if names:
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i] in names:
                    self._close_to(i)
                    break
                if self.open[i] in _LIST_SCOPE:
                    break

    def handle_starttag(self, tag, attrs):
        self._close_implied(tag)
        if tag == "br":
            for block in self.active:
                block[1].append("\n" if block[0] == "pre" else " ")
        if tag in _VOID:
            return
        dropped = any(t in _DROPPED for t in self.open) or tag in _DROPPED
        is_main = tag in ("main", "article") or dict(attrs).get("role") == "main"
        if is_main and not self.main_found and not dropped:
            self.main_found, self.main_depth = True, len(self.open) + 1
            for block in self.blocks:
                block[2] = False
        self.open.append(tag)
        if dropped:
            return
        if tag == "title" and "head" in self.open or tag == "title" and not self.title:
            self.in_title = True
        if tag in _HEADINGS or tag in _BLOCKS:
            # A block inside another text block of the same content is part of that block.
            floor = self.main_depth or 0
            nested = any(t in _BLOCKS for t in self.open[floor:-1])
            inside = self.main_depth is not None or not self.main_found
            block = [tag, [], inside, nested, len(self.open)]
            for outer in self.active:
                outer[1].append(" ")
            self.blocks.append(block)
            self.active.append(block)
        elif tag in _ENDS_PARAGRAPH or tag in ("tr", "ul", "ol"):
            for block in self.active:
                block[1].append(" ")

    def handle_endtag(self, tag):
        if tag in self.open:
            self._close_to(len(self.open) - 1 - self.open[::-1].index(tag))

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        if any(t in _DROPPED for t in self.open):
            return
        for block in self.active:
            block[1].append(data)


def page_sections(html: str) -> list[tuple[int, str, int, str]]:
    """(section_no, title, unit_no, text) of one page; a heading opens a section and is its
    first unit."""
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    title = " ".join("".join(parser.title).split()) or fixed.HTML_DEFAULT_TITLE
    rows, section, filled, unit = [], 1, False, 0
    for tag, pieces, inside, nested, _ in parser.blocks:
        if not inside or nested:
            continue
        raw = "".join(pieces)
        text = (raw.replace("\r\n", "\n").replace("\r", "\n").strip() if tag == "pre"
                else " ".join(raw.split()))
        if not text:
            continue
        unit += 1
        if tag in _HEADINGS:
            section += int(filled)
            title = text
        filled = True
        rows.append((section, title, unit, text))
    if not rows:
        raise ValueError("no indexable text in page")
    return rows


def extract_pages(pages: DataFrame, key: str = "page_id", html: str = "html",
                  extract_fn=page_sections) -> DataFrame:
    """(key, section_no, title, unit_no, text, error); a page that cannot be read gives one row
    with its error and the job goes on."""
    columns = [key, "section_no", "title", "unit_no", "text", "error"]
    key_type = pages.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for page, source in zip(frame[key], frame[html]):
                try:
                    rows += [(page, *row, None) for row in extract_fn(source or "")]
                except Exception as failure:
                    rows.append((page, None, None, None, None, str(failure)))
            out = pd.DataFrame(rows, columns=columns)
            yield out.astype({"section_no": "Int32", "unit_no": "Int32"})

    return pages.select(key, html).mapInPandas(
        run, f"{key} {key_type}, section_no int, title string, unit_no int, text string,"
             " error string")


def split_failures(extracted: DataFrame, key: str = "page_id") -> tuple[DataFrame, DataFrame]:
    """(readable rows, warnings)."""
    return (extracted.where(F.col("error").isNull()).drop("error"),
            extracted.where(F.col("error").isNotNull()).select(
                F.col(key).cast("string").alias("path"), F.lit(fixed.HTML_READER[0])
                .alias("reader_id"), F.col("error").alias("message"),
                F.lit(True).alias("skipped")))


def html_sections(units: DataFrame, documents: DataFrame, key: str = "page_id") -> DataFrame:
    """Section rows for the chunker; a section is part of one page, which has a size limit."""
    grouped = units.groupBy(key, "section_no", "title").agg(F.array_sort(F.collect_list(F.struct(
        F.col("unit_no").alias("number"), "text"))).alias("units"))
    return grouped.join(documents, key).select(
        "document_id", "path", "root", "file_name", "extension", "modified_at",
        F.concat(F.lit("section-"), F.col("section_no").cast("string")).alias("section_id"),
        F.concat(F.lit(fixed.HTML_SECTION_PREFIX), F.col("title")).alias("location_label"),
        F.lit(fixed.HTML_RANGE_LABEL).alias("range_label"), "units")


