"""HTML content extraction by text-to-tag ratio.

The standard library's parser streams a page as events. Lines end at newlines of the text and at the tags of block elements; of each line
the characters of text and the tags are counted. The ratio (a line without a tag counts one) is smoothed by a Gaussian kernel; lines whose smoothed ratio
reaches the standard deviation of all smoothed ratios of the page form the content regions. Script, style, template, head and
comment content is no text.

Defined results: NULL and empty pages give an empty text and no lines; malformed markup never fails (a marked section of an unknown kind is a comment up to its ``>``); a page with one line is
content; rows without an id are kept under a NULL id; repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.markup import LenientParser
from .common import arrow_map

SIGMA = 1.0
BLOCK = frozenset(
    "address article aside blockquote body br caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "legend li main nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
SILENT = frozenset("script style template noscript title head".split())
SPACE = re.compile(r"\s+")


class LineParser(LenientParser):
    """Gathers, line by line, the text and the number of tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.tags: list[int] = []
        self.part: list[str] = []
        self.count = 0
        self.silent: list[str] = []

    def end_line(self) -> None:
        text = SPACE.sub(" ", "".join(self.part)).strip()
        if text or self.count:
            self.texts.append(text)
            self.tags.append(self.count)
        self.part, self.count = [], 0

    def handle_starttag(self, tag, attrs) -> None:
        if tag in BLOCK:
            self.end_line()
            self.silent.clear()  # an unclosed silent element ends with the next block
        self.count += 1
        if tag in SILENT:
            self.silent.append(tag)

    def handle_startendtag(self, tag, attrs) -> None:
        if tag in BLOCK:
            self.end_line()
        self.count += 1

    def handle_endtag(self, tag) -> None:
        self.count += 1
        if tag in SILENT and tag in self.silent:
            del self.silent[self.silent.index(tag) :]
        elif tag in BLOCK:
            self.end_line()

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        first, *rest = data.split("\n")
        self.part.append(first)
        for line in rest:
            self.end_line()
            self.part.append(line)


def smooth(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; at the ends the kernel is cut and normalised anew."""
    radius = int(np.ceil(2 * sigma))
    k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    full = lambda v: np.convolve(v, k)[radius : radius + len(v)]
    return full(x) / full(np.ones(len(x)))


def content_lines(texts: list[str], tags: list[int], sigma: float = SIGMA) -> tuple[np.ndarray, float]:
    """Which lines are content, and the threshold."""
    if not texts:
        return np.zeros(0, bool), 0.0
    ratio = np.array([len(t) for t in texts], float) / np.maximum(np.array(tags), 1)
    even = smooth(ratio, sigma)
    threshold = float(even.std())
    return (even >= threshold) & (ratio > 0), threshold


def extract_page(html: str | None, sigma: float = SIGMA) -> tuple[str, int, int, float]:
    """(content, lines, content lines, threshold)."""
    p = LineParser()
    p.feed(html or "")
    p.close()
    p.end_line()
    chosen, threshold = content_lines(p.texts, p.tags, sigma)
    return "\n".join(t for t, c in zip(p.texts, chosen, strict=True) if c), len(p.texts), int(chosen.sum()), threshold


def extract(pages: DataFrame, sigma: float = SIGMA) -> DataFrame:
    """(page_id, content, n_lines, n_content_lines, threshold) of every page."""

    def run(batch: pa.RecordBatch):
        ids, html = batch.column("page_id"), batch.column("html")
        for lo in range(0, batch.num_rows, 500):
            rows = [extract_page(h, sigma) for h in html.slice(lo, 500).to_pylist()]
            yield {"page_id": ids.slice(lo, 500), **{k: list(v) for k, v in zip(("content", "n_lines", "n_content_lines", "threshold"), zip(*rows, strict=True), strict=True)}}

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    return arrow_map(own, run, "page_id bigint, content string, n_lines bigint, n_content_lines bigint, threshold double")
