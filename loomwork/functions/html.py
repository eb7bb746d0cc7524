"""HTML to text by streaming parser events: title, text with tables as Markdown, links.

The parser keeps a stack of open regions. Text inside dropped regions (scripts, navigation and the
like) is not collected; a table collects its cells on a grid, spans included, and gives one Markdown
block when it closes. ``root_id`` restricts the text to the element with that id, if there is one.
"""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as S

DROPPED = frozenset(("script", "style", "nav", "footer", "header", "aside", "noscript"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def _span(attrs: dict, name: str) -> int:
    try:
        return max(1, int(attrs.get(name, 1)))
    except (TypeError, ValueError):
        return 1


class _Grid:
    """Rows of a table; a cell's text stands in the first column and row group of its span, rows below
    a row span get the text again, further columns stay empty."""

    def __init__(self):
        self.rows: list[list[str]] = []
        self.below: dict[int, tuple[str, int]] = {}
        self.row: list[tuple[list[str], int, int]] | None = None

    def open_row(self):
        self.close_row()
        self.row = []

    def open_cell(self, attrs: dict):
        if self.row is None:
            self.row = []
        self.row.append(([], _span(attrs, "colspan"), _span(attrs, "rowspan")))

    def add(self, text: str):
        if self.row:
            self.row[-1][0].append(text)

    def close_row(self):
        cells, self.row = self.row, None
        if not cells:
            return
        out: list[str] = []
        for parts, wide, high in cells:
            self._fill(out)
            text = " ".join(" ".join(parts).split())
            for i in range(wide):
                here = "" if i else text
                if high > 1:
                    self.below[len(out)] = (here, high - 1)
                out.append(here)
        self._fill(out)
        if any(out):
            self.rows.append(out)

    def _fill(self, out: list[str]):
        while len(out) in self.below:
            text, left = self.below.pop(len(out))
            if left > 1:
                self.below[len(out)] = (text, left - 1)
            out.append(text)

    def markdown(self) -> str:
        self.close_row()
        if not self.rows:
            return ""
        width = max(map(len, self.rows))
        head, *rest = [r + [""] * (width - len(r)) for r in self.rows]
        bar = "|" + "---|" * width
        return "\n".join(["| " + " | ".join(head) + " |", bar, *("| " + " | ".join(r) + " |" for r in rest)])


class _Reader(HTMLParser):
    def __init__(self, root_id: str | None):
        super().__init__(convert_charrefs=True)
        self.root_id, self.root_depth = root_id, None
        self.depth, self.dropped, self.in_title = 0, [], False
        self.title, self.all_text, self.root_text, self.tables, self.links = [], [], [], [], []

    def put(self, text: str):
        if self.tables:
            self.tables[-1].add(text)
            return
        self.all_text.append(text)
        if self.root_depth is not None:
            self.root_text.append(text)

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "a" and attrs.get("href"):
            self.links.append(attrs["href"])
        if tag in VOID:
            return
        self.depth += 1
        if self.root_id and attrs.get("id") == self.root_id and self.root_depth is None and not self.root_text:
            self.root_depth = self.depth
        if tag in DROPPED:
            self.dropped.append(tag)
        if self.dropped:
            return
        if tag == "title":
            self.in_title = True
        elif tag == "table":
            self.tables.append(_Grid())
        elif self.tables and tag == "tr":
            self.tables[-1].open_row()
        elif self.tables and tag in ("td", "th"):
            self.tables[-1].open_cell(attrs)

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        if self.dropped:
            if tag in self.dropped:
                while self.dropped.pop() != tag:
                    pass
        elif tag == "title":
            self.in_title = False
        elif tag == "table" and self.tables:
            self.put_table()
        elif tag == "tr" and self.tables:
            self.tables[-1].close_row()
        if self.root_depth is not None and self.depth == self.root_depth:
            self.root_depth = None
        self.depth = max(0, self.depth - 1)

    def put_table(self):
        block = self.tables.pop().markdown()
        if block:
            self.put(f"\n\n{block}\n\n")

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.dropped:
            self.put(data)


def read_html(html: str, root_id: str | None = None, keep_blocks: bool = False) -> tuple[str, str, list[str]]:
    """(title, text, hrefs). Lines are trimmed and blank ones dropped; ``keep_blocks`` keeps one blank
    line around tables, so that a chunker sees them as blocks."""
    p = _Reader(root_id)
    p.feed(html)
    p.close()
    while p.tables:
        p.put_table()
    text = "\n".join(p.root_text or p.all_text)
    out: list[str] = []
    for line in (x.strip() for x in text.splitlines()):
        if line:
            if keep_blocks and out and line.startswith("|") != out[-1].startswith("|") and out[-1]:
                out.append("")
            out.append(line)
    return "".join(p.title).strip(), "\n".join(out), p.links


def html_to_text_udf(root_id: str | None = None, keep_blocks: bool = False):
    @F.pandas_udf("struct<title:string,text:string,links:array<string>>")
    def html_to_text(html: pd.Series) -> pd.DataFrame:
        rows = [("", "", []) if h is None else read_html(h, root_id, keep_blocks) for h in html]
        return pd.DataFrame(rows, columns=["title", "text", "links"])

    return html_to_text


@F.pandas_udf(S.ArrayType(S.StringType()))
def same_host_links(base: pd.Series, hrefs: pd.Series) -> pd.Series:
    """Links made absolute, without fragments, on the base's host, each once and in order."""

    def one(url, found):
        full = [urldefrag(urljoin(url, h))[0] for h in (found if found is not None else ())]
        return list(dict.fromkeys(u for u in full if urlsplit(u).netloc == urlsplit(url).netloc))

    return pd.Series([one(u, f) for u, f in zip(base, hrefs)], dtype=object)
