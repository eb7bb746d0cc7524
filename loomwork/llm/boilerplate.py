"""Problem 2: the main body of a page among menus, notices, sidebars and footers.

Method: text-to-tag ratio of each line, Gaussian smoothing of its logarithm along the page, and a
threshold that splits the smoothed values in two clusters; lines above it form the content regions and
all others are removed. For HTML (``html_lines``) the tags are counted from the events of the standard
library's streaming parser. Extracted text has lost its tags, so they are estimated: a separator or list
mark stands for some, and a line that comes back on many pages of a host (or of the whole collection)
among other such lines was written by a template, which counts as many tags a character. So do lines of
the kinds that templates fill in: menus, breadcrumbs, and the entries below a heading that is elsewhere
followed by dated or sized entries. Counting lines takes one aggregation per (host, line), with map-side
combining; the result is bounded by shares, never by the corpus.

Smoothing settles lines of which nothing is known by what stands around them. It also blurs the edges of
regions; there the line's own ratio decides.

Defined results: null or empty text gives no lines; blank lines are never removed; a page of
furniture only loses all lines; pages without a URL are one host; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.physical import BROADCAST_ROWS, materialize, skew_join

_BULLET = re.compile(r"^(?:[•»›·*–\-]|\d{1,2}[.)])\s+")
_MONTH = re.compile(r"\b(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\b")
_ENTRY = re.compile(r"\[[A-Za-z]{2,4}, \d+ [KMG]B\]\s*$|\((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2}\)\s*$")
_PARTS = re.compile(r"\s*[|·•]\s*|\s{2,}|\]\s*\[|^\[|\]$")
_CRUMB = re.compile(r"^\S+(?:\s\S+)?\s*[/»›>→]\s+\S.*[^.!?]$")
_FACT = re.compile(r"(?:office|extension)\b[^|:]{0,20}:\s*\S")  # a person's, which belong to the body
_TEMPLATE_TAGS = 10.0
_LEAST = 1 / _TEMPLATE_TAGS
_ANCHORS = np.log([_LEAST, 60.0])  # a line of a template, a line of text
_SENTENCE_END = re.compile(r"[.!?…][\"'”’)]*$")


@dataclass(frozen=True)
class Shares:
    """``host``: part of a host's pages that makes a line template there; ``everywhere``: the same over
    all pages; ``label``: parts of menus; ``least``: pages it needs at least; ``beside``: how often
    template must stand beside it; ``linked``: how often a sidebar's heading is followed by a dated or
    sized entry; ``opener`` and ``subject``: parts of the pages that a heading and an entry's subject
    need; ``sigma``: width of the smoothing, in lines."""

    host: float = 0.04
    everywhere: float = 0.02
    label: float = 0.01
    least: int = 4
    beside: float = 0.35
    linked: float = 0.12
    opener: float = 0.001
    subject: float = 0.0005
    sigma: float = 0.7


_ROOTS = ("home", "start", "startseite", "accueil", "inicio")  # where breadcrumb trails begin

# what is known of a line's key
TEMPLATE, HEADING, LABEL, SUBJECT = 1, 2, 4, 8


def key_text(line: str) -> str:
    """A line without list mark, case, numbers and months."""
    s = " ".join(line.split()).lower()
    s = _BULLET.sub("", s)
    return re.sub(r"\d+", "0", _MONTH.sub("month", s))


def key_of(text: str) -> int:
    k = xxhash.xxh3_64_intdigest(text)
    return k - (1 << 64) if k >> 63 else k


class Line:
    """A line of a page; what depends on its text only is worked out once for recurring short lines."""

    __slots__ = ("no", "text", "norm", "key", "table", "words", "sentence", "parts", "entry", "mark", "fact", "gap")

    def __init__(self, text: str):
        self.text = text
        self.norm = key_text(text)
        self.key = key_of(self.norm)
        self.table = text.startswith("|")
        self.words = self.norm.count(" ") + 1
        self.entry = text[-1] in ")]" and bool(_ENTRY.search(text))
        m = _BULLET.match(text)
        self.mark = m.group().strip() if m else ""
        self.parts = [] if self.table else [p for p in _PARTS.split(text) if p]
        self.sentence = not self.table and (self.words >= 5 and bool(_SENTENCE_END.search(text)) or self.words >= 12) and len(self.parts) < 4
        self.fact = bool(_FACT.match(self.norm))

    def at(self, no: int, gap: bool) -> Line:
        """The same line in a page; ``gap``: a blank line before."""
        x = Line.__new__(Line)
        x.text, x.norm, x.key, x.table, x.words = self.text, self.norm, self.key, self.table, self.words
        x.entry, x.mark, x.parts, x.sentence, x.fact, x.no, x.gap = self.entry, self.mark, self.parts, self.sentence, self.fact, no, gap
        return x


@lru_cache(maxsize=50_000)
def _short(text: str) -> Line:
    return Line(text)


def subject_of(norm: str) -> str:
    """What an entry is about: without number, size, date and the kind before a colon."""
    s = re.sub(r"\s*(?:\[[^\]]*\]|\([^)]*\))$", "", norm)
    s = re.sub(r"^[a-z]{2,4}\s?[-–]\s?0\s+", "", s)
    return s.rpartition(": ")[2]


def part_key(part: str) -> int:
    return key_of("part " + key_text(part))


def entry_key(x: Line) -> int:
    return key_of("entry " + subject_of(x.norm))


def lines_of(text: str) -> list[Line]:
    out, gap = [], True
    for no, line in enumerate(text.split("\n"), 1):
        line = line.strip()
        if line:
            out.append((_short(line) if len(line) <= 100 else Line(line)).at(no, gap))
            gap = False
        else:
            gap = True
    return out


def smoothed(r: np.ndarray, sigma: float) -> np.ndarray:
    reach = max(1, int(math.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(r, reach, mode="edge"), kernel / kernel.sum(), "valid")


def threshold(s: np.ndarray) -> float:
    """Middle between the means of two clusters. One typical line of each kind is added, so a page of one
    kind only isn't split."""
    s = np.concatenate([s, _ANCHORS])
    lo, hi = s.min(), s.max()
    for _ in range(30):
        upper = s > (lo + hi) / 2
        new = s[~upper].mean(), s[upper].mean()
        if abs(new[0] - lo) + abs(new[1] - hi) < 1e-9:
            break
        lo, hi = new
    return (lo + hi) / 2


def regions(r: np.ndarray, sigma: float) -> np.ndarray:
    """True for lines of content regions, from text-to-tag ratios."""
    if not len(r):
        return np.zeros(0, bool)
    own = np.log(np.maximum(r, _LEAST))
    s = smoothed(own, sigma)
    middle = threshold(s)
    inside = s > middle
    # smoothing blurs edges: a line beside one of the other side goes by its own ratio
    edge = np.zeros(len(r), bool)
    turn = inside[1:] != inside[:-1]
    edge[1:] |= turn
    edge[:-1] |= turn
    return np.where(edge, own > middle, inside)


class _Events(HTMLParser):
    """Lines of an HTML page with the number of tags that were met on each."""

    BLOCK = frozenset("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 section article header footer nav aside td th dt dd title option form".split())
    SKIP = frozenset("script style noscript template".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, int]] = []
        self.text, self.tags, self.skip = [], 0, 0

    def _end(self):
        text = " ".join("".join(self.text).split())
        if text:
            self.rows.append((text, self.tags))
            self.tags = 0
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCK:
            self._end()
        self.tags += 1
        self.skip += tag in self.SKIP

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        if tag in self.BLOCK:
            self._end()

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)


def html_lines(html: str) -> list[tuple[str, int]]:
    """(text, tags) of each line, from streaming parser events; unclosed tags do no harm."""
    p = _Events()
    p.feed(html)
    p.close()
    p._end()
    return p.rows


def html_body(html: str | None, sigma: float = Shares.sigma) -> str | None:
    """The lines of an HTML page that lie in content regions."""
    if html is None:
        return None
    rows = html_lines(html)
    if not rows:
        return ""
    r = np.array([len(t) / max(1, n) for t, n in rows])
    return "\n".join(t for (t, _), keep in zip(rows, regions(r, sigma)) if keep)


def tags(lines: list[Line], known) -> np.ndarray:
    """Estimated tags of each line. Lines of templates have ``_TEMPLATE_TAGS`` a character."""
    n = len(lines)
    flags = [known(x.key) & (TEMPLATE | HEADING) | (known(part_key(x.text)) & LABEL if x.words <= 4 and not x.table else 0) for x in lines]
    top = next((i for i, x in enumerate(lines) if x.sentence or x.table), n)
    menu = next(((x.key, y.key) for x, y, f, g in zip(lines[:top], lines[1:top], flags, flags[1:]) if f & g & LABEL), None)
    linked = [False] * n
    for i, x in enumerate(lines):
        if x.table or x.fact:
            continue
        many = len(x.parts) >= 3 and not x.sentence and sum(bool(known(part_key(p)) & LABEL) for p in x.parts) * 2 >= len(x.parts)
        trail = not x.sentence and _CRUMB.match(x.text) and x.text.split()[0].lower().rstrip("/»›>") in _ROOTS
        linked[i] = bool(flags[i] & (TEMPLATE | LABEL) or many or trail)
    # entries below a heading that is elsewhere followed by dated or sized ones: of one mark, about what such entries are about
    i = 0
    while i < n:
        j = i + 1
        if flags[i] & HEADING and not (lines[i].sentence or lines[i].table):
            style = lines[j].mark if j < n else ""
            while j < n and not (lines[j].table or lines[j].sentence or flags[j] & HEADING or lines[j].gap and j > i + 1):
                if not (lines[j].entry or known(entry_key(lines[j])) & SUBJECT and lines[j].mark == style):
                    break
                linked[j] = True
                j += 1
            linked[i] = linked[i] or j > i + 1
            if i + 1 < j < n and lines[j].words <= 3 and not lines[j].gap and known(lines[j].key) & LABEL and not flags[j] & LABEL:
                linked[j] = True  # its closing link
        i = j
    # menu words that a line of the body introduces, or that stand alone within it, are its own
    for i, x in enumerate(lines):
        if x.text.endswith(":") and not linked[i] and not flags[i] & HEADING and not x.table:
            for j in range(i + 1, n):
                again = lines[j].norm in _ROOTS or menu and j + 1 < n and (lines[j].key, lines[j + 1].key) == menu
                if not flags[j] & LABEL or lines[j].gap or again:
                    break
                linked[j] = False
        elif linked[i] and flags[i] & LABEL and not x.mark and 0 < i < n - 1 and not (linked[i - 1] or linked[i + 1]):
            linked[i] = bool(flags[i - 1])
    return np.array([_TEMPLATE_TAGS * len(x.text) if t else 1.0 + 2 * max(0, len(x.parts) - 1) * (not x.sentence and not x.fact) + bool(x.mark) for x, t in zip(lines, linked)])


def decide(lines: list[Line], known, sigma: float) -> np.ndarray:
    """True for each line that is to be removed; ``known`` gives what was learned of a key."""
    if not lines:
        return np.zeros(0, bool)
    sizes = np.array([len(x.text) for x in lines], float)
    sizes = np.where([x.table for x in lines], np.maximum(sizes, 60.0), sizes)  # cells are text, however short
    return ~regions(sizes / tags(lines, known), sigma)


# -- what is learned over all pages ------------------------------------------------------------


def count_lines(lines: list[Line], counts: Counter, linked: Counter, host: str) -> None:
    """Adds a page: pages with each key, and pages where a dated or sized entry follows it."""
    seen, with_entry = set(), set()
    for x, after in zip(lines, [*lines[1:], None]):
        if x.table:
            continue
        seen.add(x.key)
        if x.entry:
            seen.add(entry_key(x))
        if after is not None and after.entry and not x.entry and x.words <= 5:
            with_entry.add(x.key)
        if len(x.parts) > 2 and not x.sentence:
            seen.update(part_key(p) for p in x.parts if len(p) < 30)
    counts.update((host, k) for k in seen)
    linked.update((host, k) for k in with_entry)


def count_beside(lines: list[Line], often, theirs, openers, sums: dict) -> None:
    """Adds a page: for each key that is frequent (everywhere or at its host), how often frequent lines or the page's ends are before and
    after it; for each that may be a heading, how often an entry follows, and how often another such
    line is before it then (entries are alike in that, but come after each other)."""
    n = len(lines)
    common = [not x.table and not x.fact and (x.key in often or x.key in theirs) for x in lines]
    hot = [c or x.entry for c, x in zip(common, lines)]
    may = [not x.table and x.key in openers for x in lines]
    for i, x in enumerate(lines):
        if common[i] or may[i]:
            s = sums.setdefault(x.key, [0, 0, 0, 0, 0, 0])
            s[0] += 1
            s[1] += i == 0 or hot[i - 1]
            s[2] += i == n - 1 or hot[i + 1]
            s[3] += x.text.endswith(":")
            if may[i] and i < n - 1 and lines[i + 1].entry:
                s[4] += 1
                opens = i == 0 or x.gap or lines[i - 1].sentence or lines[i - 1].table or hot[i - 1]
                s[5] += i > 0 and (may[i - 1] or lines[i - 1].entry or not opens)


_KEYS = pa.schema([("host", pa.string()), ("key", pa.int64()), ("n", pa.int64()), ("linked", pa.int64())])
_SUMS = pa.schema([("key", pa.int64()), *[(f"s{i}", pa.int64()) for i in range(6)]])
_DROPS = pa.schema([("row_id", pa.int64()), ("line_no", pa.int32())])


def _batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def _pass_1(batches):
    for b in batches:
        counts: Counter = Counter()
        linked: Counter = Counter()
        for host, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            count_lines(lines_of(text), counts, linked, host)
        rows = [(h, k, n, linked[h, k]) for (h, k), n in counts.items()]
        yield _batch(list(zip(*rows)) or [[], [], [], []], _KEYS)


def _theirs(b, i: int, host: str, of_host) -> frozenset:
    """A host's own keys: of the broadcast, or of the row where they are too many for one."""
    return of_host.value.get(host, frozenset()) if of_host is not None else frozenset(b.column(2)[i].as_py() or ())


def _pass_2(shared, of_host):
    def run(batches):
        often, openers = shared.value
        for b in batches:
            sums: dict = {}
            for i, (host, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                count_beside(lines_of(text), often, _theirs(b, i, host, of_host), openers, sums)
            rows = [(k, *s) for k, s in sums.items()]
            yield _batch(list(zip(*rows)) or [[] for _ in _SUMS], _SUMS)

    return run


def _pass_3(shared, of_host, sigma: float):
    def run(batches):
        known = shared.value
        for b in batches:
            ids, numbers = [], []
            for i, (host, row_id, text) in enumerate(zip(b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(1).to_pylist())):
                theirs = _theirs(b, i, host, of_host)
                lines = lines_of(text)
                for x, gone in zip(lines, decide(lines, lambda k: known.get(k, 0) | (TEMPLATE if k in theirs else 0), sigma)):  # noqa: B023
                    if gone:
                        ids.append(row_id)
                        numbers.append(x.no)
            yield _batch([ids, numbers], _DROPS)

    return run


def furniture(pages: DataFrame, rule: Shares = Shares(), broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(row_id, line_no) of the lines outside the main body. ``pages`` has row_id, url, text.

    What goes to the driver is bounded by shares of the pages, not by their number: a key in a part
    p of all pages can occur at most (lines a page) / p times. Keys of single hosts are broadcast if
    counted to be at most ``broadcast_rows``, else joined to the pages with hot hosts apart."""
    spark = pages.sparkSession
    host = F.coalesce(F.regexp_extract(F.lower("url"), r"^[^a-z]*[a-z][a-z0-9+.\-]*://([^/?#]*)", 1), F.lit(""))
    # written once: three passes read it, and the join that found the hosts is not run again
    pages = materialize(pages.filter("length(text) > 0").select(host.alias("host"), "text", F.col("row_id").cast("bigint")))
    sizes = materialize(pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages")))
    total = sizes.agg(F.sum("pages")).first()[0] or 0
    counts = materialize(pages.select("host", "text").mapInArrow(_pass_1, "host string, key bigint, n bigint, linked bigint").groupBy("host", "key").agg(F.sum("n").alias("n"), F.sum("linked").alias("linked")))
    least = lambda share: float(max(rule.least, share * total))
    whole = counts.groupBy("key").agg(F.sum("n").alias("n"), F.sum("linked").alias("linked"))
    frequent = {r[0]: (r[1], r[2]) for r in whole.filter(F.col("n") >= least(rule.subject)).collect()}
    often = frozenset(k for k, (n, _) in frequent.items() if n >= least(rule.everywhere))
    openers = frozenset(k for k, (n, linked) in frequent.items() if n >= least(rule.opener) and linked >= rule.linked * n)
    own = materialize(counts.join(sizes, "host").filter(F.col("n") >= F.greatest(F.lit(float(rule.least)), F.col("pages") * rule.host)).select("host", "key"))

    def with_keys(keys: DataFrame):
        if keys.limit(broadcast_rows + 1).count() > broadcast_rows:
            by_host = materialize(sizes.join(keys.groupBy("host").agg(F.collect_list("key").alias("keys")), "host", "left"))
            return skew_join(pages, by_host, "host", "pages", total).select("host", "text", "keys", "row_id"), None
        held: dict[str, set] = {}
        for h, k in keys.collect():  # counted above
            held.setdefault(h, set()).add(k)
        none = F.lit(None).cast("array<bigint>").alias("keys")
        return pages.select("host", "text", none, "row_id"), spark.sparkContext.broadcast({h: frozenset(ks) for h, ks in held.items()})

    shared = spark.sparkContext.broadcast((often, openers))
    rows, of_host = with_keys(own)
    sums = rows.mapInArrow(_pass_2(shared, of_host), "key bigint, " + ", ".join(f"s{i} bigint" for i in range(6)))
    sums = materialize(sums.groupBy("key").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(6)]))
    beside = F.when(F.col("s3") * 2 > F.col("s0"), F.col("s1") / F.col("s0")).otherwise((F.col("s1") + F.col("s2")) / (2 * F.col("s0")))
    template = sums.filter(beside >= rule.beside).select("key")
    known: dict[int, int] = {}
    named = spark.createDataFrame([(k,) for k in sorted(often | openers)], "key bigint")
    for r in sums.join(F.broadcast(named), "key").select("key", "s4", "s5", (beside >= rule.beside).alias("template")).collect():
        if r["key"] in often and r["template"]:
            known[r["key"]] = TEMPLATE
        if r["key"] in openers and r["s5"] < 0.5 * r["s4"]:
            known[r["key"]] = known.get(r["key"], 0) | HEADING
    # keys of menu parts and entry subjects are told by their hash; lines have other keys
    for k, (n, _) in frequent.items():
        known[k] = known.get(k, 0) | SUBJECT | (LABEL if n >= least(rule.label) else 0)
    model = spark.sparkContext.broadcast(known)
    rows, of_host = with_keys(materialize(own.join(template, "key")))
    return rows.mapInArrow(_pass_3(model, of_host, rule.sigma), "row_id bigint, line_no int")


def corpus_furniture(corpus: DataFrame, manifest: DataFrame, rule: Shares = Shares()) -> DataFrame:
    """``furniture`` of pages whose URL is in a crawl manifest."""
    urls = manifest.select("row_id", "url")
    return furniture(corpus.select("row_id", "text").join(urls, "row_id", "left"), rule)


def bodies(corpus: DataFrame, manifest: DataFrame, rule: Shares = Shares()) -> DataFrame:
    """``corpus`` with only the main body in ``text``."""
    gone = corpus_furniture(corpus, manifest, rule).groupBy("row_id").agg(F.collect_set("line_no").alias("_gone"))
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("_gone", (i + 1).cast("int")))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return corpus.join(gone, "row_id", "left").withColumn("text", text).select(corpus.columns)
