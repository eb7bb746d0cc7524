"""Problem 9: keyword-stuffed pages, link lists and tag or product lists.

Every line (and every sentence of a line) is reduced to its shape: word count, capitals, separators and
links, whether it reads as a sentence, and whether it holds a phrase that the page repeats without end
or begins like many other sentences of the page; the last two are no sentences of prose, whatever they
look like. Lines are grouped by shape, and a page is flagged if its ``few`` commonest non-sentence
shapes hold half of its words. All that follows looks at flagged pages only.

Structured pages (directories, agendas, product lists) are dominated by few shapes too, so an exact check
confirms: pages whose shapes leave no doubt (links, hash tags, lists of short repeated phrases, one
phrase forced into most sentences) are spam; phrases that are typical of these against the other flagged
pages are counted over all data, and a flagged page is spam if most of its units hold such a phrase or a
link. Two rounds; the second counts with the first one's decisions. A flagged page is written once, as
the words of its units; copies of a text share one vote, by a count of text hashes, so no text is shuffled.

Defined results: null and empty texts, and texts below ``least_words`` without links, are no cases;
copies of a text are judged alike; tables (lines that begin with a pipe) count as neutral; other
columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.physical import join_small, materialize, skew_join

_LINK = re.compile(r"(?:https?://|www\.)\S+|<a\s[^>]*>|</a>|\]\([^)\s]*\)", re.I)
_ADDRESS = re.compile(r"(?:https?://|www\.)[^\s\"'<>)\]]+", re.I)
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_STOP = re.compile(r"[.!?;]\s+")
_PHRASES = re.compile(r"[,;·|•/>\n.!?:#]+|\s[–—-]\s|(?<=\s)#")
_HASH_TAG = re.compile(r"#\w+")
_CAMEL = re.compile(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ0-9])|(?<=[0-9])(?=[A-Za-z])")
_LABEL = re.compile(r"^\s*(?:keywords?|tags?|filed under|labels?|topics?|mots[- ]cl[ée]s|schlagworte|etiquetas)\b\s*:?", re.I)
# The most frequent function words of the four languages of the corpus.
_FUNCTION = frozenset(
    """the a an of in to and for is are was with on at by from or as that this not no be it its his her their our we
    you each every who which may must if so than then when after before because while but has had will can
    der die das und ist ein eine einen einem einer den dem des von mit für auf im zu sich nicht auch bei am oder
    le la les un une du et en est dans pour par sur au aux avec que qui se ne pas ou
    el los las y es del por con para al lo su una""".split()
)


@dataclass(frozen=True)
class Spam:
    """``dominated``: part of the words that the ``few`` commonest non-sentence shapes of a flagged page
    hold; ``share``: part of its units that must be spam; ``least_words``: shorter pages without
    links are never cases; ``typical``: part of the candidates with a phrase that must be spam for
    the phrase to count, ``least_pages`` of them at least; ``lexicon``: most phrases broadcast (more
    of them stay a table and are joined, see ``_joined``)."""

    dominated: float = 0.5
    few: int = 4
    share: float = 0.5
    least_words: int = 12
    typical: float = 0.5
    least_pages: int = 3
    lexicon: int = 100_000


_HEAD = 3  # function words that tell how a sentence begins


class Unit:
    """A line or sentence: its words in lower case, addresses, and whether it reads as a sentence."""

    __slots__ = ("text", "words", "names", "links", "table", "sentence", "separators", "address_words")

    def __init__(self, text: str):
        self.text = text
        self.table = text.lstrip().startswith("|")
        low = text.lower()
        found = _ADDRESS.findall(text) if "://" in low or "www." in low else []
        self.links = len(found)
        self.address_words = [w.lower() for a in found for w in _WORD.findall(re.sub("[-_+]", " ", a.partition("//")[2].partition("/")[2]))]
        bare = _LINK.sub(" ", text) if found else text
        self.names = _WORD.findall(_CAMEL.sub(" ", bare) if "#" in bare else bare)
        self.words = [w.lower() for w in self.names] if found or "#" in bare else _WORD.findall(low)
        n = len(self.words)
        self.separators = sum(map(bare.count, ",;·|#•"))
        self.sentence = n >= 5 and not found and self.separators * 4 <= n and sum(map(_FUNCTION.__contains__, self.words)) >= max(1, n // 8)

    def weight(self) -> int:
        """Words; an address counts as six."""
        return max(1, len(self.words)) + 6 * self.links

    def head(self) -> tuple[str, ...]:
        out = []
        for w in self.words:
            if w in _FUNCTION:
                out.append(w)
                if len(out) == _HEAD:
                    break
        return tuple(out)

    def packed(self) -> str:
        return f"{'t' if self.table else 's' if self.sentence else '-'}{self.links}\t{' '.join(self.words)}\t{' '.join(self.address_words)}"

    @staticmethod
    def unpacked(row: str) -> Unit:
        u = Unit.__new__(Unit)
        head, words, address = row.split("\t")
        u.table, u.sentence, u.links = head[0] == "t", head[0] == "s", int(head[1:])
        u.words, u.address_words = words.split(" ") if words else [], address.split(" ") if address else []
        return u


def sentences(line: str) -> list[str]:
    """A long line cut after its stops, but not after short abbreviations."""
    out, at = [], 0
    for m in _STOP.finditer(line):
        a = m.start()
        if line[a] in "!?;" or a >= 3 and line[a - 3 : a].isalnum():
            out.append(line[at : a + 1])
            at = m.end()
    return [*out, line[at:]]


def units_of(text: str) -> list[Unit]:
    out = []
    for line in text.split("\n"):
        if line.strip():
            out += [Unit(x) for x in (sentences(line) if len(line) > 60 and not line.lstrip().startswith("|") else [line]) if x.strip()]
    return out


def pair_counts(units: list[Unit], least: float) -> Counter:
    """How often pairs of content words follow each other that come ``least`` times or more; lines that
    are repeated whole (refrains) count once."""
    once = {tuple(u.words) for u in units if not u.table}
    counts: Counter = Counter()
    for words in once:
        counts.update(words)
    often = {w for w, n in counts.items() if n >= least and w not in _FUNCTION}
    pairs: Counter = Counter()
    if often:
        for words in once:
            pairs.update([p for p in zip(words, words[1:]) if p[0] in often and p[1] in often])
    return Counter({p: n for p, n in pairs.items() if n >= least})


def repeated_phrase(units: list[Unit], n_words: int) -> tuple[tuple[str, str] | None, float]:
    """The pair of words that covers most of the page beyond chance, and its cover."""
    pairs = pair_counts(units, 4)
    if not pairs:
        return None, 0.0
    pair, n = max(pairs.items(), key=lambda x: (x[1], x[0]))
    return pair, 2 * n / max(1, n_words)


def shapes(units: list[Unit]) -> tuple[Counter, int]:
    """Weight of each non-sentence shape, and of the whole page; tables have no shape."""
    n_words = sum(len(u.words) for u in units)
    keys = pair_counts(units, max(4, n_words / 60))
    heads = Counter(u.head() for u in {tuple(u.words): u for u in units if u.sentence}.values())
    alike = {h for h, n in heads.items() if len(h) >= 2 and n >= max(4, 0.2 * len(units))}
    weights: Counter = Counter()
    total = 0
    for u in units:
        n, w = len(u.words), u.weight()
        total += w
        keyed = bool(keys) and any(p in keys for p in zip(u.words, u.words[1:]))
        formal = u.sentence and u.head() in alike
        if u.table or u.sentence and not keyed and not formal:
            continue
        capitals = 2 * sum(map(str.isupper, (x[0] for x in u.names))) > n
        separators = 0 if not u.separators else 1 if u.separators * 6 <= n else 2
        weights[min(n.bit_length(), 5), capitals, separators, min(u.links, 1), u.sentence, keyed, formal] += w
    return weights, total


def flagged(units: list[Unit], rule: Spam) -> bool:
    weights, total = shapes(units)
    return total > 0 and sum(w for _, w in weights.most_common(rule.few)) >= rule.dominated * total


def judge(text: str, rule: Spam) -> tuple[int, list[Unit]] | None:
    """2: flagged, and spam beyond doubt; 1: flagged; None: not dominated by few non-sentence shapes."""
    units = units_of(text)
    n_words = sum(len(u.words) for u in units)
    links = sum(u.links for u in units)
    if n_words < rule.least_words and links < 3 or not flagged(units, rule):
        return None
    linked = sum(u.links > 0 for u in units)
    if links >= 4 and linked >= 0.6 * len(units):
        return 2, units
    tags = len(_HASH_TAG.findall(text))
    if tags >= 8 and tags >= 0.6 * len(text.split()):
        return 2, units
    rows = [x for x in text.split("\n") if x.strip()]
    numbered = sum(any(c.isdigit() for c in x) for x in rows)
    directory = len(rows) >= 4 and numbered > 0.8 * len(rows) and 2 * sum(u.sentence for u in units) < len(units)
    pair, cover = repeated_phrase(units, n_words)
    if cover >= 0.2 and not directory and sum(any(p == pair for p in zip(u.words, u.words[1:])) for u in units) >= 0.5 * len(units):
        return 2, units
    plain = [u for u in units if not u.table]
    phrases = [tuple(_WORD.findall(p.lower())) for u in plain if not u.sentence or len(u.words) < 4 for p in _PHRASES.split(_LABEL.sub("", u.text))]
    phrases = [p for p in phrases if p]
    short = [p for p in phrases if len(p) <= 5]
    inside = sum(map(len, short))
    if len(short) >= 10 and inside >= 0.7 * n_words:
        vocabulary = len({w for p in short for w in p})
        if vocabulary <= 0.34 * inside and len(set(short)) <= 0.9 * len(short) and not directory:
            return 2, units
        if vocabulary <= 0.2 * inside and not directory:
            return 2, units
    return 1, units


def phrases_of(units: list[Unit], sure: bool) -> set[str]:
    """Pairs and longer single words of a page, without function words; address words too. Of a sure
    page only those of its non-sentence units, and its forced phrase."""
    out: set[str] = set()
    for u in units:
        if u.table or sure and u.sentence:
            continue
        words = u.words + u.address_words
        out.update(w for w in words if len(w) >= 4 and w not in _FUNCTION)
        out.update(f"{a} {b}" for a, b in zip(words, words[1:]) if a not in _FUNCTION and b not in _FUNCTION)
    if sure:
        pair, cover = repeated_phrase(units, sum(len(u.words) for u in units))
        if cover >= 0.1:
            out.update((" ".join(pair), *(w for w in pair if len(w) >= 4)))
    return out


def spam_share(units: list[Unit], lexicon) -> float:
    """Part of the units (by words; an address counts as six) that hold a link or a typical phrase."""
    total = hit = 0.0
    for u in units:
        weight = u.weight()
        total += weight
        if u.table:
            continue
        if u.links:
            hit += weight
            continue
        pairs = sum(f"{a} {b}" in lexicon for a, b in zip(u.words, u.words[1:]))
        content = [w for w in u.words if len(w) >= 4 and w not in _FUNCTION]
        single = sum(w in lexicon for w in content)
        if pairs * 15 >= len(u.words) and pairs or content and single >= 0.6 * len(content) and (not u.sentence or single > 2):
            hit += weight
    return hit / total if total else 0.0


_FLAGGED = pa.schema([("doc_id", pa.int64()), ("key", pa.string()), ("units", pa.list_(pa.string())), ("sure", pa.int32())])
_ROWS = "doc_id bigint, key string, units array<string>, sure int"


def _first(rule: Spam):
    def run(batches):
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = judge(t, rule) if d is not None and t else None
                if got:
                    for c, v in zip(cols, (d, xxhash.xxh3_128_hexdigest(t), [u.packed() for u in got[1]], int(got[0] == 2))):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _FLAGGED.types)], schema=_FLAGGED)

    return run


def _unpacked(column) -> list[list[Unit]]:
    return [[Unit.unpacked(x) for x in page] for page in column.to_pylist()]


def _is_sure(units: list[Unit], before: int, lexicons: list, rule: Spam) -> bool:
    return bool(before) or any(spam_share(units, lexicon) >= rule.share for lexicon in lexicons)


def _phrase_rows(lexicons, rule: Spam):
    """Phrases with their votes among sure pages and all; each of n copies of a text has an n-th of a vote."""
    schema = pa.schema([("phrase", pa.string()), ("spam", pa.float64()), ("n", pa.float64())])

    def run(batches):
        known = [x.value for x in lexicons]
        for b in batches:
            held: dict[str, list[float]] = {}
            for units, sure, copies in zip(_unpacked(b.column(0)), b.column(1).to_pylist(), b.column(2).to_pylist()):
                vote = 1.0 / (copies or 1)
                sure = _is_sure(units, sure, known, rule)
                for p in phrases_of(units, sure):
                    h = held.setdefault(p, [0.0, 0.0])
                    h[0] += vote * sure
                    h[1] += vote
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([h[0] for h in held.values()], pa.float64()), pa.array([h[1] for h in held.values()], pa.float64())], schema=schema)

    return run


def _typical(pages: DataFrame, many: DataFrame, lexicons: list, rule: Spam) -> DataFrame:
    """(phrase, n) of the phrases typical of sure pages, counted over the distinct texts of all flagged
    ones. ``many``: (key, copies) of texts that recur."""
    voted = join_small(pages, many, ["key"], "left").select("units", "sure", "copies")
    counted = voted.mapInArrow(_phrase_rows(lexicons, rule), "phrase string, spam double, n double").groupBy("phrase").agg(F.round(F.sum("spam"), 6).alias("spam"), F.round(F.sum("n"), 6).alias("n"))
    return materialize(counted.filter((F.col("spam") >= rule.least_pages) & (F.col("spam") >= F.col("n") * rule.typical)).select("phrase"))


def looked_up(units: list[Unit]) -> set[str]:
    """All that ``spam_share`` may find in a lexicon."""
    out: set[str] = set()
    for u in units:
        if not u.table and not u.links:
            out.update(w for w in u.words if len(w) >= 4 and w not in _FUNCTION)
            out.update(f"{a} {b}" for a, b in zip(u.words, u.words[1:]) if a not in _FUNCTION and b not in _FUNCTION)
    return out


def _lookups(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.string()), ("phrase", pa.string())])
    for b in batches:
        for d, k, units in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _unpacked(b.column(2))):
            found = sorted(looked_up(units))
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(found), pa.int64()), pa.array([k] * len(found), pa.string()), pa.array(found, pa.string())], schema=schema)


def _with_own(rule: Spam):
    def run(batches):
        for b in batches:
            sure = [int(_is_sure(units, s, [frozenset(own or ())], rule)) for units, s, own in zip(_unpacked(b.column(2)), b.column(3).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sure, pa.int32())], schema=_FLAGGED)

    return run


def _joined(pages: DataFrame, typical: DataFrame, rule: Spam) -> DataFrame:
    """A round without a broadcast: each open page gets the typical phrases that it holds."""
    asked = materialize(pages.filter("sure = 0").select("doc_id", "key", "units").mapInArrow(_lookups, "doc_id bigint, key string, phrase string").distinct())
    sizes = materialize(asked.groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).join(typical, "phrase"))
    own = skew_join(asked, sizes, "phrase", "n", asked.count()).groupBy("doc_id", "key").agg(F.collect_list("phrase").alias("own"))
    held = pages.join(own, ["doc_id", "key"], "left").select("doc_id", "key", "units", "sure", "own")
    return materialize(held.mapInArrow(_with_own(rule), _ROWS))


def _decided(lexicons, rule: Spam):
    schema = pa.schema([("doc_id", pa.int64())])

    def run(batches):
        known = [x.value for x in lexicons]
        for b in batches:
            ids = [d for d, units, s in zip(b.column(0).to_pylist(), _unpacked(b.column(1)), b.column(2).to_pylist()) if _is_sure(units, s, known, rule)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], schema=schema)

    return run


def spam_pages(docs: DataFrame, rule: Spam = Spam(), rounds: int = 2) -> DataFrame:
    """(doc_id) of the pages that are spam."""
    spark = docs.sparkSession
    pages = materialize(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_first(rule), _ROWS))
    many = materialize(pages.groupBy("key").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"))
    lexicons: list = []
    for _ in range(rounds):
        typical = _typical(pages, many, lexicons, rule)
        if typical.count() <= rule.lexicon:
            lexicons.append(spark.sparkContext.broadcast(frozenset(r[0] for r in typical.collect())))
        else:
            pages = _joined(pages, typical, rule)
    return pages.select("doc_id", "units", "sure").mapInArrow(_decided(lexicons, rule), "doc_id bigint").distinct()
