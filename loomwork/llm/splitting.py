"""Problem 6: cut oversized items into pieces under a size limit.

Method: balanced targets. The least piece count that the size allows is computed, equal-length
targets are placed, each target snaps to the strongest boundary near it (blank line, line end,
sentence end, clause, word gap, in this order; the nearest of equal ones) and, while any piece is
over its limit, the count grows. Pieces are exact substrings, given with offsets: the source can be
put together again, and neighbours share a stated overlap.

Size: max(floor(1.33 * words), floor(characters / 3)) + 1. A piece that is a table (at least two
non-blank lines, at least 2 and 60 % of them starting with a pipe) has its own limit.

Defined results: null text is one piece with null offsets; empty text is one piece; a text within
its limit is one piece, unchanged; one endless word is cut between characters; rows with equal ids
are cut alike; an empty table gives an empty result; columns that clash with new names are replaced
by the new ones (``chunk_index`` and ``n_chunks`` are meant to be).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.physical import join_small, materialize

_WORD = re.compile(r"\S+")
_GAPS = re.compile(r"\s+")
_SENTENCE_END = ".!?…"
_CLAUSE_END = ",;:–—)]"


@dataclass(frozen=True)
class Limits:
    """Sizes in estimated tokens; ``overlap`` in words; ``near``: how far a cut may move from its
    target, as a share of the piece length."""

    text: int = 512
    table: int = 1800
    overlap: int = 24
    near: float = 0.2


def estimated_size(words: int, chars: int) -> int:
    # integer arithmetic: floor(1.33 * words) without binary rounding
    return max(words * 133 // 100, chars // 3) + 1


def is_table(text: str) -> bool:
    lines = [x for x in text.split("\n") if x.strip()]
    pipes = sum(x.lstrip().startswith("|") for x in lines)
    return len(lines) >= 2 and pipes >= 2 and pipes * 10 >= 6 * len(lines)


def limit_of(text: str, limits: Limits) -> int:
    return limits.table if is_table(text) else limits.text


def _boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places (start of the next piece) and strengths of all gaps between words."""
    at, strength = [], []
    for m in _GAPS.finditer(text):
        a, b = m.span()
        if a == 0 or b == len(text):
            continue
        gap, before = m.group(), text[a - 1]
        lines = gap.count("\n")
        if lines > 1:
            s = 5
        elif lines == 1:
            s = 4
        elif before in _SENTENCE_END or before in "\"'”’)" and a > 1 and text[a - 2] in _SENTENCE_END:
            s = 3
        elif before in _CLAUSE_END:
            s = 2
        else:
            s = 1
        at.append(b)
        strength.append(s)
    return np.array(at, np.int64), np.array(strength, np.int64)


def _snap(targets: np.ndarray, reach: float, at: np.ndarray, strength: np.ndarray) -> np.ndarray:
    out = []
    lo = np.searchsorted(at, targets - reach, "left")
    hi = np.searchsorted(at, targets + reach, "right")
    for t, i, j in zip(targets, lo, hi):
        if i == j:
            out.append(int(t))  # no gap near: between two characters
            continue
        s, p = strength[i:j], at[i:j]
        best = np.flatnonzero(s == s.max())
        out.append(int(p[best[np.argmin(np.abs(p[best] - t))]]))
    return np.array(out, np.int64)


def cut(text: str, limits: Limits = Limits()) -> list[tuple[int, int]]:
    """[start, end) of each piece, in order."""
    n_chars = len(text)
    spans = [m.span() for m in _WORD.finditer(text)]
    limit = limit_of(text, limits)
    if estimated_size(len(spans), n_chars) <= limit:
        return [(0, n_chars)]
    starts = np.array([a for a, _ in spans], np.int64)
    ends = np.array([b for _, b in spans], np.int64)
    at, strength = _boundaries(text)
    total = estimated_size(len(spans), n_chars)
    shared = estimated_size(limits.overlap, 0)
    count = max(2, -(-(total - shared) // max(1, limit - shared)))
    most_shared = max(1, min(limits.text, limits.table) * 3 // 4)  # characters, a quarter of the limit
    while True:
        length = n_chars / count
        targets = (np.arange(1, count) * length).astype(np.int64)
        cuts = np.unique(_snap(targets, length * limits.near, at, strength))
        cuts = cuts[(cuts > 0) & (cuts < n_chars)]
        # the next piece begins `overlap` words before the cut, fewer where those words are very long
        first = np.searchsorted(ends, cuts, "right") - limits.overlap
        begin = starts[np.clip(first, 0, None)] if limits.overlap and len(starts) else cuts
        begin = np.where(cuts - begin > most_shared, np.minimum(_next_start(starts, cuts - most_shared), cuts), begin)
        previous = np.concatenate([[0], cuts[:-1]])
        begin = np.maximum(np.minimum(begin, cuts), previous + 1)  # each piece goes on beyond the last cut
        lo = np.concatenate([[0], begin])
        hi = np.concatenate([cuts, [n_chars]])
        words = np.searchsorted(starts, hi, "left") - np.searchsorted(ends, lo, "right")
        size = np.maximum(words * 133 // 100, (hi - lo) // 3) + 1
        small = min(limits.text, limits.table)
        over = [k for k in np.flatnonzero(size > small) if size[k] > limit_of(text[lo[k] : hi[k]], limits)]
        if not over:
            return list(zip(lo.tolist(), hi.tolist()))
        count += max(1, count // 16)


def _next_start(starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.full(len(at), np.iinfo(np.int64).max)
    k = np.searchsorted(starts, at, "left")
    return np.where(k < len(starts), starts[np.minimum(k, len(starts) - 1)], np.iinfo(np.int64).max)


def cuts_udf(limits: Limits):
    @F.pandas_udf("array<struct<start:int,end:int>>")
    def cuts(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [{"start": a, "end": b} for a, b in cut(t, limits)] for t in texts], dtype=object)

    return cuts


def may_exceed(text: Column, limits: Limits) -> Column:
    """True for every text over a limit, and some others: words are at most (characters + 1) / 2,
    so shorter texts can be told by length alone, without a Python call."""
    least = min(limits.text, limits.table)
    return F.length(text) * F.lit(0.665) + F.lit(1.67) >= F.lit(float(least))


def split(df: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """One row for each piece: all columns of ``df`` with ``text`` cut, and piece, n_pieces (from 0),
    piece_start, piece_end (character offsets in the source)."""
    names = [c for c in df.columns if c not in ("piece", "n_pieces", "piece_start", "piece_end")]
    cuts = cuts_udf(limits)(F.when(may_exceed(F.col(text), limits), F.col(text)))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("end")))
    rows = df.select(*names, cuts.alias("_cuts")).withColumn("_cuts", F.coalesce("_cuts", whole))
    rows = rows.select(*names, F.size("_cuts").alias("n_pieces"), F.posexplode("_cuts").alias("piece", "_c"))
    piece = F.when(F.col("n_pieces") == 1, F.col(text)).otherwise(F.expr(f"substring(`{text}`, _c.start + 1, _c.end - _c.start)"))
    return rows.select(
        *[piece.alias(text) if c == text else F.col(c) for c in names],
        "piece", "n_pieces", F.col("_c.start").alias("piece_start"), F.col("_c.end").alias("piece_end"),
    )


_SPAN = 512


def _block_offsets(blocks: DataFrame) -> DataFrame:
    """(_source, _block, _before, _all): pieces before a block and in all, from (_source, _block, _n)."""
    by = Window.partitionBy("_source")
    before = by.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select("_source", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(by).alias("_all"))


def renumber(pieces: DataFrame, source: Column, index: str = "chunk_index", span: int = _SPAN) -> DataFrame:
    """``chunk_index`` and ``n_chunks`` anew over all pieces of a source, in order of the old index,
    the id and the piece. Running counts go over blocks of ``span`` old indices, so a source with
    very many chunks is numbered by many tasks. Null sources and indices count as one value each."""
    p = pieces.withColumn("_source", source).withColumn("_block", F.floor(F.coalesce(F.col(index), F.lit(-1)) / span))
    offsets = _block_offsets(p.groupBy("_source", "_block").agg(F.count(F.lit(1)).alias("_n")))
    p = p.alias("p").join(offsets.alias("o"), F.expr("p._source <=> o._source AND p._block = o._block")).select("p.*", "o._before", "o._all")
    order = [F.col(index).asc_nulls_first()] + ([F.col("id")] if "id" in pieces.columns else []) + [F.col("piece")]
    within = F.row_number().over(Window.partitionBy("_source", "_block").orderBy(*order))
    numbered = p.withColumn("_k", (F.col("_before") + within - 1).cast("int")).withColumn("_all", F.col("_all").cast("int"))
    keep = [c for c in pieces.columns if c not in (index, "n_chunks")]
    return numbered.select(*keep, F.col("_k").alias(index), F.col("_all").alias("n_chunks"))


def chunk_source() -> Column:
    """A chunk's document: its id without the number."""
    return F.substring_index(F.col("id"), "#", 1)


def split_chunks(chunks: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``split`` and ``renumber`` of a chunk table. Numbers are worked out on narrow rows, and only chunks
    that are cut or get other numbers are joined back (broadcast if counted to be few), so texts stay
    where they are. Tables with repeated or null ids go through ``renumber``."""
    cuts = cuts_udf(limits)(F.when(may_exceed(F.col("text"), limits), F.col("text")))
    n = F.greatest(F.coalesce(F.size("_cuts"), F.lit(1)), F.lit(1))
    narrow = chunks.select("id", chunk_source().alias("_source"), F.col("chunk_index").alias("_old"), F.col("n_chunks").alias("_old_n"), cuts.alias("_cuts"))
    narrow = materialize(narrow.withColumn("_n", n).withColumn("_cuts", F.when(n > 1, F.col("_cuts"))).withColumn("_block", F.floor(F.coalesce(F.col("_old"), F.lit(-1)) / _SPAN)))
    if narrow.select("id").groupBy("id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1 OR id IS NULL").limit(1).count():
        return renumber(split(chunks, "text", limits), chunk_source())
    numbers = narrow.drop("_cuts").join(_block_offsets(narrow.groupBy("_source", "_block").agg(F.sum("_n").alias("_n"))), ["_source", "_block"])  # no null source, as ids aren't null
    order = Window.partitionBy("_source", "_block").orderBy(F.col("_old").asc_nulls_first(), "id").rowsBetween(Window.unboundedPreceding, -1)
    numbers = numbers.withColumn("_first", F.col("_before") + F.coalesce(F.sum("_n").over(order), F.lit(0)))
    other = ~(F.col("_first").eqNullSafe(F.col("_old")) & F.col("_all").eqNullSafe(F.col("_old_n"))) | (F.col("_n") > 1)
    moved = materialize(numbers.filter(other).select("id", "_first", "_all").join(narrow.filter("_n > 1").select("id", "_cuts"), "id", "left"))
    names = [c for c in chunks.columns if c not in ("piece", "n_pieces", "piece_start", "piece_end")]
    rows = join_small(chunks.select(*names), moved, ["id"], "left")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end")))
    rows = rows.withColumn("_cuts", F.coalesce("_cuts", whole))
    rows = rows.select(*names, "_first", "_all", F.size("_cuts").alias("n_pieces"), F.posexplode("_cuts").alias("piece", "_c"))
    piece = F.when(F.col("n_pieces") == 1, F.col("text")).otherwise(F.expr("substring(text, _c.start + 1, _c.end - _c.start)"))
    new = {"text": piece, "chunk_index": (F.coalesce("_first", "chunk_index") + F.col("piece")).cast("int"), "n_chunks": F.coalesce("_all", "n_chunks").cast("int")}
    kept = [c for c in names if c not in ("chunk_index", "n_chunks")]
    return rows.select(
        *[new[c].alias(c) if c in new else F.col(c) for c in kept], "piece", "n_pieces",
        F.col("_c.start").alias("piece_start"), F.col("_c.end").alias("piece_end"), new["chunk_index"].alias("chunk_index"), new["n_chunks"].alias("n_chunks"),
    )


def oversized(chunks: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Ids of the chunks that ``split`` cuts."""
    rows = chunks.filter(may_exceed(F.col("text"), limits)).select("id", cuts_udf(limits)("text").alias("_cuts"))
    return rows.filter(F.size("_cuts") > 1).select("id").distinct()
