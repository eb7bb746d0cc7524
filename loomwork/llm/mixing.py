"""Problem 8: mix sources so that each gives its share of all tokens.

Every text of a source should be used the same, generally fractional, number of times. The whole
part is given; the fractions are rounded by the pivotal method: two texts with a fraction left
trade expected tokens, by a fair random draw, until one of them is integral. A trade keeps the
source's expected tokens exactly and each text's expected use; only the last text of a source, when
no other is left to trade with, is rounded to the nearer side, so a source misses its tokens by at
most half a text. Texts trade within buckets of about ``window`` that their id and text hash decide,
the largest first, so that the one text for each source that a bucket passes on is small; these
residuals meet in a reduction tree (``fan`` nodes to one at each level). Buckets, order and draws depend
on the texts and the seed only, so the same texts give the same mix under any partitioning.

The total is the token count of all texts that have a target, unless one is given. A source that
cannot reach its share of it within ``max_repeats`` uses of each text gives all it may, the others
keep to their own tokens, and the report shows the shares reached.

Defined results: texts that are null, empty or whose source has no target are left out; targets
with null source, or without positive share and repeats, are left out; repeated targets of a source
add their shares and take the smaller repeats; targets without texts are reported with 0; ids need
not be unique or known (rows that agree in id, source and text are counted first, so a large group of
them is no hot key); empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.physical import join_small, materialize
from .tokens import DEFAULT_VOCABULARY, Counter

_NEAR = 1e-9


def _count(vocabulary: str):
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("h", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        counter = Counter(vocabulary)
        for b in batches:
            sizes = pa.array(counter.count(b.column(3)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), sizes], schema=schema)

    return run


def clean_targets(targets: DataFrame) -> DataFrame:
    ok = targets.filter("source IS NOT NULL AND target_share > 0 AND coalesce(max_repeats, 1) > 0")
    return ok.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))


def trade(sizes: np.ndarray, p: np.ndarray, draws: np.ndarray) -> int:
    """Pivotal rounding of ``p`` in place along the array; gives the index of the one text that may
    be left with a fraction, or -1. Expected tokens (sizes * p) and each p's expectation stay."""
    left = -1
    for i in range(len(p)):
        if p[i] < _NEAR or p[i] > 1 - _NEAR:
            p[i] = round(p[i])
            continue
        if left < 0:
            left = i
            continue
        up = min((1 - p[left]) * sizes[left], p[i] * sizes[i])  # tokens from i to left
        down = min(p[left] * sizes[left], (1 - p[i]) * sizes[i])
        move = up if draws[i] * (up + down) < down else -down
        p[left] += move / sizes[left]
        p[i] -= move / sizes[i]
        for j in (left, i):
            if p[j] < _NEAR or p[j] > 1 - _NEAR:
                p[j] = round(p[j])
        rest = [j for j in (left, i) if 0 < p[j] < 1]
        left = rest[-1] if rest else -1
    return left


_ROWS = "doc_id bigint, source string, h bigint, n_tokens bigint, base int, p double, node bigint, open boolean"
_COLUMNS = [c.split()[0] for c in _ROWS.split(", ")]


def _rounded(f: pd.DataFrame, seed: int, level: int, node: int, last: bool = False) -> pd.DataFrame:
    parts = []
    for source, g in f.groupby("source", sort=True):
        g = g.sort_values(["n_tokens", "h", "doc_id"], ascending=False, kind="stable")  # what is left over is small
        rng = np.random.default_rng(xxhash.xxh3_64_intdigest(f"{seed}/{level}/{node}/{source}"))
        p = g["p"].to_numpy(float).copy()
        left = trade(g["n_tokens"].to_numpy(float), p, rng.random(len(p)))
        if last and left >= 0:
            p[left] = round(p[left])  # the nearer: off by at most half this text
            left = -1
        is_open = np.zeros(len(p), bool)
        if left >= 0:
            is_open[left] = True
        parts.append(g.assign(p=p, node=node, open=is_open))
    return pd.concat(parts) if parts else f.assign(node=node, open=False)


def _first(seed: int):
    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.astype({"doc_id": "Int64"})
        return _rounded(f.loc[f.index.repeat(f["rows"])].reset_index(drop=True), seed, 0, int(key[0]))[_COLUMNS]

    return run


def _higher(seed: int, level: int, last: bool):
    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        return _rounded(f.astype({"doc_id": "Int64"}), seed, level, int(key[1]), last)[_COLUMNS]

    return run


class Mix:
    """``rows``: (doc_id, source, n_tokens, copies) of the texts used; ``shares``: the report."""

    def __init__(self, rows: DataFrame, shares: DataFrame):
        self.rows, self.shares = rows, shares


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, vocabulary: str = DEFAULT_VOCABULARY, seed: int = 0, fan: int = 64, window: int = 20_000) -> Mix:
    targets = materialize(clean_targets(targets))
    texts = docs.filter("length(text) > 0").select(F.col("doc_id").cast("bigint"), "source", "text")
    texts = join_small(texts, targets.select("source"), ["source"], "left_semi").select("doc_id", "source", F.xxhash64("text").alias("h"), "text")
    sized = materialize(texts.mapInArrow(_count(vocabulary), "doc_id bigint, source string, h bigint, n_tokens bigint"))
    have = materialize(targets.join(sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_texts")), "source"))
    share, n_texts = have.agg(F.round(F.sum("target_share"), 12), F.sum("n_texts")).first()
    if share is None:
        rows = sized.select("doc_id", "source", "n_tokens", F.lit(0).alias("copies")).limit(0)
        return Mix(rows, _report(rows, targets))
    aim = float(have.agg(F.sum("tokens")).first()[0] if total_tokens is None else total_tokens)
    uses = F.least(F.col("max_repeats").cast("double"), F.lit(aim) * F.col("target_share") / F.lit(share) / F.col("tokens"))
    rates = materialize(have.select("source", uses.alias("uses")))
    whole = F.floor(F.col("uses") + _NEAR)
    # rows that agree in all are one row with a number; a large number is parted, so no bucket outgrows `window` much
    same = sized.groupBy("doc_id", "source", "h", "n_tokens").agg(F.count(F.lit(1)).alias("all"))
    same = same.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("all") - 1) / window)))).withColumn("rows", F.least(F.lit(window), F.col("all") - F.col("part") * window))
    buckets = max(1, -(-n_texts // window))
    node = F.pmod(F.xxhash64("doc_id", "h", "part"), F.lit(buckets)).alias("node")
    planned = join_small(same, rates, ["source"], "inner").select("doc_id", "source", "h", "n_tokens", whole.cast("int").alias("base"), F.greatest(F.lit(0.0), F.col("uses") - whole).alias("p"), node, "rows")
    # written once: residuals and the rest must come from the same draws
    done = materialize(planned.groupBy("node").applyInPandas(_first(seed), _ROWS))
    closed = [done.filter("NOT open")]
    level, left = 0, materialize(done.filter("open"))
    while True:
        nodes = left.agg(F.max("node")).first()[0]
        if nodes is None:
            break
        level += 1
        last = nodes < fan
        parent = left.withColumn("up", F.floor(F.col("node") / fan))
        after = materialize(parent.groupBy("source", "up").applyInPandas(_higher(seed, level, last), _ROWS))
        closed.append(after.filter("NOT open"))
        left = materialize(after.filter("open"))
    rows = closed[0]
    for c in closed[1:]:
        rows = rows.unionByName(c)
    rows = rows.select("doc_id", "source", "n_tokens", (F.col("base") + F.round("p").cast("int")).alias("copies")).filter("copies > 0")
    return Mix(rows, _report(rows, targets))


def _report(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: tokens taken, share reached, texts used, most uses of one text."""
    per = rows.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("n_used"), F.max("copies").alias("most_copies"))
    total = rows.agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("all_tokens"))
    out = targets.join(per, "source", "left").join(F.broadcast(total))  # one row
    tokens = F.coalesce("tokens", F.lit(0))
    return out.select("source", "target_share", "max_repeats", tokens.alias("tokens"), F.coalesce(tokens / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"), F.coalesce("n_used", F.lit(0)).alias("n_used"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))
