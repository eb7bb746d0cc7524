"""Problem 7: texts into contexts of a fixed number of tokens.

Method: each text's hashed word vector is projected to few dimensions and placed on a Hilbert curve;
a range partition by the curve key gives every task a stretch of the curve, and the task packs
neighbouring texts. Within a stretch texts go window by window, larger ones first, each into the
open context that it fills best. A text is cut only if it is larger than a context: then all its
pieces but the last fill a context each.

Texts with equal keys (copies) are told apart by ``doc_id`` in the range partition, so a group of
copies may cover many tasks. Each task leaves at most its last contexts unfilled.

Defined results: null and empty texts have no tokens and are left out; rows with null or repeated
ids are placed like others; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.physical import materialize
from .tokens import DEFAULT_VOCABULARY, Counter


@dataclass(frozen=True)
class Packing:
    """``stretch``: texts a task packs; ``window``: neighbours that may be exchanged to fill a
    context; ``dims`` * ``bits`` is the length of the curve key and at most 62."""

    capacity: int = 2048
    vocabulary: str = DEFAULT_VOCABULARY
    dims: int = 4
    bits: int = 12
    stretch: int = 25_000
    window: int = 4096


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer points (n, d), each coordinate below 2^bits
    (Skilling's transpose form: undo the excess work of the axes, Gray encode, interleave)."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where(x[d - 1] & q, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _measure(conf: Packing):
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("curve", pa.int64())])

    def run(batches):
        counter = Counter(conf.vocabulary, conf.dims)
        for b in batches:
            sizes, places = counter.measure(b.column(1))
            cells = np.clip(((places + 1) * (1 << (conf.bits - 1))).astype(np.int64), 0, (1 << conf.bits) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), pa.array(hilbert(cells, conf.bits))], schema=schema)

    return run


def measured(docs: DataFrame, conf: Packing = Packing()) -> DataFrame:
    """(doc_id, n_tokens, curve) of every text."""
    there = docs.filter(F.length("text") > 0).select(F.col("doc_id").cast("bigint"), "text")
    return there.mapInArrow(_measure(conf), "doc_id bigint, n_tokens bigint, curve bigint")


_PLACED = "doc_id bigint, token_start bigint, n_tokens bigint, context_id bigint, slot int"


class _Open:
    """Open contexts, sorted by free space."""

    def __init__(self, first: int, capacity: int):
        self.free: list[tuple[int, int]] = []
        self.next, self.capacity, self.used = first, capacity, {}

    def put(self, size: int) -> tuple[int, int]:
        k = bisect_left(self.free, (size, -1))
        if k < len(self.free):
            room, context = self.free.pop(k)
        else:
            room, context = self.capacity, self.next
            self.next += 1
        slot = self.used.get(context, 0)
        if room > size:
            insort(self.free, (room - size, context))
            self.used[context] = slot + 1
        else:
            self.used.pop(context, None)
        return context, slot


def _pack(conf: Packing):
    def run(frames):
        first = TaskContext.get().partitionId() << 36
        bins = _Open(first, conf.capacity)
        held: list[tuple[int, int, int]] = []

        def place():
            held.sort(key=lambda x: -x[2])
            rows = [(d, a, n, *bins.put(n)) for d, a, n in held]
            held.clear()
            return pd.DataFrame(rows, columns=["doc_id", "token_start", "n_tokens", "context_id", "slot"]).astype({"doc_id": "Int64"})

        for f in frames:
            for doc, size in zip(f["doc_id"], f["n_tokens"]):
                doc = None if pd.isna(doc) else int(doc)
                held.extend((doc, a, min(conf.capacity, size - a)) for a in range(0, size, conf.capacity))
                if len(held) >= conf.window:
                    yield place()
        if held:
            yield place()

    return run


def pack(docs: DataFrame, conf: Packing = Packing()) -> DataFrame:
    """(doc_id, token_start, n_tokens, context_id, slot): where each text, or each piece of one that
    is larger than a context, goes."""
    sized = materialize(measured(docs, conf))
    tasks = max(1, -(-sized.count() // conf.stretch))
    along = sized.repartitionByRange(tasks, "curve", "doc_id").sortWithinPartitions("curve", "doc_id")
    return along.select("doc_id", "n_tokens").mapInPandas(_pack(conf), _PLACED)


def report(placed: DataFrame, capacity: int = Packing.capacity) -> DataFrame:
    """One row: contexts, tokens, least number of contexts that could do, share of room left over."""
    per = placed.groupBy("context_id").agg(F.sum("n_tokens").alias("used"))
    total = per.agg(F.count(F.lit(1)).alias("n_contexts"), F.coalesce(F.sum("used"), F.lit(0)).alias("n_tokens"), F.max("used").alias("fullest"))
    least = F.ceil(F.col("n_tokens") / capacity)
    return total.select("n_contexts", "n_tokens", "fullest", least.alias("least_contexts"), (1 - F.col("n_tokens") / (F.col("n_contexts") * capacity)).alias("room_left"))
