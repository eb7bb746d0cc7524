"""Vectors at least ``floor`` alike, found without looking at every shard.

A sample of the vectors serves as pivots. Each vector lives in the cell of its most similar pivot and
visits every cell whose pivot is at most ``margin`` less similar; visitors and inhabitants of a cell are
compared all with all. A pair is found if either of the two visits the cell of the other, and both get
it. The margin is measured, not set: pairs exactly as alike as the floor are made from the sample, and
all but ``miss`` of them must be found; pairs more alike are missed more rarely. Samples too small to
tell take the margin that can miss none.

Cells lie in shards of neighbouring pivots. A vector goes to a shard once, with 24 bits an element,
packed with others. Shards expected to hold well over ``shard_rows`` are split into blocks by a hash of the
id, and visitors go to each block, so that a task holds bounded inhabitants and streams its visitors. The
shards are served in as many rounds as keep what is shuffled at once near ``round_share`` times the vectors.
No number of cells, visitors or hits is limited, but the k best of a vector in a task are all that it hands on.

A cell of N vectors costs N * N comparisons. With pivots as the root of the number of vectors, the work
grows with its power 1.5 at most as long as no large part of the vectors is crowded about one place.
"""

from __future__ import annotations

import math
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.physical import materialize


@dataclass(frozen=True)
class Cells:
    """``density`` times the root of the number of vectors is the number of pivots, with ``cell_rows`` in a
    cell at least; ``pairs``: most made pairs for the margin, ``least_pairs``: fewest to trust."""

    density: float = 4.0
    cell_rows: int = 64
    shard_rows: int = 100_000
    least_rows: int = 4000
    miss: float = 0.001
    pairs: int = 8192
    least_pairs: int = 512
    together: int = 16384
    pack: int = 256
    round_share: float = 1.25
    least_round: int = 1_000_000_000

    def pivots(self, n: int) -> int:
        return max(1, min(int(self.density * math.sqrt(n)), n // self.cell_rows))

    def shards(self, n: int, cores: int) -> int:
        return min(self.pivots(n), max(1, -(-n // self.shard_rows), min(4 * cores, n // self.least_rows)))


_STEP = np.float32(2.0**-23)


def unit(v: np.ndarray) -> np.ndarray:
    """Unit vectors in multiples of 2^-23, as they are sent."""
    v = v.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)  # squares of very large or small elements would not be finite, or zero
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return np.clip(np.rint(v * 2.0**23), -(2**23) + 1, 2**23 - 1).astype(np.float32) * _STEP


def _packed(v: np.ndarray) -> np.ndarray:
    n, d = v.shape
    return np.ascontiguousarray((v / _STEP).astype("<i4").view(np.uint8).reshape(n, d, 4)[:, :, :3]).reshape(n, 3 * d)


def _unpacked(raw: np.ndarray, d: int) -> np.ndarray:
    full = np.zeros((len(raw), d, 4), np.uint8)
    full[:, :, 1:] = raw.reshape(-1, d, 3)
    return (full.view("<i4").reshape(-1, d) >> 8).astype(np.float32) * _STEP


@dataclass
class Map:
    """``pivots`` sorted by shard, shard s having ``start[s]:start[s+1]``; its blocks are the tasks from
    ``task[s]`` up to ``task[s+1]``."""

    pivots: np.ndarray
    start: np.ndarray
    task: np.ndarray
    margin: float
    visits: np.ndarray  # expected to each shard

    @property
    def shard(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))


def _true(good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the few that are true: looks at eight at a time."""
    flat = good.reshape(-1)
    words = len(flat) // 8
    at = np.flatnonzero(flat[: 8 * words].view(np.uint64))
    if len(at) * 4 > words:
        at = np.flatnonzero(flat)
    else:
        at = (8 * at[:, None] + np.arange(8)).reshape(-1)
        at = np.r_[at[flat[at]], 8 * words + np.flatnonzero(flat[8 * words :])]
    return np.divmod(at, good.shape[1])


def _best_pivot(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.concatenate([(v[a : a + 512] @ pivots.T).argmax(1) for a in range(0, len(v), 512)]) if len(v) else np.zeros(0, np.int64)


def _margin(v: np.ndarray, pivots: np.ndarray, floor: float, conf: Cells) -> float:
    """Of pairs made of ``v``, which holds no pivots: the least margin that finds all but ``miss``."""
    sure = 2 * math.sqrt(max(0.0, 2 - 2 * floor)) + 1e-5
    x = v[: conf.pairs]
    if len(x) < conf.least_pairs:
        return sure
    away = np.roll(v, 1, 0)[: len(x)] - np.roll(v, 7, 0)[: len(x)]
    away = away - (away * x).sum(1, keepdims=True) * x
    size = np.linalg.norm(away, axis=1)
    x, away = x[size > 1e-3], away[size > 1e-3] / size[size > 1e-3, None]
    if len(x) < conf.least_pairs:
        return sure
    y = (floor * x + math.sqrt(max(0.0, 1 - floor * floor)) * away).astype(np.float32)
    need = []
    for a in range(0, len(x), 512):
        sx, sy = x[a : a + 512] @ pivots.T, y[a : a + 512] @ pivots.T
        r = np.arange(len(sx))
        need.append(np.minimum(sx.max(1) - sx[r, sy.argmax(1)], sy.max(1) - sy[r, sx.argmax(1)]))
    return min(sure, float(np.quantile(np.concatenate(need), 1 - conf.miss, method="higher")) + 1e-5)


def plan(sample: np.ndarray, n: int, floor: float, cores: int, conf: Cells) -> Map:
    """From unit vectors in random order, of ``n`` in all."""
    c = min(conf.pivots(n), len(sample))
    pivots, s = sample[:c], min(conf.shards(n, cores), c)
    weight = np.bincount(_best_pivot(sample, pivots), minlength=c)
    centres = pivots[:s].copy()
    for _ in range(8):
        total = np.zeros_like(centres)
        np.add.at(total, _best_pivot(pivots, centres), pivots * weight[:, None])
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(size > 0, total / np.maximum(size, 1e-9), centres).astype(np.float32)
    of = _best_pivot(pivots, centres)
    rows = np.bincount(of, weights=weight, minlength=s) * (n / len(sample))
    blocks = np.maximum(1, np.ceil(rows / (1.5 * conf.shard_rows))).astype(np.int64)
    start = np.r_[0, np.cumsum(np.bincount(of, minlength=s))]
    m = Map(np.ascontiguousarray(pivots[np.argsort(of, kind="stable")]), start, np.r_[0, np.cumsum(blocks)], _margin(sample[c:], pivots, floor, conf), np.zeros(s))
    some = sample[-4096:]  # the pivots come first
    m.visits = np.bincount(_places(some, m)[3], minlength=s) * (n / len(some)) * blocks
    return m


def rounds(m: Map, n: int, dim: int, conf: Cells) -> list[tuple[int, int]]:
    """Ranges of shards."""
    most = max(conf.least_round, conf.round_share * n * 4 * dim) / (3 * dim + 40)
    of = np.floor((np.cumsum(m.visits) - m.visits / 2) / (m.visits.sum() / max(1, math.ceil(m.visits.sum() / most)) + 1e-9)).astype(np.int64)
    cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True])
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))


_COLUMNS = ("lengths", "ids", "best", "vectors")
_SENT = "task int, visit int, n int, lengths binary, ids binary, best binary, vectors binary"
_SENT_ARROW = pa.schema([("task", pa.int32()), ("visit", pa.int32()), ("n", pa.int32()), *((x, pa.binary()) for x in _COLUMNS)])
_PLACED = "n int, lengths binary, ids binary, best binary, vectors binary, home binary, rows binary, shards binary"
_PLACED_ARROW = pa.schema([("n", pa.int32()), *((x, pa.binary()) for x in (*_COLUMNS, "home", "rows", "shards"))])


def _matrix(column, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _places(v: np.ndarray, m: Map) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(similarity to the best pivot, shard of that); (row, shard) of all shards with a cell to visit."""
    of, shards = m.shard, len(m.start) - 1
    best, home, rows, at = [], [], [], []
    for a in range(0, len(v), 256):
        sims = v[a : a + 256] @ m.pivots.T
        first = sims.argmax(1)
        top = sims[np.arange(len(sims)), first]
        r, c = _true(sims >= (top - np.float32(m.margin + 1e-6))[:, None])
        seen = np.zeros((len(sims), shards), bool)
        seen[r, of[c]] = True
        r, s = np.nonzero(seen)
        best.append(top)
        home.append(of[first])
        rows.append(r + a)
        at.append(s)
    return tuple(map(np.concatenate, (best, home, rows, at)))


def _batches(rows, schema: pa.Schema, most: int):
    for a in range(0, len(rows), most):
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows[a : a + most]), schema)], schema=schema)


def _names(ids: pa.Array) -> tuple[bytes, bytes]:
    ids = ids.cast(pa.binary())
    return pc.binary_length(ids).to_numpy(zero_copy_only=False).astype("<i4").tobytes(), b"".join(ids.to_pylist())


def _place(m: Map, dim: int, conf: Cells):
    """Packs of vectors with the task of each and the shards that it visits."""
    blocks = np.diff(m.task)

    def packs(t: pa.Table):
        v, ids, draw = unit(_matrix(t["vector"], dim)), t["id"].combine_chunks(), t["draw"].to_numpy()
        best, home, rows, at = _places(v, m)
        mine, raw, ends = m.task[home] + draw % blocks[home], _packed(v), np.searchsorted(rows, np.arange(0, len(v) + conf.pack, conf.pack))
        for i, a in enumerate(range(0, len(v), conf.pack)):
            z, y = slice(a, a + conf.pack), slice(ends[i], ends[i + 1])
            yield len(v[z]), *_names(ids[z]), best[z].astype("<f4").tobytes(), raw[z].tobytes(), mine[z].astype("<i4").tobytes(), (rows[y] - a).astype("<i4").tobytes(), at[y].astype("<i4").tobytes()

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, conf.together):
                yield from _batches(list(packs(pa.Table.from_batches([b.slice(a, conf.together)]))), _PLACED_ARROW, 64)

    return run


def _send(m: Map, dim: int, first: int, last: int, conf: Cells):
    """Packs for the tasks of the shards from ``first`` up to ``last``."""
    blocks = np.diff(m.task)

    def packs(held):
        ids, best, raw = _read(held, dim)
        n = np.array([r["n"] for r in held])
        mine = np.frombuffer(b"".join(r["home"] for r in held), "<i4")
        rows, at = (np.frombuffer(b"".join(r[x] for r in held), "<i4") for x in ("rows", "shards"))
        rows = rows + np.repeat(np.cumsum(n) - n, [len(r["rows"]) // 4 for r in held])
        now = (at >= first) & (at < last)
        rows, at = rows[now], at[now]
        # each visit goes to all blocks of the shard; what lives there is its own visitor
        times = blocks[at]
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        rows, task = np.repeat(rows, times), np.repeat(m.task[at], times) + nth
        visit = task != mine[rows]
        here = np.flatnonzero((mine >= m.task[first]) & (mine < m.task[last]))
        rows, key = np.r_[rows[visit], here], np.r_[2 * task[visit] + 1, 2 * mine[here]]
        order = np.argsort(key, kind="stable")
        rows, key = rows[order], key[order]
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if len(key) else np.zeros(1, np.int64)
        for a, b in zip(cuts[:-1], cuts[1:]):
            r = rows[a:b]
            yield key[a] // 2 - m.task[first], key[a] % 2, b - a, *_names(ids.take(pa.array(r))), best[r].tobytes(), raw[r].tobytes()

    def run(batches):
        for held in _gathered(batches, lambda r: 0, conf.together):
            yield from _batches(list(packs(held)), _SENT_ARROW, 64)

    return run


def _gathered(batches, key, together: int, whole=lambda key: False):
    """Rows of one key that come one after the other, of about ``together`` vectors; of ``whole`` keys all at once."""
    held, n, of = [], 0, None
    for b in batches:
        for i in range(b.num_rows):
            r = {x: b.column(j)[i].as_py() for j, x in enumerate(b.schema.names)}
            now = key(r)
            if held and (now != of or n >= together and not whole(of)):
                yield held
                held, n = [], 0
            of = now
            held.append(r)
            n += r["n"]
    if held:
        yield held


def _top(of: np.ndarray, sims: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each group, ties by ``order``."""
    i = np.lexsort((order, -sims, of))
    start = np.flatnonzero(np.r_[True, of[i][1:] != of[i][:-1]]) if len(i) else np.zeros(0, np.int64)
    return i[np.arange(len(i)) - np.repeat(start, np.diff(np.r_[start, len(i)])) < k]


def _ranks(ids: pa.Array) -> np.ndarray:
    ranks = np.empty(len(ids), np.int64)
    ranks[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    return ranks


_HITS_ARROW = pa.schema([("id", pa.string()), ("other", pa.string()), ("similarity", pa.float64())])
_MANY = 1_000_000


class _Block:
    """What lives in one block, and the best visitors of each so far."""

    def __init__(self, ids: pa.Array, v: np.ndarray, pivots: np.ndarray, margin: float, k: int, floor: float):
        self.pivots, self.margin, self.k, self.floor = pivots, margin, k, floor
        cell = _best_pivot(v, pivots)
        self.order = np.argsort(cell, kind="stable")
        self.ids, self.v = ids.take(pa.array(self.order)), v[self.order]
        self.ends = np.r_[0, np.cumsum(np.bincount(cell, minlength=len(pivots)))]
        self.ranks = _ranks(self.ids)
        self.kept = (np.zeros(0, np.int64), np.zeros(0), pa.array([], pa.string()))

    def _near(self, x: np.ndarray, y: np.ndarray, skip: np.ndarray | None, at: int) -> tuple[np.ndarray, np.ndarray]:
        sims = x @ y.T
        if skip is not None:  # a vector is not its own neighbour
            c = skip - at
            r = np.flatnonzero((c >= 0) & (c < len(y)))
            sims[r, c[r]] = -2
        good = sims >= np.float32(self.floor - 2e-6)
        n, k = np.count_nonzero(good), self.k
        if n > 4 * k * (len(x) + len(y)):  # crowded: leave only what can be among the k best of either
            slack, by_x, by_y = np.float32(2e-6), np.full((len(x), 1), -2, np.float32), np.full((1, len(y)), -2, np.float32)
            if len(y) > k:
                by_x = np.partition(sims, len(y) - k, axis=1)[:, [len(y) - k]]
            if len(x) > k:
                by_y = np.partition(sims, len(x) - k, axis=0)[[len(x) - k]]
            good &= (sims >= by_x - slack) | (sims >= by_y - slack)
        return _true(good)

    def meet(self, ids: pa.Array, x: np.ndarray, best: np.ndarray, own: np.ndarray | None = None):
        """Compares visitors, ``own`` being their places if they live here; yields the hits of the visitors."""
        cell, row = np.nonzero((x @ self.pivots.T >= (best - np.float32(self.margin + 1e-6))[:, None]).T)
        ends = np.searchsorted(cell, np.arange(len(self.pivots) + 1))
        ranks, held, n = _ranks(ids), [], 0

        def tidy():
            a, b, s = (np.concatenate(z) for z in zip(*held))
            i = _top(a, s, self.ranks[b], self.k)
            j = _top(b, s, ranks[a], self.k)
            self._keep(b[j], s[j], ids.take(pa.array(a[j])))
            return a[i], b[i], s[i]

        for c in np.flatnonzero((np.diff(ends) > 0) & (np.diff(self.ends) > 0)):
            for p in range(ends[c], ends[c + 1], 512):
                r = row[p : min(p + 512, ends[c + 1])]
                for q in range(self.ends[c], self.ends[c + 1], 2048):
                    y = self.v[q : min(q + 2048, self.ends[c + 1])]
                    i, j = self._near(x[r], y, None if own is None else own[r], q)
                    if not len(i):
                        continue
                    a, b = r[i], q + j
                    s = np.concatenate([self._exact(x[a[z : z + 65536]], self.v[b[z : z + 65536]]) for z in range(0, len(a), 65536)])
                    ok = s >= self.floor
                    held.append((a[ok], b[ok], s[ok]))
                    n += len(i)
                    if n > _MANY:
                        held = [tidy()]
                        n = 0
        if held:
            a, b, s = tidy()
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), self.ids.take(pa.array(b)), pa.array(s)], schema=_HITS_ARROW)

    @staticmethod
    def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        x, y = x.astype(np.float64), y.astype(np.float64)
        sims = np.einsum("nd,nd->n", x, y) / np.sqrt(np.einsum("nd,nd->n", x, x) * np.einsum("nd,nd->n", y, y))
        return np.minimum(1.0, np.round(sims, 12))  # the same from either side

    def _keep(self, at: np.ndarray, sims: np.ndarray, others: pa.Array) -> None:
        at, sims, others = np.r_[self.kept[0], at], np.r_[self.kept[1], sims], pa.concat_arrays([self.kept[2], others])
        order = _ranks(others)
        i = _top(at, sims, order, self.k)
        self.kept = at[i], sims[i], others.take(pa.array(i))

    def rest(self):
        at, sims, others = self.kept
        for a in range(0, len(at), 65536):
            yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(at[a : a + 65536])), others.slice(a, 65536), pa.array(sims[a : a + 65536])], schema=_HITS_ARROW)


def _read(rows: list[dict], dim: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Ids, similarities to the best pivot, packed vectors."""
    lengths = np.frombuffer(b"".join(r["lengths"] for r in rows), "<i4")
    offsets = np.r_[0, np.cumsum(lengths, dtype=np.int64)].astype(np.int32)
    ids = pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(b"".join(r["ids"] for r in rows)))
    best = np.frombuffer(b"".join(r["best"] for r in rows), "<f4")
    return ids, best, np.frombuffer(b"".join(r["vectors"] for r in rows), np.uint8).reshape(-1, 3 * dim)


def _compare(m: Map, dim: int, first: int, k: int, floor: float, conf: Cells):
    """``first``: shard of the first task."""

    def run(batches):
        block, at = None, None
        for rows in _gathered(batches, lambda r: (r["task"], r["visit"]), conf.together, lambda key: not key[1]):
            if rows[0]["task"] != at:
                if block is not None:
                    yield from block.rest()
                block, at = None, rows[0]["task"]
            ids, best, raw = _read(rows, dim)
            v = _unpacked(raw, dim)
            if not rows[0]["visit"]:
                del raw, rows
                s = int(np.searchsorted(m.task, m.task[first] + at, side="right")) - 1
                block = _Block(ids, v, m.pivots[m.start[s] : m.start[s + 1]], m.margin, k, floor)
                own = np.empty(len(v), np.int64)
                own[block.order] = np.arange(len(v))
                for a in range(0, len(v), conf.together):
                    z = slice(a, a + conf.together)
                    yield from block.meet(ids[z], v[z], best[z], own[z])
            elif block is not None:  # else nothing lives there
                yield from block.meet(ids, v, best)
        if block is not None:
            yield from block.rest()

    return run


@contextmanager
def _lean(spark):
    """For queries that end in a table: shuffle files go when the query ends, and the packs, which are large rows,
    come to Python a few MB at a time."""
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
    before = {x: spark.conf.get(x, None) for x in wanted}
    try:
        for x, value in wanted.items():
            spark.conf.set(x, value)
        yield
    finally:
        for x, value in before.items():
            if value is None:
                spark.conf.unset(x)
            else:
                spark.conf.set(x, value)


def alike(rows: DataFrame, n: int, dim: int, k: int, floor: float, conf: Cells = Cells()) -> DataFrame:
    """(id, found): the k best others of ``rows`` (id, vector), best first, at least ``floor`` alike; only ids that
    have any. ``n`` is the number of rows."""
    spark = rows.sparkSession
    rows = rows.select("id", "vector", F.xxhash64("id", F.lit(1)).alias("draw"))
    want, parts = conf.pivots(n) + conf.pairs, 1 << 40
    drawn = rows.filter(F.pmod("draw", F.lit(parts)) < int(parts * min(1.0, want / max(1, n)))).toArrow()  # about ``want`` rows
    drawn = drawn.take(pc.sort_indices(drawn, [("draw", "ascending"), ("id", "ascending")]))
    m = plan(unit(_matrix(drawn["vector"], dim)), n, floor, spark.sparkContext.defaultParallelism, conf) if len(drawn) else None
    if m is None:  # nothing, or so little that none was drawn
        return spark.createDataFrame([], "id string, found array<struct<id:string,similarity:double>>")
    hits = None
    with _lean(spark):
        placed = materialize(rows.withColumn("draw", F.abs(F.col("draw") % 1_000_003)).mapInArrow(_place(m, dim, conf), _PLACED))
        for first, last in rounds(m, n, dim, conf):
            sent = placed.mapInArrow(_send(m, dim, first, last, conf), _SENT)
            together = sent.repartitionById(int(m.task[last] - m.task[first]), F.col("task")).sortWithinPartitions("task", "visit")
            got = materialize(together.mapInArrow(_compare(m, dim, first, k, floor, conf), "id string, other string, similarity double"))
            hits = got if hits is None else hits.unionByName(got)
    best = F.array_sort(F.collect_set(F.struct((-F.col("similarity")).alias("s"), F.col("other").alias("id"))))
    lists = hits.groupBy("id").agg(F.slice(best, 1, k).alias("found"))
    return lists.select("id", F.transform("found", lambda x: F.struct(x["id"].alias("id"), (-x["s"]).alias("similarity"))).alias("found"))
