"""Problem 3: the k most similar vectors of every vector, by cosine.

Equal vectors form a class and one of each is indexed. The indexed vectors are split by a hash of
their id into shards of bounded size; each shard becomes a navigable small-world graph
(``hnsw``), written as a table of flat neighbour arrays in the shared folder. Query tasks take a
block of vectors, search every shard one after the other and merge the shard results as they go, so
nothing is shuffled but the vectors on their way into the shards. Members of a class get the list
of their class. All vectors are indexed and all are queries; shards bound memory, not results.

``min_similarity`` leaves out weaker neighbours; as these rank last, no stronger one is lost. Searching every
shard for every vector is quadratic in the number of shards. From ``cells_from`` on the lists are therefore
made without graphs: a strong floor tells in which cells of the space a neighbour can be, and only these are
compared, all with all (``cells``). Below that neighbours may be anywhere, and all shards are searched.

Defined results: vectors that are null, of another length, all zero or that hold a null, NaN or
infinite element are left out, as are rows with a null id; ties go to the smaller id; among more
than k equal vectors each has the k smallest other ids; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.physical import materialize, shared_dir, skew_join
from . import hnsw
from .cells import alike


@dataclass(frozen=True)
class Graphs:
    """``shard_rows``: most vectors of a shard; ``least_shards`` spreads smaller tables (of at least
    ``small`` rows a shard); ``m``: neighbours a node chooses; ``ef_build``, ``ef``: beam widths, all three
    for shards of up to ``base_rows``. They grow by ``wider`` with each doubling beyond that, as a larger
    graph loses recall at the same widths."""

    shard_rows: int = 100_000
    least_shards: int = 8
    small: int = 1000
    m: int = 12
    ef_build: int = 48
    ef: int = 28
    base_rows: int = 10_000
    wider: tuple[int, int, int] = (4, 16, 12)

    def shards(self, n: int) -> int:
        return max(1, -(-n // self.shard_rows), min(self.least_shards, n // self.small))

    def fitted(self, n: int) -> Graphs:
        """The widths for ``n`` vectors."""
        k = max(0, math.ceil(math.log2(max(1, n) / self.shards(n) / self.base_rows)))
        m, ef_build, ef = self.wider
        return replace(self, m=self.m + k * m, ef_build=self.ef_build + k * ef_build, ef=self.ef + k * ef)


def usable(vector: Column, dim: int) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) == dim) & ~bad & F.exists(vector, lambda x: x != 0)


def _matrix(column, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


_INDEX = "shard int, pos int, id string, others array<string>, vector array<float>, near array<int>, upper array<int>"
_ARROW = pa.schema([("shard", pa.int32()), ("pos", pa.int32()), ("id", pa.string()), ("others", pa.list_(pa.string())), ("vector", pa.list_(pa.float32())), ("near", pa.list_(pa.int32())), ("upper", pa.list_(pa.int32()))])


def _rows(a: np.ndarray, kind) -> pa.ListArray:
    n, d = a.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, d, dtype=np.int32)), pa.array(a.reshape(-1), kind))


def _build(dim: int, conf: Graphs):
    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        whole = pa.Table.from_batches(batches)
        shard_of = whole["shard"].to_numpy()
        for shard in np.unique(shard_of):
            t = whole.filter(pa.array(shard_of == shard))
            t = t.take(pa.array(np.argsort(t["draw"].to_numpy(), kind="stable")))  # random, but the same at each run
            v = _matrix(t["vector"], dim).astype(np.float64)
            v /= np.linalg.norm(v, axis=1, keepdims=True)
            v = np.ascontiguousarray(v, dtype=np.float32)
            levels = hnsw.levels(hnsw.build(v, conf.m, conf.ef_build))
            n = len(v)
            upper = [[] for _ in range(n)]
            for level in levels[1:]:
                for p in range(len(level)):
                    upper[p].extend(level[p].tolist())
            for a in range(0, n, 8192):
                b = min(n, a + 8192)
                cols = [pa.array(np.full(b - a, shard, np.int32)), pa.array(np.arange(a, b, dtype=np.int32)), t["id"].slice(a, b - a).combine_chunks(), t["others"].slice(a, b - a).combine_chunks().cast(pa.list_(pa.string()))]
                cols += [_rows(v[a:b], pa.float32()), _rows(levels[0][a:b], pa.int32()), pa.array(upper[a:b], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, schema=_ARROW)

    return run


class Index:
    """The written graphs: ``path`` of the table, ``sizes`` of the shards, one entry for each."""

    def __init__(self, path: str, sizes: dict[int, int], dim: int, conf: Graphs):
        self.path, self.sizes, self.dim, self.conf = path, sizes, dim, conf

    def _read(self, shard: int, columns: list[str]) -> pa.Table:
        system, at = pafs.FileSystem.from_uri(self.path)
        files = [f.path for f in system.get_file_info(pafs.FileSelector(f"{at}/shard={shard}")) if f.path.endswith(".parquet")]
        t = pa.concat_tables([pq.ParquetFile(system.open_input_file(f)).read(columns) for f in sorted(files)])
        pos = t["pos"].to_numpy()
        return t if (np.diff(pos) > 0).all() else t.take(pa.array(np.argsort(pos)))

    def graph(self, shard: int) -> hnsw.Graph:
        t = self._read(shard, ["pos", "vector", "near", "upper"])
        vectors, near, width = _matrix(t["vector"], self.dim), _matrix(t["near"], 2 * self.conf.m), 2 * self.conf.m
        flat = t["upper"].combine_chunks()
        sizes = flat.value_lengths().to_numpy() // width
        levels, values, start = [near], flat.flatten().to_numpy(), flat.offsets.to_numpy()[:-1] - flat.offsets.to_numpy()[0]
        for k in range(int(sizes.max(initial=0))):
            n = int((sizes > k).sum())
            levels.append(values[(start[:n] + k * width)[:, None] + np.arange(width)])
        return hnsw.assemble(vectors, levels)

    def names(self, shard: int) -> tuple[list[str], list]:
        t = self._read(shard, ["pos", "id", "others"])
        return t["id"].to_pylist(), t["others"].to_pylist()


def build_index(rows: DataFrame, n: int, dim: int, conf: Graphs) -> Index:
    """Graphs over (id, others, vector) of ``rows``, about ``n``."""
    conf, shards = conf.fitted(n), conf.shards(n)
    path = shared_dir(rows.sparkSession)
    placed = rows.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.xxhash64("id", F.lit(1)).alias("draw"), "id", "others", "vector")
    placed.repartitionById(shards, F.col("shard")).mapInArrow(_build(dim, conf), _INDEX).write.partitionBy("shard").parquet(path)
    written = rows.sparkSession.read.parquet(path) if n else None
    sizes = {r[0]: r[1] for r in written.groupBy("shard").count().collect()} if n else {}  # one row a shard
    return Index(path, sizes, dim, conf)


_FOUND = "id string, others array<string>, found array<struct<id:string,similarity:double>>"


def _search(index: Index, blocks: list[tuple[int, int, int]], k: int, floor: float):
    def one(shard: int, a: int, b: int) -> pd.DataFrame:
        conf = index.conf
        q = np.ascontiguousarray(index.graph(shard).vectors[a:b])
        n = len(q)
        sims = np.full((n, k), -2.0, np.float32)
        place = np.full((n, k, 2), -1, np.int32)
        rows = np.arange(n)
        for other in index.sizes:
            pos, s = hnsw.search(index.graph(other), q, k + 1, conf.ef)
            if other == shard:
                s = np.where(pos == rows[:, None] + a, -2.0, s)
            s = np.where((pos < 0) | (s < floor), -2.0, s).astype(np.float32)
            both = np.concatenate([sims, s], 1)
            where = np.concatenate([place, np.stack([np.full_like(pos, other), pos], 2)], 1)
            best = np.argsort(-both, axis=1, kind="stable")[:, :k]
            sims, place = np.take_along_axis(both, best, 1), np.take_along_axis(where, best[:, :, None], 1)
        good = sims > -2
        ids = np.empty((n, k), object)
        more: dict[tuple[int, int], list[str]] = {}
        own_ids, own_others = [], []
        for other in index.sizes:
            mask = good & (place[:, :, 0] == other)
            if not mask.any() and other != shard:
                continue
            names, others = index.names(other)
            if other == shard:
                own_ids, own_others = names[a:b], others[a:b]
            for i, j in zip(*np.nonzero(mask)):
                p = place[i, j, 1]
                ids[i, j] = names[p]
                if others[p]:
                    more[i, j] = others[p]
        found = []
        for i in range(n):
            one_list = [(ids[i, j], float(sims[i, j])) for j in range(k) if good[i, j]]
            for j in range(k):
                one_list += [(x, float(sims[i, j])) for x in more.get((i, j), ())]
            one_list.sort(key=lambda x: (-x[1], x[0]))
            found.append([{"id": x, "similarity": min(1.0, s)} for x, s in one_list[: k + 1]])
        return pd.DataFrame({"id": own_ids, "others": own_others, "found": found})

    def run(frames):
        for f in frames:
            for i in f["id"]:
                yield one(*blocks[i])

    return run


def _with_classes(lists: DataFrame, others: DataFrame | None, k: int) -> DataFrame:
    """(id, others, found) as ``_search`` gives them, from (id, found) and (first, others) of the classes."""
    if others is None:
        return lists.select("id", F.lit(None).cast("array<string>").alias("others"), "found")
    lists, others = materialize(lists), materialize(others)
    hits = lists.select("id", F.explode("found").alias("hit")).select("id", F.col("hit.id").alias("first"), F.col("hit.similarity").alias("similarity"))
    more = hits.join(others, "first").select("id", F.explode("others").alias("other"), "similarity")
    every = hits.withColumnRenamed("first", "other").unionByName(more)
    best = F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), F.col("other").alias("id"))))
    full = every.groupBy("id").agg(F.slice(best, 1, k + 1).alias("found")).select("id", F.transform("found", lambda x: F.struct(x["id"].alias("id"), (-x["s"]).alias("similarity"))).alias("found"))
    return full.join(others.withColumnRenamed("first", "id"), "id", "full_outer").select("id", "others", F.coalesce("found", F.array().cast("array<struct<id:string,similarity:double>>")).alias("found"))


def similar(df: DataFrame, row_id: str, vector: str, dim: int, k: int = 10, min_similarity: float = -1.0, conf: Graphs = Graphs(), block: int = 16384, cells_from: float = 0.9) -> DataFrame:
    """(id, rank, other, similarity) of the k most similar other vectors of every usable vector."""
    spark = df.sparkSession
    rows = df.filter(F.col(row_id).isNotNull() & usable(F.col(vector), dim)).select(F.col(row_id).alias("id"), F.col(vector).cast("array<float>").alias("vector"))
    rows = rows.withColumn("class", F.concat(F.hex(F.xxhash64("vector")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "vector"))))
    keys = materialize(rows.select("id", "class"))
    total = keys.count()
    many = materialize(keys.groupBy("class").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("first")).filter("members > 1"))
    equal = many.limit(1).count() > 0
    indexed, n, kept = rows.select("id", F.lit(None).cast("array<string>").alias("others"), "vector"), total, rows
    if equal:
        member = materialize(skew_join(keys, many.select("class", "members", "first"), "class", "members", total).select("id", "class", "first"))
        by = Window.partitionBy("class").orderBy("id")
        listed = member.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= k + 1)
        others = listed.filter("id <> first").groupBy("first").agg(F.array_sort(F.collect_list("id")).alias("others"))
        kept = rows.join(member.filter("id <> first").select("id"), "id", "left_anti")
        indexed = kept.join(others.withColumnRenamed("first", "id"), "id", "left").select("id", "others", "vector")
        n = total - member.filter("id <> first").count()
    if min_similarity >= cells_from:
        found = _with_classes(alike(kept.select("id", "vector"), n, dim, k, min_similarity), others if equal else None, k)
    else:
        index = build_index(indexed, n, dim, conf)
        cores = spark.sparkContext.defaultParallelism
        step = max(1024, min(block, -(-n // (4 * cores))))
        blocks = [(s, a, min(a + step, size)) for s, size in sorted(index.sizes.items()) for a in range(0, size, step)]
        tasks = spark.range(0, len(blocks), 1, max(1, len(blocks)))
        found = tasks.mapInPandas(_search(index, blocks, k, min_similarity), _FOUND)
    own = F.transform(F.col("others"), lambda x: F.struct(x.alias("id"), F.lit(1.0).alias("similarity")))
    full = F.coalesce(F.concat(own, F.col("found")), F.col("found"))
    if not equal:
        lists = found.select("id", full.alias("found"))
    else:
        found = materialize(found.select("id", "others", full.alias("found")))
        rep = F.transform(F.array("first"), lambda x: F.struct(x.alias("id"), F.lit(1.0).alias("similarity")))
        of_class = many.join(found.withColumnRenamed("id", "first"), "first").select("class", "members", F.slice(F.concat(rep, "found"), 1, k + 1).alias("found"))
        extra = member.filter("id <> first").select("id", "class")
        lists = found.select("id", F.slice("found", 1, k + 1).alias("found")).unionByName(skew_join(extra, materialize(of_class), "class", "members", total).select("id", "found"))
    theirs = F.filter("found", lambda x: x["id"] != F.col("id"))
    out = lists.select("id", F.posexplode(F.slice(theirs, 1, k)).alias("rank", "hit"))
    return out.select("id", (F.col("rank") + 1).alias("rank"), F.col("hit.id").alias("other"), F.col("hit.similarity").alias("similarity"))


def chunk_pairs(vectors: DataFrame, k: int = 10, least: float = 0.95) -> DataFrame:
    """(id_a, id_b), id_a < id_b: one is among the k most similar of the other, and similar enough."""
    hits = similar(vectors, "id", "embedding", 64, k, least)
    return hits.filter("id <> other").select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
