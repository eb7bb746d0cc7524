"""Helpers that decide physical strategy where Catalyst cannot know the bound.

* ``shared_dir``/``materialize``: cut lineage through a Parquet table in the folder that the
  session names in ``spark.checkpoint.dir`` (a private folder only where it is unset).
* ``skew_join``: equi-join of a big table with a one-row-per-key table. Keys that hold more than
  1/``HOT_PARTS`` of the big side are joined by broadcast (there can be at most ``HOT_PARTS`` of
  them, whatever the data), the rest by shuffle.
* ``join_small``: broadcast only after the row count was found under a limit.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_PARTS = 200
BROADCAST_ROWS = 200_000
_owned: list[tuple[SparkSession, str]] = []
_private: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder on storage that every executor can read: below ``spark.checkpoint.dir``, or
    where that is unset (local tests) below a private folder made once. A cluster must set it: a folder
    of one machine would be read in part or not at all."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _private:
            _private.append("file://" + tempfile.mkdtemp(prefix="loomwork-"))
        base = _private[0]
    path = f"{base.rstrip('/')}/loomwork-{uuid.uuid4().hex}"
    _owned.append((spark, path))
    return path


def _remove_all() -> None:
    while _owned:
        spark, path = _owned.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone; the folder's owner cleans it
            pass


atexit.register(_remove_all)


@contextmanager
def scratch():
    """Drops the tables that are written within it when it is left. Use it around queries of a long session,
    once their results are written or collected."""
    kept = _owned[:]
    _owned.clear()
    try:
        yield
    finally:
        _remove_all()
        _owned.extend(kept)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: each later use scans columns of
    that table instead of running the plan again, and a lost executor loses nothing."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a broadcast if ``small`` was counted to be within ``limit`` rows, else by shuffle.
    ``small`` should be a materialized table, as it is counted here."""
    if small.limit(limit + 1).count() <= limit:
        small = F.broadcast(small)
    return big.join(small, on, how)


def skew_join(big: DataFrame, keyed: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """Join ``big`` with ``keyed``, which has one row per ``key`` and in ``size`` the number of rows
    of ``big`` under that key (of ``total``). No task gets more than total/HOT_PARTS rows of one
    key; at most HOT_PARTS rows are broadcast. Null keys never match (as in SQL)."""
    limit = max(1, total // HOT_PARTS)
    hot = keyed.filter(F.col(size) > limit)
    cool = keyed.filter(F.col(size) <= limit)
    if hot.limit(1).count() == 0:
        return big.join(keyed, key, how)
    at_hot = big.join(F.broadcast(hot), key, "inner")
    rest = big.join(F.broadcast(hot.select(key)), key, "left_anti").join(cool, key, how)
    return at_hot.select(rest.columns).unionByName(rest)
