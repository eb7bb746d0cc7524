"""A chunk table in Parquet with insert-or-replace by id.

Rows lie in ``buckets`` by a hash of their key. An upsert or delete rewrites only the buckets that it
touches, into new folders; a version is a small manifest that names each bucket's folder. Manifests are
never changed: a new one appears by a rename, after a lock file of its number was created exclusively, so
readers see whole versions, an open reader keeps its files, a failed write leaves the table as it was, and
of two writers the second fails instead of losing rows. ``vacuum`` drops old versions."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class ChunkStore:
    def __init__(self, spark: SparkSession, path: str, key: str = "id", partition_by: str | None = None, buckets: int = 64):
        self.spark, self.path, self.key, self.partition_by, self.buckets = spark, path.rstrip("/"), key, partition_by, buckets

    def _fs(self, name: str):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(conf), p

    def versions(self) -> list[int]:
        fs, p = self._fs("manifests")
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[2:-5]) for n in names if n.startswith("m-") and n.endswith(".json"))

    def _manifest(self, version: int | None = None) -> dict | None:
        versions = self.versions()
        if not versions:
            return None
        name = f"manifests/m-{version or versions[-1]:012d}.json"
        return json.loads(self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0])

    def _put(self, name: str, text: str, exclusive: bool) -> None:
        fs, p = self._fs(name)
        out = fs.create(p, not exclusive)
        out.write(bytearray(text.encode()))
        out.close()

    def _table(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        paths = [f"{self.path}/data/{token}/_bucket={b}" for b, token in sorted(manifest["buckets"].items()) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The current rows, or those of an older version that was kept."""
        manifest = self._manifest(version)
        return self._table(manifest) if manifest else None

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int").alias("_bucket")

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self._bucket()).distinct().collect())  # at most ``buckets``

    def _commit(self, df: DataFrame, touched: list[int], old: dict | None) -> None:
        """Writes the touched buckets anew and then the manifest of the next version."""
        token, version = uuid.uuid4().hex, (self.versions() or [0])[-1] + 1
        if old and old["version"] != version - 1:
            raise RuntimeError(f"{self.path} was changed by another writer")
        by = ["_bucket"] + ([self.partition_by] if self.partition_by else [])
        df.withColumn("_bucket", self._bucket()).repartition(F.col("_bucket")).write.partitionBy(*by).parquet(f"{self.path}/data/{token}")
        places = dict(old["buckets"]) if old else {}
        for b in touched:
            fs, p = self._fs(f"data/{token}/_bucket={b}")
            places.pop(str(b), None)
            if fs.exists(p):
                places[str(b)] = token
        try:
            self._put(f"manifests/lock-{version:012d}", token, exclusive=True)
        except Exception as e:
            raise RuntimeError(f"{self.path} was changed by another writer") from e
        text = json.dumps({"version": version, "schema": json.loads(df.schema.json()), "buckets": places})
        self._put(f"manifests/tmp-{token}", text, exclusive=True)
        fs, made = self._fs(f"manifests/tmp-{token}")
        fs.rename(made, self._fs(f"manifests/m-{version:012d}.json")[1])

    def upsert(self, rows: DataFrame, order: str | None = None) -> None:
        """Insert or replace by key. Keys repeated in ``rows``: the greatest ``order`` wins (or an
        arbitrary but fixed one). Upserting the same rows again changes nothing."""
        rank = F.col(order).desc_nulls_last() if order else F.xxhash64(*rows.columns)
        one = rows.filter(F.col(self.key).isNotNull()).withColumn("_k", F.row_number().over(Window.partitionBy(self.key).orderBy(rank))).filter("_k = 1").drop("_k")
        touched, old = self._touched(rows.filter(F.col(self.key).isNotNull())), self._manifest()
        if touched or old is None:
            self._commit(one if old is None else merge(self._table(old, touched), one, self.key), touched, old)

    def delete(self, keys: DataFrame) -> None:
        old = self._manifest()
        touched = self._touched(keys.filter(F.col(self.key).isNotNull())) if old else []
        if touched:
            kept = self._table(old, touched)
            self._commit(kept.join(keys.select(self.key).distinct(), self.key, "left_anti").select(kept.columns), touched, old)

    def vacuum(self, keep: int = 2) -> None:
        """Drops all but the last ``keep`` versions, and the folders that none of these names."""
        versions = self.versions()
        named = {t for v in versions[-keep:] for t in self._manifest(v)["buckets"].values()}
        for v in versions[:-keep]:
            for name in (f"manifests/m-{v:012d}.json", f"manifests/lock-{v:012d}"):
                fs, p = self._fs(name)
                fs.delete(p, False)
        fs, p = self._fs("data")
        for f in fs.listStatus(p) if fs.exists(p) else []:
            if f.getPath().getName() not in named:
                fs.delete(f.getPath(), True)

    def get(self, keys: DataFrame, columns: list[str] | None = None) -> DataFrame:
        got = self.read().join(keys.select(self.key).distinct(), self.key, "left_semi")
        return got.select(*columns) if columns else got

    def count(self) -> int:
        df = self.read()
        return 0 if df is None else df.count()

    def stale(self, valid: DataFrame) -> DataFrame:
        """Keys that are stored but no longer valid."""
        return self.read().select(self.key).join(valid.select(self.key), self.key, "left_anti")


def merge(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` over ``old`` by key; columns that one side lacks are null."""
    return old.join(new.select(key), key, "left_anti").select(old.columns).unionByName(new, allowMissingColumns=True)
