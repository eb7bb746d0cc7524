import io
import wave

from pyspark.sql import functions as F

from loomwork.operators import audio, corpus, quality
from loomwork.plans.physical import join_small, materialize, scratch, skew_join
from loomwork.sources import readers
from loomwork.sources.store import ChunkStore
from loomwork.streaming.ingest import failure_rates, upsert_stream


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upsert_twice_is_once(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/c")
    first = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "id string, n int")
    store.upsert(first, order="n")
    once = rows(store.read())
    store.upsert(first, order="n")
    assert rows(store.read()) == once == [("a", 1), ("b", 3)]
    store.upsert(spark.createDataFrame([("b", 9, "x")], "id string, n int, extra string"))
    assert rows(store.read()) == [("a", 1, None), ("b", 9, "x")]
    assert rows(store.stale(spark.createDataFrame([("a",)], "id string"))) == [("b",)]
    store.delete(spark.createDataFrame([("b",)], "id string"))
    assert store.count() == 1


def test_scratch_tables_go(spark):
    import os

    kept = materialize(spark.range(3))
    with scratch():
        table = materialize(spark.range(5))
        path = table.inputFiles()[0].removeprefix("file://")
        assert table.count() == 5 and os.path.exists(path)
    assert not os.path.exists(path) and kept.count() == 3


def test_open_readers_keep_their_version(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/r", buckets=8)
    store.upsert(spark.createDataFrame([(f"k{i}", 0) for i in range(40)], "id string, n int"))
    before, places = store.read(), store._manifest()["buckets"]
    store.upsert(spark.createDataFrame([("k1", 1)], "id string, n int"))
    assert before.agg(F.sum("n")).first()[0] == 0 and store.read().agg(F.sum("n")).first()[0] == 1
    after = store._manifest()["buckets"]
    assert sum(places[b] != after[b] for b in places) == 1  # one bucket was written anew
    assert store.get(spark.createDataFrame([("k1",), ("none",)], "id string")).collect()[0].n == 1
    old = store._manifest()
    store.upsert(spark.createDataFrame([("k2", 1)], "id string, n int"))
    try:  # a writer that started from an older version loses nothing silently
        store._commit(spark.createDataFrame([("k3", 1)], "id string, n int"), [0], old)
        raise AssertionError("the second writer must fail")
    except RuntimeError:
        pass
    store.vacuum(keep=1)
    assert store.versions() == [3] and rows(store.read())[:2] == [("k0", 0), ("k1", 1)] and store.count() == 40
    store.delete(store.read().select("id"))
    assert store.count() == 0


def test_stream_upserts(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/s")
    spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id string, n int").parquet(f"{tmp_path}/in")
    q = upsert_stream(stream, store, f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(store.read()) == [("a", 1), ("b", 2)]


def test_failure_rates(spark):
    df = spark.sql("SELECT timestamp'2025-01-01 00:00:00' + make_interval(0,0,0,0,0,id) AS ts, id % 2 = 0 AS failed FROM range(10)")
    assert failure_rates(df, "ts", "failed").select("attempts", "failure_rate", "stop").distinct().count() >= 1


def test_readers(spark, tmp_path):
    (tmp_path / "s.xml").write_text('<urlset xmlns="http://x"><url><loc> https://a/ </loc></url><url><loc>https://b/</loc></url></urlset>')
    assert rows(readers.sitemap(spark, f"{tmp_path}/s.xml", "pages").select("url")) == [("https://a/",), ("https://b/",)]
    (tmp_path / "m.json").write_text('[{"url": "u", "slug": "s", "word_count": 3}]')
    assert readers.manifest(spark, f"{tmp_path}/m.json").first().doc_type == "html"
    (tmp_path / "log.txt").write_text("u\tc\told\nbroken\nu\tc\tnew\n")
    assert rows(readers.tab_log(spark, f"{tmp_path}/log.txt")) == [("u", "new")]
    (tmp_path / "c" / "pages").mkdir(parents=True)
    (tmp_path / "c" / "pages" / "x.txt").write_text("hello\nyou")
    assert rows(readers.corpus_files(spark, f"{tmp_path}/c")) == [("pages", "x", "hello\nyou")]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.pdf").write_bytes(b"%PDF-1.4")
    assert readers.documents(spark, f"{tmp_path}/d").first().is_pdf


def test_skew_join_is_a_join(spark):
    big = spark.range(1000).select(F.when(F.col("id") < 400, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    keyed = materialize(big.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("w", F.col("k") * 2))
    assert rows(skew_join(big, keyed, "k", "n", 1000).select("v", "w")) == rows(big.join(keyed, "k").select("v", "w"))
    assert join_small(big, keyed, ["k"], "inner", limit=1).count() == 1000


def test_audio(spark):
    b = io.BytesIO()
    with wave.open(b, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(48000)
        w.writeframes(b"\x00\x40\x00\x00" * 6)
    df = spark.createDataFrame([(b.getvalue(),), (b"junk",), (None,)], "c binary").select(audio.read_wav("c").alias("s"))
    got = df.select("s.rate", F.size(audio.resampled(F.col("s.samples"), 48000)).alias("n"), audio.peak(F.col("s.samples")).alias("p")).collect()
    assert (got[0].rate, got[0].n, got[0].p) == (48000, 2, 0.25) and got[1].rate is None


def test_stop_rules(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate([403, 403, 200, 403, 404, 403, 403, 200, 429])], "s int, i int, status int")
    got = [r.stop for r in quality.refusal_runs(df, "s", "i", "status").orderBy("i").collect()]
    assert got == [False, False, False, False, False, False, True, False, True]


def test_reach_and_rules(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("b", "a"), (None, "x")], "src string, dst string")
    assert rows(corpus.reachable(e, spark.createDataFrame([("a",)], "url string"), 2)) == [("a", 0), ("b", 1), ("c", 2)]
    rules = spark.createDataFrame([("/a", False), ("/a/b", True)], "prefix string, allow boolean")
    urls = spark.createDataFrame([("http://x/a/c",), ("http://x/a/b/1",), ("http://x",)], "url string")
    assert [r.allowed for r in corpus.allowed(urls, rules).collect()] == [False, True, True]
