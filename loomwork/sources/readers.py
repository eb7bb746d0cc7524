"""Readers: sitemaps, manifests, corpus files, tab-separated logs, documents, storage metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "url string, title string, slug string, category string, scraped_at string, word_count int, doc_type string"


def sitemap(spark: SparkSession, path: str, category: str, order: int = 0) -> DataFrame:
    """(url, category, ord) of an XML sitemap, namespaces ignored."""
    rows = spark.read.format("xml").option("rowTag", "url").option("ignoreNamespace", True).schema("loc string").load(path)
    return rows.select(F.trim("loc").alias("url"), F.lit(category).alias("category"), F.lit(order).alias("ord")).filter("url IS NOT NULL")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of entries; a missing document type is html."""
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path).withColumn("doc_type", F.coalesce("doc_type", F.lit("html")))


def corpus_files(spark: SparkSession, root: str) -> DataFrame:
    """(category, slug, text) of text files ``root/category/slug.txt``."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(root, wholetext=True)
    path = F.col("_metadata.file_path")
    return rows.select(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("category"), F.regexp_extract(path, r"([^/]+)\.txt$", 1).alias("slug"), F.col("value").alias("text"))


def tab_log(spark: SparkSession, path: str) -> DataFrame:
    """(url, reason) of log lines of at least two fields: the last field, of the last line of a URL.
    The order of lines is theirs in the file, so one file is one split."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    parts = rows.withColumn("f", F.split("line", "\t")).filter(F.size("f") >= 2)
    return parts.groupBy(F.col("f")[0].alias("url")).agg(F.max_by(F.element_at("f", -1), "line_no").alias("reason"))


def append_log(rows: DataFrame, path: str) -> None:
    """Adds rows to a log table."""
    rows.write.mode("append").parquet(path)


def documents(spark: SparkSession, path: str, least_bytes: int = 10_000) -> DataFrame:
    """(path, length, content, is_pdf) of binary documents; is_pdf by the file's first bytes."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select("path", "length", "content", F.expr("startswith(content, X'25504446')").alias("is_pdf"), (F.col("length") > least_bytes).alias("is_complete"))


def storage(spark: SparkSession, path: str, largest: int = 5) -> tuple[DataFrame, DataFrame]:
    """(one row with files and bytes; the largest files), without reading contents."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return rows.agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")), rows.orderBy(F.desc("length"), "path").limit(largest)
