"""Column expressions on text, URLs and questions; all of them run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def words(c: Column) -> Column:
    """Number of words between white space; null for null."""
    return F.size(F.regexp_extract_all(c, F.lit(P.NOT_SPACE + "+"), F.lit(0)))


def estimated_tokens(c: Column) -> Column:
    """max(floor(1.33 words), floor(characters / 3)) + 1."""
    return (F.greatest(F.floor(words(c) * F.lit(1.33)), F.floor(F.length(c) / F.lit(3.0))) + 1).cast("int")


def terms(c: Column) -> Column:
    """Index terms: runs of a-z and 0-9 in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(P.TERM), F.lit(0))


def query_terms(c: Column) -> Column:
    return F.array_distinct(F.filter(terms(c), lambda t: F.length(t) > 1))


def content_words(c: Column) -> Column:
    """Longer words that say something about where a text came from, in order, repeated."""
    stop = F.array(*[F.lit(w) for w in P.STOPWORDS])
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(P.CONTENT_TOKEN), F.lit(0)), lambda w: (F.length(w) > 3) & ~F.array_contains(stop, w))


def content_vocabulary(c: Column) -> Column:
    """The different content words; stop words go by one hash lookup a word."""
    long = F.regexp_extract_all(F.lower(c), F.lit(P.CONTENT_TOKEN.replace("]+", "]{3,}")), F.lit(0))
    return F.array_except(long, F.array(*[F.lit(w) for w in P.STOPWORDS]))


def even_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, P.SPACE + "+", " "))


def url_path(url: Column) -> Column:
    """What is between the host and the first ? or #."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def slugify(url: Column) -> Column:
    """The path with other characters than letters and digits as single hyphens, ``index`` if none."""
    s = F.lower(F.regexp_replace(F.regexp_replace(url_path(url), "[^a-zA-Z0-9]+", "-"), "^-+|-+$", ""))
    return F.when(s == "", "index").otherwise(s)


def _group(c: Column, pattern: str, group: int = 1) -> Column:
    got = F.regexp_extract(c, pattern, group)
    return F.when(got != "", got)


def source_year(url: Column, slug: Column, strict: bool = False) -> Column:
    """Year of publication as a string, or null: of a range of years in URL or slug (its end), in the
    file name, in the upload path. ``strict`` takes a range only if its end is the same year or up to
    ten years later, so that dates like 2024-05-10 are not taken for ranges."""
    both = F.concat_ws(" ", url, slug)
    start, end = _group(both, P.YEAR_RANGE, 1), _group(both, P.YEAR_RANGE, 2)
    full = F.when(F.length(end) == 4, end).otherwise(F.concat(F.left(start, F.lit(2)), end))
    if strict:
        full = F.when(full.cast("int").between(start.cast("int"), start.cast("int") + 10), full)
    return F.coalesce(full, _group(F.substring_index(url, "/", -1), P.YEAR), _group(url, P.UPLOAD_PATH))


def date_basis(url: Column, slug: Column) -> Column:
    both = F.concat_ws(" ", url, slug)
    return (
        F.when(both.rlike(P.YEAR_RANGE), "year range in name")
        .when(F.substring_index(url, "/", -1).rlike(P.YEAR), "year in filename")
        .when(url.rlike(P.UPLOAD_PATH), "upload path")
        .otherwise("undated (live site page)")
    )


def is_junk_url(url: Column) -> Column:
    return url.rlike(P.JUNK_URL)


def is_document_link(url: Column) -> Column:
    """The link without its query names a document file."""
    return F.substring_index(url, "?", 1).rlike(P.DOCUMENT_EXTENSIONS)


def url_variants(url: Column, public_host: str) -> Column:
    """The URL, the same path on the public host if its host is a private address, and https for http."""
    private = url_host(url).rlike(r"^(192\.168\.|10\.|172\.(1[6-9]|2\d|3[01])\.)")
    moved = F.regexp_replace(url, r"^http://[^/?#]*", f"https://{public_host}")
    secure = F.regexp_replace(url, "^http://", "https://")
    plain = url.startswith(f"http://{public_host}")
    none = F.lit(None).cast("string")
    return F.array_compact(F.array(url, F.when(private, moved).otherwise(none), F.when(plain, secure).otherwise(none)))


def asked_year(question: Column) -> Column:
    return _group(question, r"\b(20\d{2})\b").cast("int")


def wants_current(question: Column) -> Column:
    return question.rlike(P.CURRENCY_WORDS)


def is_source_challenge(question: Column) -> Column:
    return F.trim(question).rlike(P.SOURCE_CHALLENGE)


def routed_categories(question: Column) -> Column:
    """Categories to search as pools of their own."""
    return F.when(question.rlike(P.PERSON_INTENT), F.array(F.lit("personnel"))).otherwise(F.array().cast("array<string>"))


def figures(c: Column) -> Column:
    """Grouped or at least four-digit numbers."""
    return F.regexp_extract_all(c, F.lit(P.FIGURE), F.lit(0))


def titled_names(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(P.TITLED_NAME), F.lit(1))


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def table_lines(c: Column) -> Column:
    """Lines that begin with a pipe after blanks."""
    return F.size(F.filter(lines(c), lambda x: x.rlike(f"^{P.SPACE}*[|]")))


def is_table(c: Column) -> Column:
    """At least two non-blank lines, of which at least two and 60 % begin with a pipe."""
    n = F.size(F.filter(lines(c), lambda x: x.rlike(P.NOT_SPACE)))
    return (n >= 2) & (table_lines(c) >= F.greatest(F.lit(2.0), n * F.lit(0.6)))


def clean_rewrite(reply: Column, question: Column) -> Column:
    """First line of a rewritten question; the question itself if the rewrite is empty or too long."""
    bare = F.regexp_replace(F.trim(reply), '^"+|"+$', "")
    return F.when(F.coalesce(F.length(bare), F.lit(0)).between(1, 300), F.trim(F.split(bare, "\n")[0])).otherwise(question)


def question_class(reply: Column) -> Column:
    return F.when(F.upper(F.trim(reply)).startswith("GENERIC"), "GENERIC").otherwise("SPECIFIC")


def speech_text(reply: Column, flag: str, most: int = 2000) -> Column:
    """What is read aloud: without the list of sources and the flag, cut to a length."""
    return F.trim(F.left(F.replace(F.substring_index(reply, "\nSources:", 1), F.lit(flag), F.lit("")), F.lit(most)))
