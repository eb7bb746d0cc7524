"""Named queries over the test tables, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import patterns as P
from .functions import text as T
from .functions import html as H
from .operators import answering, audio, chunking, conversation, corpus, guards, quality, ranking, search

YEAR = 2026
_W = P.NOT_SPACE + "+"
_Q = _W.replace("'", "''")
_SP = P.SPACE
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# -- text measures -----------------------------------------------------------------------------

_SIZE = f"(greatest(floor(len(regexp_extract_all(text, '{_Q}')) * 1.33::DOUBLE), floor(length(text) / 3.0::DOUBLE)) + 1)::INT"


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{_Q}'))::INT AS n_words, {_SIZE} AS est_tokens FROM documents WHERE text IS NOT NULL")
def token_estimate(s, d):
    return t(s, d, "documents").filter("text IS NOT NULL").select("doc_id", T.words(F.col("text")).alias("n_words"), T.estimated_tokens(F.col("text")).alias("est_tokens"))


@query(f"SELECT row_id, len(regexp_extract_all(text, '{_Q}'))::INT AS n_words FROM corpus_text WHERE text IS NOT NULL AND len(regexp_extract_all(text, '{_Q}')) >= 200")
def length_filter(s, d):
    df = t(s, d, "corpus_text").select("row_id", T.words(F.col("text")).alias("n_words"))
    return df.filter(F.col("n_words") >= P.MIN_DOCUMENT_WORDS)


_STOP = ", ".join(f"'{w}'" for w in P.STOPWORDS)
_CONTENT = "list_filter(regexp_extract_all(lower({c}), '[a-z][a-z0-9\\-'']+'), lambda w: length(w) > 3 AND NOT list_contains([" + _STOP + "], w))"


@query(f"SELECT doc_id, len({_CONTENT.format(c='text')})::INT AS n_content, len(list_distinct({_CONTENT.format(c='text')}))::INT AS n_distinct FROM documents WHERE text IS NOT NULL")
def content_words(s, d):
    w = T.content_words(F.col("text"))
    return t(s, d, "documents").filter("text IS NOT NULL").select("doc_id", F.size(w).alias("n_content"), F.size(F.array_distinct(w)).alias("n_distinct"))


@query(f"SELECT id, left(trim(regexp_replace(text, '{_SP}+', ' ', 'g')), 240) AS snippet FROM chunks")
def snippets(s, d):
    return t(s, d, "chunks").select("id", F.left(T.even_space(F.col("text")), F.lit(240)).alias("snippet"))


@query(f"""SELECT id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^{_SP}*[|]')))::INT AS table_lines,
  len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{P.NOT_SPACE}'))) >= 2 AND
  len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^{_SP}*[|]'))) >=
  greatest(2.0, 0.6 * len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{P.NOT_SPACE}')))) AS is_table FROM chunks""")
def table_detection(s, d):
    return t(s, d, "chunks").select("id", T.table_lines(F.col("text")).alias("table_lines"), T.is_table(F.col("text")).alias("is_table"))


@query(f"SELECT row_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^{_SP}*[|]')))::INT AS n_rows FROM corpus_text WHERE len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^{_SP}*[|]'))) > 0 ORDER BY n_rows DESC, row_id LIMIT 20")
def largest_tables(s, d):
    return t(s, d, "corpus_text").select("row_id", T.table_lines(F.col("text")).alias("n_rows")).filter("n_rows > 0").orderBy(F.desc("n_rows"), "row_id").limit(20)


@query()
def figures(s, d):
    return t(s, d, "documents").filter("text IS NOT NULL").select("doc_id", F.size(T.figures(F.col("text"))).alias("n_figures"))


@query("SELECT doc_id, len(regexp_extract_all(text, '(?:^|[^A-Za-z0-9_À-ž])(?:Dr|Prof|Professor|Mr|Ms|Mrs|Engr)\\.?\\s+([A-Z][A-Za-z.\\-'']+(?:\\s+[A-Z][A-Za-z.\\-'']+){0,3})', 1))::INT AS n_names FROM documents WHERE text IS NOT NULL")
def titled_names(s, d):
    return t(s, d, "documents").filter("text IS NOT NULL").select("doc_id", F.size(T.titled_names(F.col("text"))).alias("n_names"))


# -- URLs --------------------------------------------------------------------------------------

_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1)"
_SLUG = f"CASE WHEN regexp_replace(regexp_replace({_PATH}, '[^a-zA-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') = '' THEN 'index' ELSE lower(regexp_replace(regexp_replace({_PATH}, '[^a-zA-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) END"


@query(f"SELECT row_id, {_SLUG} AS made_slug FROM manifest WHERE url IS NOT NULL")
def slugify(s, d):
    return t(s, d, "manifest").filter("url IS NOT NULL").select("row_id", T.slugify(F.col("url")).alias("made_slug"))


@query(f"SELECT {_SLUG} AS made_slug, count(DISTINCT url) AS n_urls FROM manifest WHERE url IS NOT NULL GROUP BY 1 HAVING count(DISTINCT url) > 1")
def slug_collisions(s, d):
    m = t(s, d, "manifest").filter("url IS NOT NULL").select("url").distinct()
    return m.groupBy(T.slugify(F.col("url")).alias("made_slug")).agg(F.count(F.lit(1)).alias("n_urls")).filter("n_urls > 1")


_RANGE = "'(20[0-9]{2})\\s*[-–]\\s*([0-9]{2,4})'"
_BOTH = "concat_ws(' ', url, slug)"


@query(f"""SELECT row_id, CASE WHEN regexp_matches({_BOTH}, {_RANGE}) THEN
    CASE WHEN length(regexp_extract({_BOTH}, {_RANGE}, 2)) = 4 THEN regexp_extract({_BOTH}, {_RANGE}, 2) ELSE left(regexp_extract({_BOTH}, {_RANGE}, 1), 2) || regexp_extract({_BOTH}, {_RANGE}, 2) END
  WHEN regexp_matches(regexp_extract(url, '[^/]*$'), '20[0-9]{{2}}') THEN regexp_extract(regexp_extract(url, '[^/]*$'), '20[0-9]{{2}}')
  WHEN regexp_matches(url, '/uploads/20[0-9]{{2}}/[0-9]{{2}}/') THEN regexp_extract(url, '/uploads/(20[0-9]{{2}})/[0-9]{{2}}/', 1) END AS year,
  CASE WHEN regexp_matches({_BOTH}, {_RANGE}) THEN 'year range in name' WHEN regexp_matches(regexp_extract(url, '[^/]*$'), '20[0-9]{{2}}') THEN 'year in filename'
  WHEN regexp_matches(url, '/uploads/20[0-9]{{2}}/[0-9]{{2}}/') THEN 'upload path' ELSE 'undated (live site page)' END AS basis FROM manifest""")
def source_dates(s, d):
    return t(s, d, "manifest").select("row_id", T.source_year(F.col("url"), F.col("slug")).alias("year"), T.date_basis(F.col("url"), F.col("slug")).alias("basis"))


@query(f"SELECT row_id, url FROM manifest WHERE regexp_matches(url, '{P.JUNK_URL}')")
def junk_urls(s, d):
    return t(s, d, "manifest").filter(T.is_junk_url(F.col("url"))).select("row_id", "url")


@query("SELECT row_id FROM manifest WHERE coalesce(doc_type, 'html') = 'html'")
def html_responses(s, d):
    """Entries with the content type that their kind of document is served with."""
    kind = F.when(F.coalesce("doc_type", F.lit("html")) == "html", "Text/HTML; charset=utf-8").otherwise("application/pdf")
    return corpus.html_only(t(s, d, "manifest").withColumn("content_type", kind)).select("row_id")


@query("""WITH c AS (SELECT url, category, row_id, CASE category WHEN 'pages' THEN 0 WHEN 'departments' THEN 1 ELSE 2 END AS k FROM manifest WHERE category IN ('pages', 'departments', 'courses'))
SELECT url, arg_min(category, k * 1000000000 + row_id) AS category FROM c WHERE url IS NOT NULL GROUP BY url""")
def sitemap_union(s, d):
    """Three lists of one crawl in their order."""
    m = t(s, d, "manifest").select("url", "category", F.col("row_id").alias("pos"))
    return corpus.union_in_order([m.filter(F.col("category") == c) for c in ("pages", "departments", "courses")], "url", "category")


@query(f"""SELECT sum(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^{_SP}*[|]'))))::BIGINT AS table_rows,
  sum((len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^{_SP}*[|]'))) > 0)::INT)::BIGINT AS pages_with_tables FROM corpus_text""")
def table_totals(s, d):
    return corpus.table_totals(t(s, d, "corpus_text"))


@query("""SELECT row_id, 'Page ' || row_id AS title, 'Page ' || row_id || chr(10) || 'In ' || coalesce(category, 'none') || ' & more' || chr(10) || '| Words | Kind |' || chr(10) || '|---|---|' || chr(10) || '| ' || coalesce(word_count::VARCHAR, '-') || ' | ' || coalesce(doc_type, 'html') || ' |' AS text,
  'https://h.example/a/' || row_id || ' https://h.example/x' AS links FROM manifest""")
def html_pages(s, d):
    """Each entry as a page with furniture, a table, unclosed tags and links."""
    c = F.concat
    n = F.col("row_id").cast("string")
    page = c(
        F.lit("<html><head><title> Page "), n, F.lit("</title><style>p {}</style></head><body><nav>Menu</nav><h1>Page "), n, F.lit("</h1><p>In "), F.coalesce("category", F.lit("none")), F.lit(" &amp; more<p>"),
        F.lit("<table><tr><th>Words<th>Kind</tr><tr><td>"), F.coalesce(F.col("word_count").cast("string"), F.lit("-")), F.lit("</td><td>"), F.coalesce("doc_type", F.lit("html")), F.lit("</td></tr><tr></tr></table>"),
        F.lit("<a href='"), n, F.lit("#top'></a><a href='/x'></a><a href='https://other.example/'></a><footer>End</footer><script>var a = '</p>'</script></body></html>"),
    )
    got = t(s, d, "manifest").select("row_id", H.html_to_text_udf()(page).alias("h"))
    return got.select("row_id", "h.title", "h.text", F.array_join(H.same_host_links(F.lit("https://h.example/a/b"), F.col("h.links")), " ").alias("links"))


@query("SELECT category, count(*) AS n FROM manifest WHERE regexp_matches(split_part(url, '?', 1), '(?i)\\.(pdf|doc|docx|xlsx)$') GROUP BY category")
def document_links(s, d):
    return t(s, d, "manifest").filter(T.is_document_link(F.col("url"))).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


_PUBLIC = "www.nordvale.example"


@query(f"""SELECT row_id, unnest(list_filter([url, CASE WHEN regexp_matches(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1), '^(192\\.168\\.|10\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.)')
  THEN regexp_replace(url, '^http://[^/?#]*', 'https://{_PUBLIC}') END, CASE WHEN starts_with(url, 'http://{_PUBLIC}') THEN regexp_replace(url, '^http://', 'https://') END], lambda x: x IS NOT NULL)) AS variant
  FROM (SELECT row_id, CASE WHEN row_id % 3 = 0 THEN regexp_replace(url, '^(?i)https?://[^/?#]*', 'http://192.168.7.1') WHEN row_id % 3 = 1 THEN regexp_replace(url, '^(?i)https?://', 'http://') ELSE url END AS url FROM manifest)""")
def url_variants(s, d):
    """Every third URL is moved to a private host and every third to plain http first."""
    u = F.when(F.col("row_id") % 3 == 0, F.regexp_replace("url", "^(?i)https?://[^/?#]*", "http://192.168.7.1")).when(F.col("row_id") % 3 == 1, F.regexp_replace("url", "^(?i)https?://", "http://")).otherwise(F.col("url"))
    return t(s, d, "manifest").select("row_id", F.explode(T.url_variants(u, _PUBLIC)).alias("variant"))


@query(f"""WITH paths AS (SELECT row_id, CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END AS p FROM manifest),
rules(prefix, allow) AS (VALUES ('/', true), ('/course/', false), ('/course/cs', true), ('/wp-content/', false), ('/personnel', false)),
best AS (SELECT row_id, allow, row_number() OVER (PARTITION BY row_id ORDER BY length(prefix) DESC) AS k FROM paths JOIN rules ON starts_with(p, prefix))
SELECT row_id, coalesce(allow, true) AS allowed FROM paths LEFT JOIN (SELECT * FROM best WHERE k = 1) USING (row_id)""")
def robots_rules(s, d):
    rules = s.createDataFrame([("/", True), ("/course/", False), ("/course/cs", True), ("/wp-content/", False), ("/personnel", False)], "prefix string, allow boolean")
    return corpus.allowed(t(s, d, "manifest").select("row_id", "url"), rules).select("row_id", "allowed")


# -- questions ---------------------------------------------------------------------------------


@query(f"""SELECT row_id, try_cast(nullif(regexp_extract(title, '\\b(20[0-9]{{2}})\\b', 1), '') AS INT) AS year, regexp_matches(title, '{P.CURRENCY_WORDS}') AS wants_current,
  regexp_matches(title, '{P.PERSON_INTENT}') AS person FROM manifest WHERE title IS NOT NULL""")
def question_intents(s, d):
    q = F.col("title")
    return t(s, d, "manifest").filter("title IS NOT NULL").select("row_id", T.asked_year(q).alias("year"), T.wants_current(q).alias("wants_current"), (F.size(T.routed_categories(q)) > 0).alias("person"))


_CHALLENGE = P.SOURCE_CHALLENGE.replace("'", "''")


@query(f"SELECT doc_id, regexp_matches(trim(text), '{_CHALLENGE}') AS challenge FROM documents WHERE text IS NOT NULL")
def source_challenges(s, d):
    return t(s, d, "documents").filter("text IS NOT NULL").select("doc_id", T.is_source_challenge(F.col("text")).alias("challenge"))


_REPLY = "CASE row_id % 5 WHEN 0 THEN '\"' || title || '\"' WHEN 1 THEN '' WHEN 2 THEN title || chr(10) || 'More.' WHEN 3 THEN repeat('long ', 80) END"


@query(f"""WITH b AS (SELECT row_id, slug, regexp_replace(trim(reply), '^"+|"+$', '', 'g') AS b FROM (SELECT row_id, slug, {_REPLY} AS reply FROM manifest))
SELECT row_id, CASE WHEN coalesce(length(b), 0) BETWEEN 1 AND 300 THEN trim(split_part(b, chr(10), 1)) ELSE slug END AS search_query FROM b""")
def condensed_questions(s, d):
    """Titles as rewritten questions: quoted, empty, of two lines, too long, or none at all."""
    k = F.col("row_id") % 5
    reply = F.when(k == 0, F.concat(F.lit('"'), "title", F.lit('"'))).when(k == 1, "").when(k == 2, F.concat("title", F.lit("\nMore."))).when(k == 3, "long " * 80)
    return t(s, d, "manifest").select("row_id", T.clean_rewrite(reply, F.col("slug")).alias("search_query"))


# -- corpus ------------------------------------------------------------------------------------


@query("SELECT category, coalesce(doc_type, 'html') AS doc_type, count(*) AS n FROM manifest GROUP BY 1, 2")
def category_counts(s, d):
    return t(s, d, "manifest").groupBy("category", F.coalesce("doc_type", F.lit("html")).alias("doc_type")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT coalesce(CASE WHEN regexp_matches(url, '{P.JUNK_URL}') THEN 'theme demo' WHEN coalesce(len(regexp_extract_all(text, '{_Q}')), 0) < 10 THEN 'too thin' END, 'kept') AS reason, count(*) AS n
  FROM corpus_text c LEFT JOIN manifest m ON c.row_id = m.row_id GROUP BY 1""")
def page_filter(s, d):
    pages = t(s, d, "corpus_text").select("row_id", "text").join(t(s, d, "manifest").select("row_id", "url"), "row_id", "left")
    return corpus.reject_reasons(pages).groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_LINES = f"SELECT row_id AS page, regexp_replace(x, '^{_SP}+|{_SP}+$', '', 'g') AS line FROM (SELECT row_id, unnest(string_split(text, chr(10))) AS x FROM corpus_text WHERE text IS NOT NULL)"
_COMMON = f"lines AS (SELECT * FROM ({_LINES}) WHERE line <> ''), common AS (SELECT line, count(DISTINCT page) AS n_pages FROM lines GROUP BY line HAVING count(DISTINCT page) >= {{share}} * (SELECT count(*) FROM corpus_text WHERE text IS NOT NULL))"


@query("WITH " + _COMMON.replace("{share}", "0.05::DOUBLE") + " SELECT line, n_pages FROM common")
def common_lines(s, d):
    return corpus.common_lines(t(s, d, "corpus_text"), "row_id", "text", 0.05)


@query("WITH " + _COMMON.replace("{share}", "0.02::DOUBLE") + " SELECT page, round(count(c.line) / count(*), 9) AS share FROM lines l LEFT JOIN common c USING (line) GROUP BY page HAVING count(c.line) / count(*) >= 0.5::DOUBLE")
def boilerplate_pages(s, d):
    """With lower limits than the defaults, which no page here reaches."""
    return corpus.boilerplate_pages(t(s, d, "corpus_text"), "row_id", "text", 0.02, 0.5).select("page", F.round("share", 9).alias("share"))


@query("SELECT url, arg_max(reason, seq) AS reason FROM skip_log WHERE url IS NOT NULL AND reason IS NOT NULL GROUP BY url")
def last_reason(s, d):
    return ranking.last_wins(t(s, d, "skip_log").filter("reason IS NOT NULL"), "url", "seq", "reason")


@query("SELECT url, arg_min(category, row_id) AS category FROM manifest WHERE category IS NOT NULL GROUP BY url")
def first_category(s, d):
    return ranking.first_wins(t(s, d, "manifest").filter("category IS NOT NULL"), "url", "row_id", "category")


@query("SELECT reason, count(*) AS n FROM skip_log GROUP BY reason ORDER BY n DESC, reason LIMIT 20")
def top_reasons(s, d):
    return t(s, d, "skip_log").groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("reason")).limit(20)


@query("SELECT row_id, url FROM manifest WHERE url NOT IN (SELECT url FROM skip_log WHERE url IS NOT NULL)")
def resume_crawl(s, d):
    return corpus.resume(t(s, d, "manifest").select("row_id", "url"), t(s, d, "skip_log")).select("row_id", "url")


_SLOG = "SELECT DISTINCT url FROM skip_log WHERE url IS NOT NULL AND reason LIKE '%thin%'"


@query(f"""WITH thin AS ({_SLOG}), failed AS (SELECT DISTINCT url FROM skip_log WHERE url IS NOT NULL AND NOT coalesce(reason LIKE '%thin%', false)),
have AS (SELECT DISTINCT m.url FROM corpus_text c JOIN manifest m ON c.row_id = m.row_id)
SELECT CASE WHEN t.url IS NOT NULL AND regexp_matches(m.url, '{P.JUNK_URL}') THEN 'thin: theme demo page' WHEN t.url IS NOT NULL THEN 'thin: real page' WHEN f.url IS NOT NULL THEN 'fetch failed' ELSE 'unexplained' END AS bucket,
  m.category, count(*) AS n FROM manifest m LEFT JOIN thin t ON m.url = t.url LEFT JOIN failed f ON m.url = f.url WHERE m.url NOT IN (SELECT url FROM have) GROUP BY 1, 2""")
def coverage_buckets(s, d):
    m, log = t(s, d, "manifest"), t(s, d, "skip_log").filter("url IS NOT NULL")
    is_thin = F.coalesce(F.col("reason").like("%thin%"), F.lit(False))
    have = t(s, d, "corpus_text").select("row_id").join(m.select("row_id", "url"), "row_id")
    return corpus.coverage(m.select("url", "category"), have, log.filter(is_thin), log.filter(~is_thin)).groupBy("bucket", "category").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT row_id, category FROM (SELECT row_id, category, row_number() OVER (PARTITION BY category ORDER BY row_id) AS k FROM manifest) WHERE k <= 8")
def checkpoint_sample(s, d):
    return ranking.first_of_each(t(s, d, "manifest").select("row_id", "category"), "category", "row_id", 8).select("row_id", "category")


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, greatest(1, (count(*) OVER ()) // 50) AS step FROM documents) SELECT doc_id FROM r WHERE r % step = 0 AND r < step * 50")
def systematic_sample(s, d):
    return ranking.every_nth(t(s, d, "documents").select("doc_id"), "doc_id", 50).select("doc_id")


@query("SELECT doc_id FROM documents ORDER BY md5(concat('7/', doc_id)), doc_id LIMIT 10")
def seeded_sample(s, d):
    return t(s, d, "documents").select("doc_id").orderBy(F.md5(F.concat(F.lit("7/"), F.col("doc_id").cast("string"))), "doc_id").limit(10)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT doc_url AS src, page_url AS dst FROM doc_links WHERE doc_url IS NOT NULL AND page_url IS NOT NULL
  UNION SELECT DISTINCT page_url, doc_url FROM doc_links WHERE doc_url IS NOT NULL AND page_url IS NOT NULL),
r(url, depth) AS (SELECT DISTINCT page_url, 0 FROM doc_links WHERE page_url LIKE '%/department/%' UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON r.url = e.src WHERE r.depth < 2)
SELECT url, min(depth)::INT AS depth FROM r GROUP BY url""")
def link_reach(s, d):
    """From department pages along links in either direction, two steps."""
    links = t(s, d, "doc_links")
    edges = links.select(F.col("doc_url").alias("src"), F.col("page_url").alias("dst")).unionByName(links.select(F.col("page_url").alias("src"), F.col("doc_url").alias("dst")))
    return corpus.reachable(edges, links.filter("page_url LIKE '%/department/%'").select(F.col("page_url").alias("url")), 2)


@query("SELECT c.id FROM chunks c LEFT JOIN (SELECT DISTINCT id FROM chunk_vectors WHERE id IS NOT NULL) v ON c.id = v.id WHERE v.id IS NULL")
def stale_ids(s, d):
    return t(s, d, "chunks").select("id").join(t(s, d, "chunk_vectors").select("id"), "id", "left_anti")


@query("""WITH new AS (SELECT row_id, 'merged' AS title FROM manifest WHERE category = 'courses' UNION ALL SELECT row_id + 100000000, 'added' FROM manifest WHERE category = 'documents')
SELECT row_id, title FROM new UNION ALL SELECT row_id, title FROM manifest WHERE row_id NOT IN (SELECT row_id FROM new)""")
def upsert_merge(s, d):
    from .sources.store import merge

    m = t(s, d, "manifest").select("row_id", "title", "category")
    new = m.filter("category = 'courses'").select("row_id", F.lit("merged").alias("title")).unionByName(m.filter("category = 'documents'").select((F.col("row_id") + 100000000).alias("row_id"), F.lit("added").alias("title")))
    return merge(m.select("row_id", "title"), new, "row_id")


@query("SELECT source_url, count(*) AS n_chunks, max(chunk_index)::INT AS last_index FROM chunks GROUP BY source_url")
def chunks_per_source(s, d):
    return t(s, d, "chunks").groupBy("source_url").agg(F.count(F.lit(1)).alias("n_chunks"), F.max("chunk_index").alias("last_index"))


# -- chunking ----------------------------------------------------------------------------------


@query(f"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '{_Q}') AS w FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, w, unnest(range(0, greatest(0, ceil((len(w) - {chunking.WINDOW}) / {chunking.STRIDE}.0))::BIGINT + 1)) AS i FROM w WHERE len(w) > 0)
SELECT doc_id, i::INT AS window_no, array_to_string(w[i * {chunking.STRIDE} + 1 : i * {chunking.STRIDE} + {chunking.WINDOW}], ' ') AS text FROM k""")
def hard_split_windows(s, d):
    return t(s, d, "documents").filter("text IS NOT NULL").select("doc_id", F.posexplode(chunking.word_windows(F.col("text"))).alias("window_no", "text"))


@query()
def chunk_records(s, d):
    m = t(s, d, "manifest").select("row_id", "url", "title", "scraped_at", "doc_type")
    return chunking.chunk_records(t(s, d, "corpus_text").select("row_id", "category", "slug", "text").join(m, "row_id"))


@query()
def document_chunks(s, d):
    return t(s, d, "documents").select("doc_id", F.posexplode(chunking.chunk_text("text")).alias("chunk_index", "text"))


# -- search ------------------------------------------------------------------------------------

_TS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"


@query(f"SELECT greatest(1, count(*)) AS n_docs, round(avg(len({_TS})), 9) AS avgdl, sum(len(list_distinct({_TS})))::BIGINT AS n_postings FROM documents")
def bm25_corpus_stats(s, d):
    return search.corpus_stats(t(s, d, "documents"), "doc_id", "text").withColumn("avgdl", F.round("avgdl", 9))


@query(f"SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct({_TS})) AS term FROM documents) GROUP BY term")
def document_frequency(s, d):
    return search.document_frequency(t(s, d, "documents"), "doc_id", "text")


def _titles(s, d):
    return t(s, d, "manifest").filter("row_id % 100 = 0 AND title IS NOT NULL").select(F.col("row_id").alias("query_id"), F.col("title").alias("question"))


_BM25 = f"""
docs AS (SELECT row_id AS id, {_TS} AS ts FROM corpus_text),
corpus AS (SELECT greatest(1, count(*)) AS n, avg(len(ts)) AS avgdl FROM docs),
post AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(ts) AS term FROM docs) GROUP BY id, term),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
q AS (SELECT row_id AS query_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda x: length(x) > 1))) AS term FROM manifest WHERE row_id % 100 = 0 AND title IS NOT NULL),
scored AS (SELECT q.query_id, post.id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(ts) / avgdl))) AS score
  FROM q JOIN post USING (term) JOIN df USING (term) JOIN docs USING (id), corpus GROUP BY 1, 2),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM scored) WHERE rank <= 60)
"""


@query(f"WITH {_BM25} SELECT query_id, id, rank::INT AS rank, round(score, 6) AS score FROM lex")
def bm25_topk(s, d):
    """Titles of every hundredth manifest entry against all corpus texts."""
    index = search.build_index(t(s, d, "corpus_text"), "row_id", "text")
    return search.bm25(index, _titles(s, d)).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(f"""WITH s AS (SELECT b.vec_id AS query_id, a.vec_id AS id, {_COS} AS score FROM embeddings a, embeddings b WHERE b.vec_id % 100 = 0)
SELECT query_id, id, rank::INT AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s) WHERE rank <= 60""")
def dense_topk(s, d):
    e = t(s, d, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    got = search.dense(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), q)
    return got.select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query(f"""WITH s AS (SELECT b.vec_id AS query_id, a.vec_id AS id, {_COS} AS score FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE b.vec_id % 100 = 0)
SELECT query_id, id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s) WHERE rank <= 5""")
def dense_topk_filtered(s, d):
    """Nearest of the query's own label: the filter comes before the cut."""
    e = t(s, d, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"), "label")
    pairs = e.join(F.broadcast(q), "label") if q.count() <= 2000 else e.join(q, "label")
    return search.ranked(pairs.select("query_id", F.col("vec_id").alias("id"), search.cosine(F.col("embedding"), F.col("qvec")).alias("score")), 5).select("query_id", "id", "rank")


_HY = """
docs AS (SELECT doc_id AS id, source AS category, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS ts FROM documents),
corpus AS (SELECT greatest(1, count(*)) AS n, avg(len(ts)) AS avgdl FROM docs),
post AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(ts) AS term FROM docs) GROUP BY id, term),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
q AS (SELECT query_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(question), '[a-z0-9]+'), lambda x: length(x) > 1))) AS term FROM questions),
scored AS (SELECT q.query_id, post.id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(ts) / avgdl))) AS score
  FROM q JOIN post USING (term) JOIN df USING (term) JOIN docs USING (id), corpus GROUP BY 1, 2),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM scored) WHERE rank <= 60),
cosines AS (SELECT b.vec_id AS query_id, a.vec_id AS id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a, embeddings b WHERE b.vec_id IN (SELECT query_id FROM questions)),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM cosines) WHERE rank <= 60)
"""
_QUESTIONS = "questions AS (SELECT doc_id AS query_id, concat_ws(' ', category, source, lang, CASE WHEN doc_id % 200 = 0 THEN 'professor' END) AS question, source FROM documents WHERE doc_id % 100 = 0 AND doc_id IN (SELECT vec_id FROM embeddings))"
_TAIL = """fused AS (SELECT query_id, id, sum(part) AS fused FROM parts GROUP BY 1, 2),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 12) DESC, id) AS rank FROM fused) WHERE rank <= 5)
SELECT t.query_id, t.id, t.rank::INT AS rank, round(fused, 9) AS fused, round(coalesce(c.score, 0), 6) AS score FROM top t LEFT JOIN near c USING (query_id, id)"""


def _hybrid_inputs(s, d):
    docs, e = t(s, d, "documents"), t(s, d, "embeddings")
    v = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    word = F.when(F.col("doc_id") % 200 == 0, F.lit("professor"))
    q = docs.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.concat_ws(" ", "category", "source", "lang", word).alias("question"), "source")
    q = q.join(v.withColumnRenamed("id", "query_id").withColumnRenamed("vec", "qvec"), "query_id")
    return search.build_index(docs, "doc_id", "text"), v, q, docs


def _rounded(df):
    return df.select("query_id", "id", "rank", F.round("fused", 9).alias("fused"), F.round("score", 6).alias("score"))


@query(f"WITH {_QUESTIONS}, {_HY}, parts AS (SELECT query_id, id, 1 / (60.0::DOUBLE + rank) AS part FROM lex UNION ALL SELECT query_id, id, 1 / (60.0::DOUBLE + rank) FROM near), {_TAIL}")
def hybrid_rrf(s, d):
    index, v, q, _ = _hybrid_inputs(s, d)
    return _rounded(search.hybrid(index, v, q.drop("source")))


@query(f"""WITH {_QUESTIONS}, {_HY},
cats AS (SELECT doc_id AS id, CASE WHEN source = 'faculty-profiles' THEN 'personnel' ELSE source END AS category FROM documents),
routed AS (SELECT query_id FROM questions WHERE regexp_matches(question, '{P.PERSON_INTENT}')),
near_r AS (SELECT * FROM (SELECT c.query_id, c.id, row_number() OVER (PARTITION BY c.query_id ORDER BY round(score, 9) DESC, c.id) AS rank FROM cosines c JOIN cats USING (id) JOIN routed USING (query_id) WHERE category = 'personnel') WHERE rank <= 10),
lex_r AS (SELECT * FROM (SELECT l.query_id, l.id, row_number() OVER (PARTITION BY l.query_id ORDER BY round(score, 9) DESC, l.id) AS rank FROM lex l JOIN cats USING (id) JOIN routed USING (query_id) WHERE category = 'personnel') WHERE rank <= 10),
parts AS (SELECT query_id, id, 1 / (60.0::DOUBLE + rank) AS part FROM lex UNION ALL SELECT query_id, id, 1 / (60.0::DOUBLE + rank) FROM near
  UNION ALL SELECT query_id, id, 2.5::DOUBLE / (60.0::DOUBLE + rank) FROM near_r UNION ALL SELECT query_id, id, 2.5::DOUBLE / (60.0::DOUBLE + rank) FROM lex_r), {_TAIL}""")
def hybrid_routed(s, d):
    index, v, q, docs = _hybrid_inputs(s, d)
    cats = docs.select(F.col("doc_id").alias("id"), F.when(F.col("source") == "faculty-profiles", "personnel").otherwise(F.col("source")).alias("category"))
    return _rounded(search.hybrid(index, v, q.drop("source"), cats))


@query(f"""WITH {_QUESTIONS}, {_HY}, wanted AS (SELECT query_id, source AS category FROM questions),
near2 AS (SELECT * FROM (SELECT c.query_id, c.id, c.score, row_number() OVER (PARTITION BY c.query_id ORDER BY round(score, 9) DESC, c.id) AS rank FROM cosines c JOIN docs USING (id) JOIN wanted w ON c.query_id = w.query_id WHERE w.category IS NULL OR docs.category = w.category) WHERE rank <= 60),
lex2 AS (SELECT l.query_id, l.id, l.rank FROM lex l JOIN docs USING (id) JOIN wanted w ON l.query_id = w.query_id WHERE w.category IS NULL OR docs.category = w.category),
parts AS (SELECT query_id, id, 1 / (60.0::DOUBLE + rank) AS part FROM lex2 UNION ALL SELECT query_id, id, 1 / (60.0::DOUBLE + rank) FROM near2), {_TAIL.replace('LEFT JOIN near c', 'LEFT JOIN near2 c')}""")
def hybrid_category(s, d):
    """Filtered by the question's category: dense before the cut, lexical after it."""
    index, v, q, docs = _hybrid_inputs(s, d)
    cats = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("category"))
    return _rounded(search.hybrid(index, v, q.withColumnRenamed("source", "category"), cats))


# -- ranked lists ------------------------------------------------------------------------------


def _hits(s, d):
    """One list for each document type of the chunk table, in order of id; the lists are partitions."""
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy("id")
    rows = t(s, d, "chunks").select("id", "source_url", "text", "source_date", F.concat_ws("/", F.coalesce("category", F.lit("-")), F.substring("source_url", -6, 6)).alias("query_id"))
    return rows.withColumn("pos", F.row_number().over(w))


_HITS = "hits AS (SELECT id, source_url, text, source_date, query_id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS pos FROM (SELECT id, source_url, text, source_date, concat_ws('/', coalesce(category, '-'), right(source_url, 6)) AS query_id FROM chunks))"


@query(f"""WITH {_HITS}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id, coalesce(source_url, '') ORDER BY pos) AS n FROM hits)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY pos)::INT AS pos FROM k WHERE n <= 3""")
def cap_per_source(s, d):
    return ranking.cap_per_source(_hits(s, d)).select("query_id", "id", "pos")


@query(f"""WITH {_HITS}, c AS (SELECT *, sum({_SIZE} + 40) OVER (PARTITION BY query_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS used FROM hits)
SELECT query_id, id, pos::INT AS pos, used::BIGINT AS used FROM c WHERE used <= 6000 OR pos = 1""")
def budget_prefix(s, d):
    return ranking.within_budget(_hits(s, d)).select("query_id", "id", "pos", "used")


@query(f"""WITH {_HITS} SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN coalesce(source_date, '') = '' THEN 0 ELSE 1 END,
  CASE WHEN coalesce(source_date, '') = '' THEN 0 ELSE coalesce(-try_cast(source_date AS INT), 0) END, pos)::INT AS pos FROM hits""")
def prefer_recent(s, d):
    return ranking.prefer_recent(_hits(s, d)).select("query_id", "id", "pos")


_REPLIES = "replies AS (SELECT query_id, CASE count(*) % 4 WHEN 0 THEN '3, 1, 3, ' || (count(*) + 1) WHEN 1 THEN 'no idea' WHEN 2 THEN '[2] then [1]' ELSE count(*) || ', 2' END AS reply, count(*) AS n FROM hits GROUP BY query_id)"
_PERMUTED = """n AS (SELECT query_id, unnest(regexp_extract_all(reply, '[0-9]+')) AS x, unnest(range(len(regexp_extract_all(reply, '[0-9]+')))) AS place FROM replies),
f AS (SELECT query_id, x::BIGINT AS pos, min(place) AS place FROM n GROUP BY 1, 2)"""


def _replies(hits):
    n = F.count(F.lit(1))
    text = F.when(n % 4 == 0, F.concat(F.lit("3, 1, 3, "), (n + 1).cast("string"))).when(n % 4 == 1, "no idea").when(n % 4 == 2, "[2] then [1]").otherwise(F.concat(n.cast("string"), F.lit(", 2")))
    return hits.groupBy("query_id").agg(text.alias("reply"))


@query(f"""WITH {_HITS}, {_REPLIES}, {_PERMUTED}
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n > 1 THEN coalesce(place, 1000000) ELSE 1000000 END, h.pos)::INT AS pos FROM hits h JOIN replies USING (query_id) LEFT JOIN f USING (query_id, pos)""")
def rerank_permute(s, d):
    """All lists of hits, each with a reply that fits its length, repeats a number, or names none."""
    hits = _hits(s, d)
    return ranking.permute(hits, _replies(hits)).select("query_id", "id", "pos")


@query(f"""WITH {_HITS}, {_REPLIES}, {_PERMUTED},
capped AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS p FROM (SELECT *, row_number() OVER (PARTITION BY query_id, coalesce(source_url, '') ORDER BY pos) AS k FROM hits WHERE pos <= 20) WHERE k <= 3),
kept AS (SELECT * FROM capped WHERE p <= 12), sizes AS (SELECT query_id, count(*) AS m FROM kept GROUP BY query_id),
read AS (SELECT k.query_id, k.id, k.source_date, row_number() OVER (PARTITION BY k.query_id ORDER BY CASE WHEN m > 1 THEN coalesce(place, 1000000) ELSE 1000000 END, p) AS q FROM kept k JOIN sizes USING (query_id) LEFT JOIN f ON k.query_id = f.query_id AND k.p = f.pos),
five AS (SELECT * FROM read WHERE q <= 5)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN query_id LIKE 'courses%' OR coalesce(source_date, '') = '' THEN 0 ELSE 1 END,
  CASE WHEN query_id LIKE 'courses%' OR coalesce(source_date, '') = '' THEN 0 ELSE coalesce(-try_cast(source_date AS INT), 0) END, q)::INT AS pos FROM five""")
def evidence_to_read(s, d):
    """Pool, cap per source, reply's order, cut, and recent sources first but for courses."""
    hits = _hits(s, d)
    dated = hits.select("query_id").filter("query_id NOT LIKE 'courses%'").distinct()
    return answering.read_first(hits, _replies(hits), dated).select("query_id", "id", "pos")


@query("""WITH p AS (SELECT user_id AS query_id, value AS score FROM events WHERE event_type = 'view') SELECT user_id AS query_id, coalesce(max(score), 0) AS top FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN p ON user_id = query_id GROUP BY 1""")
def top_scores(s, d):
    e = t(s, d, "events")
    return answering.top_scores(e.filter("event_type = 'view'").select(F.col("user_id").alias("query_id"), F.col("value").alias("score")), e.select(F.col("user_id").alias("query_id")))


@query(f"""WITH s AS (SELECT b.vec_id AS query_id, a.vec_id AS id, {_COS} AS score FROM embeddings a, embeddings b WHERE b.vec_id % 100 = 0),
r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s)
SELECT query_id, id, rank::INT AS rank, source, lang, source_url FROM r JOIN documents ON id = doc_id WHERE rank <= 5""")
def hit_payloads(s, d):
    e = t(s, d, "embeddings")
    hits = search.dense(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec")), 5)
    return search.with_payload(hits.select("query_id", "id", "rank"), t(s, d, "documents").select("doc_id", "source", "lang", "source_url"), "doc_id")


# -- guards ------------------------------------------------------------------------------------

_A, _E = _CONTENT.format(c="a.text"), _CONTENT.format(c="b.text")


@query(f"""SELECT a.id, round(CASE WHEN len(list_distinct({_A})) < 12 THEN 1.0 ELSE len(list_intersect(list_distinct({_A}), list_distinct({_E}))) / len(list_distinct({_A})) END, 9) AS support
  FROM chunks a JOIN chunks b ON regexp_extract(a.id, '^[^#]*') = regexp_extract(b.id, '^[^#]*') AND b.chunk_index = a.chunk_index + 1""")
def evidence_support(s, d):
    """Each chunk as an answer, the next chunk of its document as evidence."""
    c = t(s, d, "chunks").select("id", "chunk_index", "text", F.substring_index("id", "#", 1).alias("doc"))
    after = c.select("doc", (F.col("chunk_index") - 1).alias("chunk_index"), F.col("text").alias("evidence"))
    return c.join(after, ["doc", "chunk_index"]).select("id", F.round(guards.support(F.col("text"), F.col("evidence")), 9).alias("support"))


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, printf('%,d', (l_extendedprice * 10)::BIGINT) AS fig, l_partkey % 2 = 0 AS told FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN told OR length(replace(fig, ',', '')) < 4 THEN 0 ELSE 1 END::INT AS n_substring,
  CASE WHEN length(replace(fig, ',', '')) < 4 THEN 0 ELSE 1 END::INT AS n_boundary FROM f""")
def unsupported_figures(s, d):
    """An answer quotes a figure; its evidence has it inside a longer one, or not at all."""
    rows = t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr("format_number(cast(round(l_extendedprice * 10) as bigint), 0)").alias("fig"), (F.col("l_partkey") % 2 == 0).alias("told"))
    body = F.concat(F.lit("It costs "), F.col("fig"), F.lit(" now."))
    seen = F.when(F.col("told"), F.concat(F.lit("Price list: 7"), F.replace("fig", F.lit(","), F.lit("")), F.lit(" in all."))).otherwise(F.lit("Price list: none."))
    return rows.select("l_orderkey", "l_linenumber", F.size(guards.unsupported_figures(body, seen)).alias("n_substring"), F.size(guards.unsupported_figures(body, seen, boundary=True)).alias("n_boundary"))


@query()
def unsupported_names(s, d):
    """Names of each document, with the next document as evidence."""
    docs = t(s, d, "documents").filter("text IS NOT NULL").select("doc_id", "text")
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("evidence"))
    return docs.join(after, "doc_id").select("doc_id", guards.unsupported_names(F.col("text"), F.col("evidence")).alias("names"))


@query()
def ended_terms(s, d):
    rows = t(s, d, "documents").select("doc_id", guards.ended_terms("text", F.lit(YEAR)).alias("ended"))
    return rows.filter(F.size("ended") > 0)


@query(f"""SELECT id, concat_ws('; ', CASE WHEN coalesce(source_date, '') <> '' THEN 'published ' || source_date ELSE 'live website page, no publication date, kept up to date' END,
  CASE WHEN coalesce(source_date, '') <> '' AND try_cast(source_date AS INT) < {YEAR} THEN ({YEAR} - try_cast(source_date AS INT)) || ' year(s) old — may be superseded' END,
  CASE WHEN chunk_index % 3 = 0 THEN 'WARNING: mentions a role with an ENDED term (2001-2004, 2010-2012) — that person is a FORMER holder, not the current one' END) AS note FROM chunks""")
def source_notes(s, d):
    """Every third chunk of a document is taken to name two ended terms."""
    ended = guards.ended_terms(F.when(F.col("chunk_index") % 3 == 0, "Dean 2001-2004; head of section from 2010 to 2012"), F.lit(YEAR))
    return t(s, d, "chunks").select("id", guards.source_note(F.col("source_date"), ended, YEAR).alias("note"))


@query(f"""WITH y AS (SELECT source_url, list_reverse_sort(list_distinct(list(source_date) FILTER (coalesce(source_date, '') <> ''))) AS ys FROM chunks GROUP BY source_url)
SELECT source_url, CASE WHEN ys IS NULL OR len(ys) = 0 THEN '' ELSE chr(10) || chr(10) || 'Source dates: ' || array_to_string(list_transform(ys, lambda y: CASE WHEN y::INT < {YEAR} THEN y || ' (' || ({YEAR} - y::INT) || ' yr old)' ELSE y END), ', ') || '. Newer information may supersede this.' END AS line FROM y""")
def provenance_lines(s, d):
    years = t(s, d, "chunks").groupBy("source_url").agg(F.collect_set("source_date").alias("ys"))  # distinct years only
    return years.select("source_url", guards.provenance(F.col("ys"), F.lit("nothing dated"), YEAR).alias("line"))


@query("""WITH r AS (SELECT id, source_url, 'About ' || id || '.' AS said, (chunk_index % 6)::INT AS k FROM chunks)
SELECT id, k <> 1 AS answered, CASE k WHEN 0 THEN 'u2 ' || source_url WHEN 1 THEN '' WHEN 3 THEN 'u2' ELSE source_url || ' u2' END AS cites,
  CASE k WHEN 4 THEN '' WHEN 5 THEN 'Sure!' || chr(10) || said ELSE said END AS body FROM r""")
def parsed_replies(s, d):
    """A reply about each chunk: with a header, declined, without one, with numbers out of range, a header
    only, and a header after a preamble."""
    said, k = F.concat(F.lit("About "), "id", F.lit(".")), F.col("chunk_index") % 6
    raw = (
        F.when(k == 0, F.concat(F.lit("ANSWERED: yes\nSOURCES_USED: 2, 1\n---\n"), said)).when(k == 1, F.concat(F.lit("**ANSWERED:** NO\n---\n"), said))
        .when(k == 2, said).when(k == 3, F.concat(F.lit("- ANSWERED: yes\n- SOURCES_USED: 9, 2\n\n"), said, F.lit("\nANSWERED: yes")))
        .when(k == 4, "ANSWERED: yes").otherwise(F.concat(F.lit("Sure!\n"), said))
    )
    df = t(s, d, "chunks").select("id", raw.alias("raw"), F.array("source_url", F.lit("u2"), "source_url").alias("urls"))
    return df.select("id", guards.parse_structured("raw", "urls").alias("r")).select("id", "r.answered", F.array_join("r.citations", " ").alias("cites"), "r.body")


_DECIDE = f"""raw AS (SELECT a.id, a.source_url, a.chunk_index % 7 AS k, length(a.text) AS n, b.id IS NOT NULL AS hit,
  round(CASE WHEN b.id IS NULL OR len(list_distinct({_A})) < 12 THEN 1.0 ELSE len(list_intersect(list_distinct({_A}), list_distinct({_E}))) / len(list_distinct({_A})) END, 9) AS support
  FROM chunks a LEFT JOIN chunks b ON regexp_extract(a.id, '^[^#]*') = regexp_extract(b.id, '^[^#]*') AND b.chunk_index = a.chunk_index + 1),
r AS (SELECT *, (n % 100) / 100.0::DOUBLE AS top, n % 11 = 0 AS bad, CASE WHEN n % 2 = 0 THEN 'GENERIC' ELSE 'SPECIFIC' END AS kind,
  CASE WHEN k = 1 THEN 'Not in the sources.' WHEN k IN (2, 3) THEN '' ELSE 'About ' || id || '.' END AS said FROM raw),
y AS (SELECT *, k <> 1 AND said = '' AS again, CASE WHEN k = 2 THEN 'Second try.' WHEN k = 3 THEN '' ELSE said END AS body, k NOT IN (1, 3) AS answered FROM r),
m AS (SELECT *, CASE WHEN hit AND top >= 0.5::DOUBLE AND answered AND support >= 0.3::DOUBLE AND NOT bad THEN 'GROUNDED' WHEN kind = 'GENERIC' THEN 'GENERAL' ELSE 'REFUSE' END AS mode FROM y),
d AS (SELECT *, CASE mode WHEN 'GROUNDED' THEN body || CASE WHEN n % 3 = 0 THEN ' [dated]' ELSE '' END WHEN 'GENERAL' THEN '[general]' || chr(10) || chr(10) || 'In general.'
  ELSE CASE WHEN hit AND top >= 0.5::DOUBLE AND NOT bad AND body <> '' THEN body ELSE 'Nothing found.' END || chr(10) || chr(10) || 'Ask the office.' END AS text,
  CASE WHEN mode <> 'GROUNDED' THEN '' WHEN again THEN source_url || ' u2' ELSE 'u2' END AS cites FROM m)"""


def _decisions(s, d):
    """Each chunk as an answer with the next one of its document as evidence; replies decline, come empty
    or need a second try, scores and classes of questions follow from lengths."""
    c = t(s, d, "chunks").select("id", "chunk_index", "source_url", "text", F.substring_index("id", "#", 1).alias("doc"))
    after = c.select("doc", (F.col("chunk_index") - 1).alias("chunk_index"), F.col("text").alias("evidence"))
    n, k = F.length("text"), F.col("chunk_index") % 7
    said = F.when(k == 1, "Not in the sources.").when(k.isin(2, 3), "").otherwise(F.concat(F.lit("About "), "id", F.lit(".")))
    reply = answering.second_try(k != 1, said, F.array(F.lit("u2")), F.when(k == 2, "Second try."), F.array("source_url", F.lit("u2"), F.lit("")))
    rows = c.join(after, ["doc", "chunk_index"], "left").select("id", "source_url", F.when(F.col("evidence").isNotNull(), 1).otherwise(0).alias("n_hits"), ((n % 100) / 100.0).alias("top"), reply.alias("reply"), F.round(guards.support(F.col("text"), F.col("evidence")), 9).alias("support"), n.alias("n"))
    c = F.col
    shown = answering.decided(c("n_hits"), c("top"), c("reply"), c("support"), F.when(c("n") % 11 == 0, 1).otherwise(0), F.when(c("n") % 2 == 0, "GENERIC").otherwise("SPECIFIC"), F.lit("In general."), F.when(c("n") % 3 == 0, " [dated]"), "[general]", "Nothing found.", "Ask the office.")
    return rows.select("id", "source_url", "n", shown.alias("a"))


@query(f"WITH {_DECIDE} SELECT id, mode, text, cites FROM d")
def mode_decisions(s, d):
    return _decisions(s, d).select("id", "a.mode", "a.text", F.array_join("a.citations", " ").alias("cites"))


@query(f"""WITH {_DECIDE}, x AS (SELECT *, CASE n % 4 WHEN 0 THEN 'GENERAL' WHEN 1 THEN 'GROUNDED' ELSE mode END AS expected FROM d)
SELECT id, ((mode = 'GROUNDED' AND n % 5 <> 0 AND cites = '')::INT + (mode = 'GROUNDED' AND n % 5 = 0)::INT + (mode = 'GROUNDED' AND n % 5 <> 0)::INT
  + (mode = 'GENERAL' AND n % 3 = 0)::INT + (mode = 'REFUSE' AND n % 3 = 0)::INT + (mode <> expected)::INT)::INT AS n_failures FROM x""")
def contract_checks(s, d):
    """Answers as decided, some spoilt: every third general one loses its flag and every third refusal its
    contacts; every fifth grounded one loses its citations, the others' 'u2' was not retrieved."""
    c = F.col
    a = _decisions(s, d).select("id", "n", "source_url", "a.*")
    text = F.when((c("n") % 3 == 0) & (c("mode") == "GENERAL"), "In general.").when((c("n") % 3 == 0) & (c("mode") == "REFUSE"), "No.").otherwise(c("text"))
    links = F.when((c("n") % 5 == 0) & (c("mode") == "GROUNDED"), F.array().cast("array<string>")).otherwise(c("citations"))
    expected = F.when(c("n") % 4 == 0, "GENERAL").when(c("n") % 4 == 1, "GROUNDED").otherwise(c("mode"))
    return a.select("id", F.size(guards.contract_failures(c("mode"), expected, text, links, F.array("source_url"), "[general]", "site.example", ("contact", "office"))).alias("n_failures"))


@query("""SELECT count(*) AS n, sum((event_type <> 'error')::INT)::BIGINT AS right_mode, sum((value > 50)::INT)::BIGINT AS broken_contracts, round(avg(value), 6) AS mean_latency, max(value) AS max_latency FROM events""")
def mode_accuracy(s, d):
    """Event rows as results: an error is a wrong mode, a value over 50 breaks a contract."""
    e = t(s, d, "events").select(F.lit("ok").alias("expected"), F.when(F.col("event_type") == "error", "bad").otherwise("ok").alias("mode"), (F.col("value") > 50).cast("int").alias("n_failures"), F.col("value").alias("latency"))
    return quality.mode_accuracy(e)


@query("SELECT user_id AS question, round(avg(value) FILTER (event_type = 'view'), 6) AS view, round(avg(value) FILTER (event_type = 'click'), 6) AS click FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id")
def model_comparison(s, d):
    e = t(s, d, "events").filter("event_type IN ('view', 'click')").select(F.col("user_id").alias("question"), F.col("event_type").alias("model"), F.col("value").alias("latency"))
    return quality.compare_models(e, ["view", "click"])


# -- long runs and conversations ---------------------------------------------------------------

_ATT = "att AS (SELECT event_id, ts, user_id % 16 AS stream, (event_type = 'error') AS failed, CASE event_type WHEN 'error' THEN 403 WHEN 'signup' THEN 404 ELSE 200 END AS status FROM events)"


def _attempts(s, d):
    status = F.when(F.col("event_type") == "error", 403).when(F.col("event_type") == "signup", 404).otherwise(200)
    return t(s, d, "events").select("event_id", (F.col("user_id") % 16).alias("stream"), (F.col("event_type") == "error").alias("failed"), status.alias("status"))


@query(f"""WITH {_ATT} SELECT event_id, round(avg(failed::INT) OVER w, 9) AS failure_rate, (count(*) OVER w = 200) AND avg(failed::INT) OVER w > 0.05 AS stop FROM att
  WINDOW w AS (PARTITION BY stream ORDER BY event_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)""")
def rolling_failures(s, d):
    return quality.rolling_failures(_attempts(s, d), "stream", "event_id", "failed").select("event_id", F.round("failure_rate", 9).alias("failure_rate"), "stop")


@query(f"""WITH {_ATT}, r AS (SELECT stream, event_id, count(*) OVER w >= 20 AND avg(failed::INT) OVER w > 0.15 AS stop FROM att WINDOW w AS (PARTITION BY stream ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT stream, min(event_id) AS stop_at FROM r WHERE stop GROUP BY stream""")
def crawl_stop(s, d):
    return quality.first_stop(quality.running_failures(_attempts(s, d), "stream", "event_id", "failed"), "stream", "event_id")


@query(f"""WITH {_ATT}, i AS (SELECT *, sum((status = 200)::INT) OVER (PARTITION BY stream ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS island FROM att),
r AS (SELECT *, sum((status = 403)::INT) OVER (PARTITION BY stream, island ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS refusals FROM i)
SELECT event_id, refusals::BIGINT AS refusals, status = 429 OR (status = 403 AND island > 0 AND refusals >= 3) AS stop FROM r""")
def refusal_runs(s, d):
    return quality.refusal_runs(_attempts(s, d), "stream", "event_id", "status").select("event_id", "refusals", "stop")


@query(f"""WITH {_ATT}, i AS (SELECT *, sum((NOT failed)::INT) OVER (PARTITION BY stream ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS island FROM att),
r AS (SELECT *, sum(failed::INT) OVER (PARTITION BY stream, island ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM i),
k AS (SELECT stream, event_id, row_number() OVER (PARTITION BY stream ORDER BY event_id) AS k FROM r WHERE failed AND run % 3 = 0)
SELECT stream, min(event_id) AS restart_at, max(CASE WHEN k = 2 THEN event_id END) AS stop_at FROM k WHERE k <= 2 GROUP BY stream""")
def unreachable_stops(s, d):
    """With three failures in a row, which these events have."""
    return quality.unreachable(_attempts(s, d), "stream", "event_id", "failed", 3)


@query("SELECT count(*) AS n, count(*) BETWEEN 2500 AND 6000 AS in_range FROM chunks")
def chunk_count(s, d):
    return quality.count_in_range(t(s, d, "chunks"), 2500, 6000)


@query("""SELECT id, CASE WHEN embedding IS NULL THEN 'missing' WHEN len(embedding) <> 64 THEN 'wrong length' WHEN len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) > 0 THEN 'not a number' ELSE 'all zero' END AS defect FROM chunk_vectors
  WHERE embedding IS NULL OR len(embedding) <> 64 OR len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) > 0 OR len(list_filter(embedding, lambda x: x <> 0)) = 0""")
def vector_defects(s, d):
    return quality.vector_defects(t(s, d, "chunk_vectors"), "id", "embedding", 64)


_TURNS = "turns AS (SELECT user_id AS conv_id, event_id AS turn, CASE event_type WHEN 'view' THEN 'user' WHEN 'click' THEN 'assistant' WHEN 'purchase' THEN 'user' ELSE 'system' END AS role, event_type || '   said' || chr(10) || props AS content FROM events)"


def _turns(s, d):
    role = F.when(F.col("event_type").isin("view", "purchase"), "user").when(F.col("event_type") == "click", "assistant").otherwise("system")
    return t(s, d, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), role.alias("role"), F.concat("event_type", F.lit("   said\n"), "props").alias("content"))


@query(f"WITH {_TURNS} SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM turns WHERE role IN ('user', 'assistant') AND content IS NOT NULL) WHERE k <= 12")
def history_window(s, d):
    return conversation.sanitize(_turns(s, d)).select("conv_id", "turn")


@query(f"""WITH {_TURNS}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM turns WHERE role IN ('user', 'assistant') AND content IS NOT NULL) WHERE k <= 12)
SELECT conv_id, right(string_agg(CASE WHEN role = 'user' THEN 'Student: ' ELSE 'Assistant: ' END || left(trim(regexp_replace(content, '{_SP}+', ' ', 'g')), 400), chr(10) ORDER BY turn), 1200) AS history FROM k GROUP BY conv_id""")
def format_history(s, d):
    return conversation.history(_turns(s, d))


@query(f"""WITH {_TURNS} SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN content END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM turns""")
def last_user_turn(s, d):
    return conversation.last_user_turn(_turns(s, d)).select("conv_id", "turn", "previous")


@query("""WITH a AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings) SELECT vec_id, round(list_max(list_transform(x, lambda v: abs(v))), 9) AS peak, round(sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)), 9) AS rms FROM a""")
def audio_levels(s, d):
    """Vectors as sound samples."""
    x = F.col("embedding")
    return t(s, d, "embeddings").select("vec_id", F.round(audio.peak(x), 9).alias("peak"), F.round(audio.rms(x), 9).alias("rms"))


@query("""WITH a AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), i AS (SELECT vec_id, x, unnest(range(21)) AS i FROM a)
SELECT vec_id, i::INT AS i, round(x[floor(i * 3.0)::INT + 1] * (1 - (i * 3.0::DOUBLE - floor(i * 3.0))) + x[least(floor(i * 3.0)::INT + 1, 63) + 1] * (i * 3.0::DOUBLE - floor(i * 3.0)), 9) AS v FROM i""")
def audio_resampled(s, d):
    return t(s, d, "embeddings").select("vec_id", F.posexplode(audio.resampled(F.col("embedding"), 48000, 16000)).alias("i", "v")).select("vec_id", "i", F.round("v", 9).alias("v"))
