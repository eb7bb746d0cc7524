from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.functions.html import html_to_text_udf, read_html, same_host_links
from loomwork.operators import chunking as C
from loomwork.operators import guards as G


def test_table_with_spans():
    html = "<table><tr><th rowspan=2>No</th><th colspan='2'>Fee</th></tr><tr><td>A</td><td> B\n b</td></tr><tr></tr><tr><td>1</td><td>2</td></tr><tr><td></td></tr></table>"
    assert read_html(html)[1].splitlines() == ["| No | Fee |  |", "|---|---|---|", "| No | A | B b |", "| 1 | 2 |  |"]


def test_html_text_drops_furniture_and_survives_bad_markup():
    title, text, links = read_html("<title> T </title><nav>menu</nav><p><b>one<br><p>two<script>var a = '</p>'</script><a href='x.pdf'>three</a><footer>end")
    assert (title, text, links) == ("T", "one\ntwo\nthree", ["x.pdf"])
    assert read_html("<p>out</p><div id=main><p>in</p></div>", root_id="main")[1] == "in"


def test_html_udf_handles_nulls(spark):
    df = spark.createDataFrame([(None,), ("",), ("<p>x",)], "html string")
    assert [r.t.text for r in df.select(html_to_text_udf()("html").alias("t")).collect()] == ["", "", "x"]
    links = spark.createDataFrame([("https://a.example/x/", ["y#z", "https://b.example/", "/y", "y"])], "u string, l array<string>")
    assert links.select(same_host_links("u", "l").alias("l")).first().l == ["https://a.example/x/y", "https://a.example/y"]


def test_source_years(spark):
    rows = [("https://x/uploads/2021/03/a.pdf", "s"), ("https://x/a-2023-24.pdf", "s"), ("https://x/h-2022.pdf", "s"), ("https://x/p/", "s"), ("https://x/2024-05-10/", "s"), (None, None)]
    df = spark.createDataFrame(rows, "u string, s string")
    got = df.select(T.source_year(F.col("u"), F.col("s")).alias("y"), T.source_year(F.col("u"), F.col("s"), strict=True).alias("z")).collect()
    assert [r.y for r in got] == ["2021", "2024", "2022", None, "2005", None]
    assert [r.z for r in got][4] is None


def test_windows_cover_the_words():
    for n in (0, 1, 384, 385, 720, 721, 2000):
        text = " ".join(f"w{i}" for i in range(n))
        w = C.windows(text)
        assert {x for p in w for x in p.split()} == set(text.split())
        assert all(len(p.split()) <= 384 for p in w)
        assert len(w) == (0 if not n else 1 if n <= 384 else -(-(n - 384) // 336) + 1)


def test_chunks():
    block = "word " * 150
    table = "| a | b |\n|---|---|\n" + "\n".join(f"| {i} | x |" for i in range(20))
    text = f"{block}\n\n{block}\n\n{block}\n\n{table}\n\nend."
    got = C.chunks(text)
    assert table in got and got[-1] == "end." and all(C.size(c) <= 512 or C.is_table(c) for c in got)
    assert got[0].split("\n\n")[-1] == got[1].split("\n\n")[0]  # overlap by a block
    assert C.chunks("") == C.chunks(None) == []


def test_large_tables_end_and_keep_their_header():
    big = "| h | k |\n|---|---|\n" + "\n".join(f"| {i} | {'x ' * 20}|" for i in range(300))
    parts = C.table_parts(big)
    assert len(parts) > 1 and all(p.startswith("| h | k |\n|---|---|") for p in parts) and all(C.size(p) <= C.P.TABLE_TOKENS for p in parts)
    for odd in ("|---|\n|---|\n|---|", "|  |\n|---|\n| |\n| a |"):
        assert C.table_parts(odd)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .|-\n", max_size=400))
def test_chunks_lose_no_word(text):
    assert {w for c in C.chunks(text) for w in c.split()} >= {w for b in C.blocks(text) for w in b.split()}


def test_replies():
    urls = ["u1", "u2", "u1"]
    assert G.parse_reply("ANSWERED: yes\nSOURCES_USED: 2, 7\n---\nBody", urls) == {"answered": True, "citations": ["u2"], "body": "Body"}
    assert G.parse_reply("**ANSWERED:** NO\nSOURCES_USED: none\n---\nNothing", urls) == {"answered": False, "citations": [], "body": "Nothing"}
    assert G.parse_reply("free text", urls)["citations"] == ["u1", "u2"]
    assert "ANSWERED" not in G.parse_reply("Sure\n- ANSWERED: yes\nBody\n# SOURCES_USED: 1", urls)["body"]
    assert G.parse_reply(None, None)["body"] == ""


def test_terms_and_periods():
    text = "Dean of X, September 2019 to August 2023. Built 2001-2005 on the hill."
    assert G.terms_ended(text, 2026)[0] == "2019-2023" and G.terms_ended(text, 2023) == ["2001-2005"]
    assert G.terms_ended("Fees 2019-2023", 2026) == []
    table = "| Program | Per semester |\n|---|---|\n| CS | 75,000 |"
    assert G.periodic("75,000", [table]) and not G.periodic("5,000", [table])
    assert not G.periodic("75,000", ["It is Rs. 75,000 once. The semester begins."])


def test_claims(spark):
    df = spark.createDataFrame([("Dr. Umar Haq paid 75,000 in 2024, see [1], [2].", "Ishaq 175,000 2024")], "b string, e string")
    r = df.select(G.unsupported_names(F.col("b"), F.col("e")).alias("n"), G.unsupported_figures(F.col("b"), F.col("e")).alias("f"), G.unsupported_figures(F.col("b"), F.col("e"), True).alias("g")).first()
    assert (r.n, r.f, r.g) == (["Umar Haq"], [], ["75,000"])
