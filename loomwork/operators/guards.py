"""Deterministic checks of answers against their evidence, and the decision what to show.

Model replies are input columns. Evidence is an array of structs (source_url, title, text,
source_date). Checks are native expressions, but for the reply parser and the scan for ended terms,
which need match offsets and run as Arrow functions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import patterns as P
from ..functions import text as T

_HEADER = re.compile(P.HEADER_LINE)
_SEPARATOR = re.compile(P.SEPARATOR_LINE)
_PAST = re.compile(P.PAST_TERM)


def swept(text: str) -> str:
    """Without header lines, and without separators before the first line that stays."""
    kept: list[str] = []
    for line in text.splitlines():
        if not _HEADER.match(line) and (kept or not _SEPARATOR.match(line)):
            kept.append(line)
    return "\n".join(kept).strip()


def parse_reply(raw: str | None, urls) -> dict:
    """answered, citations, body of a structured reply. The header may be decorated and may come within
    the first eight lines; a reply without one counts as answered; citations are valid numbers of
    sources, or all of them where an answer names none."""
    raw = raw or ""
    urls = list(urls if urls is not None else ())
    rows = raw.splitlines()
    answered, numbers, found, used = True, [], False, 0
    for row in rows[:8]:
        m = _HEADER.match(row)
        if m:
            found = True
            if m[1].upper() == "ANSWERED":
                answered = "NO" not in m[2].strip().upper()[:3]
            else:
                numbers = [int(x) for x in re.findall(r"\d+", m[2])]
        elif found and row.strip():
            used += bool(_SEPARATOR.match(row))
            break
        used += 1
    body = raw
    if found:
        rest = rows[used:]
        skip = 0
        while skip < len(rest) and (rest[skip].strip() in ("", "---") or rest[skip].strip().upper().startswith(("ANSWERED:", "SOURCES_USED:"))):
            skip += 1
        body = "\n".join(rest[skip:]).strip()
    body = swept(body) or swept(raw)
    named = [urls[k - 1] for k in numbers if 1 <= k <= len(urls)]
    cited = list(dict.fromkeys(u for u in named if u))
    if answered and not cited:
        cited = list(dict.fromkeys(u for u in urls if u))
    return {"answered": answered, "citations": cited, "body": body}


@F.pandas_udf(S.StructType().add("answered", S.BooleanType()).add("citations", S.ArrayType(S.StringType())).add("body", S.StringType()))
def parse_structured(raw: pd.Series, urls: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_reply(r, u) for r, u in zip(raw, urls)], columns=["answered", "citations", "body"])


def terms_ended(text: str | None, year: int) -> list[str]:
    """Spans of years that ended before ``year`` with a role named close by."""
    out = []
    for m in _PAST.finditer(text or ""):
        near = text[max(0, m.start() - 120) : m.end() + 40].lower()
        if int(m[2]) < year and any(w in near for w in P.ROLE_WORDS):
            out.append(f"{m[1]}-{m[2]}")
    return out


@F.pandas_udf(S.ArrayType(S.StringType()))
def ended_terms(texts: pd.Series, years: pd.Series) -> pd.Series:
    return pd.Series([terms_ended(t, int(y)) for t, y in zip(texts, years)], dtype=object)


def support(body: Column, evidence_text: Column) -> Column:
    """Part of an answer's different content words that its evidence has; 1 where the answer is too
    short to tell or there is no evidence."""
    own, theirs = T.content_vocabulary(body), T.content_vocabulary(evidence_text)
    share = F.size(F.array_intersect(own, theirs)) / F.size(own)
    return F.when((F.size(own) < P.SUPPORT_WORDS) | evidence_text.isNull(), F.lit(1.0)).otherwise(share)


def evidence_text(evidence: Column) -> Column:
    """Title, address and text of all sources, which is what a claim may rest on."""
    part = lambda h: F.concat_ws(" ", F.coalesce(h["title"], F.lit("")), F.coalesce(h["source_url"], F.lit("")), F.coalesce(h["text"], F.lit("")))
    return F.array_join(F.transform(evidence, part), " ")


def unsupported_figures(body: Column, haystack: Column, boundary: bool = False) -> Column:
    """Figures of the answer that the evidence lacks, commas and blanks aside. ``boundary``: a figure
    must stand by itself in the evidence (75,000 isn't in 175,000)."""
    if boundary:
        known = F.transform(F.regexp_extract_all(haystack, F.lit(r"\d+(?:,\d{3})*"), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit("")))
        return F.filter(T.figures(body), lambda x: ~F.array_contains(known, F.replace(x, F.lit(","), F.lit(""))))
    bare = F.regexp_replace(haystack, r"[,\s]", "")
    return F.filter(T.figures(body), lambda x: ~F.contains(bare, F.replace(x, F.lit(","), F.lit(""))))


def unsupported_names(body: Column, haystack: Column) -> Column:
    """Titled names whose last part isn't a word of the evidence."""
    even = F.lower(F.regexp_replace(haystack, r"\s+", " "))
    noise = F.array(*[F.lit(x) for x in P.NAME_NOISE])

    def surname(name: Column) -> Column:
        parts = F.filter(F.split(name, r"\s+"), lambda p: (F.length(p) > 2) & ~F.array_contains(noise, F.regexp_replace(F.lower(p), r"^\.+|\.+$", "")))
        return F.regexp_replace(F.lower(F.try_element_at(parts, F.lit(-1))), r"^[.,]+|[.,]+$", "")

    def missing(name: Column) -> Column:
        s = surname(name)
        quoted = F.regexp_replace(s, r"([^a-z0-9])", r"\\$1")
        return s.isNotNull() & ~F.rlike(even, F.concat(F.lit(r"\b"), quoted, F.lit(r"\b")))

    return F.filter(T.titled_names(body), missing)


def source_note(source_date: Column, ended: Column, year: int) -> Column:
    y = F.expr("try_cast(source_date AS INT)") if source_date is None else source_date.try_cast("int")
    dated = F.coalesce(source_date, F.lit("")) != ""
    none = F.lit(None).cast("string")
    return F.concat_ws(
        "; ",
        F.when(dated, F.concat(F.lit("published "), source_date)).otherwise("live website page, no publication date, kept up to date"),
        F.when(dated & (y < year), F.concat((F.lit(year) - y).cast("string"), F.lit(" year(s) old — may be superseded"))).otherwise(none),
        F.when(F.size(ended) > 0, F.concat(F.lit("WARNING: mentions a role with an ENDED term ("), F.array_join(ended, ", "), F.lit(") — that person is a FORMER holder, not the current one"))).otherwise(none),
    )


def provenance(years: Column, body: Column, year: int) -> Column:
    """A closing line with the sources' years, newest first; empty where the text names them all."""
    listed = F.reverse(F.array_sort(F.array_distinct(F.filter(years, lambda y: y.isNotNull() & (y != "")))))
    told = F.transform(listed, lambda y: F.when(y.cast("int") < year, F.concat(y, F.lit(" ("), (F.lit(year) - y.cast("int")).cast("string"), F.lit(" yr old)"))).otherwise(y))
    silent = (F.size(listed) == 0) | F.forall(listed, lambda y: F.contains(body, y))
    return F.when(silent, "").otherwise(F.concat(F.lit("\n\nSource dates: "), F.array_join(told, ", "), F.lit(". Newer information may supersede this.")))


def decide_mode(n_hits: Column, top: Column, answered: Column, body: Column, supported: Column, unsupported: Column, kind: Column) -> Column:
    """GROUNDED, GENERAL or REFUSE from what the checks found."""
    shown = (n_hits > 0) & (top >= P.RELEVANCE_FLOOR) & answered & (F.trim(F.coalesce(body, F.lit(""))) != "")
    return F.when(shown & (supported >= P.SUPPORT_GATE) & (unsupported == 0), "GROUNDED").when(kind == "GENERIC", "GENERAL").otherwise("REFUSE")


def contract_failures(mode: Column, expected: Column, text: Column, citations: Column, retrieved: Column, flag: str, site: str, contacts: tuple[str, ...], bare_figure: Column | None = None) -> Column:
    """What an answer breaks of its mode's contract, as a list of messages. ``bare_figure``: a grounded
    answer's figure that lacks its period (``figure_without_period``), if it has one."""
    low = F.lower(F.coalesce(text, F.lit("")))
    none = F.lit(None).cast("string")
    when = lambda cond, message: F.when(cond, message).otherwise(none)
    foreign = F.transform(F.array_except(citations, retrieved), lambda c: F.concat(F.lit("citation not in retrieved set: "), c))
    some = F.lit(False)
    for c in contacts:
        some = some | F.contains(low, F.lit(c))
    checks = F.array(
        when((mode == "GROUNDED") & (F.size(citations) == 0), "GROUNDED with no citation"),
        when((mode == "GENERAL") & ~F.contains(text, F.lit(flag)), "GENERAL without the visible flag"),
        when((mode == "GENERAL") & (F.size(citations) > 0), "GENERAL carrying citations"),
        when((mode == "GENERAL") & F.contains(low, F.lit(site)), "GENERAL text references the site"),
        when((mode == "REFUSE") & ~some, "REFUSE without pointing anywhere to ask"),
        when((mode == "REFUSE") & (F.size(citations) > 0), "REFUSE carrying citations"),
        none if bare_figure is None else when((mode == "GROUNDED") & bare_figure.isNotNull(), F.concat(F.lit("periodic figure "), bare_figure, F.lit(" quoted without its period"))),
        when(mode != expected, F.concat(F.lit("mode "), mode, F.lit(", expected "), expected)),
    )
    return F.concat(F.array_compact(checks), F.when(mode == "GROUNDED", foreign).otherwise(F.array().cast("array<string>")))


_SENTENCES = re.compile(r"(?<!\bRs)(?<!\bNo)(?<!\bDr)(?<!\bMr)(?<!\bMs)(?<=[.!?])\s+(?=[A-Z])")


def periodic(figure: str, texts) -> bool:
    """The figure stands in a sentence, or under a table header up to six lines above, that names a period."""
    here = re.compile(rf"(?<![\d,]){re.escape(figure)}(?![\d,])")
    names = lambda s: any(w in s.lower() for w in P.PERIOD_WORDS)
    bar = lambda s: s.lstrip().startswith("|")
    for text in texts if texts is not None else ():
        rows = (text or "").splitlines()
        for i, row in enumerate(rows):
            if here.search(row):
                around = [r for r in rows[max(0, i - 6) : i] if bar(r)] if bar(row) else [s for s in _SENTENCES.split(row) if here.search(s)]
                if any(map(names, around)):
                    return True
    return False


@F.pandas_udf(S.BooleanType())
def is_periodic(figure: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([periodic(f, t) for f, t in zip(figure, texts)])


@F.pandas_udf(S.StringType())
def figure_without_period(body: pd.Series, texts: pd.Series) -> pd.Series:
    """The first figure of an answer that its evidence gives for a period, where the answer names none."""

    def first(text: str | None, evidence) -> str | None:
        if not text or any(m in text.lower() for m in P.PERIOD_MARKERS):
            return None
        return next((f for f in re.findall(P.PERIODIC_FIGURE, text) if periodic(f, evidence)), None)

    return pd.Series([first(b, t) for b, t in zip(body, texts)], dtype=object)


def prompt_sources(evidence: Column, notes: Column) -> Column:
    """The numbered sources of a prompt: address, currency note, text."""
    part = lambda h, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(h["source_url"], F.lit("")), F.lit("\nCURRENCY: "), F.get(notes, i), F.lit("\n"), F.coalesce(h["text"], F.lit("")))
    return F.array_join(F.transform(evidence, part), "\n\n")
