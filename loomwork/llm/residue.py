"""Problem 5: template residue, filler, error messages and demands for scripts.

A record's title parts and URL path parts are its passages. Trusted ones are template syntax, standard
filler, statuses, and passages equal to one of the given ``RECORDS``. A naive Bayes model over words and
word pairs is fitted by expectation-maximization to trusted wordings (positive) and all other passages
(unlabelled), in which unlabelled passages move over to the positive side as far as the model believes
it. A passage can only be believed if more than half of its content words are known from trusted
wordings and speak for it, so pages about errors, scripts or templates, whose other words are of their
subject, stay. A record is bad if one of its passages is, and a page is bad with all entries that
``canonical`` finds to be copies.

Counts are aggregated over all passages. Only undecided passages move, which have mostly trusted words and
are few; rounds go over them on the driver if counted to be at most ``held``, else by aggregations with
the same result. The driver holds the features of these and of trusted wordings; every record is scored.

Defined results: null and empty titles say nothing; a null URL gives no passages; entries without
url or slug are judged alone; copies count with their page even if their own title is blank; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.physical import materialize, skew_join
from .canonical import digest, page_key


@dataclass(frozen=True)
class Fit:
    """``held``: most undecided passages that are fitted on the driver; ``weight``: entries that each
    given record counts as; ``least``: entries a feature must be in; ``strong``, ``pair``: log odds from
    which a word or a word pair speaks for a passage; ``covered``: part of the content words that must."""

    held: int = 100_000
    rounds: int = 8
    smoothing: float = 0.5
    threshold: float = 0.5
    least: int = 2
    weight: int = 3
    strong: float = 1.0
    pair: float = 0.5
    covered: float = 0.5


# Template syntax of common engines, unfilled: these can't be content.
_NAME = r"[A-Za-z][\w.\- ]*"
SYNTAX = re.compile(
    rf"""\{{\{{\s*{_NAME}\}}\}} | \{{%-?\s*{_NAME}-?%\}} | <%[=-]?\s*{_NAME}%> | [$\#]\{{\s*{_NAME}\}} | %%\s*{_NAME}%%
    | @@\s*{_NAME}@@ | \[\[\s*{_NAME}\]\] | (?<!\w)__\s*[A-Za-z][\w.\-]*?__(?!\w) | (?<![\w$\#\{{])\{{[A-Za-z][\w.\-]{{2,}}\}}(?!\}})
    | (?<![\w\]])\[(?:[A-Za-z]+_[A-Za-z_]+|title|heading|name|subtitle|headline|page|slug|url)\] | <(?:[A-Za-z]+[ _-])?(?:title|name|page|heading|slug)>
    | &lt;/?\w+&gt; | \[object\ object\] | (?:^|\s)%[sd](?:$|\s) | \{{\d\}} | (?:^|/):[a-z]+_[a-z]+ | (?:^|/)%[a-z]+%(?:$|/)""",
    re.X | re.I,
)
# Trusted records, which are default messages of servers, browsers' script notices and
# placeholders of site generators; case, punctuation and digits evened out.
RECORDS = tuple(
    """page not found|the page could not be found|oops that page can't be found|the page you asked for no longer exists
this page is no longer available|the page was moved or deleted|the page cannot be shown|the page failed to load
your request produced an error|we could not process your request|something went wrong|sorry this record could not be found
notice the file you want could not be found|seite nicht gefunden|page introuvable|página no encontrada|pagina no encontrada
access denied|nothing found here|we are sorry|your session has expired|too many requests try again later
this site is temporarily down for maintenance|error establishing a database connection
warning undefined variable in index php on line 0|fatal error memory limit reached in index php
enable javascript|please enable javascript to continue|javascript is required to view this page|this page needs javascript
you need to turn on javascript to use this site|javascript disabled|please turn on scripts in your browser
bitte javascript aktivieren|activez javascript pour afficher cette page|noscript|noscript scripts must be switched on
kindly activate javascript and reload|your browser does not run scripts|this app does not work without javascript
just a moment|checking your browser before you continue|to go on switch on active content and reload
you must allow js to see this page|please enable scripting
hello world|sample page|just another site|untitled document|new page copy of copy|placeholder|this is a placeholder page
dummy page 0|demo content|lipsum generator text|page title here|your heading goes here|your page url here|insert title
insert slug here|type the title of the page|todo title|title of document replace me|please delete|xxx 0 course title
undefined|null|blah blah|asdf qwerty|asdf asdf""".replace("\n", "|").split("|")
)
FILLER = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua"
FILLED = ("lorem ipsum ", "sample text for ")  # before any subject
STATUS_NAMES = ("bad request", "unauthorized", "forbidden", "not found", "gone", "too many requests", "internal server error", "bad gateway", "service unavailable", "gateway time-out")
FUNCTION = frozenset("a an and at before by can do does for from in is it no not of on or so than that the then this to was we when with you your".split())
_NAMES = "|".join(STATUS_NAMES).replace("time-out", "time-?out")
_ALONE = "|".join(n for n in STATUS_NAMES if " " in n and n != "bad request" and n != "too many requests").replace("time-out", "time-?out")
STATUS = re.compile(rf"(?:error |http |http error )?[45]\d\d(?:\W+(?:{_NAMES}))?(?:\.html?)?|(?:{_NAMES})(?:\s*\([45]\d\d\)|\s+[45]\d\d)|{_ALONE}|errors?\.html?")
SAME = re.compile(r"(\w{3,})(?:\W+\1)+|(\w)\2{3,}(?:\W+\2{3,})*")  # one word or letter again and again
_KNOWN = frozenset(RECORDS)
_FILLER = frozenset(FILLER.split())
_CODE = re.compile(r"\b[a-z]{2}\s?[-–_]\s?\d{3}\b", re.I)
_PARTS = re.compile(r"\s+(?:\||::|–|—|-)\s+|\s{0,1}\|\s{0,1}")
_TOKEN = re.compile(r"[^\W\d_]+|\d+")


def passages(url: str | None, title: str | None) -> list[str]:
    """Title parts and path parts, white space and case evened out."""
    out = []
    if title and title.strip():
        even = " ".join(title.split()).lower()
        parts = [p for p in _PARTS.split(even) if p.strip()]
        out += parts
        if SYNTAX.search(even) and not any(SYNTAX.search(p) for p in parts):
            out.append(even)
    if url:
        path = re.sub(r"^\s*[a-z][a-z+.\-]*://[^/?]*", "", unquote(url).lower().strip(), flags=re.I).partition("?")[0]
        out += ["/" + " ".join(p.split()) for p in path.split("/") if p.strip("#.~​ ")]
    return out


def kind(passage: str) -> int:
    """1: trusted wording; 2: trusted, but its words teach nothing (template syntax, filler around a
    subject, repetition); 0: unlabelled."""
    if SYNTAX.search(passage):
        return 2
    bare = passage[1:].replace("-", " ").replace("_", " ") if passage[:1] == "/" else passage
    text = " ".join(re.sub(r"[^\w'’ ]+", " ", bare.replace(".html", "")).split())
    words = text.split()
    if text.startswith(FILLED) or SAME.fullmatch(text):
        return 2
    return int(re.sub(r"\d+", "0", text) in _KNOWN or bool(STATUS.fullmatch(bare)) or len(words) > 1 and all(w in _FILLER for w in words))


def features(passage: str) -> list[str]:
    """Words and word pairs with the ends marked; numbers by their kind. A path part's last word is
    its page's own and left out if it follows others."""
    coded = _CODE.sub(" codexx ", passage)
    words = ["codexx" if w == "codexx" else ("4xx5xx" if re.fullmatch(r"[45]\d\d", w) else "0") if w.isdigit() else w for w in _TOKEN.findall(coded)]
    if passage[:1] == "/" and len(words) > 1:
        words = words[:-1]
        ends = [*words, "/"]
    else:
        ends = [*words, "$"]
    if not words:
        return []
    return words + [f"{a} {b}" for a, b in zip(["^", *words], ends)]


@dataclass(frozen=True)
class Model:
    """Log odds of features, the prior under ``""``; the features of trusted wordings."""

    odds: dict[str, float]
    told: frozenset[str]


def given_records(conf: Fit) -> list[tuple[str, int, int]]:
    """(passage, kind, entries) of the records that every fit starts from."""
    statuses = [x for n in STATUS_NAMES for x in (n, f"{n} 503", f"404 {n}")]
    return [(r, 1, conf.weight) for r in [*RECORDS, FILLER, *statuses]]


def _content(words: list[str]) -> list[int]:
    return [i for i, w in enumerate(words) if w != "0" and w not in FUNCTION]


def may_be_believed(fs: list[str], told, conf: Fit) -> bool:
    """Necessary for ``believed`` under any odds."""
    words = [f for f in fs if " " not in f]
    at = _content(words)
    return sum(words[i] in told for i in at) > conf.covered * len(at)


def believed(fs: list[str], model: Model, conf: Fit, path: bool = False) -> float:
    """Belief that a passage with these features is residue. Words that are strong themselves or part of
    a pair that is must cover it; a path part, which is short, must have all its pairs from trusted
    wordings; a single word is trusted or nothing."""
    n = sum(" " not in f for f in fs)
    if n < 2:
        return 0.0
    speaks = lambda f, least: f in model.told and model.odds.get(f, 0.0) >= least
    pairs = [speaks(f, conf.pair) for f in fs[n + 1 : -1]]  # between its words
    if path and not all(pairs):
        return 0.0
    at = _content(fs[:n])
    good = sum(speaks(fs[i], conf.strong) or i > 0 and pairs[i - 1] or i < n - 1 and pairs[i] for i in at)
    return _belief(fs, model.odds) if good > conf.covered * len(at) else 0.0


def _belief(fs: list[str], odds: dict[str, float]) -> float:
    # words and pairs overlap, so they count half each
    s = odds.get("", -9.0) + 0.5 * sum(odds.get(f, 0.0) for f in fs)
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, s))))


def score(passage: str, model: Model, conf: Fit = Fit()) -> float:
    return 1.0 if kind(passage) else believed(features(passage), model, conf, passage[:1] == "/")


def _list_passages(batches):
    schema = pa.schema([("passage", pa.string()), ("kind", pa.int32()), ("n", pa.int64())])
    for b in batches:
        found = Counter(p for u, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for p in passages(u, t))
        names = sorted(found)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([kind(p) for p in names], pa.int32()), pa.array([found[p] for p in names], pa.int64())], schema=schema)


def _judge(shared, conf: Fit):
    schema = pa.schema([("row_id", pa.int64()), ("h", pa.binary()), ("bad", pa.int32())])

    def run(batches):
        model = shared.value
        memo: dict[str, bool] = {}
        for b in batches:
            bad = []
            for u, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                hit = False
                for p in passages(u, t):
                    known = memo.get(p)
                    if known is None:
                        if len(memo) > 500_000:
                            memo.clear()
                        known = memo[p] = score(p, model, conf) >= conf.threshold
                    hit = hit or known
                bad.append(int(hit))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bad, pa.int32())], schema=schema)

    return run


_STATS = pa.schema([("feature", pa.string()), *[(c, pa.int64()) for c in ("seen", "uses", "sure_uses")]])


def _feature_rows(batches):
    """For each feature: entries, uses, uses in trusted wordings; under ``""`` of all passages."""
    for b in batches:
        sums: dict[str, list[int]] = {}
        for p, sure, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            held = Counter(features(p))
            if held:
                held[""] = 1
            for f, k in held.items():
                s = sums.setdefault(f, [0, 0, 0])
                for i, x in enumerate((n, k * n, k * n * sure)):
                    s[i] += x
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*((f, *s) for f, s in sums.items())) if sums else [[]] * 4, _STATS.types)], schema=_STATS)


def _undecided(shared, conf: Fit):
    schema = pa.schema([("fs", pa.list_(pa.string())), ("path", pa.bool_()), ("n", pa.int64())])

    def run(batches):
        told = shared.value
        for b in batches:
            rows = [(features(p), p[:1] == "/", n) for p, sure, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()) if not sure]
            rows = [r for r in rows if may_be_believed(r[0], told, conf)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.types)], schema=schema)

    return run


def move(rows, before: Model | None, model: Model, conf: Fit) -> dict[str, list[float]]:
    """Mass that undecided passages (features, path, entries) bring to each feature's positive side; under
    ``""`` their belief and how far it moved."""
    sums: dict[str, list[float]] = {"": [0.0, 0.0]}
    for fs, path, n in rows:
        now = believed(fs, model, conf, path)
        sums[""][0] += now * n
        sums[""][1] += abs(now - (believed(fs, before, conf, path) if before else 0.0)) * n
        if now > 0:
            for f in fs:
                if f in model.odds:
                    sums.setdefault(f, [0.0, 0.0])[0] += now * n
    return sums


def _moves(shared, conf: Fit):
    schema = pa.schema([("feature", pa.string()), ("pos", pa.float64()), ("moved", pa.float64())])

    def run(batches):
        before, model = shared.value
        for b in batches:
            sums = move(zip(*(b.column(i).to_pylist() for i in range(3))), before, model, conf)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([s[0] for s in sums.values()]), pa.array([s[1] for s in sums.values()])], schema=schema)

    return run


def fit(listed: DataFrame, conf: Fit = Fit()) -> Model:
    """The model from a table (passage, kind, n) of all passages."""
    spark = listed.sparkSession
    share_with = spark.sparkContext.broadcast
    taught = listed.filter("kind < 2").select("passage", "kind", "n").unionByName(spark.createDataFrame(given_records(conf), "passage string, kind int, n bigint"))
    counts = ["seen", "uses", "sure_uses"]
    stats = taught.mapInArrow(_feature_rows, "feature string, " + ", ".join(f"{c} bigint" for c in counts))
    stats = materialize(stats.groupBy("feature").agg(*[F.sum(c).alias(c) for c in counts]))
    top = stats.filter("feature = ''").first()
    known = stats.filter(F.col("feature") != "").filter((F.col("seen") >= conf.least) | (F.col("sure_uses") > 0))
    told = frozenset(r[0] for r in known.filter("sure_uses > 0").select("feature").collect())  # of given wordings only
    free = materialize(taught.mapInArrow(_undecided(share_with(told), conf), "fs array<string>, path boolean, n bigint"))
    needed = free.select(F.explode("fs").alias("feature")).distinct().withColumn("free", F.lit(True))
    base = {r[0]: (r[1], r[2]) for r in known.join(needed, "feature", "left").filter("free OR sure_uses > 0").select("feature", "sure_uses", "uses").collect()}
    sure_uses, uses = known.agg(F.sum("sure_uses"), F.sum("uses")).first()
    sure_n = taught.filter("kind = 1").agg(F.sum("n")).first()[0]
    few = free.limit(conf.held + 1).count() <= conf.held
    rows = [tuple(r) for r in free.collect()] if few else []
    moved: dict[str, list[float]] = {}
    before, model = None, Model({}, told)
    for _ in range(conf.rounds):
        more = {f: s[0] for f, s in moved.items() if f}
        part, a, odds = min(1 - 1e-6, (sure_uses + sum(more.values())) / uses), conf.smoothing, {}
        for f, (sure, every) in base.items():
            pos = sure + more.get(f, 0.0)
            # a prior around what chance would give: a feature that was never seen says nothing
            odds[f] = math.log((pos + a * part) / part) - math.log((every - pos + a * (1 - part)) / (1 - part))
        share = min(0.5, max(1e-4, (sure_n + moved.get("", [0.0])[0]) / top["seen"]))
        odds[""] = math.log(share / (1 - share))
        before, model = model if model.odds else None, Model(odds, told)
        if few:
            moved = move(rows, before, model, conf)
        else:
            sums = free.mapInArrow(_moves(share_with((before, model)), conf), "feature string, pos double, moved double")
            moved = {r[0]: [r[1], r[2]] for r in sums.groupBy("feature").agg(F.sum("pos"), F.sum("moved")).collect()}
        if moved.get("", [0.0, 0.0])[1] < 1e-5 * top["seen"]:
            break
    return model


def model_of(manifest: DataFrame, conf: Fit = Fit()) -> Model:
    return fit(materialize(manifest.select("url", "title").mapInArrow(_list_passages, "passage string, kind int, n bigint").groupBy("passage").agg(F.max("kind").alias("kind"), F.sum("n").alias("n"))), conf)


def bad_entries(manifest: DataFrame, conf: Fit = Fit()) -> DataFrame:
    """(row_id) of all entries of pages with residue."""
    model = manifest.sparkSession.sparkContext.broadcast(model_of(manifest, conf))
    key = F.when(F.col("url").isNotNull() & F.col("slug").isNotNull(), digest(page_key()))
    rows = manifest.select(F.col("row_id").cast("bigint"), key.alias("h"), "url", "title")
    judged = materialize(rows.mapInArrow(_judge(model, conf), "row_id bigint, h binary, bad int"))
    pages = materialize(judged.filter("h IS NOT NULL").groupBy("h").agg(F.max("bad").alias("page_bad"), F.count(F.lit(1)).alias("n")).filter("page_bad = 1"))
    found = skew_join(judged.filter("h IS NOT NULL"), pages, "h", "n", judged.count()).select("row_id")
    return found.unionByName(judged.filter("h IS NULL AND bad = 1").select("row_id")).distinct()


def without_residue(manifest: DataFrame, conf: Fit = Fit()) -> DataFrame:
    """The manifest without these entries."""
    return manifest.join(bad_entries(manifest, conf), "row_id", "left_anti").select(manifest.columns)
