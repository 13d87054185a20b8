"""Personal data: spans found by fixed patterns, and further spans by weak supervision.

DataFrame expressions only. Patterns give the base spans (e-mail, IP, card, phone) and weaker
candidates (numbers and keys that no base rule accepts). Labelers vote 1, 0 or -1 on each span:

* shape: whether a strict format accepts it,
* check: checksum, value ranges,
* gazetteer: top-level domains, card issuer prefixes, country codes, address ranges,
* context: cue words in the 24 characters before it,
* size: usual number of digits.

Counts of each (kind, votes) pattern, at most ``8 * 3**5`` rows whatever the input, reach the driver.
There expectation-maximisation (two classes, one confusion table for each labeler, independent given
the class) estimates the labelers' reliabilities, and a logistic regression on votes and kinds is
trained on the class probabilities. It becomes a column expression that scores every span; weak
candidates from ``ADD_AT`` on that touch no base span are added. Base spans always stay.

Positions are code points, end exclusive. They are sums of the lengths of matches and of the texts
between them (the same pattern splits and extracts). Patterns use possessive repeats and look-behinds
that change no match but keep long runs of one kind of character linear.

Null texts are empty and have no spans. Repeated rows are found each for itself. Without any candidate
no model is needed. Empty input: empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopscope.llm.common import staged, text_rows

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "ssn", "iban", "secret", "other")
LABELERS = ("shape", "check", "gazetteer", "context", "size")
ADD_AT = 0.9
CONTEXT = 24

_LOCAL, _DOMAIN = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_DOMAIN}++(?:\.{_DOMAIN}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a run of digits with fewer than 13 of them can't be a card, and no part of it can
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap conditions without which a pattern can't match.
GUARDS = {"email": "@", "phone": "+"}
WEAK = {
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|sk-[A-Za-z0-9]{16,64}|AKIA[0-9A-Z]{16})(?![A-Za-z0-9])",
    "phone": r"(?<![0-9+)(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}\x20?[\[(]dot[\])]\x20?[A-Za-z]{2,24}",
}
_IP_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Fixed values of the gazetteers and cues.
DOMAINS = ("com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "eu", "us", "ch", "at", "it", "nl")
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[4-7]|6)"
COUNTRIES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CUES = r"\b(?:e-?mail|mail|phone|tel|telephone|call|mobile|fax|contact|card|visa|credit|account|iban|ssn|social|ip|address|host|password|token|secret|key)\b"
AGAINST = r"\b(?:version|isbn|issn|page|section|chapter|figure|table|price|total|serial|order|build|release)\b"


def _matches(found: Column, gaps: Column) -> Column:
    """array<struct<start, end, value>> of all matches, from the columns of matches and of gaps."""
    starts = F.aggregate(
        F.sequence(F.lit(1), F.size(found)),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, i: F.struct(
            (acc["at"] + F.length(F.element_at(gaps, i)) + F.length(F.element_at(found, i))).alias("at"),
            F.concat(acc["out"], F.array(acc["at"] + F.length(F.element_at(gaps, i)))).alias("out")),
        lambda acc: acc["out"])
    return F.when(F.size(found) > 0, F.transform(
        F.arrays_zip(starts.alias("s"), found.alias("v")),
        lambda x: F.struct(x["s"].alias("start"), (x["s"] + F.length(x["v"])).alias("end"), x["v"].alias("value")))) \
        .otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc, i):
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike("^" + r"\.".join([_IP_PART] * 4) + "$")
    if kind == "card":
        d = _digits(value)
        return F.length(d).between(14, 19) & _luhn(d)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit(1)).when(no, F.lit(-1)).otherwise(F.lit(0)).cast("byte")


def _votes(text: Column, kind: Column, base: Column, span: Column) -> list[Column]:
    value, d = span["value"], _digits(span["value"])
    before = F.lower(F.substring(text, F.greatest(span["start"] - CONTEXT, F.lit(0)) + 1, F.least(span["start"], F.lit(CONTEXT))))
    n = F.length(d)
    tld = F.lower(F.regexp_extract(value, r"([A-Za-z]+)$", 1))
    return [
        _vote(base | kind.isin("ssn", "iban", "secret"), ~base & kind.isin("card", "ip")),
        F.when(kind == "card", _vote(_luhn(d), ~_luhn(d)))
        .when(kind == "ip", _vote(_valid("ip", value), ~_valid("ip", value)))
        .when(kind == "ssn", _vote(~d.rlike("^(?:000|666|9)"), d.rlike("^(?:000|666|9)")))
        .otherwise(F.lit(0)).cast("byte"),
        F.when(kind == "email", _vote(tld.isin(*DOMAINS), ~tld.isin(*DOMAINS)))
        .when(kind == "card", _vote(d.rlike(ISSUERS), ~d.rlike(ISSUERS)))
        .when(kind == "phone", _vote(value.rlike(COUNTRIES), F.lit(False)))
        .when(kind == "ip", _vote(~value.rlike(r"^(?:0|127|22[4-9]|2[3-9][0-9])\."), value.rlike(r"^(?:0|127|22[4-9]|2[3-9][0-9])\.")))
        .otherwise(F.lit(0)).cast("byte"),
        _vote(before.rlike(CUES), before.rlike(AGAINST)),
        F.when(kind == "card", _vote(n.isin(15, 16), ~n.between(14, 19)))
        .when(kind == "phone", _vote(n.between(10, 13), n > 15)).otherwise(F.lit(0)).cast("byte"),
    ]


_SPAN = "array<struct<kind:string,base:boolean,start:int,end:int,shape:tinyint,check:tinyint,gazetteer:tinyint,context:tinyint,size:tinyint>>"


def with_spans(rows: DataFrame) -> DataFrame:
    """Adds ``candidates``: all base and weak spans of ``text`` with their votes."""
    text = F.col("text")
    any_digit = text.rlike("[0-9]")
    guards = {k: F.contains(text, F.lit(GUARDS[k])) if k in GUARDS else any_digit for k in PATTERNS}
    guards["weak"] = any_digit | text.rlike(r"[\[(]at[\])]")
    patterns = PATTERNS | {"weak": "|".join(f"(?:{p})" for p in WEAK.values())}
    none = F.array().cast("array<string>")
    # matches and gaps are columns of their own: inside a lambda they would be found anew for each element
    rows = rows.withColumns({f"f_{k}": F.when(guards[k], F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none)
                             for k, p in patterns.items()})
    rows = rows.withColumns({f"g_{k}": F.when(F.size(f"f_{k}") > 0, F.split(text, p, -1)).otherwise(none)
                             for k, p in patterns.items()})
    raw = {f"m_{k}": _matches(F.col(f"f_{k}"), F.col(f"g_{k}")) for k in patterns}
    rows = rows.withColumns(raw).drop(*[f"{x}_{k}" for k in patterns for x in "fg"])

    def judged(kind, spans: Column, base) -> Column:
        def one(x):
            k = kind(x["value"]) if callable(kind) else F.lit(kind)
            b = _valid(kind, x["value"]) if base is None else F.lit(base)
            votes = _votes(text, k, b, x)
            return F.struct(k.alias("kind"), b.alias("base"), x["start"].alias("start"), x["end"].alias("end"),
                            *[v.alias(n) for n, v in zip(LABELERS, votes)])
        return F.transform(spans, one).cast(_SPAN)

    def weak_kind(value):
        return F.coalesce(*[F.when(value.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in WEAK.items()], F.lit("other"))

    # digit runs that are too short or long for cards are plain numbers: no candidates
    base = [judged(k, F.filter(F.col(f"m_{k}"), lambda x: F.length(_digits(x["value"])).between(13, 19)) if k == "card" else F.col(f"m_{k}"), None)
            for k in BASE_KINDS]
    found = F.concat(*base, judged(weak_kind, F.col("m_weak"), False))
    return rows.withColumn("candidates", F.when(
        F.size("m_email") + F.size("m_ip") + F.size("m_card") + F.size("m_phone") + F.size("m_weak") > 0, found)
        .otherwise(F.array().cast(_SPAN))).drop(*raw)


# ---------------------------------------------------------------- aggregation of the votes

def vote_counts(rows: DataFrame) -> list:
    """Number of spans of each (kind, votes): at most 8 * 3**5 rows."""
    # an inner generator brings a filter on its array, for which every pattern would run anew
    spans = rows.select(F.inline_outer("candidates")).where("kind is not null")
    return spans.groupBy("kind", "base", *LABELERS).agg(F.count(F.lit(1)).alias("n")).collect()


def estimate(patterns: list[tuple[tuple[int, ...], float]], rounds: int = 100) -> tuple[float, list[dict], list[float]]:
    """(share of true spans, P(vote | class) of each labeler, P(true | votes) of each pattern)."""
    share = 0.5
    table = [{(v, c): (0.6 if (v > 0) == (c == 1) and v else 0.2) for v in (-1, 0, 1) for c in (0, 1)} for _ in LABELERS]
    post: list[float] = []
    for _ in range(rounds):
        post = []
        for votes, _n in patterns:
            a, b = math.log(share), math.log(1 - share)
            for t, v in zip(table, votes):
                a, b = a + math.log(t[v, 1]), b + math.log(t[v, 0])
            post.append(1 / (1 + math.exp(min(700, b - a))))
        total = sum(n for _, n in patterns)
        yes = sum(n * p for (_, n), p in zip(patterns, post))
        share = min(0.99, max(0.01, (yes + 1) / (total + 2)))
        for j, t in enumerate(table):
            for c, mass in ((1, yes), (0, total - yes)):
                for v in (-1, 0, 1):
                    hit = sum(n * (p if c else 1 - p) for (votes, n), p in zip(patterns, post) if votes[j] == v)
                    t[v, c] = (hit + 1) / (mass + 3)
    return share, table, post


def _inputs(kind: str, votes) -> list[float]:
    return [1.0, *[float(v == s) for v in votes for s in (1, -1)], *[float(kind == k) for k in KINDS]]


def train(counts: list) -> list[float]:
    """Weights of the span classifier: logistic regression on the class probabilities, weighted by the
    logarithm of the counts (a pattern's, not a hot document's, evidence)."""
    rows = [(r["kind"], tuple(r[x] for x in LABELERS), float(r["n"])) for r in counts]
    if not rows:
        return [0.0] * len(_inputs("", (0,) * len(LABELERS)))
    _, _, post = estimate([(v, n) for _, v, n in rows])
    data = [(_inputs(k, v), p, math.log1p(n)) for (k, v, n), p in zip(rows, post)]
    total = sum(g for *_, g in data)
    w = [0.0] * len(data[0][0])
    for _ in range(300):
        grad = [1e-3 * x for x in w]
        for x, p, g in data:
            z = sum(a * b for a, b in zip(w, x))
            err = (1 / (1 + math.exp(-max(-500.0, min(500.0, z)))) - p) * g / total
            for i, v in enumerate(x):
                if v:
                    grad[i] += err
        w = [a - 2.0 * b for a, b in zip(w, grad)]
    return w


def _probability(span: Column, w: list[float]) -> Column:
    z, at = F.lit(w[0]), 1
    for name in LABELERS:
        z = z + F.when(span[name] == 1, F.lit(w[at])).when(span[name] == -1, F.lit(w[at + 1])).otherwise(F.lit(0.0))
        at += 2
    kinds = F.lit(0.0)
    for k, x in zip(KINDS, w[at:]):
        kinds = F.when(span["kind"] == k, F.lit(x)).otherwise(kinds)
    return 1 / (1 + F.exp(-(z + kinds)))


def _sorted(spans: Column) -> Column:
    """array<struct<start, rank of kind, end, kind>>, by start, then kind as listed."""
    rank = lambda k: F.array_position(F.array(*[F.lit(x) for x in KINDS]), k).cast("int")
    return F.array_sort(F.transform(spans, lambda x: F.struct(
        x["start"].alias("start"), rank(x["kind"]).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))))


def accepted(rows: DataFrame, w: list[float]) -> DataFrame:
    """``base_spans`` and ``all_spans`` (base and added ones) in place of ``candidates``."""
    base = F.filter("candidates", lambda x: x["base"])
    rows = rows.withColumn("base_spans", _sorted(base))
    added = F.filter("candidates", lambda x: ~x["base"] & (_probability(x, w) >= ADD_AT) & ~F.exists(
        F.col("base_spans"), lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))
    return rows.withColumn("all_spans", F.when(
        F.size("candidates") > F.size("base_spans"), F.array_distinct(_sorted(F.concat(base, added))))
        .otherwise(F.col("base_spans"))).drop("candidates")


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every document."""
    rows = staged(with_spans(text_rows(docs)).drop("text"), "pii-candidates")
    out = accepted(rows, train(vote_counts(rows)))

    def count(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    n = [count(k) for k in BASE_KINDS]
    return out.select("doc_id", *n, F.sha2(_written(F.col("base_spans")), 256).alias("base_sha256"),
                      _written(F.col("all_spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets (n_chars, if there, follows).

    The spans are found twice, once to count the votes: a table of them would hold every text again."""
    given = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("given"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = with_spans(given)
    out = accepted(found, train(vote_counts(found)))
    text = F.col("text")

    def cut(acc, x):
        new = x["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(new, F.concat(
            acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]")))
            .otherwise(acc["out"]).alias("out"))

    done = F.aggregate(F.col("all_spans"), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), cut, lambda acc: F.concat(
        acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    lower = {c.lower(): c for c in docs.columns}
    out = out.withColumn("clean", F.when(F.size("all_spans") > 0, done).otherwise(F.col("given")[lower["text"]]))
    put = {lower["text"]: F.col("clean")}
    if "n_chars" in lower:
        put[lower["n_chars"]] = F.when(F.size("all_spans") > 0, F.length("clean").cast(docs.schema[lower["n_chars"]].dataType)) \
            .otherwise(F.col("given")[lower["n_chars"]])
    return out.select(*[put.get(c, F.col("given")[c]).alias(c) for c in docs.columns])
