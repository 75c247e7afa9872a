"""Personal data by weak supervision, in DataFrame functions alone.

Candidates are matches of strict patterns (the base, which always stays) and of looser ones that overlap no base
match. Five labelers vote on each (+1, 0, -1): form, checksum or range, gazetteer, words to
the left, and what touches the span. Expectation-maximisation over the counts of vote patterns (at most
3^5 a kind, whatever the input) estimates each labeler's reliability by kind; its posteriors train a logistic span
classifier, and a loose candidate becomes a span where the classifier gives ``ACCEPT`` or more.

Positions are code points. Patterns are possessive where that changes no match, so that Java's matcher neither
recurses nor backs up on long runs, and start where a longer run can't have begun before.

Positions and redacted texts come from prefix sums and prefix maxima over blocks of ``BLOCK`` matches, so that a text with many matches costs
no more than BLOCK steps a match.

Defined results: a null text is empty and has no spans; repeated rows are treated one by one; an empty table gives no rows
(and an untrained model, which adds nothing); the caller's columns travel in one struct, so that no name clashes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm._store import stored

KINDS = ("email", "ip", "card", "phone", "secret")
ACCEPT = 0.95
LABELERS = ("shape", "check", "gazetteer", "context", "touching")
LEFT = 40
BLOCK = 128

_LOCAL = r"[A-Za-z0-9._%+-]"
_AT = lambda run: rf"(?:\G|(?<!{run}))"  # noqa: E731  a run's beginning, or the end of the last match
STRICT = {
    "email": rf"{_AT(_LOCAL)}{_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": rf"{_AT('[0-9]')}[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?i)(?<![a-z0-9])[a-z0-9][a-z0-9._%+-]{{0,63}}\x20?(?:\[at\]|\(at\))\x20?[a-z0-9-]{{1,63}}(?:\x20?(?:\[dot\]|\(dot\)|\.)\x20?[a-z0-9-]{{1,63}}){{1,5}}",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20-]?[0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+",
}

# Gazetteers and context words.
TLDS = "com net org edu gov info io dev de fr es uk eu ch at it nl se pl ru cn jp in br us ca au"
CARD_STARTS = "4|5[1-5]|2[2-7]|34|37|6011|65|35"
CALLING = r"\+(?:1|7|20|27|3[0-469]|4[0-13-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
SECRET_STARTS = "AKIA|ASIA|ghp_|gho_|github_pat_|sk_live_|sk-|xox[abp]-|AIza|eyJ"
NEAR = {
    "email": "e-?mail|mail|contact|correo|courriel",
    "ip": "ip|host|server|address|addr|login",
    "card": "card|visa|mastercard|amex|credit|debit|tarjeta|carte|karte",
    "phone": "phone|tel|call|mobile|fax|cell|telefon|telefono",
    "secret": "token|secret|password|passwd|api[_ -]?key|apikey|credential|bearer",
}
NOT_NEAR = "version|isbn|issn|doi|order|invoice|sha1|sha256|md5|commit|checksum|digest"


def prefixes(values: Column, op) -> Column:
    """For an array of longs, op (a sum, a maximum) over all values before each, from 0 on; in blocks, as each step copies what it adds to."""
    none = F.array().cast("array<bigint>")

    def scan(block: Column, at: Column) -> Column:
        zero = F.struct(at.alias("at"), none.alias("out"))
        return F.aggregate(block, zero, lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])

    last = F.greatest(F.ceil(F.size(values) / F.lit(BLOCK)).cast("int") - 1, F.lit(0))
    blocks = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(values, k * BLOCK + 1, BLOCK))
    zero = F.lit(0).cast("long")
    whole = lambda of: F.flatten(F.zip_with(of, scan(F.transform(of, lambda x: F.aggregate(x, zero, op)), zero), scan))
    return F.when(F.size(values) <= BLOCK, scan(values, zero)).otherwise(bound(blocks, whole))


def _found(text: Column, pattern: str, kind: str, form: str) -> Column:
    """Array of (kind, form, start, stop, value) of all matches, in order."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    item = "struct<kind:string,form:string,start:bigint,stop:bigint,value:string>"

    def one(x: Column, before: Column) -> Column:
        start = before + F.length(x["gap"])
        return F.struct(F.lit(kind).alias("kind"), F.lit(form).alias("form"), start.alias("start"), (start + F.length(x["hit"])).alias("stop"), x["hit"].alias("value"))

    pairs = F.zip_with(hits, F.slice(gaps, 1, F.greatest(F.size(hits), F.lit(1))), lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
    pairs = F.filter(pairs, lambda x: x["hit"].isNotNull())
    long = lambda x: (F.length(x["gap"]) + F.length(x["hit"])).cast("long")
    made = bound(pairs, lambda x: F.zip_with(x, prefixes(F.transform(x, long), lambda a, b: a + b), one))
    return F.when(text.rlike(pattern), made).otherwise(F.array().cast(f"array<{item}>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def bound(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def luhn(digits: Column, most: int = 19) -> Column:
    """Whether up to ``most`` digits pass; more never do."""

    def passes(d: Column) -> Column:
        n = F.length(d)

        def step(acc: Column, k: Column) -> Column:
            x = F.ascii(F.substring(d, n - k, F.lit(1))) - 48
            twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
            return acc + F.when(k % 2 == 1, twice).otherwise(x)

        return F.when(n.between(1, most), F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0).otherwise(False)

    return bound(digits, passes)


def _ip_ok(value: Column) -> Column:
    def part(x: Column) -> Column:
        short = F.regexp_replace(x, "^0+", "")
        return (F.length(short) <= 3) & (F.coalesce(F.when(F.length(short) <= 3, short.try_cast("int")), F.lit(0)) <= 255)

    return F.forall(F.split(value, r"\."), part)


def _valid(x: Column, kind: str) -> Column:
    n = F.length(_digits(x["value"]))
    return {"email": F.lit(True), "ip": _ip_ok(x["value"]), "card": n.between(16, 19) & luhn(_digits(x["value"])), "phone": n.between(8, 15)}[kind]


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit(1)).when(no, F.lit(-1)).otherwise(F.lit(0))


def _votes(x: Column, text: Column) -> Column:
    """The candidate with one vote a labeler."""
    kind, value, digits = x["kind"], x["value"], _digits(x["value"])
    n = F.length(digits)
    never = F.lit(False)
    by = lambda of: reduce(lambda acc, k: acc.when(kind == k, of[k]), list(of)[1:], F.when(kind == next(iter(of)), of[next(iter(of))]))
    tld = F.lower(F.substring_index(F.regexp_replace(value, r"[)\]\x20]", "."), ".", -1))
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    hexed = value.rlike("^[0-9a-fA-F]+$")
    check = by({
        "email": _vote(tld.rlike("^[a-z]{2,24}$"), ~tld.rlike("^[a-z]{2,24}$")),
        "ip": _vote(_ip_ok(value) & ~value.rlike(r"(^|\.)0[0-9]"), ~_ip_ok(value)),
        "card": _vote(n.between(13, 19) & luhn(digits), ~luhn(digits)),
        "phone": _vote(n.between(10, 13), ~n.between(8, 15)),
        "secret": _vote(mixed & (F.length(value) >= 32), ~mixed),
    })
    gazetteer = by({
        "email": _vote(F.array_contains(F.lit(TLDS.split()), tld), F.length(tld) > 12),
        "ip": _vote(never, value.rlike(r"^(0\.|127\.|255\.)")),
        "card": _vote(digits.rlike(f"^({CARD_STARTS})"), ~digits.rlike(f"^({CARD_STARTS})")),
        "phone": _vote(value.rlike(f"^{CALLING}"), value.rlike("^[(]?[01]")),
        "secret": _vote(value.rlike(f"^({SECRET_STARTS})"), ~hexed & ~value.rlike("[0-9].*[0-9].*[0-9]")),
    })
    left = F.lower(F.substring(text, F.greatest(x["start"] - LEFT, F.lit(0)).cast("int") + 1, F.least(x["start"], F.lit(LEFT).cast("long")).cast("int")))
    near = by({k: left.rlike(rf"(^|[^a-z])({NEAR[k]})[^a-z]") for k in KINDS})
    context = _vote(near, left.rlike(rf"(^|[^a-z])({NOT_NEAR})[^a-z]"))
    after = F.substring(text, x["stop"].cast("int") + 1, F.lit(1))
    touching = F.when(left.rlike("[a-z0-9_]$") | after.rlike("[A-Za-z0-9_]"), -1).otherwise(0)
    shape = F.when(x["form"] == "strict", 1).otherwise(0)
    names = dict(zip(LABELERS, (shape, check, gazetteer, context, touching)))
    return F.struct(*(x[c].alias(c) for c in ("kind", "form", "start", "stop")), *(v.cast("tinyint").alias(k) for k, v in names.items()))


def candidates(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (a struct of the kept columns), ``body`` (the text, a null one empty) and ``cands``: all candidates with their votes, by start."""
    kept = docs.columns if keep is None else keep
    body = F.col("body")
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("body"))
    valid = lambda kind: lambda x: _valid(x, kind)
    strict = [F.filter(_found(body, p, k, "strict"), valid(k)) for k, p in STRICT.items()]
    loose = [_found(body, p, k, "loose") for k, p in LOOSE.items()]
    out = out.withColumn("strict", F.concat(*strict)).withColumn("loose", F.concat(*loose))
    free = F.filter("loose", lambda x: ~F.exists("strict", lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"])))
    return out.withColumn("cands", F.transform(F.concat("strict", free), lambda x: _votes(x, body))).drop("strict", "loose")


@dataclass
class Model:
    """Weights of the span classifier by kind: bias, then one for each vote of each labeler but 0."""

    weights: dict[str, list[float]]
    reliability: dict[str, list[list[list[float]]]]

    def accepts(self, x: Column, least: float = ACCEPT) -> Column:
        bound = math.log(least / (1 - least))
        out = F.lit(False)
        for kind, w in self.weights.items():
            score = F.lit(w[0])
            for k, name in enumerate(LABELERS):
                score = score + F.when(x[name] == 1, w[1 + 2 * k]).when(x[name] == -1, w[2 + 2 * k]).otherwise(0.0)
            out = out | ((x["kind"] == kind) & (score >= bound))
        return out


def _em(rows: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> tuple[list[float], list[list[list[float]]]]:
    """Posterior of each vote pattern and p(vote | class) by class, labeler and vote (-1, 0, 1)."""
    post = [min(0.95, max(0.05, 0.5 + 0.2 * sum(v))) for v, _ in rows]
    p: list[list[list[float]]] = []
    for _ in range(rounds):
        mass = [sum(n * (q if y else 1 - q) for (_, n), q in zip(rows, post)) for y in (0, 1)]
        total = sum(mass)
        prior = [(m + 1) / (total + 2) for m in mass]
        p = [[[1.0] * 3 for _ in LABELERS] for _ in (0, 1)]  # one pseudo-count each
        for (v, n), q in zip(rows, post):
            for k, x in enumerate(v):
                p[0][k][x + 1] += n * (1 - q)
                p[1][k][x + 1] += n * q
        p = [[[c / sum(x) for c in x] for x in y] for y in p]
        for k, own in enumerate(p[1]):  # a vote for the class is never evidence against it
            if own[2] / own[0] < p[0][k][2] / p[0][k][0]:
                p[0][k] = p[1][k] = [(a + b) / 2 for a, b in zip(p[0][k], p[1][k])]
        post = []
        for v, _ in rows:
            like = [math.log(prior[y]) + sum(math.log(p[y][k][x + 1]) for k, x in enumerate(v)) for y in (0, 1)]
            post.append(1 / (1 + math.exp(max(-50.0, min(50.0, like[0] - like[1])))))
    return post, p


def _logistic(rows: list[tuple[tuple[int, ...], int]], post: list[float], rounds: int = 400) -> list[float]:
    """Weighted logistic regression on the posteriors, by full gradient steps with a little shrinkage."""
    total = sum(n for _, n in rows)
    x = [[1.0] + [float(s) for v in votes for s in (v == 1, v == -1)] for votes, _ in rows]
    w = [0.0] * len(x[0])
    for _ in range(rounds):
        grad = [1e-4 * a for a in w]
        for f, (_, n), q in zip(x, rows, post):
            z = sum(a * b for a, b in zip(w, f))
            err = n / total * (1 / (1 + math.exp(max(-50.0, min(50.0, -z)))) - q)
            for k, b in enumerate(f):
                grad[k] += err * b
        w = [a - 2.0 * g for a, g in zip(w, grad)]
    return w


def fit(cands: DataFrame) -> Model:
    """From the counts of vote patterns; at most 3^5 rows a kind reach the driver."""
    c = F.explode("cands").alias("c")
    seen = cands.select(c).groupBy("c.kind", *[f"c.{x}" for x in LABELERS]).count().collect()
    weights, reliability = {}, {}
    for kind in KINDS:
        rows = sorted((tuple(int(r[x]) for x in LABELERS), r["count"]) for r in seen if r["kind"] == kind)
        if rows:
            post, reliability[kind] = _em(rows)
            weights[kind] = _logistic(rows, post)
    return Model(weights, reliability)


def spans(cands: DataFrame, model: Model) -> DataFrame:
    """Adds ``base`` and ``spans``: arrays of (kind place, start, stop), sorted."""
    at = lambda x: F.array_position(F.lit(list(KINDS)), x["kind"])
    cut = lambda x: F.struct(at(x).alias("k"), x["start"].alias("start"), x["stop"].alias("stop"))
    base = F.filter("cands", lambda x: x["form"] == "strict")
    kept = F.filter("cands", lambda x: (x["form"] == "strict") | model.accepts(x))
    return cands.withColumn("base", F.array_sort(F.transform(base, cut))).withColumn("spans", F.array_sort(F.transform(kept, cut)))


def listed(column: str) -> Column:
    name = lambda x: F.element_at(F.lit(list(KINDS)), x["k"].cast("int"))
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", name(x), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def redacted(text: Column, column: str = "spans") -> Column:
    """The text with each span replaced by its kind in brackets; of spans that overlap, the first is named and all are removed."""
    by_start = F.array_sort(F.transform(column, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["k"].alias("k"))))

    def piece(x: Column, reach: Column) -> Column:
        name = F.concat(F.lit("["), F.upper(F.element_at(F.lit(list(KINDS)), x["k"].cast("int"))), F.lit("]"))
        gap = F.substring(text, reach.cast("int") + 1, (x["start"] - reach).cast("int"))
        return F.when(x["start"] >= reach, F.concat(gap, name)).otherwise(F.lit(""))

    def done(found: Column) -> Column:
        stops = F.transform(found, lambda x: x["stop"])
        rest = F.substring(text, F.array_max(stops).cast("int") + 1, F.length(text))
        return F.concat(F.array_join(F.zip_with(found, prefixes(stops, lambda a, b: F.greatest(a, b)), piece), ""), rest)

    return F.when(F.size(column) > 0, bound(by_start, done)).otherwise(text)


def query(spark, sf_dir: str) -> DataFrame:
    made = stored(candidates(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"]).drop("body"), "spans")
    out = spans(made, fit(made))
    n = lambda k: F.size(F.filter("base", lambda x: x["k"] == k + 1)).cast("long")
    return out.select("row.doc_id", *(n(k).alias(f"n_{KINDS[k]}") for k in range(4)), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its spans replaced. n_chars follows the text; a null text stays null. Texts and votes are stored once, for fitting and for spans."""
    made = stored(candidates(docs).drop("body"), "votes")
    text = F.col("row.text")
    out = spans(made, fit(made)).select("row", redacted(text).alias("new"))
    new = {"text": F.when(text.isNotNull(), F.col("new")), "n_chars": F.when(text.isNotNull(), F.length("new").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
