"""Language profiles, filter audits and collocations against brute force in plain Python."""

import collections
import itertools
import re
import unicodedata
import zlib

import numpy as np
import pytest
from compare import connection, differences

from strandloom.llm import _text, collocations, filter_audit, language_id, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", ["op12_filter_audit", "op13_collocations"])
def test_sql(spark, name):
    assert differences(spark, connection(SF), queries.QUERIES[name], queries.ORACLE_SQL[name], SF) == ""


# -- language profiles -------------------------------------------------------------------------------------------------
def brute_grams(text):
    kind = lambda c: unicodedata.category(c)[0] in "LM"
    words = "".join(c if kind(c) else " " for c in (text or "").lower()).split(" ")
    return collections.Counter(g for w in words if w for n in (1, 2, 3) for i in range(len(w) + 3 - n) if (g := f" {w} "[i : i + n]) != " ")


def packed(gram):
    v = 0
    for c in gram:
        v = v << 21 | (0 if c == " " else ord(c))
    return v - (0 if len(gram) == 3 else 1 << (60 + len(gram)))


def brute_rank(counter, size):
    return [g for g, _ in sorted(((packed(g), n) for g, n in counter.items()), key=lambda x: (-x[1], x[0]))[:size]]


def brute_languages(rows, size):
    by = collections.defaultdict(collections.Counter)
    for name, text, lang in rows:
        if name is not None and zlib.crc32(str(name).encode()) % 3 != 1 and lang is not None and text is not None:
            by[lang] += brute_grams(text)
    place = {lang: {g: k for k, g in enumerate(brute_rank(c, size))} for lang, c in by.items() if c}
    for name, text, _ in rows:
        own = brute_rank(brute_grams(text), size)
        held = name is None or zlib.crc32(str(name).encode()) % 3 == 1
        if not place or not any(c.isalpha() for c in text or ""):
            yield name, held, "und", 0.0
            continue
        d = {lang: sum(abs(p[g] - k) if g in p else size for k, g in enumerate(own)) for lang, p in place.items()}
        best = min(d, key=lambda x: (d[x], x))
        yield name, held, best, round(1 - d[best] / (len(own) * size), 9)


def languages(df, size=language_id.SIZE):
    from pyspark.sql import functions as F

    df = df.withColumn("held_out", language_id.held_out(F.col("doc_id")))
    out = language_id.predict(df, language_id.profiles(df.where("NOT held_out"), size=size), keep=["doc_id", "held_out"], size=size)
    return collections.Counter((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in out.collect())


@pytest.mark.parametrize("size", [30, 400])
def test_languages(docs, size):
    rows = docs.select("doc_id", "text", "lang").collect()
    assert languages(docs, size) == collections.Counter(brute_languages(rows, size))


def test_languages_held_out(spark, docs):
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = [r for r in queries.QUERIES["op11_language_id"](spark, SF).collect() if r.held_out]
    assert len(rows) > 50 and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in rows) >= 0.98 * len(rows)


ODD = [(None, "alles gut", "de"), (0, None, "de"), (1, "", "fr"), (2, "12 -- 34", None), (3, "Über été", "fr"), (3, "Über été", "fr"), (4, "ａ漢字かな𐐀𐐨", "ja"), (5, "नमस्ते दुनिया", "hi"),
       (6, "x" * 5000 + " y" * 3000, "en"), (7, "ab\x00ab áb", "en"), (8, "unlabelled text", None)]


def test_languages_odd(spark, monkeypatch):
    df = spark.createDataFrame([(*r, 1.5, "z") for r in ODD], "doc_id long, text string, lang string, score double, rank string")
    assert languages(df) == collections.Counter(brute_languages(ODD, 400))
    assert not languages(df.where("false"))
    assert {x[2] for x in languages(df.where("lang IS NULL"))} == {"und"}
    long = "Straße été. " * 500 + "ab" * 300
    want = dict(zip(*(x.tolist() for x in language_id.counted(language_id.signs(long)[0]))))
    monkeypatch.setattr(language_id, "PART", 97)
    assert dict(zip(*(x.tolist() for x in language_id.counted(language_id.signs(long)[0])))) == want == {packed(g): n for g, n in brute_grams(long).items()}


# -- filter audit ------------------------------------------------------------------------------------------------------
def brute_audit(rows, labels):
    good, toxic = ({n for n, q, t in labels if (q, t)[k] == 1 and n is not None} for k in (0, 1))
    least = {}
    key = lambda n: (n is None, n)
    for name, _, text in rows:
        least[text or ""] = min(least.get(text or "", key(name)), key(name))
    fails = []
    for name, part, text in rows:
        t = text or ""
        w = WORD.findall(t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": least[t] != key(name)}
        fails.append((part or "", name, {k for k, v in f.items() if v}))
    out, shapley = [], collections.Counter()
    for order in itertools.permutations("ABCDE"):
        for part in {f[0] for f in fails}:
            own = [f for f in fails if f[0] == part]
            for step, k in enumerate(order, 1):
                before = set(order[: step - 1])
                gone = [f for f in own if k in f[2] and not f[2] & before]
                shapley[part, k] += len(gone)
                out.append((part, "".join(order), step, sum(not f[2] & {*before, k} for f in own), len(gone), sum(k in f[2] and bool(f[2] & before) for f in own), sum(f[2] == {k} for f in own),
                            sum(f[1] in good for f in gone), sum(f[1] in toxic for f in gone)))
    return collections.Counter((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


@pytest.mark.parametrize("hashed", [filter_audit.fingerprint, lambda data: 7, lambda data: len(data) % 3])
def test_audit(spark, hashed):
    long = " ".join(f"w{k % 150}" for k in range(300))
    rows = [(None, None, None), (1, "s", ""), (2, "s", long), (2, "s", long), (0, "t", long), (3, "t", "A" + long), (None, "t", long), (4, "s", "Ab # é"), (5, "", "é ü " * 120), (6, "s", "é ü " * 120), (None, "s", "A" + long)]
    labels = [(2, 1, 0), (2, 0, 1), (0, 1, 1), (None, 1, 1), (4, None, 1), (9, 1, 1)]
    rows = rows + [(k, f"s{k % 2}", long) for k in range(20, 60)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, source string, text string, bits int, part int").repartition(5)
    marks = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, text string")
    for held in (1, filter_audit.HELD):
        got = filter_audit.audit(df, marks, hashed=hashed, held=held).collect()
        assert collections.Counter(tuple(r) for r in got) == brute_audit(rows, labels)
    assert filter_audit.audit(df.where("false"), marks, hashed=hashed).count() == 0
    assert filter_audit.audit(df, marks.where("false"), hashed=hashed).agg({"good_lost": "sum"}).first()[0] == 0


# -- collocations ------------------------------------------------------------------------------------------------------
def brute_phrases(rows, least, percent=100, size=2000, longest=5):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", *w[i : i + m]) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    gone = {(p[0], *p[i:j]) for p, a in cand.items() for i in range(1, len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) - 1 and 100 * a >= percent * cand[(p[0], *p[i:j])]}
    out = collections.defaultdict(list)
    for p, a in cand.items():
        if p not in gone:
            lang, w = p[0], p[1:]
            score, k = min((1000 * a * n[lang] // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    return {(lang, rank, p.decode(), -a, x, y, n[lang], -s) for lang, own in out.items() for rank, (s, a, p, x, y) in enumerate(sorted(own)[:size], 1)}


@pytest.mark.parametrize("least,percent,size,bits", [(5, 100, 2000, None), (3, 70, 50, 16), (300, 100, 2000, 18)])
def test_phrases(docs, least, percent, size, bits):
    rows = [(r.text, r.lang) for r in docs.collect()]
    got = collocations.mine(docs.repartition(7), least=least, percent=percent, size=size, bits=bits).collect()
    want = brute_phrases(rows, least, percent, size)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


ODD_TEXTS = [(None, None), ("", "en"), (" \t. , ;", "en"), ("one", None), ("A b a B\x0bA b. a\x00b  é\tü a b", "en"), ("a b a b a b a b", "en"), ("a b a b a b a b", "en"), ("z" * 3000 + " q w" * 900, "de"), ("a b. a b, a b; a b", None), ("x y z " * 50, "und")]


def test_phrases_odd(spark):
    df = spark.createDataFrame([(*r, 1, "x") for r in ODD_TEXTS], "text string, lang string, n int, phrase string")
    assert {tuple(r) for r in collocations.mine(df, least=2).collect()} == brute_phrases(ODD_TEXTS, 2)
    assert collocations.mine(df.where("false")).count() == 0


def hashes_of(rows):
    import pyarrow as pa

    seen = collections.Counter()
    for _, w, _, lang, a, z in collocations._runs(pa.RecordBatch.from_pydict({"lang": [r[1] or "und" for r in rows], "text": pa.array([r[0] for r in rows], pa.string())})):
        for n, at, h in collocations.survivors(w, lang, range(1, 6), a, z, []):
            seen.update((n, x) for x in h.tolist())
    return seen


@pytest.mark.parametrize("run,part", [(40, 3), (7, 1)])
def test_texts_in_parts(monkeypatch, run, part):
    import pyarrow as pa

    want = hashes_of(ODD_TEXTS)
    monkeypatch.setattr(_text, "RUN_BYTES", run)
    monkeypatch.setattr(collocations, "PART", part)
    assert hashes_of(ODD_TEXTS) == want
    for text, _ in ODD_TEXTS:
        for _, _, w in collocations.texts_of(pa.array([text])):
            words = [(w.data[a:z].tobytes().decode(), p) for a, z, p in zip(w.start, w.end, w.piece)]
            pieces = [re.findall(r"[^\x20\x09]+", piece) for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text))]
            assert [x for x, _ in words] == [x for p in pieces for x in p]
            assert [len(list(g)) for _, g in itertools.groupby(words, key=lambda x: x[1])] == [len(p) for p in pieces if p]


def test_sketch_only_overestimates(docs):
    own = docs.select("lang", "text")
    got = collocations.sketch(own, 16, range(1, 3), 100, [])
    seen = collections.Counter()
    for b in own.toArrow().to_batches():
        for _, w, _, lang, a, z in collocations._runs(b):
            for _, _, h in collocations.survivors(w, lang, range(1, 3), a, z, []):
                seen.update(h.tolist())
    often = np.array([h for h, n in seen.items() if n >= 100], np.uint64)
    rare = np.array([h for h, n in seen.items() if n < 20], np.uint64)
    assert len(often) and got.has(often).all() and got.has(rare).mean() < 0.2
