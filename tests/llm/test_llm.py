"""Operators for training data against brute force, round trips and held-out text."""

import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.llm import best_fit, components, decontamination, license_scan, ngram_join, packed_matrix, pii, quality_rules, quotes, suffix_tree_lm, token_ids, warc
from strandloom.llm._store import stored

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Nulls, empty and odd texts, repeats, a long one.
ODD = [(None, None), (1, ""), (2, " \n\t"), (3, "one"), (3, "one"), (4, "a b"), (5, "é ü — x" * 30), (6, "w " * 3000 + "x" * 5000), (None, "one"), (7, "A B C d e f g h i j"), (7, None)]


def low(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def odd(spark):
    """With columns whose names clash with those of the operators."""
    return spark.createDataFrame([(*r, 1, "x") for r in ODD], "doc_id long, text string, row int, n_words string")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


# -- packing -----------------------------------------------------------------------------------------------------------
def expected_pieces(rows, capacity=2048):
    from tokenizers import Tokenizer

    t, out = Tokenizer.from_file(token_ids.default_path()), collections.Counter()
    for name, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for n, a in enumerate(range(0, len(ids), capacity)):
            out[name, n, a, len(ids[a : a + capacity]), zlib.crc32(ids[a : a + capacity].tobytes())] += 1
    return out


def check_placing(rows, capacity):
    seq = collections.defaultdict(list)
    for r in rows:
        seq[r.sequence_id].append((r.offset, r.length))
    for v in seq.values():
        v.sort()
        assert v[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(v, v[1:])) and sum(n for _, n in v) <= capacity
    return len(seq)


def test_best_fit(docs):
    rows = best_fit.pack(docs).collect()
    want = expected_pieces([tuple(r) for r in docs.collect()])
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert check_placing(rows, 2048) <= math.ceil(sum(r.length for r in rows) / 2048) + 2


def test_best_fit_odd(odd, empty):
    rows = best_fit.pack(odd, capacity=16).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected_pieces(ODD, 16)
    check_placing(rows, 16)
    assert best_fit.pack(empty).count() == 0


@pytest.mark.parametrize("kind", ["spread", "clumped", "three"])
def test_sweep_is_best_fit_decreasing(kind):
    """Piece by piece: the same number of sequences with the same room left, and places that are gapless."""
    r = random.Random(4)
    for trial in range(60):
        if kind == "three":
            lengths, capacity = [600] * 4 + [500] * 2 + [400] * (trial % 3 + 1), 2048
        elif kind == "spread":
            lengths, capacity = [r.randrange(1, 65) for _ in range(r.randrange(1, 120))], 64
        else:
            sizes = [r.randrange(1, 65) for _ in range(r.randrange(1, 6))]
            lengths, capacity = [r.choice(sizes) for _ in range(r.randrange(1, 200))], 64
        gaps = []
        for n in sorted(lengths, reverse=True):
            fit = [g for g in gaps if g >= n]
            gaps.append((min(fit) if fit else capacity) - n)
            if fit:
                gaps.remove(min(fit))
        seq = collections.defaultdict(list)
        for length, lo, hi, first, deep, begin in best_fit.sweep(collections.Counter(lengths), capacity):
            for rank in range(hi - lo):
                seq[first + rank // deep].append((begin + rank % deep * length, length))
        ends = []
        for v in seq.values():
            v.sort()
            assert v[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(v, v[1:]))
            ends.append(capacity - sum(v[-1]))
        assert sorted(ends) == sorted(gaps) and sum(map(len, seq.values())) == len(lengths)
    if kind == "three":
        assert len(gaps) == 3 and len(best_fit.sweep({600: 4, 500: 2, 400: 1}, 2048)) and max(x[3] for x in best_fit.sweep({600: 4, 500: 2, 400: 1}, 2048)) == 1


def test_matrix_round_trip(spark, odd, empty):
    rows = packed_matrix.pack(odd, capacity=32, shard_tokens=200).cache()
    got = packed_matrix.unpacked(rows, 32).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, zlib.crc32(bytes(r.ids))) for r in got) == expected_pieces(ODD, 32)
    for r in rows.collect():
        assert len(r.ids) == 4 * 32 and r.cu_seqlens[-1] == r.n_tokens <= 32 and r.position_resets == r.cu_seqlens[:-1] and r.ids_crc32 == zlib.crc32(bytes(r.ids)[: 4 * r.n_tokens])
    assert packed_matrix.pack(empty).count() == 0


def test_capacity_tree():
    t, held, r = packed_matrix.CapacityTree(50), collections.Counter(), random.Random(2)
    for _ in range(500):
        k = r.randrange(51)
        t.add(k, 1)
        held[k] += 1
        need = r.randrange(51)
        want = min((x for x in held if x >= need and held[x]), default=None)
        assert t.find(need) == want


def test_ids_of_fuzzed_texts():
    ids, r = token_ids.Ids(token_ids.default_path()), random.Random(1)
    parts = [*"abcXYZ019'!.,-<>|=~^&#éÉßñ”“…—İſﬁ½²中 \t\n \x1c\x85", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "́", "̸"]
    for _ in range(3000):
        s = "".join(r.choice(parts) for _ in range(r.randint(1, 14)))
        assert ids.document(s.encode()) == np.array([*ids.tokenizer.encode(s, add_special_tokens=False).ids, 0], "<u4").tobytes()


# -- similarity join ---------------------------------------------------------------------------------------------------
def test_ids_of_letters_beyond_ascii():
    from tokenizers import Tokenizer

    t, ids, r = Tokenizer.from_file(token_ids.default_path()), token_ids.Ids(token_ids.default_path()), random.Random(5)
    signs = [chr(c) for c in range(0xA1, 0x180)] + ["\u0130", "\u0301", "\u0308", "\u03a3", "\u212b", "'s", "<|endoftext|>", "a", "B", "7", ",", "!!", " "]
    for _ in range(3000):
        text = "".join(r.choice(signs) if r.random() < 0.6 else r.choice("aZ0., ") for _ in range(r.randrange(1, 12)))
        assert ids.document(text.encode()) == np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4").tobytes(), text


@pytest.mark.parametrize("run", [1, 7, 40])
def test_ids_of_texts_cut_into_runs(monkeypatch, run):
    text = ("Straße, (x) it's \t<|endoftext|>  é×1 Ünder_score 2024 中文! " * 9).encode()
    ids = token_ids.Ids(token_ids.default_path())
    want = ids.tokenizer.encode(text.decode(), add_special_tokens=False).ids
    monkeypatch.setattr(token_ids, "RUN_BYTES", run, raising=False)
    for t in (text, text.strip(), b" " + text):
        assert np.frombuffer(ids.document(t), "<u4").tolist() == [*want, 0]


def test_ids_of_known_words_are_not_made_anew(monkeypatch):
    """A word in other case or between other signs needs no tokenizer."""
    ids = token_ids.Ids(token_ids.default_path())
    known = ids.document("häuser straße baum 7 ! , ( )".encode())
    monkeypatch.setattr(ids, "tokenizer", None)
    monkeypatch.setattr(ids, "tokenize", None, raising=False)
    chunks = "Häuser HÄUSER häuser, (Straße) Baum! BAUM7,".split()
    assert set(np.frombuffer(ids.document(" ".join(chunks).encode()), "<u4").tolist()) <= set(np.frombuffer(known, "<u4").tolist())


def brute_components(rows, size, p):
    sets = []
    for _, text in rows:
        w = WORD.findall(low(text))
        sets.append(frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 100 >= p * max(len(a), len(b)) and 100 * len(a & b) >= p * len(a | b):
                root[find(i)] = find(j)
    first = {}
    for k, (name, _) in enumerate(rows):
        first.setdefault(find(k), []).append(name)
    least = {k: min((n for n in v if n is not None), default=None) for k, v in first.items()}
    return collections.Counter((rows[k][0], len(s), least[find(k)]) for k, s in enumerate(sets))


def joined(df, **kw):
    return collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df, **kw).collect())


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_join_against_brute_force(spark, docs, size, percent):
    """Real texts, with chains of near copies at and around the threshold."""
    r = random.Random(size)
    rows = [tuple(x) for x in docs.collect()][:120]
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    for base in range(6):
        w = [word() for _ in range(r.choice((12, 40, 150)))]
        for k in range(25):
            rows.append((10_000 + 100 * base + k, " ".join(w)))
            w = list(w)
            for _ in range(r.randrange(1, 3)):
                w[r.randrange(len(w))] = word()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert joined(df, size=size, percent=percent) == brute_components(rows, size, percent)


def test_join_odd(odd, empty):
    assert joined(odd) == brute_components(ODD, 3, 90)
    assert ngram_join.jaccard_components(empty).count() == 0


def test_tree_pairs_lose_nothing():
    r = np.random.default_rng(5)
    vec = r.integers(0, 6, (200, 64)).astype(np.int32)
    vec[100:] = vec[:100] + r.integers(0, 2, (100, 64)) * (r.random((100, 64)) < 0.1)
    n = vec.sum(axis=1)
    got = {tuple(sorted(x)) for i, j in ngram_join.tree_pairs(vec, n, 90) for x in zip(i.tolist(), j.tolist())}
    want = {(i, j) for j in range(200) for i in range(j) if np.minimum(vec[i], vec[j]).sum() >= -(-90 * (n[i] + n[j]) // 190) and 100 * min(n[i], n[j]) >= 90 * max(n[i], n[j])}
    assert want and got == want


@pytest.mark.parametrize("across", [False, True])
def test_forest_connects_what_links_connect(across):
    """A shard of chains of near copies against all pairs; of two sides, only pairs across."""
    r, p = np.random.default_rng(3), 85
    sets = []
    for _ in range(12):
        s = r.integers(0, 2**48, 60).astype(np.uint64)
        for _ in range(30):
            sets.append(np.unique(s))
            s = s.copy()
            s[r.integers(0, 60, r.integers(0, 5))] = r.integers(0, 2**48, 1).astype(np.uint64)
    side = r.integers(0, 2, len(sets)) * across
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    links = ngram_join.Shard(np.concatenate(sets), first, np.arange(len(sets)), side, p).forest()

    def groups(pairs):
        root = list(range(len(sets)))
        for i, j in pairs:
            a, b = root[i], root[j]
            root = [a if x == b else x for x in root]
        return root

    whole = [set(s.tolist()) for s in sets]
    link = lambda i, j: 100 * len(whole[i] & whole[j]) >= p * len(whole[i] | whole[j])
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if (not across or side[i] != side[j]) and link(i, j)]
    assert all(link(i, j) for i, j in links) and len(links) < len(sets)
    one, two = groups(pairs), groups(links)
    assert len(set(zip(one, two))) == len(set(one)) == len(set(two))


@pytest.mark.parametrize("shard", [4, 2048])
def test_join_of_one_large_group(spark, monkeypatch, shard):
    """One group of near copies about the threshold, in one shard and in many blocks."""
    r = random.Random(17)
    monkeypatch.setattr(ngram_join, "SHARD", shard)
    base = ["".join(r.choice("abcdef") for _ in range(5)) for _ in range(80)]
    rows = []
    for k in range(90):
        w = list(base)
        for _ in range(r.randrange(0, 5)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append((k + 1, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert joined(df) == brute_components(rows, 3, 90)


def test_shard_of_large_sets_takes_little_memory():
    """A group of several batches is worked on in less memory than its unpacked sets once more, and batches aren't copied together."""
    r = np.random.default_rng(7)
    sets = [np.unique(r.integers(0, 1 << 48, 16_384, np.uint64)) for _ in range(120)]
    sets += [np.concatenate([s[:-200], s[-200:] + np.uint64(1)]) for s in sets[:8]]
    size = 8 * sum(map(len, sets))
    zero = pa.array(np.zeros(16, np.int64))
    names = ["shard", "lo", "hi", "cls", "comp", "side", "elements"]
    batch = lambda k: pa.RecordBatch.from_arrays([*[zero] * 3, *[pa.array(np.arange(k, k + 16))] * 2, zero, pa.array([ngram_join.packed(s << np.uint64(16)).tobytes() for s in sets[k : k + 16]])], names=names)
    batches = [batch(k) for k in range(0, len(sets), 16)]
    arrow = pa.total_allocated_bytes()
    (t,) = ngram_join.whole_groups(iter(batches))
    e, first = ngram_join.unpacked(t.column(6))
    assert (e == np.concatenate(sets)).all() and np.diff(first).tolist() == [len(s) for s in sets]
    assert pa.total_allocated_bytes() - arrow < size / 10
    shard = ngram_join.Shard(e, first, np.arange(len(sets)), np.zeros(len(sets), np.int64), 80)
    tracemalloc.start()
    try:
        links = shard.forest()
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert {tuple(sorted(x)) for x in links} == {(k, 120 + k) for k in range(8)}
    assert most < size


def test_batches_are_bounded_in_bytes(spark):
    """Rows of long values go to Python workers in batches of some MB."""
    rows = stored(spark.range(0, 400, 1, 1).select("id", F.repeat(F.lit("x"), 100_000).alias("text")), "long")
    sizes = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long").collect()
    assert sum(r.n for r in sizes) >= 40_000_000 and max(r.n for r in sizes) < 8_000_000


def test_points_rule_out_unrelated_large_sets(spark):
    r = np.random.default_rng(3)
    new = lambda n: np.unique(r.integers(0, 1 << 48, n, np.uint64) << np.uint64(16))
    base = new(8600)
    sets = {1: new(12_000), 2: new(12_000), 3: new(9_000), 4: base[:8000], 5: base[:8500], 6: new(40), 7: np.repeat(new(1), 700), 8: np.repeat(new(1), 70_000)}
    sets[9] = sets[8][:69_000]
    heads = spark.createDataFrame([(k, ngram_join.packed(v).tobytes()) for k, v in sets.items()], "cls long, elements binary")
    rows = spark.createDataFrame([(0, lo, hi, k, k, k % 2 if hi else 0) for k in sets for lo, hi in ((0, 0), (0, 1))], "shard long, lo long, hi long, cls long, comp long, side long")
    for p in (80, 90):
        got = {(x.hi, x.cls) for x in ngram_join.near_points(rows.join(ngram_join.points(heads), "cls"), p).collect()}
        assert got == {(h, k) for h in (0, 1) for k in (4, 5, 8, 9)}


def test_stage_keeps_one_row_of_a_group(spark):
    words = " ".join(f"w{k}" for k in range(40))
    rows = [(None, words, {"a": 1}, 1), (5, words.upper(), None, 2), (5, words + " end", {"b": 2}, 3), (7, "", None, 4), (7, "", None, 5), (None, None, None, 6), (8, "apart from all others here", None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra map<string,int>, row long")
    got = sorted(r.row for r in ngram_join.stage(spark, df, "").collect())
    assert got[1:] == [4, 5, 6, 7] and got[0] in (2, 3)
    assert ngram_join.stage(spark, df.where("false"), "").count() == 0


def test_components(spark):
    chain = [(k, k + 1) for k in range(50)] + [(100, 101), (103, 101)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(51)} | {100: 100, 101: 100, 103: 100}


# -- language model ----------------------------------------------------------------------------------------------------
def test_suffix_tree(docs):
    got = {r.doc_id: r for r in suffix_tree_lm.score(docs).collect()}
    rows = [tuple(r) for r in docs.collect()]
    c = collections.Counter()
    for name, text in rows:
        if zlib.crc32(str(name).encode()) % 5 != 1:
            c.update([*WORD.findall(low(text)), None])
    n, v, held = sum(c.values()), len(c), [0.0, 0.0]
    for name, text in rows:
        w, g = [*WORD.findall(low(text)), None], got[name]
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (g.n_tokens, g.n_known, g.train_tokens, g.held_out) == (len(w), sum(c[x] > 0 for x in w), n, zlib.crc32(str(name).encode()) % 5 == 1)
        assert g.base_score == pytest.approx(base)
        if g.held_out:
            held[0] += g.base_score
            held[1] += g.score
    assert held[1] > held[0]


class BruteTree:
    """The tree word by word in dictionaries, from the definition."""

    def __init__(self, texts, depth=suffix_tree_lm.DEPTH, least=suffix_tree_lm.LEAST):
        self.depth, self.least = depth, least
        self.count = collections.Counter(tuple(w[k : k + m]) for w in texts for m in range(1, depth + 2) for k in range(len(w) - m + 1))
        self.n = sum(len(w) for w in texts)
        self.v = sum(len(g) == 1 for g in self.count)
        self.next = collections.defaultdict(list)
        for g, c in self.count.items():
            if len(g) > 1 and c >= least:
                self.next[g[:-1]].append(g[-1])
        self.nodes, self.known = {}, {}

    def node(self, context):
        """Stored symbols and B / (C + 1) of a kept context, else None."""
        if context not in self.nodes:
            held, gain, c = [], 0.0, self.count[context]
            for t in self.next.get(context, ()):
                own, parent = self.count[*context, t] / c, self.p(context[1:], t)
                if max(own / parent, parent / own) >= suffix_tree_lm.RATIO:
                    held.append(t)
                    gain += self.count[*context, t] * math.log(own / parent)
            b = c - sum(self.count[*context, t] for t in held) + 1
            self.nodes[context] = (set(held), b / (c + 1)) if gain >= suffix_tree_lm.GAIN else None
        return self.nodes[context]

    def p(self, context, t):
        if (context, t) not in self.known:
            if not context:
                out = (self.count[(t,)] + 0.5) / (self.n + 0.5 * (self.v + 1))
            else:
                out, node = self.p(context[1:], t), self.node(context)
                if node:
                    out *= node[1]
                    if t in node[0]:
                        out += self.count[*context, t] / (self.count[context] + 1)
            self.known[context, t] = out
        return self.known[context, t]

    def score(self, w):
        return sum(math.log10(self.p(tuple(w[max(0, k - self.depth) : k]), w[k])) for k in range(len(w)))


def of_words(text):
    return [*WORD.findall(low(text)), None]


@pytest.mark.parametrize("head", [suffix_tree_lm.HEAD, 1e-3, 1.0])
def test_suffix_tree_against_brute_force(docs, head):
    """Every text's score, whether keys are sent or shuffled, with many, few and no contexts kept."""
    rows = [tuple(r) for r in docs.collect()]
    tree = BruteTree([of_words(x) for name, x in rows if zlib.crc32(str(name).encode()) % 5 != 1])
    got = {r.doc_id: r for r in suffix_tree_lm.score(docs, head=head).collect()}
    for name, text in rows:
        assert got[name].score == pytest.approx(tree.score(of_words(text)))
    assert sum(x is not None for x in tree.nodes.values()) > 100
    known = [t for (t,) in [g for g in tree.count if len(g) == 1]]
    for context in [c for c, x in tree.nodes.items() if x][:20]:  # probabilities over all known tokens and an unknown one sum to one
        assert sum(tree.p(context, t) for t in known) + tree.p(context, "never seen") == pytest.approx(1.0)


def test_lookups_go_in_rounds(spark):
    """Each round shuffles its own buckets; together they find what is there, once."""
    r = np.random.default_rng(7)
    keys = np.unique(r.integers(-(1 << 63), (1 << 63) - 1, 4000)).tolist()
    table = spark.createDataFrame([(k, -1.0 if n % 2 else None, float(n % 5)) for n, k in enumerate(keys[:3000])], "key long, lp double, w double")
    rows = [(n, [keys[k] for k in r.integers(0, len(keys), 200).tolist()]) for n in range(50)] + [(50, [])]
    asked, there = spark.createDataFrame(rows, "row long, asked array<long>"), {k: n for n, k in enumerate(keys[:3000])}
    want = {n: [there[k] for k in own if k in there] for n, own in rows if own}
    assert collections.Counter(keys) == collections.Counter(set(keys))
    got = suffix_tree_lm.answered(asked, table)
    assert len(got.inputFiles()) >= suffix_tree_lm.PASSES  # all stored, no round waits in a plan
    got = {x.row: (x.lp or 0.0, x.w, x.seen) for x in got.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("lp", "w", "seen")]).collect()}
    assert got == {n: (-sum(v % 2 for v in ks), sum(float(v % 5) for v in ks), sum(v % 2 for v in ks)) for n, ks in want.items()}
    for nth in range(suffix_tree_lm.PASSES):
        assert suffix_tree_lm._answered(asked, table, 8, nth).count() > 0


def test_answers_do_not_grow_with_buckets(spark):
    """A round returns one row a text, with as many sums of few as of many buckets."""
    r = np.random.default_rng(8)
    keys = np.unique(r.integers(-(1 << 63), (1 << 63) - 1, 3000)).tolist()
    table = spark.createDataFrame([(k, -1.0, 2.0) for k in keys], "key long, lp double, w double")
    asked = spark.createDataFrame([(n, r.permutation(keys)[:500].tolist()) for n in range(60)], "row long, asked array<long>")
    conf = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for many in (8, 256):
            rounds = [suffix_tree_lm._answered(asked, table, many, nth).collect() for nth in range(suffix_tree_lm.PASSES)]
            assert all(sorted(x.row for x in rows) == list(range(60)) for rows in rounds)
            for n in ("lp", "w", "seen"):
                assert sum(x[n] for rows in rounds for x in rows) == 60 * 500 * {"lp": -1, "w": 2, "seen": 1}[n]
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_lookups_of_texts_from_several_tasks(docs):
    """Texts are numbered by task; a batch of lookups may hold texts of several."""
    rows = [tuple(r) for r in docs.collect()]
    tree = BruteTree([of_words(x) for name, x in rows if zlib.crc32(str(name).encode()) % 5 != 1])
    got = {r.doc_id: r for r in suffix_tree_lm.score(docs.repartition(7)).collect()}
    for name, text in rows:
        assert got[name].score == pytest.approx(tree.score(of_words(text)))


def test_suffix_tree_odd(odd, empty):
    rows = suffix_tree_lm.score(odd).collect()
    assert len(rows) == len(ODD) and all(not r.held_out for r in rows if r.doc_id is None) and all(r.n_tokens >= 1 for r in rows)
    assert suffix_tree_lm.score(empty).count() == 0


def test_suffix_tree_floor_does_not_rise(spark):
    """A pair seen four times is a node, however much other text there is (2.4 million tokens)."""
    rows = [(k, "a b c d e f g h i j " * 8000) for k in range(40)] + [(100 + k, "qq zz") for k in range(40)]
    seen = [x for x, _ in rows[40:] if zlib.crc32(str(x).encode()) % 5 != 1][:4]
    held = next(x for x, _ in rows[40:] if zlib.crc32(str(x).encode()) % 5 == 1)
    df = spark.createDataFrame([r for r in rows if r[0] < 100 or r[0] in (*seen, held)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in suffix_tree_lm.score(df).collect()}
    assert got[held].train_tokens > 2_000_000 and got[held].score > got[held].base_score + 4


# -- quotes ------------------------------------------------------------------------------------------------------------
MESSAGES = [
    (1, 0, "u", "Hello there my friend, how are you today?\nI have a question about boats."),
    (1, 1, "a", "> I have a question about boats.\nAsk me anything about boats please"),
    (1, 2, "u", "On Mon, X wrote:\n>> I have a question about boats.\n> Ask me anything about boats please\nWhich boat floats best?"),
    (1, 3, "a", "Unrelated message here indeed"),
    (2, 0, "u", "> Unrelated message here indeed\nok"),
    (1, 4, "a", "> Which boat floats best?\nThe wooden one."),
    (1, None, None, None),
    (3, 0, "u", "> quote of nothing known at all\nfine"),
]


def test_quotes(spark):
    df = spark.createDataFrame(MESSAGES, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in quotes.conversations(df).collect()}
    assert got[1, 2].clean_text == "Which boat floats best?" and got[1, 2].max_level == 2 and got[1, 2].n_quoted_lines == 2 and got[1, 2].n_links == 2
    assert got[1, 4].path == [0, 1, 2, 4] and got[1, 3].path == [3] and got[1, 4].parent_turn == 2
    assert (got[2, 0].source_conv_id, got[2, 0].source_turn, got[2, 0].parent_turn) == (1, 3, None)
    assert got[3, 0].n_links == 0 and got[3, 0].clean_text == "fine"
    assert len(got) == len(MESSAGES) and quotes.conversations(df.where("false")).count() == 0


def test_long_thread(spark):
    rows = [(1, k, "u", f"> this is message number {k - 1}\nthis is message number {k}") for k in range(40)]
    got = {r.turn: r for r in quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[39].path == list(range(40)) and got[39].depth == 39


def test_short_and_rewrapped_quotes(spark):
    one, two, three = "The first paragraph is\nabout boats.", "The second one goes on\nabout sails and oars.", "The third ends it all."
    rows = [
        (1, 0, "u", "Boat or car?"), (1, 1, "a", "Yes, I agree!"), (1, 2, "u", "> Yes, I agree!\nGood, then we go."), (1, 3, "a", "Which one?"), (1, 4, "u", "> Which one?\nThe boat."),
        (2, 0, "u", "> Which one?\nNo link to another conversation."),
        (3, 0, "u", f"{one}\n\n{two}\n\n{three}"), (3, 1, "a", "> The first paragraph\n> is about boats.\n>\n> The second one goes\n> on about sails and\n> oars.\nYes."),
        (4, 0, "u", "> ...\n> !\nNothing quoted."), (4, 1, "u", "..."),
    ]
    got = {(r.conv_id, r.turn): r for r in quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[1, 2].parent_turn, got[1, 2].n_links, got[1, 4].parent_turn, got[1, 4].path) == (1, 1, 3, [3, 4])
    assert (got[2, 0].parent_turn, got[2, 0].n_links, got[2, 0].source_conv_id) == (None, 0, None)
    assert (got[3, 1].parent_turn, got[3, 1].n_links) == (0, 2) and got[4, 0].n_links == 0


# -- WARC --------------------------------------------------------------------------------------------------------------
def test_warc_round_trip(spark, tmp_path):
    r = random.Random(3)
    big = "".join(r.choice("ab\r\nWARC/1.1 é\0") for _ in range(30_000))
    rows = [(1, "u", big), (2, "u\r\nX: y", big), (3, None, None), (4, "u", ""), (5, "u", "x" * 999), (6, "u", "x" * 999), (7, "u", "y" * 5000), (7, "u", "y" * 5000), (None, "u", "y" * 5000), (8, "u", "WARC/1.1\r\n\r\n" * 100)]
    pages = spark.createDataFrame([(*x, "z") for x in rows], "page_id long, url string, html string, digest string")
    warc.write(warc.marked(pages), str(tmp_path / "w"), segment_bytes=700, chunked_bytes=300, file_records=3)
    made = warc.read(spark, str(tmp_path / "w")).cache()
    assert made.where("not ok").count() == 0 and made.count() == len(rows)
    got = collections.Counter(tuple(x) for x in warc.report(made).collect())
    most = collections.defaultdict(lambda: -1)
    for name, _, html in rows:
        most[html or ""] = max(most[html or ""], -1 if name is None else name)
    want = collections.Counter()
    for name, _, html in rows:
        b = (html or "").encode()
        again = len(b) >= 1000 and name != most[html or ""]
        want[name, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", most[html or ""] if again else None] += 1
    assert got == want
    assert {bytes(x.payload) for x in made.where("warc_type = 'response'").collect()} == {(h or "").encode() for _, _, h in rows}


def test_warc_broken_segments(spark):
    rec = lambda i, o, n, t, b: (i, o, n, t, "response" if n in (None, 1) else "continuation", {"a": "b"}, b)
    head = b"HTTP/1.1 200 OK\r\n\r\n"
    rows = [rec("a", "a", 1, None, head), rec("a2", "a", 2, 21, b"xy"), rec("b", "b", 1, None, head), rec("b3", "b", 3, 21, b"xy"), rec("c", "c", 1, None, head), rec("c2", "c", 2, 99, b"xy"), rec("d", "d", None, None, head + b"q")]
    got = {r.record_id: (r.ok, r.payload and bytes(r.payload)) for r in warc.reassembled(spark.createDataFrame(rows, warc.RECORD)).collect()}
    assert got == {"a": (True, b"xy"), "b": (False, None), "c": (False, None), "d": (True, b"q")}
    assert warc.unchunked(warc.chunked(b"abc" * 100, 7)) == b"abc" * 100 and warc.unchunked(b"5\r\nab") is None


# -- decontamination ---------------------------------------------------------------------------------------------------
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(rows, items, size=8):
    wins = collections.defaultdict(set)
    for name, text in items:
        w = ALNUM.findall(low(text))
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[k : k + n])].add(str(name))
    out = collections.Counter()
    for name, text in rows:
        w, hit, found = ALNUM.findall(low(text)), set(), set()
        for n in {len(k) for k in wins}:
            for k in range(len(w) - n + 1):
                if x := wins.get(tuple(w[k : k + n])):
                    found |= x
                    hit.update(range(k, k + n))
        out[name, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2] += 1
    return out


@pytest.mark.parametrize("block", [1 << 18, 20])
def test_decontamination(spark, docs, block):
    r = random.Random(8)
    word = lambda: r.choice("alpha beta gamma delta eps".split())
    items = [(k, " ".join(word() for _ in range(r.choice((1, 3, 8, 12, 20))))) for k in range(12)] + [(50, None), (51, ""), (52, "...")]
    rows = [(k, " ".join(word() for _ in range(r.randrange(200)))) for k in range(40)] + [(900, items[3][1]), (901, (items[4][1] or "") + " x " + (items[5][1] or "")), (None, "Alpha"), (902, None), (902, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    index = decontamination.build_index(spark.createDataFrame(rows, "doc_id long, text string"), segment_words=500)
    got = decontamination.report(decontamination.search(index, bench, block_windows=block))
    assert collections.Counter((x.doc_id, x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in got.collect()) == brute_hits(rows, items)


def test_proximity_and_empty(spark, odd, empty):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight")], "item_id long, text string")
    rows = [(1, "eight seven six five four three two one"), (2, "one two " + "x " * 100 + "three four five six seven eight"), (3, "one two three four five six seven eight")]
    found = {x.doc_id: (x.items, x.near_items) for x in decontamination.search(decontamination.build_index(spark.createDataFrame(rows, "doc_id long, text string")), bench).collect()}
    assert found == {1: ([], ["1"]), 2: ([], []), 3: (["1"], ["1"])}
    assert decontamination.search(decontamination.build_index(empty), bench).count() == 0
    assert decontamination.report(decontamination.search(decontamination.build_index(odd), bench.where("false"))).where("contaminated or n_hit > 0").count() == 0


def test_items_without_id(spark):
    rows = [(1, "alpha beta gamma delta one two three four"), (2, "nothing of it")]
    bench = spark.createDataFrame([(None, "alpha beta gamma"), ("b", "beta gamma"), (None, None), ("c", None)], "item_id string, text string")
    for block in (1, 100):
        got = {r.doc_id: (r.n_hit, r["items"], r.whole) for r in decontamination.search(decontamination.build_index(spark.createDataFrame(rows, "doc_id long, text string")), bench, block_windows=block).collect()}
        assert got == {1: (3, ["b"], False), 2: (0, [], False)}


def brute_near(text, items, size=8, slop=16):
    """Items with a window whose first word has a place with each other word of the window within slop words."""
    at, found = collections.defaultdict(list), set()
    for k, w in enumerate(ALNUM.findall(low(text))):
        at[w].append(k)
    for name, item in items:
        w = ALNUM.findall(low(item))
        n = min(size, len(w))
        wins = [w[k : k + n] for k in range(len(w) - n + 1)] if n else []
        if any(all(x in at for x in win) and any(all(any(abs(q - p) <= slop for q in at[x]) for x in win) for p in at[win[0]]) for win in wins):
            found.add(str(name))
    return sorted(found)


def test_query_reports_proximity(spark, tmp_path):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    w = ALNUM.findall(low(bench[0][1]))[:8]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(9001, " ".join(reversed(w))), (9002, " so ".join(w)), (9003, " ".join(w[:4]) + " so" * 40 + " " + " ".join(w[4:])), (9004, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in decontamination.query(spark, str(tmp_path)).collect()}
    for name, text in rows:
        near = brute_near(text, bench)
        assert (got[name].n_near_items, got[name].near_items_sha256) == (len(near), decontamination.items_digest(near))
    assert [got[k].n_items for k in (9001, 9002, 9003)] == [0, 0, 0] and got[9001].n_near_items >= 1 and got[9002].n_near_items >= 1 and got[9003].n_near_items == 0


# -- licences ----------------------------------------------------------------------------------------------------------
def test_licenses(spark, docs):
    extra = [(9001, "Some text.\nReleased under the MIT License."), (9002, "The driver's license was issued in 2010."), (9003, "Licensed under the Apache License, Version 2.0.\n\nLicensed under CC BY-NC 4.0."), (9004, None), (9005, ""), (9006, "This work is licensed under the GNU General Public\nLicense, version 3.")]
    got = {r.doc_id: r.licenses for r in license_scan.scan(docs.where("doc_id < 100").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))).collect()}
    assert (got[9001], got[9002], got[9003], got[9004], got[9005], got[9006]) == ("mit", "", "apache-2.0,cc-by-nc", "", "", "gpl")
    text = {r.doc_id: r.text for r in docs.collect()}
    for k, v in got.items():
        if k < 9000:
            assert bool(v) == bool(re.search(r"[Ll]icensed? |License", text[k]))


#: Licences of families that the classifier doesn't know; clauses like those of the first and the third are among its wordings of other licences.
UNSEEN = [
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions.",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software.",
    "This license governs use of the accompanying software. If you use the software, you accept this license. If you do not accept the license, do not use the software.",
]


#: Stricter, older or other licences, beside the family that their words are near to.
VARIANTS = [
    ("cc-by", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc-by", "Licensed under CC BY-ND 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC-ND 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution Non-Commercial Share Alike 4.0 International License."),
    ("apache-2.0", "Licensed under the Apache License, Version 1.1."),
    ("apache-2.0", "Licensed under the Apache Software License, Version 1.0."),
    ("mpl-2.0", "Licensed under the Mozilla Public License, Version 1.1."),
    ("mit", "SPDX-License-Identifier: MIT-0"),
    ("mit", "Released under the MIT License-0."),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License."),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: all advertising materials mentioning features must display this."),
]
#: Licences of which no wording is trained on.
CLEAN_UNSEEN = [
    "Everyone is permitted to do what they want with this work under the terms of the Do What You Want To Public License, version 2.",
    "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above notice appears in all copies.",
    "This library is free software; you may redistribute and modify it under the same terms as Perl itself.",
    "The contents of this file are subject to the terms of the Common Development and Distribution License. You may not use this file except in compliance with the License.",
    "Licensed under the Academic Free License version 3.0.",
    "Licensed under the Open Software License version 3.0.",
    "Copying and distribution of this file, with or without modification, are permitted in any medium without royalty, provided the notice is preserved.",
    "As long as you retain this notice you can do whatever you want with this stuff. If we meet some day, you can buy me a beer in return.",
    "Distributed under the terms of the Boost Software License, Version 1.0.",
    "This source file is subject to version 3.01 of the PHP license.",
    "Licensed to PSF under a Contributor Agreement.",
    "Developed by the group. Permission is hereby granted to deal with the Software without restriction, under the NCSA Open Source License.",
    "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3.",
    "You may use this file under the Artistic License 2.0 or the terms of the Ruby license.",
    "This data is made available under the Open Database License.",
    "SPDX-License-Identifier: ISC",
]


def test_stricter_variants_are_never_confirmed(spark, docs):
    extra = [(9000 + k, "Some text.\n\n" + t) for k, (_, t) in enumerate(VARIANTS)] + [(9100 + k, "Some text.\n\n" + t) for k, t in enumerate(CLEAN_UNSEEN)]
    plain = [("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."), ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License). See version 3 of the manual."), ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
             ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the foundation, version 3."), ("cc-by-nc", "Licensed under CC BY-NC 4.0."), ("mit", "Released under the MIT License.")]
    extra += [(9200 + k, "Some text.\n\n" + t) for k, (_, t) in enumerate(plain)]
    got = {r.doc_id: r for r in license_scan.scan(docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"))).collect()}
    for k, (family, text) in enumerate(VARIANTS):
        assert family not in got[9000 + k].licenses.split(",") and got[9000 + k].n_confirmed + got[9000 + k].n_unknown == 1, text
    for k, (family, text) in enumerate(plain):
        assert got[9200 + k].licenses == family, text
    found = [k for k in range(len(CLEAN_UNSEEN)) if got[9100 + k].n_unknown]
    assert not any(got[9100 + k].licenses for k in range(len(CLEAN_UNSEEN)))
    print("unknown as they should be:", len(found), "of", len(CLEAN_UNSEEN), [CLEAN_UNSEEN[k][:40] for k in range(len(CLEAN_UNSEEN)) if k not in found])
    assert len(found) >= 8


def test_every_notice_is_in_reach_of_the_lexicon():
    for notices in license_scan.TRIPLES.values():
        for triples in notices:
            outside = sum(not set(t.split()) & set(license_scan.LEXICON) for t in triples)
            assert outside / len(triples) < license_scan.CONTAINED


def test_licenses_against_brute_force_templates(spark, docs):
    """Every paragraph that holds enough of a notice is confirmed or unknown, none is confirmed without; wordings, unseen families, and clean text."""
    said = {
        9102: ("This work is available under a Creative Commons Attribution 4.0 International", "cc-by"),
        9103: ("This work is available under a Creative Commons Attribution ShareAlike 4.0 International", "cc-by-sa"),
        9104: ("Dedicated to the public domain under the CC0 1.0 Universal deed", "cc0"),
        9105: ("Permission is hereby granted, free of charge, to any person obtaining a copy of this font and associated documentation files", "mit"),
        9106: ("Released under the Unlicense.", "unlicense"),
    }
    extra = [(k, "Some text.\n\n" + t, 1) for k, (t, _) in said.items()] + [(9200 + k, "Some text.\n\n" + t, 1) for k, t in enumerate(UNSEEN)] + [(9300, "x " * 50_000 + "\n\nlicensed under cc0 1.0", 1), (9301, None, 1)]
    d = docs.withColumn("words", F.lit(1)).unionByName(spark.createDataFrame(extra, "doc_id long, text string, words int"))
    got = {r.doc_id: r for r in license_scan.scan(d).collect()}
    rows = {r.doc_id: r.text for r in d.collect()}
    wrong = 0
    for name, text in rows.items():
        enough, families = 0, set()
        for p in re.split(r"\n[ \t\r]*\n|(?<=[.!?:])[ \t\r]*\n", text or ""):
            w = [x for x in re.split("[^a-z0-9]+", p.lower()) if x]
            own = {" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))}
            held = {k for k, v in license_scan.TRIPLES.items() for n in v if len(own & set(n)) / len(n) >= license_scan.CONTAINED}
            enough += bool(held)
            families |= held
        r = got[name]
        assert r.n_confirmed + r.n_unknown >= enough and set(filter(None, r.licenses.split(","))) <= families
        if name < 9000 and not families:
            wrong += r.n_unknown > 0
    assert wrong <= 0.02 * len(rows)  # licences of no family that aren't there
    for k, (_, family) in said.items():
        assert got[k].licenses == family or got[k].n_unknown == 1
    assert sum(got[k].licenses == family for k, (_, family) in said.items()) >= 4
    assert [got[9200 + k].n_unknown for k in range(len(UNSEEN))] == [1] * len(UNSEEN)
    assert got[9300].licenses == "cc0" and (got[9301].n_paragraphs, got[9301].n_unknown) == (0, 0)
    assert license_scan.scan(d.where("false")).count() == 0


def test_paragraphs_without_a_word_of_the_lexicon_are_classified(spark, docs, monkeypatch):
    text = "Permission is granted free of charge to any person with a copy of this work and associated documentation files"
    assert not set(text.lower().split()) & set(license_scan.LEXICON)
    d = docs.unionByName(spark.createDataFrame([(9001, "Some text.\n\n" + text)], "doc_id long, text string"))
    model, temperature, least = license_scan.train(spark, d)
    monkeypatch.setattr(license_scan, "train", lambda *_: (model, temperature, least))
    rows = d.select("doc_id", F.explode(license_scan.paragraphs(F.col("text"))).alias("p")).withColumn("words", license_scan.words(F.col("p")))
    rows = license_scan.classified(model, rows).select("doc_id", "p", license_scan.vector_to_array("rawPrediction").alias("z"), license_scan.most_some(model, F.col("words")).alias("bound")).collect()
    want = collections.Counter()
    for r in rows:  # every paragraph by the whole model
        e = [math.exp((a - max(r.z)) / temperature) for a in r.z]
        assert r.bound >= max(r.z[1:]) - r.z[0] - 1e-6
        want[r.doc_id] += 1 - e[0] / sum(e) >= least
    got = {r.doc_id: r for r in license_scan.scan(d).collect()}
    assert got[9001].n_unknown == want[9001] == 1
    assert all(r.n_confirmed + r.n_unknown >= want[k] for k, r in got.items())


# -- personal data -----------------------------------------------------------------------------------------------------
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if not k % 2 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")) or kind == "card" and 16 <= len(d) <= 19 and luhn(d) or kind == "phone" and 8 <= len(d) <= 15:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_pii(spark, docs):
    r = random.Random(6)
    rows = [(k, "".join(r.choice(["1", "22", "4111111111111111", ".", "-", " ", "@", "+", "a", "é", "b.c", "(555) ", "255", "\n", "%_"]) for _ in range(60))) for k in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "9" * 20_000 + " " + "a" * 20_000 + "@" + "b." * 5000 + "c"), (1003, 'token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2" x'), (1004, "mail a@b.com, 1.2.3.4 and a@b.com")]
    rows += [(2000 + k, f'token = "{hashlib.sha1(str(k).encode()).hexdigest()}"') for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs)
    made = pii.candidates(df)
    out = pii.spans(made, pii.fit(made)).select("row.doc_id", F.col("body").alias("_text"), pii.listed("base").alias("base"), pii.listed("spans").alias("spans"), pii.redacted(F.col("body")).alias("red")).collect()
    for x in out:
        assert x.base == base_spans(x._text)
        assert set(filter(None, x.base.split(","))) <= set(x.spans.split(","))
    by = {x.doc_id: x for x in out if x.doc_id >= 1000}
    assert by[1004].red == "mail [EMAIL], [IP] and [EMAIL]" and by[1000].red == "" and by[1003].red == 'token = "[SECRET]" x'
    empty = df.where("false")
    assert pii.spans(pii.candidates(empty), pii.fit(pii.candidates(empty))).count() == 0


def test_long_secrets(spark, docs):
    """A token has no greatest length."""
    token = lambda n: "".join(hashlib.sha256(f"{n} {k}".encode()).hexdigest() for k in range(9))[:n]
    rows = [(2000 + k, f'token = "{hashlib.sha1(str(k).encode()).hexdigest()}"') for k in range(40)] + [(n, f'token = "{token(n)}" x') for n in (200, 201, 500)]
    made = pii.candidates(spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs))
    red = {r.doc_id: r.red for r in pii.spans(made, pii.fit(made)).select("row.doc_id", pii.redacted(F.col("body")).alias("red")).collect()}
    assert [red[n] for n in (200, 201, 500)] == ['token = "[SECRET]" x'] * 3


# -- quality -----------------------------------------------------------------------------------------------------------
def measured(text):
    w = WORD.findall(text or "")
    wins = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    inside = {k + j for k in range(len(w) - 2) if wins[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def test_quality(spark, docs, odd, empty):
    for df, rows in ((docs, [tuple(r) for r in docs.collect()]), (odd, ODD)):
        got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.ledger(df, keep=["doc_id"]).collect())
        assert got == collections.Counter((name, *measured(text)) for name, text in rows)
    assert quality_rules.ledger(empty).count() == 0
    made = quality_rules.ledger(docs).cache()
    ab = {r.rule: (r.n_failed, r.n_only) for r in quality_rules.ablation(made).collect()}
    for name, bit in quality_rules.BIT.items():
        assert ab[name][0] == made.where(F.col("fail_bits").bitwiseAND(F.lit(bit)) != 0).count()
        assert ab[name][1] == made.where(F.col("fail_bits") == bit).count()


# -- stages on odd tables ----------------------------------------------------------------------------------------------
def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls in any column, empty texts, repeated ids and rows, clashing names, and no rows at all."""
    spark.createDataFrame([("i", "w w w w w w w w w")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    long = " ".join(f"w{k}" for k in range(80)) + " mail a@b.com now"
    rows = [*ODD, (20, long), (20, long), (None, long + " x"), (21, long.replace("w5", "v5").replace("w6", "v6").replace("w7", "v7"))]
    names = "doc_id long, text string, lang string, source string, n_chars long, n_words long, _text string, row int, cands int, base int, fail_bits int, segment int, _bad int, label int, elements int"
    df = spark.createDataFrame([(*r, None, "s", None, 77, None, 1, 2, 3, 4, 5, 6, 7, 8) for r in rows], names)
    want = {quality_rules: 4, ngram_join: None, decontamination: None, pii: len(rows)}
    for module, n in want.items():
        out = module.stage(spark, df, str(tmp_path))
        got = out.collect()
        assert out.columns == df.columns and all(r.n_words == 77 and r.fail_bits == 4 for r in got)
        assert n is None or len(got) == n
        texts = {r.doc_id: r.text for r in got}
        if module is ngram_join:
            assert sum((r.text or "").startswith("w0 ") for r in got) == 2 and sum(not (r.text or "").strip() for r in got) == 4
        elif module is decontamination:
            assert {r.doc_id for r in got} == {r[0] for r in rows} - {6}
        elif module is pii:
            assert "[EMAIL]" in texts[20] and "a@b.com" not in texts[20] and any(r.doc_id == 7 and r.text is None for r in got)
        assert module.stage(spark, df.where("false"), str(tmp_path)).count() == 0
    packed = best_fit.stage(spark, df, str(tmp_path)).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == expected_pieces(rows)


def test_many_matches_in_one_text(spark):
    """More matches than a block of prefixes holds, some overlapping."""
    text = " ".join(f"x{k}@y{k}.com 10.0.{k % 300}.1, 4111 1111 1111 1111;" for k in range(400))
    made = pii.candidates(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    r = pii.spans(made, pii.Model({}, {})).select(pii.listed("base").alias("base"), pii.redacted(F.col("body")).alias("red")).first()
    assert r.base == base_spans(text) and r.base.count("email") == 400
    assert r.red == re.sub("4111 1111 1111 1111", "[CARD]", re.sub(r"x\d+@y\d+\.com", "[EMAIL]", re.sub(r"10\.0\.(\d+)\.1", lambda m: "[IP]" if int(m[1]) < 256 else m[0], text)))
