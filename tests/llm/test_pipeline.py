"""Each stage against its brute-force version on its own input."""

import collections
import re

import corpus_pipeline
from test_llm import ALNUM, base_spans, brute_components, brute_hits, expected_pieces, low, measured  # noqa: F401

from strandloom.llm._store import stored

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        if name == "best_fit_packing":
            got = collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in docs.collect())
            assert got == expected_pieces(rows.items())
            continue
        assert docs.columns == names
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality_rules":
            for k, text in rows.items():
                n, _, symbols, _, repeated = measured(text)
                assert (k in after) <= (n >= 50 and 100 * repeated <= 50 * n and 100 * symbols <= 20 * n)
            assert len(after) > 0.5 * len(rows)
        elif name == "near_duplicates":
            of = collections.defaultdict(list)
            for (k, n, c), _ in brute_components(list(rows.items()), 5, 80).items():
                of[c if n else ("own", k)].append(k)
            assert set(after) == {min(v) for v in of.values()}
        elif name == "decontamination":
            bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            long = [b for b in bench if len(ALNUM.findall(low(b[1]))) >= 8]
            hit = {x[0] for x in brute_hits(rows.items(), long) if x[2]} | {x[0] for x in brute_hits(rows.items(), bench) if x[3] >= 2}
            assert set(after) == set(rows) - hit
        else:
            assert set(after) == set(rows)
            for k, text in rows.items():  # base spans are gone, and a text without candidates is as it was
                assert not base_spans(after[k])
                if re.fullmatch(r"[^@+]*", text) and not re.search(r"[0-9]{3}|[A-Za-z0-9+/_=-]{20}|[0-9]\.|\[at\]|\(at\)", text):
                    assert after[k] == text
        rows = after


def test_stages_drop_their_large_tables(spark):
    from pathlib import Path

    from strandloom.llm import decontamination, ngram_join
    from strandloom.llm._store import shared_dir

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for module in (ngram_join, decontamination):
        at = Path(shared_dir(spark).removeprefix("file://"))
        before = set(at.iterdir())
        assert module.stage(spark, docs, sf).count() > 0
        assert not {x.name.split("-")[0] for x in set(at.iterdir()) - before} & {"sets", "members", "classes", "rows", "postings"}
