"""Base modifications of reads from their MM and ML tags."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_PART = re.compile(r"([ACGTUN])([-+])([a-z]+|\d+)([.?]?)((?:,\d+)*)$")
_COMPLEMENT = dict(zip("ACGTN", "TGCAN"))
SCHEMA = "aln_id long, qpos long, mod_code string, canonical string, strand int, prob int"


def decoded(seq: str, reverse: bool, mm: str, ml: list[int]) -> Iterator[tuple[int, str, str, int, int]]:
    """(place in seq as stored, code, canonical base, strand 0 or 1, probability or -1). A reversed read is counted from its other end, on complements."""
    read = "".join(_COMPLEMENT.get(b, "N") for b in reversed(seq.upper())) if reverse else seq.upper()
    used = 0
    for part in filter(None, mm.rstrip(";").split(";")):
        m = _PART.match(part.strip())
        if not m:
            raise ValueError(f"malformed base modifications {part!r}")
        base, sign, codes, _, deltas = m.groups()
        base = base.replace("U", "T")
        codes = [codes] if codes.isdigit() else list(codes)
        steps = [int(x) for x in deltas.split(",") if x]
        # on the opposite strand the tag still counts the read's own bases
        places = [k for k, b in enumerate(read) if base == "N" or b == base]
        at = -1
        for d in steps:
            at += d + 1
            if at >= len(places):
                raise ValueError("more modifications than bases")
            for code in codes:
                prob = ml[used] if used < len(ml) else -1
                used += 1
                yield (len(seq) - 1 - places[at] if reverse else places[at]), code, base, int(sign == "-"), prob


def modifications(reads: DataFrame) -> DataFrame:
    """reads: (aln_id, flag, seq, tags) -> one row a modification. At most one read is held with its rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for b in batches:
            rows = []
            for aln, flag, seq, tags in zip(b.aln_id, b.flag, b.seq, b.tags):
                tags = dict(tags) if tags is not None else {}
                mm = tags.get("MM", tags.get("Mm"))
                if mm and seq and seq != "*":
                    ml = [int(x) for x in tags.get("ML", tags.get("Ml", "")).split(",")[1:] if x]
                    rows += [(aln, *r) for r in decoded(seq, bool(flag & 16), mm, ml)]
            yield pd.DataFrame(rows, columns=names)

    return reads.select("aln_id", "flag", "seq", "tags").mapInPandas(run, SCHEMA)
