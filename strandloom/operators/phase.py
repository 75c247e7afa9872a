"""Greedy phasing of the graph, by islands.

A node starts an island when no edge spans it; an island's first node receives no votes, so islands are independent
and are phased in parallel, those of a stretch by one call. An island's state is its nodes and aggregated edges, never reads. Only this step is sequential.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.edges import LINK_BITS, neighbourhoods, packed
from strandloom.params import INDEL, MOD, REPEAT_INDEL, SNP
from strandloom.sources import shared

ASSIGNED = "chrom long, pos long, block long, hp int"


def linked(node_types: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with their packed edges, as edges.neighbourhoods() gives them, from types and decided edges."""
    d = F.col("decision")
    own = edges.groupBy("chrom", F.col("p1").alias("pos")).agg(F.max("p2").alias("far"), F.collect_list(F.when(d != 0, packed(d, d))).alias("links"))
    return node_types.join(own, ["chrom", "pos"], "left").withColumn("links", F.coalesce("links", F.array().cast("array<bigint>")))


def islands(node: DataFrame, distance: int = 300_000, size: int = 1 << 16) -> DataFrame:
    """(chrom, pos, vtype, links, visit, island) of nodes with far and links; an island is named by its first position.

    A contig is cut into bins of ``size`` positions. A row a bin tells the bin after it what reaches beyond, so no task has a whole contig's nodes.
    """
    x = node.withColumn("bin", F.floor(F.col("pos") / size))
    over = Window.partitionBy("chrom").orderBy("bin")  # a row a bin
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    bins = x.groupBy("chrom", "bin").agg(F.max("far").alias("_far"), F.min("pos").alias("_first"))
    bins = bins.select("chrom", "bin", F.max("_far").over(before).alias("_reach"), F.lead("_first").over(over).alias("_next"))
    by = Window.partitionBy("chrom", "bin").orderBy("pos")
    reach = F.greatest(F.max("far").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.col("_reach"))
    x = x.join(bins, ["chrom", "bin"]).withColumn("gap", F.coalesce(F.lead("pos").over(by), F.col("_next")) - F.col("pos"))
    x = x.withColumn("visit", F.coalesce(F.col("gap") <= distance, F.lit(False))).withColumn("reach", reach)
    x = x.withColumn("opens", F.when(F.col("reach").isNull() | (F.col("reach") < F.col("pos")), F.col("pos")))
    x = x.withColumn("island", F.max("opens").over(by)).select("chrom", "pos", "vtype", "links", "visit", "bin", "island")
    # nodes before the first one of a bin that opens belong to the last island of the bins before
    last = x.groupBy("chrom", "bin").agg(F.max("island").alias("_last")).select("chrom", "bin", F.max("_last").over(before).alias("_last"))
    return x.join(last, ["chrom", "bin"]).withColumn("island", F.coalesce("island", "_last")).drop("bin", "_last")


def nodes(node_types: DataFrame, edges: DataFrame, distance: int = 300_000) -> DataFrame:
    """(chrom, pos, vtype, links, visit, island). visit: whether the walk places the node at all."""
    return islands(linked(node_types, edges), distance)


def _walked(pos: list, vtype: list, visit: list, out_edges: dict[int, list]) -> list[tuple]:
    """(pos, block, hp) of the placed nodes. out_edges: by place (place, decision, weight, few votes, clear)."""
    received: dict[int, list] = defaultdict(list)
    rows, block, reached = [], None, None
    for i, p in enumerate(pos):
        if not visit[i]:
            continue
        votes = received.pop(i, [])
        h = [0, 0]
        for hap, w, *_ in votes:
            h[hap - 1] += w
        single = sum(v[2] for v in votes)
        if single > 3:  # one read may vote again and again: then only well supported votes count
            sure = [0, 0]
            for hap, w, one, clear, kind in votes:
                if not one and clear and w >= 10 and kind != INDEL:
                    sure[hap - 1] += w
            h = sure if any(sure) else h
        if h[0] == h[1]:
            if reached is not None and p < reached:
                continue
            block, hp = p, 1
        else:
            hp = 1 if h[0] > h[1] else 2
        rows.append((p, block, hp))
        for j, d, w, one, clear in sorted(out_edges.get(i, ())):
            received[j].append((hp if d == 1 else 3 - hp, w, one, clear, vtype[i]))
            reached = pos[j]
    return rows


def walk(node: pd.DataFrame, edge: pd.DataFrame, adjacent: int) -> pd.DataFrame:
    """Phase a run of nodes that no edge leaves. Weights are in tenths, so sums are exact."""
    node = node.sort_values("pos")
    pos, vtype = node.pos.tolist(), node.vtype.tolist()
    place = {p: k for k, p in enumerate(pos)}
    out_edges: dict[int, list] = defaultdict(list)
    for a, b, d, w, para, cross, ratio in zip(edge.p1, edge.p2, edge.decision, edge.weight, edge.para, edge.cross, edge.ratio):
        i, j = place[a], place[b]
        if d and j - i <= adjacent:
            out_edges[i].append((j, d, 1 if vtype[i] == REPEAT_INDEL else 10 * int(w), para + cross <= 1, ratio < 0.2))
    rows = _walked(pos, vtype, node.visit.tolist(), out_edges)
    return pd.DataFrame([(node.chrom.iloc[0], *r) for r in rows], columns=["chrom", "pos", "block", "hp"])


def _walk_linked(t: pa.Table, adjacent: int) -> pa.Table:
    """walk() on nodes with packed edges."""
    t = t.sort_by("pos")
    pos, vtype = t["pos"].to_numpy(), t["vtype"].to_numpy()
    links = t["links"].combine_chunks()
    i = np.repeat(np.arange(len(pos)), links.value_lengths().to_numpy(zero_copy_only=False))
    x = links.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    j = np.searchsorted(pos, pos[i] + (x >> LINK_BITS))
    one, two = vtype[i], vtype[j]
    mixed = ((one == SNP) & (two == MOD)) | ((one == MOD) & (two == SNP))
    d = np.where(mixed, x >> 5 & 3, x >> 3 & 3) - 1
    w = np.where(one == REPEAT_INDEL, 1, np.where(x & 4, 200, 10))
    used = (d != 0) & (j - i <= adjacent)
    out_edges: dict[int, list] = defaultdict(list)
    for k, *link in zip(*[c[used].tolist() for c in (i, j, d, w, x >> 1 & 1, x & 1)]):
        out_edges[k].append(link)
    rows = _walked(pos.tolist(), vtype.tolist(), t["visit"].to_pylist(), out_edges)
    p, block, hp = zip(*rows) if rows else ((), (), ())
    chrom = pa.array([t["chrom"][0].as_py()] * len(rows), pa.int64())
    return pa.table([chrom, pa.array(p, pa.int64()), pa.array(block, pa.int64()), pa.array(hp, pa.int32())], names=["chrom", "pos", "block", "hp"])


def greedy(node: DataFrame, edges: DataFrame | None = None, adjacent: int = 35, stretch: int = 1 << 14) -> DataFrame:
    """(chrom, pos, block, hp) of the placed nodes; block is its first position. edges: only for nodes that carry no links of their own.

    Islands that begin within ``stretch`` positions are walked by one call, which gives what a call an island would: nothing passes from one to the next.
    """
    if "links" not in node.columns:
        node = linked(node, edges)
    node = node.select(F.col("chrom").cast("long").alias("chrom"), F.col("pos").cast("long").alias("pos"), "vtype", "links", "visit", F.floor(F.col("island") / stretch).alias("run"))
    return node.groupBy("chrom", "run").applyInArrow(lambda t: _walk_linked(t, adjacent), ASSIGNED)


def walked(obs: DataFrame, distance: int = 300_000, adjacent: int = 35, min_quality: int = 12, threshold: float = 0.7, low: float = 0.1) -> DataFrame:
    """greedy() on the graph of clean observations. Runs a job: nodes with their packed edges are checkpointed below spark.checkpoint.dir, since islands ask for them more than once."""
    shared.set_checkpoints(obs.sparkSession)
    return greedy(islands(neighbourhoods(obs, adjacent, min_quality, threshold, low).checkpoint(), distance), adjacent=adjacent)


def blocks(assigned: DataFrame) -> DataFrame:
    """Placed nodes of blocks of two or more, with ps = first position + 1."""
    n = F.count("*").over(Window.partitionBy("chrom", "block"))
    return assigned.withColumn("n", n).where("n >= 2").select("chrom", "pos", (F.col("block") + 1).alias("ps"), "hp")


def export(corrected: DataFrame) -> DataFrame:
    return corrected.select("chrom", "pos", F.when(F.col("hp") == 1, "0|1").otherwise("1|0").alias("gt"), "ps")


def block_summary(phased: DataFrame) -> DataFrame:
    return phased.groupBy("chrom", "ps").agg(F.count("*").alias("n_nodes"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
