"""Phasing by stretches of islands, with edges counted where observations meet, against whole contigs and separate frames."""

import re

from pyspark.sql import functions as F

from strandloom.operators import correct, edges, phase
from strandloom.plans import api
from strandloom.plans.bindings import view

SF = "/root/testdata/sf0.001"


def _odd(spark, name):
    """Observations with null qualities, several of a read at a position, kinds that differ between reads, and unknown alleles."""
    o = view(spark, SF, name)
    more = o.where("read_id % 5 = 0").withColumn("allele", (F.col("read_id") % 3).cast("int")).withColumn("vtype", (F.col("pos") % 5).cast("int"))
    return o.withColumn("qual", F.when(F.col("read_id") % 7 > 0, F.col("qual"))).unionByName(more)


def test_neighbourhoods_equal_decided_edges(spark):
    o = _odd(spark, "obs")
    t = edges.node_types(o)
    want = {(r.chrom, r.pos): (r.vtype, r.far, sorted(r.links)) for r in phase.linked(t, edges.decided(edges.edge_weights(o), t)).collect()}
    kind = {(r.chrom, r.pos): r.vtype for r in t.collect()}
    got = {}
    for r in edges.neighbourhoods(o).collect():
        own = []
        for x in r.links:
            mixed = {kind[r.chrom, r.pos], kind[r.chrom, r.pos + (x >> edges.LINK_BITS)]} == {0, 2}
            d = x >> 5 & 3 if mixed else x >> 3 & 3
            if d != 1:
                own.append(x & ~0b1111000 | d << 5 | d << 3)
        got[r.chrom, r.pos] = (r.vtype, r.far, sorted(own))
    assert got == want and sum(len(x[2]) for x in want.values()) > 1000


def test_stretches_and_bins_of_any_size(spark):
    for o in (view(spark, SF, "obs_gapped"), _odd(spark, "obs_gapped")):
        t = edges.node_types(o)
        e = edges.decided(edges.edge_weights(o), t)
        for distance in (10, 300_000):
            n = phase.nodes(t, e, distance)
            node, edge = n.toPandas(), e.where("decision <> 0").toPandas()
            want = {(r.chrom, r.pos, r.block, r.hp) for c in node.chrom.unique() for r in phase.walk(node[node.chrom == c], edge[edge.chrom == c], 35).itertuples()}
            near = edges.neighbourhoods(o)
            for size, stretch in ((1, 1), (7, 40), (1 << 16, 1 << 14)):
                x = phase.islands(near, distance, size)
                assert {(r.chrom, r.pos): r.island for r in x.collect()} == {(r.chrom, r.pos): r.island for r in node.itertuples()}
                assert {tuple(r) for r in phase.greedy(x, stretch=stretch).collect()} == want


def test_phasing_walks_once_by_stretches(spark):
    """Both a call an island and a second walk for the correction took most of the time."""
    plan = api.phase_observations(view(spark, SF, "obs_gapped"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMap") == 1 and "FlatMapGroupsInArrow [chrom" in plan and ", run" in plan
    assert phase.walked(view(spark, SF, "obs_gapped").where("false")).count() == 0


def test_no_window_over_the_nodes_of_a_contig(spark):
    n = edges.neighbourhoods(view(spark, SF, "obs_gapped")).localCheckpoint()
    plan = phase.islands(n)._jdf.queryExecution().optimizedPlan().toString()
    by = re.findall(r"windowspecdefinition\(chrom#\d+L?, (\w+)#\d+L?( ASC)?", plan)
    assert by and {name for name, _ in by} == {"bin"}


def test_corrected_equals_votes_in_steps(spark):
    o = _odd(spark, "obs_gapped")
    placed = phase.blocks(phase.walked(o)).localCheckpoint()
    r = correct.reassigned(correct.haplotype_counts(o, correct.read_votes(o, placed)))
    want = placed.drop("hp").join(r.select("chrom", "pos", "hp"), ["chrom", "pos"])
    got = correct.corrected(o, placed)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
