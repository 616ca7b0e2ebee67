"""Blocks of vectors in a recursive pivot tree, and the pairs of blocks that can hold a hit.

A node with too many rows draws pivots from its rows, deals each row to its nearest pivot (of as
many as it needs parts) and cuts the rows of a pivot by ranges of their angle to it (after Brin, "Near Neighbor Search in
Large Metric Spaces", 1995).  Every block keeps the least and largest angle of its rows to each
pivot on its path.  The angle between unit vectors is a metric, so two nodes whose ranges for
one pivot lie further apart than an angle hold no pair within it; pairs of nodes are followed
from the roots down, and what lies below a pair that is left out is never looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import text as tx
from sievework.functions.text import let
from sievework.session import stage

#: Pivots of a node, ranges of angle to each, and levels of the tree.
PIVOTS, RANGES, DEPTH = 8, 4, 12
#: Slack for angles that are computed in floating point.
SLACK = 1e-6


@dataclass(frozen=True)
class PivotTree:
    """``rows``: q, id, v, block.  ``zones``: a row per block with its ``path`` (array of child
    names) and the ranges ``lo``, ``hi`` of its rows' angles to the pivots on the path."""

    rows: DataFrame
    zones: DataFrame
    depth: int
    pivots: int


def _angle(a: Column, b: Column) -> Column:
    inner = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    return F.acos(tx.clamp(inner, -1.0, 1.0))


def grow(unit: DataFrame, block_rows: int, pivots: int = PIVOTS, ranges: int = RANGES) -> PivotTree:
    """The tree over unit vectors (q, id, v), one root per non-null ``q``.

    A node splits while it has more than ``block_rows`` rows and its last split took rows away:
    copies of one vector, which no angle tells apart, are cut into hashed blocks instead.
    """
    def wanted(most: int, each: int) -> Column:
        """Parts that a node of ``size`` rows needs, ``each`` of which are cut elsewhere."""
        return F.least(F.lit(most), F.ceil(F.col("size") / F.lit(float(block_rows * each)))).cast("int")

    rows = stage(unit.filter("q is not null").select(
        "q", "id", "v", F.lit("").alias("node"), F.array().cast("array<double>").alias("angles"),
        F.lit(None).cast("long").alias("held")), "tree-rows")
    depth = 0
    for depth in range(DEPTH + 1):
        sizes = stage(rows.groupBy("q", "node").agg(F.count(F.lit(1)).alias("n"), F.first("held").alias("held")), "node-sizes")
        large = sizes.filter((F.col("n") > block_rows) & (F.col("held").isNull() | (F.col("n") < F.col("held"))))
        if depth == DEPTH or large.isEmpty():
            break
        drawn = rows.join(large.select("q", "node"), ["q", "node"], "left_semi").groupBy("q", "node").agg(F.array(*[
            F.min_by("v", F.xxhash64("id", F.lit(depth), F.lit(j))) for j in range(pivots)]).alias("marks"))
        marks = stage(drawn.join(large.select("q", "node", "n"), ["q", "node"]), "pivots")
        # The pivots of the few nodes of the upper levels are small tables, which the planner
        # broadcasts; further down no node is large.
        split = rows.join(marks.select("q", "node", "marks", F.col("n").alias("size")), ["q", "node"], "left").withColumn(
            "new", F.when(F.col("marks").isNotNull(), let(F.col("v"), lambda v: F.transform("marks", lambda m: _angle(m, v)))))
        dealt = stage(split.select(
            "q", "id", "v", "node", "held", "size", "angles", "new", F.slice("new", F.lit(1), wanted(pivots, 1)).alias("near")).select(
            "*", F.array_position("near", F.array_min("near")).alias("nearest"), F.array_min("near").alias("own")).drop("near"),
            "dealt-rows")
        cuts = stage(dealt.filter("new is not null").groupBy("q", "node", "nearest").agg(F.percentile_approx(
            "own", [k / ranges for k in range(1, ranges)], F.lit(1000)).alias("cuts")), "angle-cuts")
        met = dealt.join(cuts, ["q", "node", "nearest"], "left")
        range_ = F.size(F.filter("cuts", lambda c: c < F.col("own"))) * wanted(ranges, pivots) / ranges
        child = F.concat("nearest", F.lit("-"), F.floor(range_))
        moved = F.col("new").isNotNull()
        rows = stage(met.select(
            "q", "id", "v", F.when(moved, F.concat("node", F.lit("/"), child)).otherwise(F.col("node")).alias("node"),
            F.when(moved, F.concat("angles", "new")).otherwise(F.col("angles")).alias("angles"),
            # a node that was not split keeps what it was held against, so it stays a leaf
            F.when(moved, F.col("size")).otherwise(F.col("held")).alias("held")), "tree-rows")
    parts = sizes.select("q", "node", F.ceil(F.col("n") / F.lit(float(block_rows))).cast("int").alias("parts"))
    cut = stage(rows.join(parts, ["q", "node"]).withColumn(
        "block", F.concat("node", F.lit("#"), F.pmod(F.xxhash64("id"), F.col("parts")))), "vector-blocks")
    width = pivots * depth
    zones = cut.groupBy("q", "block").agg(
        F.array(*[F.min(F.get("angles", F.lit(j))) for j in range(width)]).cast("array<double>").alias("lo"),
        F.array(*[F.max(F.get("angles", F.lit(j))) for j in range(width)]).cast("array<double>").alias("hi"))
    return PivotTree(cut.select("q", "id", "v", "block"),
                     stage(zones.withColumn("path", F.split("block", "[/#]")), "zones"), depth, pivots)


def block_pairs(tree: PivotTree, limit: float) -> DataFrame:
    """Pairs of blocks (q, lo, hi; each once, a block also with itself) that may hold two vectors
    within the angle ``limit``, followed level by level from the roots."""
    limit += SLACK

    def level(k: int) -> DataFrame:
        """Nodes ``k`` steps below the root (leaves higher up stand for themselves), blocks at the end."""
        width = tree.pivots * min(k, tree.depth)
        last = F.size("path") - 1

        def prefix(steps: int) -> Column:
            return F.array_join(F.slice("path", F.lit(1), F.least(F.lit(steps + 1), last)), "/")

        whole = k > tree.depth
        name = F.col("block") if whole else prefix(k)
        return tree.zones.select("q", name.alias("node"), prefix(k - 1).alias("parent"), "lo", "hi").groupBy(
            "q", "node", "parent").agg(
            F.array(*[F.min(F.get("lo", F.lit(j))) for j in range(width)]).cast("array<double>").alias("lo"),
            F.array(*[F.max(F.get("hi", F.lit(j))) for j in range(width)]).cast("array<double>").alias("hi"))

    pairs = tree.zones.select("q", F.lit("").alias("a"), F.lit("").alias("b"), F.lit(0).alias("shared")).distinct()
    for k in range(1, tree.depth + 2):
        nodes = stage(level(k), "tree-level")
        first, second = (nodes.select("q", F.col("parent").alias(s), F.col("node").alias(f"{s}_node"), F.col("lo").alias(f"{s}_lo"),
                                      F.col("hi").alias(f"{s}_hi")) for s in ("a", "b"))
        same = F.col("a") == F.col("b")
        # Children of one node share its pivots and those above; others only where their paths agree.
        shared = F.when(same, F.lit(tree.pivots * min(k, tree.depth))).otherwise(F.col("shared"))

        def apart(x: str, y: str) -> Column:
            gaps = F.zip_with(f"{x}_lo", f"{y}_hi", lambda lo, hi: F.coalesce(lo - hi > limit, F.lit(False)))
            return F.exists(F.slice(gaps, F.lit(1), F.col("common")), lambda gap: gap)

        met = pairs.join(first, ["q", "a"]).join(second, ["q", "b"]).withColumn("common", shared).filter(
            (~same | (F.col("a_node") <= F.col("b_node"))))
        pairs = stage(met.filter(~(apart("a", "b") | apart("b", "a"))).select(
            "q", F.col("a_node").alias("a"), F.col("b_node").alias("b"), F.col("common").alias("shared")), "node-pairs")
    return pairs.select("q", F.col("a").alias("lo"), F.col("b").alias("hi"))
