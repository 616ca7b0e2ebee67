import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm import hard_negatives as hn

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
    T.StructField("label", T.IntegerType()), T.StructField("row", T.StringType()), T.StructField("place", T.StringType()),
    T.StructField("block", T.StringType()), T.StructField("v", T.StringType())])


def table(spark, rows):
    return spark.createDataFrame([(*r, "r", "p", "b", "v") for r in rows], SCHEMA)


def plain(rows, every, scale=256):
    """Row by row from the definition."""
    kept = []
    for key, x, label in rows:
        if key is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        kept.append((key, label, [math.floor(scale * c) for c in x]))
    out = []
    for i, (a_id, a_label, a) in enumerate(kept):
        if a_id % every:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(a, b)), b_id, label) for j, (b_id, label, b) in enumerate(kept) if j != i))
        for p_score, p_id, _ in [s for s in scored if s[2] == a_label][:5]:
            window = [s for s in scored if s[2] != a_label and -80 * p_score <= -100 * s[0] <= -100 * p_score][:5]
            out += [(a_id, p_id, k + 1, n_id, -p_score, -n_score) for k, (n_score, n_id, _) in enumerate(window)]
    return sorted(out)


def mined(spark, rows, **how):
    found = hn.mine(table(spark, rows), **how)
    return sorted(tuple(r) for r in found.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("dims, bits", [(2, 3), (3, 2), (4, 1)])
def test_neighbours_on_the_curve_are_neighbours(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    keys = hn.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    walked = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walked, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold():
    rng = np.random.default_rng(3)
    exact = hn.Exact(300, 6)
    a, rows = rng.integers(-300, 300, (20, 6)), rng.integers(-300, 300, (50, 6))
    least, most = exact.bounds(a, rows.min(axis=0)[None], rows.max(axis=0)[None])
    scores = exact.times(a, rows)
    assert (scores >= least).all() and (scores <= most).all()


def vectors(seed, n, dims=5, labels=3, clusters=6):
    rng = random.Random(seed)
    centers = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(clusters)]
    return [(k, [c + rng.gauss(0, 0.2) for c in rng.choice(centers)], rng.choice([0, *range(labels)])) for k in range(n)]


@pytest.mark.parametrize("block, seeds", [(2048, None), (16, None), (16, 1), (5, 3)])
def test_mining_equals_brute_force(spark, block, seeds):
    rows = vectors(block, 400)
    want = plain(rows, 20)
    assert len(want) > 50
    assert mined(spark, rows, every=20, block_rows=block, seeds=seeds) == want


def test_copies_nulls_and_odd_vectors(spark):
    """A third of all rows is one vector; ids and whole rows repeat; vectors of other lengths."""
    same = [0.5, 0.25, -0.5, 0.0, 1.0]
    rows = vectors(9, 120) + [(k, same, k % 2) for k in range(120, 200)] + [
        (0, same, 0), (0, same, 0), (20, same, 1), (None, same, 0), (40, None, 0), (60, same, None), (80, [0.1, None, 0.2], 1),
        (100, [float("nan")], 0), (7, [float("inf")], 0), (3, [], 0), (40, [0.3, 0.9], 1), (8, [0.0] * 5, 2)]
    assert mined(spark, rows, every=20, block_rows=16) == plain(rows, 20)


def test_large_numbers_are_exact(spark):
    rows = [(k, [(k * 7919 % 1000) * 1e3 + 0.3, (k * 104729 % 997) * -1e3], k % 2) for k in range(60)]
    assert mined(spark, rows, every=10, block_rows=16) == plain(rows, 10)
    with pytest.raises(ValueError):
        hn.mine(table(spark, [(0, [1e300], 0)]))


def test_no_rows(spark):
    assert mined(spark, []) == [] and mined(spark, [(0, None, 1)]) == [] and mined(spark, [(0, [1.0], 1)]) == []


def test_zone_maps_leave_blocks_out(spark):
    """Clusters far apart: an anchor's plan names few of the blocks."""
    rng = random.Random(1)
    rows = [(k, [100.0 * (k % 8 == c) + rng.gauss(0, 0.1) for c in range(8)], k % 2) for k in range(4000)]
    df = table(spark, rows).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").alias("id"), "label",
                                   F.transform("embedding", lambda x: F.floor(x * 256)).alias("v"))
    blocks, zones = hn._layout(df, 8, 50)
    chunks = hn._chunks(blocks, 100, 8)
    pages = zones.select(F.lit(0).alias("page"), F.struct("block", "label", "low", "high").alias("zone")).groupBy("page").agg(
        F.collect_list("zone").alias("zones"))
    asked = chunks.withColumn("windows", F.transform("anchors", lambda a, i: F.struct(
        i.alias("anchor"), F.lit(0).alias("k"), F.lit(10 ** 8).alias("low"), F.lit(10 ** 12).alias("high"))))
    plan = hn._plan(asked, pages, 1, hn.Exact(30000, 8), 8, True)
    whole = chunks.count() * zones.count() / 2
    assert 0 < plan.count() < 0.4 * whole
