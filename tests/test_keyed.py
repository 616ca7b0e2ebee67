import random

import pytest
from pyspark.sql import functions as F

from sievework.operators import keyed
from sievework.operators.scoring import rank_scores, top_k


def skewed(spark, n=900, seed=1):
    """A third of the rows share one key."""
    rng = random.Random(seed)
    rows = [(i, "hot" if i % 3 == 0 else f"k{rng.randrange(200)}", float(rng.randrange(50))) for i in range(n)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "row_id BIGINT, key STRING, value DOUBLE").repartition(4)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_equals_join(spark, how):
    rows, df = skewed(spark)
    names = sorted({k for _, k, _ in rows})[::2] + (["hot"] if how == "inner" else [])
    right = spark.createDataFrame([(k, k.upper()) for k in dict.fromkeys(names)], "key STRING, up STRING")
    got = {(r.row_id, r.up) for r in keyed.lookup(df, right, ["key"], how).collect()}
    known = set(names)
    want = {(i, k.upper() if k in known else None) for i, k, _ in rows if how == "left" or k in known}
    assert got == want


def test_hot_keys_are_bounded(spark):
    _, df = skewed(spark)
    assert [r.key for r in keyed.hot_keys(df, ["key"], limit=5).collect()] == ["hot"]
    assert keyed.hot_keys(df, ["key"], limit=300).count() <= 300


def test_first_and_latest(spark):
    rows, df = skewed(spark)
    first = {r.key: r.row_id for r in keyed.first_per_key(df, ["key"]).collect()}
    last = {r.key: r.row_id for r in keyed.latest_per_key(df, ["key"], ["value", "row_id"]).collect()}
    for key in {k for _, k, _ in rows}:
        mine = [(v, i) for i, k, v in rows if k == key]
        assert first[key] == min(i for _, i in mine)
        assert last[key] == max(mine)[1]


def test_previous_value_equals_lag(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("aaab"), rng.randrange(100), None if i % 7 == 0 else f"v{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "seq INT, key STRING, at INT, value STRING")
    got = {r.seq: r.prev for r in keyed.previous_value(
        df, "key", ["at", "seq"], "value", "prev", F.floor(F.col("at") / 10)).collect()}
    for key in "ab":
        mine = sorted((at, i, v) for i, k, at, v in rows if k == key)
        for before, now in zip([(0, 0, None), *mine], mine):
            assert got[now[1]] == before[2]


@pytest.mark.parametrize("block_rows", [3, 40, 10_000])
def test_pair_blocks_meets_each_pair_once(spark, block_rows):
    rows, df = skewed(spark, 150)
    counts = df.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    pairs = keyed.pair_blocks(df.join(counts, "key"), ["key"], "row_id", F.col("n"),
                              on=lambda a, b: F.col("value" + a) != F.col("value" + b), block_rows=block_rows)
    got = [(r.key, *sorted((r.row_id_a, r.row_id_b))) for r in pairs.collect()]
    want = {(k, *sorted((i, j))) for i, k, v in rows for j, m, w in rows if k == m and i < j and v != w}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("bits", [0, 4, 20])
def test_rank_without_one_task(spark, bits):
    rows, df = skewed(spark, 400)
    scored = df.withColumnRenamed("value", "total_score")
    got = {r.row_id: (r.rank, r.n_ranked) for r in rank_scores(scored, bits=bits).collect()}
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    assert got == {row[0]: (i + 1, len(rows)) for i, row in enumerate(order)}
    assert [r.row_id for r in top_k(scored, 7).collect()] == [r[0] for r in order[:7]]


def test_filter_stays_above_costly_columns(spark):
    df = spark.range(5).select(F.col("id"), F.concat(F.lit("a"), "id").alias("t"))
    made = keyed.computed_once(df, {"x": F.regexp_count("t", F.lit("[a-z]")), "y": F.col("id") + 1})
    plan = made.filter("x = 1")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    assert [(r.id, r.x, r.y) for r in made.filter("y > 4").collect()] == [(4, 1, 5)]


def test_previous_value_of_a_null_key_crosses_buckets(spark):
    df = spark.createDataFrame([(None, 1), (None, 15), ("a", 2), (None, 27)], "k string, t int")
    got = keyed.previous_value(df, "k", ["t"], "t", "before", F.floor(F.col("t") / 10)).collect()
    assert {(r.k, r.t): r.before for r in got} == {(None, 1): None, (None, 15): 1, (None, 27): 15, ("a", 2): None}


def test_weights_that_are_all_zero_stay(spark):
    from sievework.operators import learning
    weights = spark.createDataFrame([("a", 0.0), ("b", 0.0)], "dimension string, weight double")
    none = spark.createDataFrame([], "dimension string, delta double")
    assert sorted(tuple(r) for r in learning.apply_weights(weights, none).collect()) == [("a", 0.0), ("b", 0.0)]
