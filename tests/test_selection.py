import random

import pytest
from pyspark.sql import functions as F

from sievework.operators import learning, scoring, selection


@pytest.mark.parametrize("kind", ["even", "exponential", "one value", "two values", "copies", "tiny"])
def test_kth_smallest_of_any_doubles(spark, kind):
    rng = random.Random(kind)
    values = {"even": [rng.uniform(-5, 5) for _ in range(3000)], "exponential": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(2000)],
              "one value": [3.25] * 50, "two values": [-0.5, 7.0] * 20, "copies": [0.0] * 900 + [rng.gauss(0, 1e-9) for _ in range(300)],
              "tiny": [5e-324, 0.0, 1e-323, 1.7e308, -1.7e308]}[kind]
    df = spark.createDataFrame([(v,) for v in values], "s double").cache()
    ordered = sorted(values)
    for k in {0, len(values) // 3, len(values) // 2, len(values) - 1}:
        assert selection.kth_smallest(df, "s", k, ordered[0], ordered[-1]) == ordered[k]


def test_a_million_distinct_scores(spark):
    n = 1_000_000
    scored = spark.range(n).select(F.col("id").alias("row_id"), (F.pmod(F.col("id") * 7919, F.lit(n)) / 7.0).alias("total_score"))
    ranked = scoring.rank_scores(scored)
    wrong = ranked.filter((F.col("rank") != n - F.round(F.col("total_score") * 7)) | (F.col("n_ranked") != n))
    assert wrong.isEmpty() and ranked.count() == n
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
    stats = learning.score_stats(scored).first()
    assert (stats.total_candidates, stats.min, stats.median) == (n, 0.0, round(n // 2 / 7, 2))


def test_equal_null_and_nan_scores(spark):
    df = spark.createDataFrame([(k, [1.5, 1.5, None, 2.0][k % 4]) for k in range(400)], "row_id long, total_score double")
    got = {r.row_id: r["rank"] for r in scoring.rank_scores(df).collect()}
    want = sorted(range(400), key=lambda k: (-([1.5, 1.5, -1.0, 2.0][k % 4]), k))
    assert got == {k: i + 1 for i, k in enumerate(want)}
    stats = learning.score_stats(spark.createDataFrame([(None,), (float("nan"),), (1.0,), (3.0,)], "total_score double")).first()
    assert tuple(stats) == (4, 2.0, 1.0, 3.0, 3.0)


def test_a_repeated_default_role_is_an_error(spark, people):
    lexicon = spark.createDataFrame([("ai_agent_developer", ["a"]), ("ai_agent_developer", ["b"])], "role_key string, terms array<string>")
    with pytest.raises(Exception, match="(?i)subquery"):
        scoring.with_role_terms(people({}), lexicon, "ai_agent_developer").collect()
