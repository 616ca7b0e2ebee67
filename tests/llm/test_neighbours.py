import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, part string, node string, rank int"


def frame(spark, vectors):
    return spark.createDataFrame([(k, None if v is None else [None if x is None else float(x) for x in v], "p", "n", 1)
                                  for k, v in vectors], SCHEMA)


def brute(vectors, k):
    good = {i: np.array(v, np.float32).astype(float) for i, v in vectors if i is not None and v is not None and all(
        x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in good:
        if q % 20 == 0:
            ranked = sorted(((-(good[q] * v).sum(), i) for i, v in good.items() if i != q))
            out[q] = [(i, -s) for s, i in ranked[:k]]
    return out


def ask(spark, vectors, k=20, **more):
    got = neighbours.nearest(frame(spark, vectors), F.col("vec_id") % 20 == 0, k, **more).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_few_vectors_and_unusable_ones(spark):
    rng = np.random.default_rng(1)
    vectors = [(k, rng.normal(size=4).tolist()) for k in range(12)]
    vectors += [(20, vectors[3][1]), (40, vectors[3][1]), (60, None), (80, [0.0] * 4), (100, [1.0, None, 0.0, 0.0]),
                (120, [1.0, float("nan"), 0, 0]), (140, [float("inf"), 1, 0, 0]), (None, vectors[0][1]), (40, vectors[3][1]), (-20, [0, 0, -0.0, 2])]
    got, want = ask(spark, vectors), brute(vectors, 20)
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=1e-12)


@pytest.mark.parametrize("norms", [False, True])
def test_recall_and_a_vector_that_many_share(spark, monkeypatch, norms):
    monkeypatch.setattr(neighbours, "PART_NODES", 200)  # several parts, so that searches cross them
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(10, 16))
    data = centres[rng.integers(0, 10, 1500)] + 0.7 * rng.normal(size=(1500, 16))
    data = data if norms else data / np.linalg.norm(data, axis=1, keepdims=True)
    vectors = [(k, v.tolist()) for k, v in enumerate(data)]
    vectors += [(k, data[7].tolist()) for k in range(1500, 2300)]
    got, want = ask(spark, vectors), brute(vectors, 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    found = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert found >= 0.95 * 20 * len(want)
    assert all([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in want if q >= 1500)  # ties to smaller ids


def test_empty_table_and_one_vector(spark):
    assert ask(spark, []) == {} and ask(spark, [(0, [1.0, 2.0])]) == {}


def test_walk_finds_the_best_of_a_connected_graph():
    vec = np.eye(6)[:, :2] + np.arange(6)[:, None]
    near = [[1], [0, 2], [1, 3], [2, 4], [3, 5], None]
    got = neighbours.walk(np.ones(2), [0], set(), vec, near, 6)
    assert set(got) == set(range(6)) and not got[5][1] and all(got[k][1] for k in range(5))


def test_a_walk_looks_at_many_nodes_at_a_time():
    """Scores are worked out for the neighbours of several nodes together, and the result is that of a walk by single nodes."""
    rng = np.random.default_rng(4)
    vec, asked = rng.normal(size=(300, 8)), []

    class Counted:
        def __len__(self):
            return len(vec)

        def __getitem__(self, at):
            asked.append(len(at))
            return vec[at]

    near = [sorted({int(k) for k in rng.integers(0, 300, 20)} | {(p + 1) % 300}) for p in range(300)]
    got = neighbours.walk(vec[5], [5], set(), Counted(), near, 200)
    assert len(asked) < 40 and sum(asked) <= 300
    best = np.argsort(-(vec * vec[5]).sum(1))[:200]
    assert len(got) == 200 and len(set(got) & set(best.tolist())) >= 195 and all(looked for _, looked in got.values())
