import numpy as np
import pytest

from sievework.operators import pivots, similarity


def frame(spark, vectors, labels):
    return spark.createDataFrame([(int(k), str(q) if q is not None else None, [float(x) for x in v])
                                  for k, (v, q) in enumerate(zip(vectors, labels))], "id long, label string, v array<double>")


def wanted(vectors, labels, threshold):
    unit = np.array([v / max(np.linalg.norm(v), 1e-8) for v in vectors])
    cosines = unit @ unit.T
    return {(labels[i], i, j) for i in range(len(labels)) for j in range(i + 1, len(labels))
            if labels[i] is not None and labels[i] == labels[j] and cosines[i, j] >= threshold}


def clustered(seed, clusters, each, dims=16, spread=0.05):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(clusters, dims))
    centers /= np.linalg.norm(centers, axis=1)[:, None]
    return np.concatenate([c + spread * rng.normal(size=(each, dims)) / dims ** 0.5 for c in centers])


@pytest.mark.parametrize("threshold", [0.97, 0.6, -0.5])
def test_pairs_equal_brute_force_over_several_levels(spark, threshold):
    rng = np.random.default_rng(4)
    vectors = np.concatenate([clustered(1, 12, 15), rng.normal(size=(100, 16)), np.zeros((3, 16)), np.ones((60, 16))])
    labels = [["a", "a", "b", None][k % 4] for k in range(len(vectors))]
    got = similarity.embedding_cosine(frame(spark, vectors, labels), "label", "id", "v", threshold, block_rows=8)
    rows = [(r.label, r.id_a, r.id_b) for r in got.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == wanted(vectors, labels, threshold)


def test_most_block_pairs_are_skipped_also_inside_a_cell(spark):
    vectors = clustered(2, 40, 50)
    unit = similarity.unit_vectors(frame(spark, vectors, ["x"] * len(vectors)), "label", "id", "v")
    tree = pivots.grow(unit, 32)
    assert tree.depth >= 2
    zones = [r.path for r in tree.zones.select("path").collect()]
    kept = [(tuple(lo.split("/")), tuple(hi.split("/"))) for lo, hi in (
        (r.lo, r.hi) for r in pivots.block_pairs(tree, float(np.arccos(0.95))).collect())]
    n = len(zones)
    assert len(kept) < 0.2 * n * (n + 1) / 2
    # Pairs of different blocks under one child of the root are told apart by pivots as well.
    cells = [p[1] for p in zones]
    inside = sum(m * (m - 1) // 2 for m in map(cells.count, set(cells)))
    assert 0 < sum(a[1] == b[1] and a != b for a, b in kept) < 0.6 * inside


def test_copies_of_one_vector_stay_in_bounded_blocks(spark):
    vectors = np.concatenate([np.ones((300, 4)), np.eye(4)])
    unit = similarity.unit_vectors(frame(spark, vectors, ["x"] * len(vectors)), "label", "id", "v")
    tree = pivots.grow(unit, 20)
    assert max(r["count"] for r in tree.rows.groupBy("q", "block").count().collect()) < 60
