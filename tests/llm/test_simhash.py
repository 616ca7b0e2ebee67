import random

import numpy as np
import xxhash

from sievework.llm import simhash


def slow_fingerprint(text, words=4):
    w = "".join(c.lower() if c.isascii() else c for c in (text or "")).translate(
        {k: " " for k in range(9, 14)}).split(" ")
    w = [x for x in w if x]
    if not w:
        return 0
    shingles = [" ".join(w[k:k + words]) for k in range(max(1, len(w) - words + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps, radius):
    root = list(range(len(fps)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(k) for k in range(len(fps))]


def sample(seed, n, flips):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(n)]
    return base + [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, flips))) for b in base for _ in range(3)]


def test_fingerprints_equal_brute_force():
    rng = random.Random(1)
    texts = [None, "", " \t\n", "one", "Two Words", "a b c d", "A B C D E", "É é x y z w", "x\x0by\x1cz w v u"]
    texts += [" ".join(rng.choices(["Alpha", "be\nta", "gam\tma", "ñu", "  ", "Ω"], k=rng.randint(1, 200))) for _ in range(60)]
    texts.append("word " * 70_000)
    assert [f % 2**64 for f in simhash.fingerprints(texts)] == [slow_fingerprint(t) for t in texts]


def test_near_equals_popcount():
    rng = random.Random(2)
    fps = np.array(sample(2, 40, 9)[:128], np.uint64)
    planes = np.zeros((64, 2), np.uint64)
    for k, f in enumerate(fps.tolist()):
        for bit in range(64):
            planes[bit, k // 64] |= np.uint64((f >> bit & 1) << (k % 64))
    for radius in range(8):
        left = np.array([fps[rng.randrange(128)] ^ np.uint64(rng.getrandbits(2)) for _ in range(60)], np.uint64)
        for word in (0, 1):
            got = simhash.near(planes, left, np.full(60, word), radius)
            for a, mask in zip(left.tolist(), got.tolist()):
                want = sum(1 << k for k in range(64) if (a ^ int(fps[64 * word + k])).bit_count() <= radius)
                assert mask == want


def test_every_scheme_is_exact():
    for radius in (0, 3, 4):
        for count in (10, 10**6, 10**9, 10**12):
            masks = simhash.bucket_keys(radius, *simhash.pieces_for(count, radius))
            rng = random.Random(count)
            for _ in range(200):
                flips = sum(1 << k for k in rng.sample(range(64), radius))
                assert any(m & flips == 0 for m in masks)


def test_links_give_the_components_of_all_pairs(spark, monkeypatch):
    from sievework.llm.components import components
    fps = sorted(set(sample(3, 150, 6)))
    near_chain = [fps[0] ^ ((1 << k) - 1) for k in range(1, 40)]  # neighbours one bit apart
    fps = sorted(set(fps + near_chain))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    want = slow_components(fps, 4)
    for count, cell in ((len(fps), 2048), (len(fps), 16), (10**9, 2048)):
        found = simhash.links(df, count, 4, cell)
        roots = {r.node % 2**64: r.root for r in components(found).collect()}
        mine = [roots.get(f, f) for f in fps]
        assert len(set(zip(mine, want))) == len(set(mine)) == len(set(want))


def test_query_equals_brute_force(documents):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 120))) for _ in range(40)]
    for t in texts[:20]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts += [" ".join(w), t]
    rows = [(k * 3 % 1000, t) for k, t in enumerate(texts)] + [(5000, None), (5001, ""), (None, texts[0]), (5002, texts[1]), (5002, texts[1])]
    fps = [slow_fingerprint(t) for _, t in rows]
    root = slow_components(fps, 4)
    least = {}
    for (key, _), r in zip(rows, root):
        if key is not None:
            least[r] = min(least.get(r, key), key)
    docs = documents(*rows)
    got = simhash.near_groups(docs).collect()
    assert sorted((str(r.doc_id), r.fp % 2**64, r.component_id) for r in got) == sorted(
        (str(k), f, least[r]) for (k, _), f, r in zip(rows, fps, root))
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())


def test_empty_and_hot(documents):
    assert simhash.near_groups(documents((1, "a")).limit(0)).collect() == []
    assert simhash.drop_near_copies(documents((1, "a")).limit(0)).collect() == []
    rows = [(k, "the same five words here") for k in range(2000)] + [(3000, "quite another text than that one")]
    assert sorted(r.doc_id for r in simhash.drop_near_copies(documents(*rows)).collect()) == [0, 3000]
