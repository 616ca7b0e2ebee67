import random

import corpus_pipeline
from sievework.llm import packing
from tests.llm.test_exact import fold
from tests.llm.test_simhash import slow_components, slow_fingerprint


def test_stages_against_brute_force(spark, documents, tmp_path):
    rng = random.Random(1)
    words = {"en": ["river", "stone", "light", "walks", "under"], "de": ["straße", "über", "nicht", "großer", "wald"]}
    rows = []
    for k in range(120):
        lang = rng.choice(["en", "en", "de"])
        rows.append((k, " ".join(rng.choices(words[lang], k=rng.randint(20, 90))), lang, rng.choice(["a", "b", None])))
    rows += [(200 + k, rows[k][1].upper() if k < 5 and rows[k][2] == "en" else rows[k][1], rows[k][2], "a") for k in range(30)]
    rows += [(300 + k, rows[k][1] + " " + rows[k][1].split()[0], rows[k][2], "b") for k in range(30)]
    rows += [(400, None, None, "a"), (401, "12 34", "en", "b"), (402, "", "de", None), (None, rows[50][1], "en", "a"), (119, *rows[119][1:])]
    docs = documents(*rows)
    docs.drop("row", "id", "hit", "id_hit", "digest").write.parquet(f"{tmp_path}/documents.parquet")

    kept = corpus_pipeline.language_id(spark, docs, "")
    assert kept.columns == docs.columns
    left = [(r.doc_id, r.text, r.source) for r in kept.collect()]
    assert sorted(map(str, left)) == sorted(str((k, t, s)) for k, t, _, s in rows if t and any(map(str.isalpha, t)))

    kept = corpus_pipeline.exact_dedup(spark, kept, "")
    best = {}
    for k, t, _ in left:
        best[fold(t)] = max((k if k is not None else -1), best.get(fold(t), -1))
    left = [(r.doc_id, r.text, r.source) for r in kept.collect()]
    assert sorted(k for k, *_ in left) == sorted(best.values())

    kept = corpus_pipeline.simhash_near_dedup(spark, kept, "")
    fps = [slow_fingerprint(t) for _, t, _ in left]
    least = {}
    for (k, _, _), root in zip(left, slow_components(fps, 4)):
        least[root] = min(k, least.get(root, k))
    left = {r.doc_id: len(r.text.split()) for r in kept.collect()}
    assert sorted(left) == sorted(least.values()) and kept.columns == docs.columns

    mixed = corpus_pipeline.mixing(spark, kept, "")
    taken = [r.doc_id for r in mixed.collect()]
    assert set(taken) <= set(left) and max(map(taken.count, taken)) <= 3 and mixed.columns == docs.columns
    assert abs(sum(left[k] for k in taken) - sum(left.values())) <= 3 * 91

    pieces = corpus_pipeline.packing(spark, mixed, "").collect()
    assert sum(p.length for p in pieces) == sum(p.doc_tokens for p in pieces if p.start == 0)
    assert len([p for p in pieces if p.start == 0]) == len(taken)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda p: (p.doc_id, p.start, p.length, p.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, pieces))


def test_empty_table(spark, documents):
    docs = documents((1, "a")).limit(0)
    for _, function in corpus_pipeline.STAGES[:-1]:
        docs = function(spark, docs, "")
        assert docs.collect() == []
    assert corpus_pipeline.packing(spark, docs, "").collect() == []
    assert packing.sequences(corpus_pipeline.packing(spark, docs, "")).collect() == []
