import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sievework.llm import spelling
from sievework.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def one_edit(a, b):
    """Exactly one inserted, deleted or replaced code point, from the definition."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain(rows, min_length=6, min_count=5, ratio=5, every=199):
    counts = Counter()
    for key, text in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[a-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += len(run) >= min_length
    counts = {w: n for w, n in counts.items() if n >= min_count}
    near = {w: [] for w in counts}
    holes: dict = {}  # words that agree but for one place, by that place
    for w in counts:
        for k in range(len(w)):
            holes.setdefault((w[:k], w[k + 1:]), []).append(w)
            if w[:k] + w[k + 1:] in counts:
                near[w].append(w[:k] + w[k + 1:])
                near[w[:k] + w[k + 1:]].append(w)
    for group in holes.values():
        for w in group:
            near[w] += [v for v in group if v != w]
    near = {w: set(v) for w, v in near.items()}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return out


def collected(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_rotations_are_sorted():
    rng = random.Random(2)
    for symbols in (2, 3, 90):
        for n in (1, 2, 5, 200):
            text = np.array([0, 0, *(rng.randrange(1, symbols) for _ in range(n))], np.uint8)
            want = sorted(range(len(text)), key=lambda k: text[k:].tolist() + text[:k].tolist())
            assert spelling.rotations(text, (symbols - 1).bit_length()).tolist() == want


@pytest.mark.parametrize("letters, low, high", [("ab", 4, 8), ("abcdeé", 5, 9), ("a", 4, 60)])
def test_searches_equal_brute_force(letters, low, high):
    rng = random.Random(letters)
    words = sorted({"".join(rng.choices(letters, k=rng.randint(low, high))) for _ in range(250)})
    asked = words[:200] + ["".join(rng.choices(letters + "z", k=rng.randint(low, high))) for _ in range(50)]
    index = spelling.Bidirectional(words)
    for batch, half in spelling._batches(asked):
        got = {False: set(), True: set()}
        for exact in got:
            got[exact] = {(batch[q], words[v]) for q, v in zip(*index.near(batch, half, exact))}
        want = {(a, b) for a in batch for b in words if one_edit(a, b)}
        assert got[True] == {(a, b) for a, b in want if a[:half] == b[:half]}
        assert got[False] == {(a, b) for a, b in want if b.endswith(a[half:])}
        assert got[True] | got[False] == want


def corpus(seed, n, letters="abé"):
    rng = random.Random(seed)
    words = ["".join(rng.choices(letters, k=rng.randint(5, 9))) for _ in range(150)]
    text = lambda: " ".join(rng.choices(words, weights=[3 ** (k % 7) for k in range(150)], k=60))
    return [(k, text()) for k in range(n)]


@pytest.mark.parametrize("shard, block", [(200_000, 400_000), (300, 600), (2_000_000, 200)])
def test_variants_equal_brute_force(spark, documents, shard, block):
    """One shard, many shards, and one shard in many blocks."""
    rows = corpus(4, 60) + [
        (None, "Abébab ABÉBAB abébab"), (5, None), (6, ""), (7, "× ÷ 12 _"),
        *((k, "chainaa " * 3 + "chainab " * 20 + "chaincb " * 150) for k in range(8, 12))] + corpus(4, 2) * 2
    got = spelling.spelling_variants(documents(*rows), every=7, shard_symbols=shard, block_symbols=block)
    want = plain(rows, every=7)
    assert collected(got) == want
    assert sum(r[1] is not None for r in want) > 5 and any(r[2] != r[1] and r[1] for r in want)


def test_long_words_ties_and_no_words(spark, documents):
    long = "x" * 3000
    rows = [(1, f"{long} {long}y bananas bananaz bananar " * 5 + "banana " * 25)] * 2 + [(2, "xx")]
    got = collected(spelling.spelling_variants(documents(*rows), every=10 ** 9))
    assert got == plain(rows, every=10 ** 9)
    assert spelling.spelling_variants(documents((1, "a b"), (2, None))).count() == 0
    assert spelling.spelling_variants(documents((1, "a b")).limit(0)).count() == 0


def test_query(spark):
    texts = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    assert collected(QUERIES["op11_spelling"](spark, FOLDER)) == plain(texts)
