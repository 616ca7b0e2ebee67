import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sievework.llm import exact_dedup
from sievework.llm.common import LOWER, UPPER

ROWS = [(1, "Same text"), (2, "same TEXT"), (3, "other"), (4, None), (5, ""), (None, "other"), (7, "É"), (8, "é"),
        (9, "x" * 300_000), (10, "x" * 300_000), (11, "x" * 299_999 + "y"), (3, "other"), (12, "Same text!")]


def fold(text):
    return hashlib.sha256((text or "").translate(str.maketrans(UPPER, LOWER)).encode()).hexdigest()


def expected(rows):
    groups = defaultdict(list)
    for key, text in rows:
        groups[fold(text)].append(key)
    return {d: (max((k for k in ks if k is not None), default=None), len(ks)) for d, ks in groups.items()}


def check(rows, got):
    want = expected(rows)
    assert sorted((str(r.doc_id), r.digest) for r in got) == sorted((str(k), fold(t)) for k, t in rows)
    for r in got:
        assert (r.keep_id, r.group_size) == want[r.digest]
    kept = [r for r in got if r.kept]
    assert sorted(r.digest for r in kept) == sorted(want)
    assert all(r.doc_id == r.keep_id for r in kept)


def test_groups_equal_brute_force(documents):
    check(ROWS, exact_dedup.exact_groups(documents(*ROWS), all_digests=True).collect())


def test_digest_only_where_shared(documents):
    got = exact_dedup.exact_groups(documents((1, "lone text here"), (2, "ab"), (3, "ab"))).collect()
    assert {r.doc_id: r.digest is None for r in got} == {1: True, 2: False, 3: False}


def test_same_prefix_and_length_are_told_apart(documents):
    rows = [(k, "p" * 80 + f"{k:04d}") for k in range(40)] + [(100, "p" * 80 + "0001")]
    check(rows, exact_dedup.exact_groups(documents(*rows), all_digests=True).collect())


@pytest.mark.parametrize("together", [exact_dedup.PART_TEXTS, 1])
def test_drop_copies(documents, monkeypatch, together):
    """Groups of copies whole, and cut into parts of single rows."""
    monkeypatch.setattr(exact_dedup, "PART_TEXTS", together)
    monkeypatch.setattr(exact_dedup, "PART_ROWS", together)
    docs = documents(*ROWS)
    got = exact_dedup.drop_copies(docs)
    assert got.columns == docs.columns
    want = sorted((str(k), d) for d, (k, _) in expected(ROWS).items())
    assert sorted((str(r.doc_id), fold(r.text)) for r in got.collect()) == want


def test_one_group_holds_most_rows(documents):
    rows = [(k, "copy of one text") for k in range(3000)] + [(k, f"text {k}") for k in range(3000, 3100)]
    docs = documents(*rows)
    check(rows, exact_dedup.exact_groups(docs, all_digests=True).collect())
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(docs).collect()) == list(range(2999, 3100))


def test_prefixes_are_hashed_only_where_the_length_is_shared(spark, documents):
    """Every length occurs once, so the second refinement has nothing left to hash."""
    docs = documents(*[(k, "x" * k) for k in range(200)])
    assert exact_dedup.survivors(docs, F.coalesce("text", F.lit(""))).table.count() == 0
    twice = documents(*[(k, "x" * (k // 2)) for k in range(200)])
    assert exact_dedup.survivors(twice, F.coalesce("text", F.lit(""))).table.count() > 0


def test_empty_table(documents):
    docs = documents((1, "a")).limit(0)
    assert exact_dedup.exact_groups(docs).collect() == [] and exact_dedup.drop_copies(docs).collect() == []
