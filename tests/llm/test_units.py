import random

from sievework.llm import unit_dedup


def brute(rows, line_words=3, sentence_words=8):
    seen, gone = {}, []
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    found = [(k, s, e, w, d) for k in order for w, s, e, d in unit_dedup.units(rows[k][1] or "", line_words, sentence_words)]
    found.sort(key=lambda x: (rows[x[0]][0] is not None, rows[x[0]][0] or 0, x[1], x[0]))
    for k, s, e, w, d in found:
        if d in seen and seen[d] != (k, s):
            gone.append((str(rows[k][0]), s, e, w, d.hex(), str(rows[seen[d][0]][0]), seen[d][1]))
        seen.setdefault(d, (k, s))
    return sorted(gone)


def sample():
    rng = random.Random(1)
    words = [f"w{k}" for k in range(30)]
    shared = ["One shared line of words", "Another sentence of at least eight words goes here now. And a second one."]
    rows = []
    for k in range(60):
        lines = [" ".join(rng.choices(words, k=rng.randint(1, 20))) + rng.choice(["", ".", "?! "]) for _ in range(rng.randint(0, 5))]
        if k % 3:
            lines.insert(rng.randint(0, len(lines)), rng.choice(shared).upper() if k % 2 else "  " + rng.choice(shared))
        rows.append((k * 7 % 61, "\n".join(lines)))
    return rows + [(100, None), (101, ""), (102, "\n\n"), (None, shared[0]), (103, rows[1][1]), (103, rows[1][1]),
                   (104, "\n".join(["same short line"] * 4)), (105, "long words here. " * 9000)]


def test_removed_units_equal_brute_force(documents):
    rows = sample()
    got = unit_dedup.repeated_units(documents(*rows)).collect()
    assert sorted((str(r.doc_id), r.start, r.stop, r.whole_line, r.digest, str(r.keep_id), r.keep_start) for r in got) == brute(rows)


def test_cut_keeps_the_earliest_and_offsets(documents):
    rows = sample()
    docs = documents(*rows)
    got = unit_dedup.cut_repeats(docs)
    assert got.columns == [*docs.columns, "removed"]
    left = got.collect()
    assert len(left) == len(rows)
    assert {r.doc_id for r in left if r.text is None} == {100}
    gone = {}
    for key, start, stop, *_ in brute(rows):
        gone.setdefault(key, set()).update(range(start, stop))
    cut = sorted(sum(s.stop - s.start for s in r.removed) for r in left if r.doc_id == 103)
    assert cut[0] == cut[1] > 200  # both repeat an earlier row
    for r in left:
        if r.doc_id != 103:
            assert {k for s in r.removed for k in range(s.start, s.stop)} == gone.get(str(r.doc_id), set())
    texts = dict(rows)
    for r in left:
        kept, at = "", 0
        for s in r.removed:
            kept, at = kept + texts[r.doc_id][at:s.start], s.stop
        assert r.text is None or r.text == kept + texts[r.doc_id][at:]


def test_hot_line_and_empty(documents):
    docs = documents(*[(k, f"text number {k} alone here\na very common line indeed") for k in range(2000)])
    got = unit_dedup.repeated_units(docs).collect()
    assert sorted(r.doc_id for r in got) == list(range(1, 2000)) and {r.keep_id for r in got} == {0}
    assert unit_dedup.repeated_units(docs.limit(0)).collect() == [] and unit_dedup.cut_repeats(docs.limit(0)).collect() == []


def test_short_sentences_inside_a_line_with_the_floor_of_lines(documents):
    passage = "He came at noon. She left at ten. They met again later."
    rows = [(1, f"One start here {passage} and one end"), (2, f"Another start there {passage} with other ends")]
    docs = documents(*rows)
    assert unit_dedup.repeated_units(docs).count() == 0
    got = unit_dedup.repeated_units(docs, sentence_words=unit_dedup.LINE_WORDS).collect()
    assert sorted((str(r.doc_id), r.start, r.stop, r.whole_line, r.digest, str(r.keep_id), r.keep_start) for r in got) == brute(rows, 3, 3)
    assert {rows[1][1][r.start:r.stop].strip() for r in got} == {"She left at ten.", "They met again later."}
