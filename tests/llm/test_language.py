import random
import zlib

import numpy as np
import pytest

from sievework.llm import language

WORDS = {"aa": ["banana", "papaya", "lemon"], "bb": ["schnee", "wasser", "berg"], "cc": ["ñandú", "él", "qué"]}


def longest(text, sample):
    n = 0
    while n < len(text) and any(text[:n + 1] in piece for piece in sample):
        n += 1
    return n


def test_automaton_accepts_exactly_the_substrings():
    rng = random.Random(1)
    for _ in range(20):
        codes = np.array(rng.choices(range(3), k=40) + [3] + rng.choices(range(3), k=30))
        table = language.automaton(codes, 3)
        flat = "".join(map(str, codes.tolist()))
        for _ in range(200):
            probe = rng.choices(range(3), k=rng.randint(1, 7))
            state = 0
            for c in probe:
                state = table[state, c] if state >= 0 else -1
            assert (state >= 0) == ("".join(map(str, probe)) in flat)


def test_phrases_equal_slow_parsing():
    rng = random.Random(2)
    texts = {k: [" ".join(rng.choices(v, k=30)) for _ in range(3)] for k, v in WORDS.items()}
    model = language.Model.fit(texts)
    probes = [" ".join(rng.choices(sum(WORDS.values(), []), k=rng.randint(1, 40))) for _ in range(30)] + ["zzz 日本 Ä!"]
    probes.append("banana, schnee. " * 400)  # several segments
    coded, _, _ = model.codes(probes)
    total, _ = model.phrases(probes)
    for number, name in enumerate(model.languages):
        pieces = ["".join(map(chr, c + 65)) for c in model.codes(texts[name])[0]]
        for text, codes in enumerate(coded):
            line, count = "".join(map(chr, codes + 65)), 0
            for at in range(0, len(line), language.SEGMENT):
                part = line[at:at + language.SEGMENT]
                while part:
                    count += 1
                    part = part[max(1, longest(part, pieces)):]
            assert total[number, text] == count


def test_learns_and_predicts(spark, documents):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choices(WORDS[lang], k=rng.randint(3, 60))), lang, "s")
            for k, lang in enumerate(rng.choices(list(WORDS), [8, 1, 1], k=400))]
    rows += [(1000, None, "aa", "s"), (1001, "", "bb", "s"), (1002, "12 345 !!", "cc", "s"), (1003, "Banana " * 20_000, None, "s"),
             (1004, "wasser schnee", None, "s"), (1004, "wasser schnee", None, "s"), (None, "papaya lemon", "zz", "s")]
    docs = documents(*rows)
    learned = language.samples(docs, ~language.held_out())
    assert set(learned) == set(WORDS) | {"zz"}
    assert all(sum(map(len, v)) <= language.TRAIN_CHARS for v in learned.values())
    assert learned == language.samples(docs.repartition(7), ~language.held_out())
    learned.pop("zz")
    got = language.identify(docs, learned)
    assert got.columns == [*docs.columns, "lang_pred", "score"]
    for r in got.collect():
        if r.doc_id in (1000, 1001, 1002):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert 0 <= r.score <= 1
            assert r.lang_pred == {1003: "aa", 1004: "bb", None: "aa"}.get(r.doc_id, r.lang)


def test_labels_of_held_out_rows_are_not_read(documents):
    out = [k for k in range(200) if zlib.crc32(str(k).encode()) % 5 == 0]
    docs = documents(*[(k, "banana lemon", "wrong" if k in out else "aa", "s") for k in range(200)])
    assert set(language.samples(docs, ~language.held_out())) == {"aa"}
    assert sorted(r.doc_id for r in docs.filter(language.held_out()).collect()) == out


def test_nothing_to_learn_and_empty_table(documents):
    docs = documents((1, "words", None, "s"))
    assert [r.lang_pred for r in language.identify(docs, language.samples(docs, ~language.held_out())).collect()] == ["und"]
    empty = docs.limit(0)
    assert language.samples(empty, ~language.held_out()) == {} and language.identify(empty, {}).collect() == []


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_held_out_accuracy(spark, sf):
    from sievework.llm.queries import op1_language
    folder = f"/root/testdata/{sf}"
    found = op1_language(spark, folder).filter("held_out").join(
        spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(found) > 20 and np.mean([r.lang == r.lang_pred for r in found]) >= 0.95


def test_no_label_is_left_out(documents):
    rng = random.Random(5)
    words = {f"l{k:03d}": ["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(6)] for k in range(90)}
    rows = [(n, " ".join(rng.choices(words[lang], k=20)), lang, "s") for n, lang in enumerate([*words, *list(words)[:70]] * 2)]
    learned = language.samples(documents(*rows), language.F.lit(True))
    assert set(learned) == set(words)
    found, _ = language.Model.fit(learned).predict([" ".join(rng.choices(v, k=20)) for v in words.values()])
    assert found == list(words)


def test_letters_of_a_large_script_stay_apart():
    rng = random.Random(6)
    script = [chr(0x4E00 + k) for k in range(900)]
    a, b = ["".join(rng.choices(script, k=400)) for _ in range(20)], ["".join(rng.choices(script, k=400)) for _ in range(20)]
    model = language.Model.fit({"a": a, "b": b})
    assert len(set(np.concatenate(model.codes(["".join(script)])[0]).tolist())) == len(set("".join(a + b)) & set(script))
    total, _ = model.phrases([a[3][50:90], b[4][7:60]])
    assert total[0, 0] == 1 and total[1, 1] == 1 and total[1, 0] > 10 and total[0, 1] > 10
    probe = ["".join(x) for x in (a[0][k:k + 2] + b[0][k:k + 2] for k in range(0, 100, 5))]
    for text, row in zip(probe, model.phrases(probe)[0].T):
        for got, pieces in zip(row, (a, b)):
            count = 0
            while text[count_at(text, pieces, count):]:
                count += 1
            assert got == count


def count_at(text, pieces, phrases):
    """Where the phrase after so many phrases starts."""
    at = 0
    for _ in range(phrases):
        at += max(1, longest(text[at:], pieces))
    return at
