import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sievework.llm import packing, tokens

PATHS = {n: public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}
TEXTS = [None, "", " ", "\n\n", "Hello, world", "  two  spaces ", "a\n b\n\n c  ", "don't they'll I'M", "x\t y\r\nz", "tab\x0bfeed\x0c end",
         "odd space here　", "unit\x1cseparator a", "<|endoftext|> and <|startoftext|>", "É̈ é ñandú ΑΣ ς", "3.14, 2,7;; x!?", "dots...more. ",
         "a" * 5000, "日本語 テキスト。次", "mix 12ab-cd_ef. g", "﻿bom ​zero"]


@pytest.mark.parametrize("name", PATHS)
def test_memo_gives_the_library_ids(name):
    plain = Tokenizer.from_file(PATHS[name])
    rng = random.Random(7)
    alphabet = list("abcDEF é ñ..,,  \n\n''ts12-_!\t") + ["́", " the", "n't", "\x85", " "]
    texts = TEXTS + ["".join(rng.choices(alphabet, k=rng.randint(1, 80))) for _ in range(3000)]
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    encoder = tokens.Ids(PATHS[name])
    for _ in range(2):  # the second time from the memo
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want
    encoder.chars = tokens.MEMO_CHARS + 1
    assert [len(x) for x in encoder.encode(texts[:50])] == [4 * len(w) for w in want[:50]]


@pytest.mark.parametrize("name", PATHS)
def test_words_of_letters_go_to_the_model(name, monkeypatch):
    plain, encoder, rng = Tokenizer.from_file(PATHS[name]), tokens.Ids(PATHS[name]), random.Random(8)
    letters = [chr(c) for c in [*range(65, 91), *range(97, 123), *range(0xc0, 0x100)]]
    words = ["".join(rng.choices(letters, k=rng.randint(1, 15))) for _ in range(3000)]
    texts = [" ".join(words[k:k + 30]) for k in range(0, 3000, 30)] + ["\u00d7 \u00f7a \u0130b \u01c5 \u03a3\u03c2 a\u0301"]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoder.form is not None
    calls = []
    monkeypatch.setattr(encoder, "whole", lambda texts: calls.extend(texts) or [])  # no other call of the library is needed for them
    assert len(encoder.encode([" ".join(w + w for w in words if w.isalpha())])) == 1 and not calls


@pytest.mark.parametrize("name", PATHS)
def test_special_strings(name):
    plain = Tokenizer.from_file(PATHS[name])
    texts = ["one <|endoftext|> two", "one <|startoftext|> two", "a<|ENDOFTEXT|>b <|endoftext|>", "<|endoftext|>"]
    for as_text in (False, True):
        plain.encode_special_tokens = as_text
        want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(x, "<u4").tolist() for x in tokens.Ids(PATHS[name], special_as_text=as_text).encode(texts)] == want


def test_tree_takes_the_tightest_window():
    rng = random.Random(3)
    for window in (1, 7, 64, 100):
        tree, rooms = packing.CapacityTree(window), []
        for number in range(400):
            if rng.random() < 0.5:
                room = rng.randint(1, window)
                tree.add(room, number)
                rooms.append(room)
            else:
                need = rng.randint(1, window)
                want = min((r for r in rooms if r >= need), default=None)
                got = tree.take(need)
                assert (got and got[0]) == want
                if want:
                    rooms.remove(want)


def test_best_fit_decreasing_fits():
    rng = random.Random(4)
    lengths = [rng.randint(1, 99) for _ in range(2000)]
    places, used = packing.best_fit_decreasing(lengths, 100)
    for number in range(used):
        inside = sorted((o, n) for n, (w, o) in zip(lengths, places) if w == number)
        at = 0
        for offset, n in inside:
            assert offset == at
            at += n
        assert 0 < at <= 100
    assert used <= 1.05 * sum(lengths) / 100


@pytest.mark.parametrize("held", [packing.HELD_TOKENS, 200])
def test_pieces_cover_every_document(documents, held):
    rng = random.Random(5)
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(5, "again"), (None, "no id"), (50, "long words " * 4000)]
    rows += [(100 + k, " ".join(rng.choices(["alpha", "Beta.", "gamma"], k=rng.randint(0, 300)))) for k in range(200)]
    plain = Tokenizer.from_file(PATHS["byte_bpe_50k.json"])
    got = packing.pack(documents(*rows).repartition(3), PATHS["byte_bpe_50k.json"], window=128, held_tokens=held).collect()
    found = {}
    for r in got:
        found.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    want = {}
    for key, text in rows:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        want.setdefault((key, len(ids)), []).append(ids)
    assert set(found) == set(want)
    for key, pieces in found.items():
        assert sum(len(p.ids) for p in pieces) == 4 * sum(map(len, want[key]))
        if len(want[key]) == 1:
            pieces.sort(key=lambda p: p.start)
            assert np.frombuffer(b"".join(p.ids for p in pieces), "<u4").tolist() == want[key][0]
            assert [p.start for p in pieces] == np.r_[0, np.cumsum([p.length for p in pieces])[:-1]].tolist()
    windows = {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128


def test_sequences_are_padded_but_for_powers_of_two(documents):
    pieces = packing.pack(documents((1, "a b c"), (2, "d e f g"), (3, "x " * 400)).coalesce(1),
                          PATHS["byte_bpe_50k.json"], window=128)
    for r in packing.sequences(pieces, 128, 7).collect():
        n = len(r.ids) // 4
        assert n == r.n_tokens + r.padding
        assert n == 128 or n & (n - 1) == 0 and not r.padding
        assert np.frombuffer(r.ids, "<u4").tolist()[r.n_tokens:] == [7] * r.padding


def test_empty_table(documents):
    assert packing.pack(documents((1, "a")).limit(0), PATHS["byte_bpe_50k.json"]).collect() == []
