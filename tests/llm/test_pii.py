import random
import re

import numpy as np
import pytest

from sievework.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def slow_base(text):
    out = []
    for k, kind in enumerate(pii.KINDS):
        for m in re.finditer(PLAIN[kind], text):
            digits = re.findall("[0-9]", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                  "card": 12 <= len(digits) <= 19 and pii.luhn("".join(digits)), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@pytest.fixture(scope="module")
def model():
    return pii.train(pii.labelled())


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(1)
    parts = ["a.b@c-d.ef", "@", "x@y", "@@", "a@b.c@d.e", ".", "..", "10.0.0.1", "256.1.1.1", "1.2.3.4.5.6.7.8", "0255.1.1.1", "4111 1111 1111 1111",
             "4111-1111-1111-1111", "411111111111111", "+1 (212) 555-0100", "+12", "++49 30 1234567", "+1().-2", " ", "-", "é", "日", "1", "22", "%", "_"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 8)))
        assert pii.base_spans(text) == slow_base(text), text
    assert pii.base_spans("") == []


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "a." * 150_000 + "@", "1" * 300_000, "1." * 150_000, "+" + "1 " * 150_000, "@a" * 150_000, "1-" * 150_000):
        assert pii.base_spans(text) == [] or len(text) < 10**6


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_viterbi_is_the_best_path(model):
    field = pii.Field(*model)
    rng = random.Random(2)
    for _ in range(10):
        text = " ".join(rng.choices(["call", "555", "-", "0134", "at", "dot", "Anna", "."], k=6))
        number, _, _, shape = field.shapes.tokens([text])
        score = sum(field.weights[c] for c in pii.features(shape, number).T)
        best, stack = -np.inf, [((k,), score[0, k] - (1e4 if k and k % 2 == 0 else 0)) for k in range(pii.LABELS)]
        for t in range(1, len(shape)):  # exhaustive, but for paths that a rule forbids
            stack = [(p + (k,), s + field.moves[p[-1], k] + score[t, k]) for p, s in stack for k in range(pii.LABELS)
                     if field.moves[p[-1], k] > -1e3]
            stack = sorted(stack, key=lambda x: -x[1])[:20_000]
        best = max(stack, key=lambda x: x[1])[0]
        assert tuple(field.labels(number, shape)) == best


def test_windows_do_not_change_the_labels(model, monkeypatch):
    field = pii.Field(*model)
    text = " ".join(["call me at 555-201-3344 now. In 2024 about 15 000 came, at noon."] * 30)
    number, _, _, shape = field.shapes.tokens([text])
    whole = pii.Field(*model)
    monkeypatch.setattr(pii, "WINDOW", 100_000)
    want = whole.labels(number, shape)
    monkeypatch.setattr(pii, "WINDOW", 32)
    assert (field.labels(number, shape) == want).all()


def test_tokens_and_offsets(model):
    texts = ["", "  Ab1,é\n日本 x", "tel 5", " A"]
    number, start, end, _ = pii.Field(*model).shapes.tokens(texts)
    assert [(k, texts[k][s:e]) for k, s, e in zip(number, start, end)] == [
        (1, "Ab"), (1, "1"), (1, ","), (1, "é"), (1, "日本"), (1, "x"), (2, "tel"), (2, "5"), (3, "A")]


def test_held_out_forms_are_found(model):
    field = pii.Field(*model)
    rows = [(t, s) for t, s in pii.labelled(6, seed=77) if not s or all(pii.plausible(k, t[a:b]) for a, k, b in s)]
    want = {(k, *s) for k, (_, spans) in enumerate(rows) for s in spans}
    got = {(k, *s) for k, spans in enumerate(field.spans([t for t, _ in rows])) for s in spans}
    assert len(want & got) >= 0.95 * len(want) and len(got - want) <= 0.02 * len(rows)


def test_find(spark, documents, model):
    rows = [(1, None), (2, ""), (3, "write to a@b.org or +49 30 1234567, card 4111 1111 1111 1111 at 10.0.0.1 é"), (4, "Call me at 555-201-3344 after six."),
            (5, "é日 " * 50_000 + "x@y.zz"), (6, "a@b.org"), (6, "a@b.org"), (None, "Nothing of the kind, at 10 or 12.")]
    got = pii.find(documents(*rows), model).collect()
    assert len(got) == len(rows)
    for r, (key, text) in zip(sorted(got, key=lambda r: (r.doc_id or 99, r.base)), sorted(rows, key=lambda r: (r[0] or 99))):
        assert r.doc_id == key and r.base == pii.joined(slow_base(text or ""))
        assert set(filter(None, r.base.split(","))) <= set(r.spans.split(","))
    by = {r.doc_id: r for r in got}
    assert (by[3].n_email, by[3].n_ip, by[3].n_card, by[3].n_phone) == (1, 1, 1, 1)
    assert by[4].base == "" and by[4].spans == "phone:11:23" and by[None].spans == ""
    assert pii.masked(rows[3][1], by[4].spans) == "Call me at <phone> after six."
    assert pii.find(documents((1, "a")).limit(0), model).collect() == []


@pytest.mark.parametrize("trained", [True, False])
def test_long_spans_at_every_offset_of_a_window_edge(trained):
    tagger = pii.Field(*pii.train(pii.labelled()))
    if not trained:  # a field whose labels hold on for long
        noise = np.random.default_rng(4).normal(0, 0.05, tagger.weights.shape)
        tagger = pii.Field(noise.astype(np.float32), (pii._allowed() + 3 * np.eye(pii.LABELS)).astype(np.float32))
    address = "email anna.maria.de.la.cruz [at] mail [dot] lab [dot] north [dot] example [dot] net"
    lines = ["word " * k + address + " and more words" * 70 for k in range(80, 135)]
    lines.append(" ".join(["1 2 , 3 . 4 - 5"] * 200))

    def whole(text):  # one pass over the whole text
        _, _, _, shape = tagger.shapes.tokens([text])
        score = tagger.weights[pii.features(shape, np.zeros(len(shape), int))].sum(1, dtype=float)
        best = score[0] - 1e4 * ((np.arange(pii.LABELS) % 2 == 0) & (np.arange(pii.LABELS) > 0))
        trail = []
        for s in score[1:]:
            options = best[:, None] + tagger.moves
            trail.append(options.argmax(0))
            best = options.max(0) + s
        label = [int(best.argmax())]
        for step in reversed(trail):
            label.append(int(step[label[-1]]))
        return label[::-1]

    text, _, _, shape = tagger.shapes.tokens(lines)
    got = tagger.labels(text, shape)
    for k, line in enumerate(lines):
        assert got[text == k].tolist() == whole(line), k
