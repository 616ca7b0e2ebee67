"""Personal data: exact base patterns, and a linear-chain conditional random field.

The base patterns find what is written in the usual way.  The field adds what is not: numbers
without a plus sign, addresses spelt with "at" and "dot".  It is trained on the small labelled
table below, over shapes of words (kind of characters, case, length, the mark itself, a few
contact words) of a token and its surroundings, and decoded by Viterbi in numpy, many windows
of tokens at once.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import batches, kept, rows_of

KINDS = ("email", "ip", "card", "phone")

AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")

_DOT = r"(?:\.|[\x20]*[\[(]?[\x20]*\bdot\b[\x20]*[\])]?[\x20]*)"
#: An address with its marks or with words for them.
SPELT = re.compile(rf"[\w%+-]+(?:{_DOT}[\w%+-]+)*[\x20]*(?:@|[\[(]?[\x20]*\bat\b[\x20]*[\])]?)[\x20]*[\w-]+(?:{_DOT}[\w-]+)+", re.I)

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind; failing ones are dropped, not retried.

    The patterns are anchored where a match can start (the run before an at sign, the first
    digit of a run), so that long texts take linear time; the matches are the same.
    """
    out = []
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := AT.match(text, at)):
            out.append((start, 0, m.end()))
            done = at = m.end()
        else:
            at += 1
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(DIGITS.findall(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


#: The labelled table: [kind text] marks a span.  Digits stand for any digits.
LABELLED = [
    "Call me at [phone 555-201-3344] after six.", "phone: [phone (212) 555-0187]", "Tel. [phone 030 1234567], ask for Anna",
    "My number is [phone 0176 22334455].", "mobile [phone 07700 900123] or office [phone 020 7946 0958]",
    "Fax [phone 212.555.0143], room 12", "ring [phone 415 555 2671] today", "téléphone [phone 01 23 45 67 89] le matin",
    "Teléfono: [phone 912 345 678]", "contact us, phone [phone 800-555-0199], Monday to Friday", "Handy [phone 0151-23456789]",
    "text [phone 5552013344] now", "Cell: [phone 555.201.3344]", "call [phone 555-0134] please",
    "write to [email jane dot doe at example dot com] soon", "email [email info (at) example (dot) org] for help",
    "mail: [email bob [at] mail [dot] example [dot] net]", "reach me under [email tom at example dot com].",
    "E-mail [email m.smith (at) example.com] or come by", "contact [email sales at example.org] first",
    "my email is [email anna at example dot com]", "Email me: [email kim_lee [at] example.net], thanks",
    "server ip [ip 10 . 0 . 0 . 12] is down", "IP: [ip 192 . 168 . 10 . 4] port 80", "host at [ip 172,16,254,1] refused",
    "ip address [ip 10-20-30-40] blocked", "card [card 4111.1111.1111.1111] exp 12 / 27", "visa: [card 5500/0000/0000/0004] on file",
    "Pay with card number [card 4012_8888_8888_1881] now", "credit card [card 3782.822463.10005], code 123",
    # Rows without personal data.
    "In 2024 about 15 000 people came, 3.5 percent more than in 2019.", "Version 1.2.3 of chapter 12 is at page 404.",
    "The meeting is at 10:30 on 12.05.2023, room 7.", "He arrived at noon and left at dawn.", "Prices rose from 10-12 to 14-15 dollars.",
    "See figure 3.14 and table 12-4 at the end.", "Le train de 8 h 15 part à 9 h 20.", "Der Zug um 18.45 Uhr, Gleis 7, fällt aus.",
    "Los 300 alumnos, 25 por clase, viven en 12 barrios.", "dot the letters and look at the example", "we met at school, at work and at home",
    "isbn 978-3-16-148410-0, 320 pages", "order 2023-0045-7781 was shipped", "pi is 3.14159 26535 89793", "serial 00045-AB-7781 at line 9",
    "1 2 3 4 5 6 7 8 9 10", "scores: 12, 15, 9, 22, 31", "Thinwh of onren, 42 onble. Edthnd ernt at 7 shea.", "Ouwhea the of rend at ofthst.",
    "Call it a day at last.", "The card game at eight, the phone on the table.", "Mail came at ten. Email did not.",
    "zu und die 12 üauß der 7. Lichach enö.", "total 1,234,567.89 for 2021, 2022 and 2023", "x = 10 + 20 - 30 / 40", "a.b.c d-e-f (g) [h]",
    "on 2021-03-04 at 05:06:07 the job 8812 failed", "id 123456789012 row 7", "Elleoi çelle 4337 èè ouaneux 12 éleoi.",
]
#: Contact words that are shapes of their own.
LEXICON = ("at", "dot", "phone", "tel", "call", "mobile", "cell", "fax", "email", "mail", "card", "visa", "ip", "number", "com", "org", "net")

LABELS = 1 + 2 * len(KINDS)  # other, then first and further tokens of each kind
#: Shapes: letters by case and length, digits by length, marks, contact words; each with and without a gap before.
_LETTERS, _DIGITS, _MARKS = 4 * 5, 8, 33
SHAPES = 2 * (_LETTERS + _DIGITS + _MARKS + len(LEXICON)) + 1
PAIRS = 2048
#: Tokens of a window and around it, and tokens that are decoded side by side.
WINDOW, HALO, CELLS = 128, 16, 1 << 19
_B = np.uint64(1099511628211)


def _word_hash(word: str) -> int:
    value = 0
    for k, c in enumerate(word):
        value = (value + (ord(c) + 1) * pow(int(_B), k + 1, 1 << 64)) % (1 << 64)
    return value


class Shapes:
    """Tokens and their shapes for texts, with numpy."""

    def __init__(self) -> None:
        self.kind = np.full(0x110000, 255, np.uint8)  # 0 space, 1 letter, 2 upper-case letter, 3 digit, 4 other
        hashes = np.array([_word_hash(w) for w in LEXICON], np.uint64)
        self.order = np.argsort(hashes)
        self.words = hashes[self.order]
        self.powers = np.cumprod(np.full(12, _B, np.uint64))

    def kinds(self, points: np.ndarray) -> np.ndarray:
        got = self.kind[points]
        if (new := got == 255).any():
            for p in np.unique(points[new]).tolist():
                c = chr(p)
                self.kind[p] = (0 if c.isspace() else 3 if c in "0123456789" else 2 if c.isupper() and c.isalpha()
                                else 1 if c.isalpha() else 4)
            got = self.kind[points]
        return got

    def tokens(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text number, start, end (in the text) and shape of each token."""
        points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        kind = self.kinds(points)
        group = np.where(kind == 2, 1, kind)
        before = np.r_[0, group[:-1]] if len(group) else group
        start = np.flatnonzero((group != 0) & ((group != before) | (group == 4)))
        change = np.flatnonzero((group != before) | (group == 4))
        end = np.r_[change, len(group)][np.searchsorted(change, start, "right")] if len(start) else start
        length, g = end - start, group[start]
        upper = np.r_[0, np.cumsum(kind == 2)]
        many = upper[end] - upper[start]
        case = np.where(many == 0, 0, np.where(many == length, 2, np.where((many == 1) & (kind[start] == 2), 1, 3)))
        letters = case * 5 + np.searchsorted([1, 2, 3, 6], length, "left")
        digits = _LETTERS + np.searchsorted([1, 2, 3, 4, 6, 9, 11], length, "left")
        mark = points[start]
        ascii_ = np.where(mark < 48, mark - 33, np.where(mark < 65, mark - 43, np.where(mark < 97, mark - 69, mark - 95)))
        marks = _LETTERS + _DIGITS + np.where((mark > 32) & (mark < 127), ascii_, 32)
        shape = np.where(g == 1, letters, np.where(g == 3, digits, marks))
        value = np.zeros(len(start), np.uint64)
        short = np.flatnonzero((g == 1) & (length <= 8))
        for k in range(8):
            on = short[length[short] > k]
            p = points[start[on] + k]
            low = np.where((p >= 65) & (p <= 90), p + 32, p)
            value[on] += (low + 1).astype(np.uint64) * self.powers[k]
        at = np.minimum(np.searchsorted(self.words, value), len(self.words) - 1)
        known = (self.words[at] == value) & (g == 1)
        shape = np.where(known, _LETTERS + _DIGITS + _MARKS + self.order[at], shape)
        shape = 1 + 2 * shape + (before[start] == 0)
        ends = np.cumsum([len(t) + 1 for t in texts])
        text = np.searchsorted(ends, start, "right")
        offset = np.r_[0, ends[:-1]][text] if len(texts) else text
        return text, start - offset, end - offset, shape


def features(shape: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Rows of feature numbers: shapes at -2 to 2 and hashed pairs; shape 0 stands for the edge."""
    n = len(shape)
    near = []
    for d in (-2, -1, 0, 1, 2):
        at = np.clip(np.arange(n) + d, 0, max(0, n - 1))
        inside = (np.arange(n) + d >= 0) & (np.arange(n) + d < n)
        near.append(np.where(inside & (text[at] == text), shape[at], 0) if n else shape)
    pairs = [((near[a] * 211 + near[b]) * 7 + k) % PAIRS for k, (a, b) in enumerate(((1, 2), (2, 3), (0, 2), (2, 4)))]
    return np.stack([*[k * SHAPES + s for k, s in enumerate(near)], *[5 * SHAPES + p for p in pairs]], axis=1)


def _allowed() -> np.ndarray:
    """0 for transitions that may be, a large penalty for others: a further token follows its kind."""
    rule = np.zeros((LABELS, LABELS))
    for k in range(len(KINDS)):
        rule[:, 2 + 2 * k] = -1e4
        rule[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
    return rule


def labelled(copies: int = 8, seed: int = 1) -> list[tuple[str, list[Span]]]:
    """The labelled table, each row in ``copies`` forms with other digits and without capitals."""
    rng = random.Random(seed)
    out = []
    for row in LABELLED:
        for k in range(copies):
            text, spans, at = "", [], 0
            for m in re.finditer(r"\[(email|ip|card|phone) ((?:[^\[\]]|\[(?:at|dot)\])+)\]", row):
                text += row[at:m.start()]
                spans.append((len(text), KINDS.index(m[1]), len(text) + len(m[2])))
                text += m[2]
                at = m.end()
            text += row[at:]
            if k:
                text = DIGITS.sub(lambda m: m[0] if m[0] == "0" else str(rng.randint(1, 9)), text)
            out.append((text.lower() if k % 3 == 2 else text, spans))
    return out


def train(rows: Sequence[tuple[str, list[Span]]], rounds: int = 120, rate: float = 0.15,
          decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights of features and transitions: gradient ascent (Adagrad) on the log-likelihood."""
    text, start, end, shape = Shapes().tokens([t for t, _ in rows])
    feats = features(shape, text)
    gold = np.zeros(len(shape), int)
    for k, (_, spans) in enumerate(rows):
        for s, kind, e in spans:
            inside = np.flatnonzero((text == k) & (start >= s) & (end <= e))
            gold[inside] = 2 + 2 * kind
            gold[inside[:1]] = 1 + 2 * kind
    lengths = np.bincount(text, minlength=len(rows))
    first = np.cumsum(lengths) - lengths
    lanes = np.flatnonzero(lengths)
    first, lengths = first[lanes], lengths[lanes]
    width = int(lengths.max())
    weights, moves, rule = np.zeros((5 * SHAPES + PAIRS, LABELS)), np.zeros((LABELS, LABELS)), _allowed()
    power = [np.full(weights.shape, 1e-2), np.full(moves.shape, 1e-2)]
    step = np.arange(width)
    live = step[None, :] < lengths[:, None]
    spot = np.minimum(first[:, None] + step, len(shape) - 1)
    pairs = (live[:, 1:] & live[:, :-1])

    def total(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis, keepdims=True)
        return np.log(np.exp(x - top).sum(axis)) + np.squeeze(top, axis)

    for _ in range(rounds):
        score = weights[feats].sum(1)[spot]
        move = moves + rule
        ahead, back = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0] + np.where(np.arange(LABELS) % 2 == 0, np.where(np.arange(LABELS) > 0, -1e4, 0), 0)
        for t in range(1, width):
            new = score[:, t] + total(ahead[:, t - 1, :, None] + move, 1)
            ahead[:, t] = np.where(live[:, t, None], new, ahead[:, t - 1])
        for t in range(width - 2, -1, -1):
            new = total(move + (score[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            back[:, t] = np.where(live[:, t + 1, None], new, 0)
        norm = total(ahead[:, -1], 1)
        chance = np.exp(ahead + back - norm[:, None, None])
        wrong = np.zeros((len(shape), LABELS))
        wrong[np.arange(len(shape)), gold] = 1
        np.subtract.at(wrong, spot[live], chance[live])
        slope = np.zeros_like(weights)
        for k in range(feats.shape[1]):
            np.add.at(slope, feats[:, k], wrong)
        both = ahead[:, :-1, :, None] + move + (score + back)[:, 1:, None, :] - norm[:, None, None, None]
        turn = -(np.exp(both) * pairs[:, :, None, None]).sum((0, 1))
        np.add.at(turn, (gold[spot[:, :-1]][pairs], gold[spot[:, 1:]][pairs]), 1)
        for value, change, seen in ((weights, slope, power[0]), (moves, turn, power[1])):
            change -= decay * len(rows) * value
            seen += change * change
            value += rate * change / np.sqrt(seen)
    return weights.astype(np.float32), (moves + rule).astype(np.float32)


class Field:
    """The trained field as a tagger of texts."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves, self.shapes = weights, moves, Shapes()

    def labels(self, text: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """Best labels of whole texts.  Texts are cut into windows, which see ``HALO`` tokens
        around them; windows are joined wherever that is not enough to decide as the whole
        text would: where the scores at their edge still depend on what came before, or the
        label there on what comes after."""
        n = len(shape)
        out = np.zeros(n, np.int8)
        if not n:
            return out
        feats = features(shape, text)
        score = self.weights[feats[:, 0]].copy()
        for k in range(1, feats.shape[1]):
            score += self.weights[feats[:, k]]
        first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
        size = np.diff(np.r_[first, n])
        cores = -(-size // WINDOW)
        of = np.repeat(np.arange(len(first)), cores)
        core = first[of] + (np.arange(len(of)) - np.repeat(np.cumsum(cores) - cores, cores)) * WINDOW
        begin, end = first[of], (first + size)[of]
        new = np.ones(len(core), bool)
        enter, leave, sure = np.zeros((len(core), LABELS)), np.zeros((len(core), LABELS)), np.ones(len(core), bool)
        while new.any():
            stop = np.r_[core[1:], n]
            lo, hi = np.maximum(core - HALO, begin), np.minimum(stop + HALO, end)
            order = np.flatnonzero(new)
            order = order[np.argsort((lo - hi)[order], kind="stable")]
            at = 0
            while at < len(order):
                width = int((hi - lo)[order[at]])
                pick = order[at:at + max(1, min(2048, CELLS // width))]
                at += len(pick)
                enter[pick], leave[pick], sure[pick] = self._decode(score, lo[pick], hi[pick], core[pick], stop[pick], out)
            apart = core[1:] == begin[1:]
            joint = ~apart & ~(sure[:-1] & (np.abs(leave[:-1] - enter[1:]).max(1) < 1e-2))
            stay = np.r_[True, ~joint]
            new = np.add.reduceat(np.r_[False, joint], np.flatnonzero(stay)) > 0
            core, begin, end, enter, leave, sure = (x[stay] for x in (core, begin, end, enter, leave, sure))
        return out

    def _decode(self, score, lo, hi, core, stop, out) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Labels of the cores, longest lane first; scores at ``core`` and at ``stop`` relative
        to the best, and whether every label at the end leads to one label before ``stop``."""
        length = hi - lo
        width, lanes = int(length[0]), len(lo)
        trail = np.zeros((width, lanes, LABELS), np.int8)
        begin = np.where((np.arange(LABELS) % 2 == 0) & (np.arange(LABELS) > 0), np.float32(-1e4), np.float32(0))
        best = score[lo] + begin
        final = best.copy()
        enter, leave = best.copy(), np.zeros_like(best)
        for t in range(1, width):
            live = int(np.searchsorted(-length, -t, "left"))
            options = best[:live, :, None] + self.moves
            trail[t, :live] = options.argmax(1)
            best = options.max(1) + score[lo[:live] + t]
            if t % 64 == 0:  # sums stay small, so long lanes are as exact as short ones
                best -= best.max(1, keepdims=True)
            final[:live] = best
            for kept_at, place in ((enter, core), (leave, stop)):
                here = np.flatnonzero(place[:live] - lo[:live] == t)
                kept_at[here] = best[here]
        label = final.argmax(1)
        every = np.repeat(np.arange(LABELS)[None, :], lanes, axis=0)
        for t in range(width - 1, -1, -1):
            live = int(np.searchsorted(-length, -t, "left"))
            spot = lo[:live] + t
            own = (spot >= core[:live]) & (spot < stop[:live])
            out[spot[own]] = label[:live][own]
            if t:
                past = np.flatnonzero(spot >= stop[:live])
                every[past] = np.take_along_axis(trail[t, past], every[past], axis=1)
                label[:live] = trail[t, np.arange(live), label[:live]]
        sure = (hi == stop) | (every == every[:, :1]).all(1)
        return enter - enter.max(1, keepdims=True), leave - leave.max(1, keepdims=True), sure

    def spans(self, texts: Sequence[str]) -> list[list[Span]]:
        """Spans of each text that the field finds and that hold as many digits, parts or
        marks as their kind needs."""
        text, start, end, shape = self.shapes.tokens(texts)
        label = self.labels(text, shape)
        out: list[list[Span]] = [[] for _ in texts]
        heads = np.flatnonzero(label % 2 == 1)
        for h in heads.tolist():
            kind, stop, k = int(label[h] - 1) // 2, h, h + 1
            while k < len(label) and label[k] == label[h] + 1 and text[k] == text[h]:
                stop, k = k, k + 1
            part = texts[text[h]][start[h]:end[stop]]
            if plausible(kind, part):
                out[text[h]].append((int(start[h]), kind, int(end[stop])))
        return out


def plausible(kind: int, part: str) -> bool:
    digits = DIGITS.findall(part)
    if kind == 0:
        return len(part) <= 120 and bool(SPELT.fullmatch(part))
    if kind == 1:
        parts = re.findall("[0-9]+", part)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn("".join(digits))
    return 7 <= len(digits) <= 15


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], id_column: str = "doc_id",
         text_column: str = "text") -> DataFrame:
    """Per row: the id; ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` and ``base``, the base
    spans as ``kind:start:end`` in code points, comma-joined; ``spans``, base spans and those
    that the field adds where it meets none.

    A null text is empty and has no spans.  Texts of any length are read whole; repeated rows
    and equal ids keep a row each; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    names = [id_column, *[f"n_{k}" for k in KINDS], "base", "spans"]
    schema = f"`{id_column}` {rows.schema['id'].dataType.simpleString()}, " + ", ".join(
        [*[f"n_{k} long" for k in KINDS], "base string", "spans string"])
    key = hashlib.sha256(model[0].tobytes() + model[1].tobytes()).hexdigest()

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = kept("pii")
        if key not in fields:
            fields[key] = Field(*model)
        field = fields[key]
        for part in parts:
            out = []
            for batch in batches(rows_of(part, 1), 0):
                texts = [t or "" for t, in batch]
                for text, added in zip(texts, field.spans(texts)):
                    base = base_spans(text)
                    more = [a for a in added if not any(a[0] < b[2] and b[0] < a[2] for b in base)]
                    counts = [sum(b[1] == k for b in base) for k in range(len(KINDS))]
                    out.append((*counts, joined(base), joined(base + more)))
            columns = list(zip(*out)) or [()] * 6
            kinds = [pa.int64()] * len(KINDS) + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=names)

    return rows.mapInArrow(task, schema)


def masked(text: str, spans: str) -> str:
    """``text`` with every span of ``find`` replaced by its kind in angle brackets."""
    found = [s.split(":") for s in spans.split(",") if s]
    out, at = [], 0
    for kind, start, end in sorted(((k, int(s), int(e)) for k, s, e in found), key=lambda x: x[1]):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])
