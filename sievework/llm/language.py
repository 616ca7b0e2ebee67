"""Language identification by cross-parsing against suffix automata.

A bounded sample of labelled text per language becomes a suffix automaton.  A document is
parsed greedily into the longest phrases that occur in the sample; the language that needs
the fewest phrases, each weighed with the bits that point into its sample, wins.  Automata
lie packed in one sparse table, and thousands of text segments walk all of them at once in numpy.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.common import batches, give_back, kept, rows_of

#: The bounded sample of each label: documents drawn, characters of a piece, characters kept.
SAMPLE_DOCS, PIECE_CHARS, TRAIN_CHARS = 400, 512, 20_480
#: Characters that one walk covers; longer texts are several walks, and their phrases add up.
SEGMENT = 1024
#: Walkers (segments times languages) that go side by side.
WALKERS = 1 << 20


def samples(docs: DataFrame, learn: Column, id_column: str = "doc_id", text_column: str = "text",
            lang_column: str = "lang") -> dict[str, list[str]]:
    """Pieces of labelled texts of every label: at most ``TRAIN_CHARS`` characters each.

    ``learn`` picks the rows to learn from.  Documents and pieces are drawn by hash, so every
    run draws the same, and only the pieces reach the driver.
    """
    rows = docs.filter(learn & F.col(lang_column).isNotNull() & F.col(text_column).isNotNull()).select(
        F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"),
        F.col(lang_column).cast("string").alias("lang"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    draw = F.pmod(F.xxhash64("id", F.lit("documents")), F.lit(1 << 31)) * F.col("n") < F.lit(SAMPLE_DOCS << 31)
    drawn = rows.join(F.broadcast(counts), "lang").filter(draw)
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(PIECE_CHARS))
    pieces = drawn.select("lang", "id", "text", F.explode(starts).alias("at")).select(
        "lang", F.xxhash64("id", "at", F.lit("pieces")).alias("order"), "at",
        F.expr(f"substring(text, at + 1, {PIECE_CHARS})").alias("piece"))
    first = Window.partitionBy("lang").orderBy("order", "at", "piece")
    kept = pieces.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= TRAIN_CHARS // PIECE_CHARS)
    out: dict[str, list[str]] = {}
    for r in kept.orderBy("lang", "k").select("lang", "piece").collect():
        out.setdefault(r.lang, []).append(r.piece)
    return out


def edges(codes: np.ndarray) -> list[dict[int, int]]:
    """Moves of each state of the suffix automaton of a coded text."""
    following: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes.tolist():
        new = len(following)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in following[p]:
            following[p][c] = new
            p = link[p]
        if p >= 0:
            q = following[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(following)
                following.append(dict(following[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and following[p].get(c) == q:
                    following[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return following


def automaton(codes: np.ndarray, width: int) -> np.ndarray:
    """Transitions of the suffix automaton of a coded text: (states, width), -1 for none.

    Code ``width`` ends a piece: no phrase crosses it.
    """
    following = edges(codes)
    table = np.full((len(following), width), -1, np.int32)
    for state, moves in enumerate(following):
        for c, to in moves.items():
            if c < width:
                table[state, c] = to
    return table


def packed(following: list[dict[int, int]], width: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Row displacement of all states but the root: the base of each state, and per slot the
    base of the state that owns it (-1 for none) and the base it moves to.

    The move of a state with code c is in slot base + c; no two states have the same base.
    Moves with code ``width`` are left out.
    """
    moves = [sorted(c for c in m if c < width) for m in following]
    order = sorted(range(1, len(moves)), key=lambda k: -len(moves[k]))
    room = sum(map(len, moves)) + len(moves) + 2 * width + 2
    used, taken, base = bytearray(room), bytearray(room), [0] * len(moves)
    used[:width] = b"\1" * width  # so that no base is negative
    taken[0] = 1  # the root's
    low, many = width, 0
    for state in order:
        codes = moves[state]
        if len(codes) != many:
            many, low, tries = len(codes), width, 0
        while True:
            if not codes:
                low = taken.find(0, low)
                spot = low if low >= 0 else len(taken)
            else:
                low = used.find(0, low)
                spot = (low if low >= 0 else len(used)) - codes[0]
            if spot + width >= len(used):
                used.extend(bytes(len(used)))
                taken.extend(bytes(len(taken)))
                low = max(low, width)
                continue
            if not taken[spot] and not any(used[spot + c] for c in codes):
                break
            tries += 1
            low += 1 + (tries >> 8)  # a crowded stretch is left to states with fewer moves
        base[state], taken[spot] = spot, 1
        for c in codes:
            used[spot + c] = 1
    size = max(base) + width + 1
    owner, target = np.full(size, -1, np.int64), np.zeros(size, np.int64)
    for state in order:
        for c in moves[state]:
            owner[base[state] + c], target[base[state] + c] = base[state], base[following[state][c]]
    return base, owner, target


@dataclass
class Model:
    """All languages in one sparse table; a walker's state is the base of its row.

    A slot holds the state that owns it in its high half and the state it moves to in its low
    half.  ``starts`` has where each language goes when a phrase starts with a code.
    """

    languages: list[str]
    table: np.ndarray
    roots: np.ndarray
    starts: np.ndarray
    bits: np.ndarray
    lut: np.ndarray
    own: dict[str, int]

    @classmethod
    def fit(cls, texts: Mapping[str, list[str]]) -> "Model":
        languages = sorted(texts)
        letters = sorted({c for pieces in texts.values() for p in pieces for c in p.lower() if c.isalpha()})
        # 0 is for what is no letter, then every letter learned, then one code for all others.
        own = {c: k + 1 for k, c in enumerate(letters)}
        width = len(own) + 2
        kind = np.min_scalar_type(width + 1)
        none = np.zeros(0, np.uint32)
        model = cls(languages, np.zeros(0, np.uint64), none, none.reshape(0, width), np.zeros(0),
                    np.full(0x110000, np.iinfo(kind).max, kind), own)
        parts, roots, starts, sizes, offset = [], [], [], [], 0
        for language in languages:
            coded, _, _ = model.codes(texts[language])
            cut = [np.append(c.astype(np.int64), width) for c in coded]
            following = edges(np.concatenate(cut))
            base, owner, target = packed(following, width)
            if offset + len(owner) >= 1 << 32:
                raise ValueError("the sample is too large for one transition table")
            # The root's base owns no slot: a move from the root, like a missing one, starts a phrase.
            start = np.full(width, base[0] + offset, np.uint32)
            for c, to in following[0].items():
                if c < width:
                    start[c] = base[to] + offset
            parts.append(np.where(owner >= 0, (owner + offset) << 32 | (target + offset), -1).astype(np.uint64))
            roots.append(base[0] + offset)
            starts.append(start)
            sizes.append(sum(map(len, cut)))
            offset += len(owner)
        if parts:
            model.table, model.starts = np.concatenate(parts), np.stack(starts)
        model.roots = np.array(roots, np.uint32)
        model.bits = np.log2(np.array(sizes, float) + 1)
        return model

    def codes(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Coded texts (0 for any run of other characters, then letters), and their ends."""
        lowered = [t.lower() for t in texts]
        points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
        coded = self.lut[points]
        if (new := coded == np.iinfo(coded.dtype).max).any():
            for point in np.unique(points[new]).tolist():
                c = chr(point)
                self.lut[point] = self.own.get(c, 1 + len(self.own)) if c.isalpha() else 0
            coded = self.lut[points]
        ends = np.cumsum([len(t) for t in lowered])
        keep = coded != 0
        keep[1:] |= coded[:-1] != 0
        if len(keep):
            keep[np.r_[0, ends[:-1]][np.r_[0, ends[:-1]] < len(keep)]] = True
        at = np.r_[0, np.cumsum(keep)]
        coded, ends = coded[keep], at[ends]
        return np.split(coded, ends[:-1]) if len(ends) else [], coded, ends

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text in each language, and each text's coded length."""
        _, coded, ends = self.codes(texts)
        begins = np.r_[0, ends[:-1]]
        sizes = ends - begins
        many = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), many)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        start = begins[owner] + number * SEGMENT
        length = np.minimum(ends[owner], start + SEGMENT) - start
        order = np.argsort(-length, kind="stable")
        start, length, owner = start[order], length[order], owner[order]
        total = np.zeros((len(self.roots), len(texts)))
        high, low = np.uint64(32), np.uint64((1 << 32) - 1)
        few = max(1, WALKERS // max(1, len(start)))
        for first in range(0, len(self.roots), few):
            begin = self.starts[first:first + few]
            state = np.repeat(self.roots[first:first + few, None], len(start), axis=1)
            count = np.zeros(state.shape, np.uint32)
            for step in range(int(length[0]) if len(length) else 0):
                live = int(np.searchsorted(-length, -step, "left"))
                code = coded[start[:live] + step]
                slot = self.table[state[:, :live] + code]
                miss = slot >> high != state[:, :live]
                count[:, :live] += miss
                state[:, :live] = np.where(miss, begin[:, code], slot & low)
            for row, c in zip(total[first:first + few], count):
                row += np.bincount(owner, c, len(texts))
        return total, sizes

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and margin of each text; ``und`` without a letter or without a model."""
        known = [k for k, t in enumerate(texts) if t and self.languages and any(map(str.isalpha, t))]
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if known:
            total, sizes = self.phrases([texts[k] for k in known])
            cost = total * self.bits[:, None] / np.maximum(sizes, 1)
            best = cost.argmin(0)
            ranked = np.sort(cost, axis=0)
            margin = 1 - ranked[0] / ranked[1] if len(cost) > 1 else np.ones(len(known))
            for k, b, m in zip(known, best.tolist(), margin.tolist()):
                names[k], scores[k] = self.languages[b], m
        return names, scores


def _model(key: int, texts: Mapping[str, list[str]]) -> Model:
    """The fitted model of this worker process."""
    fitted = kept("language")
    if key not in fitted:
        fitted.clear()
        fitted[key] = Model.fit(texts)
    return fitted[key]


def identify(docs: DataFrame, texts: Mapping[str, list[str]], text_column: str = "text",
             lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """``docs`` with two more columns: the predicted language and its margin (0 to 1).

    Only the text decides.  A text that is null or has no letter is ``und`` with score 0, and
    so is every text if nothing was learned.  Texts of any length are read whole.  All rows
    and columns stay; new columns replace those of the same name.
    """
    key = hash(tuple((k, tuple(v)) for k, v in sorted(texts.items())))
    texts = {k: list(v) for k, v in texts.items()}
    plain = docs.drop(lang_name, score_name) if {lang_name, score_name} & set(docs.columns) - {text_column} else docs
    at = plain.columns.index(text_column)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema],
                        f"`{lang_name}` string", f"`{score_name}` double"])

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(key, texts)
        for part in parts:
            names: list[str] = []
            scores: list[float] = []
            for batch in batches(rows_of(part, at), 0):
                n, s = model.predict([t for t, in batch])
                names += n
                scores += s
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=[*part.schema.names, lang_name, score_name])
            give_back()

    return plain.mapInArrow(task, schema)


def held_out(id_column: str = "doc_id") -> Column:
    """The fifth of the documents that is never learned from."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))
