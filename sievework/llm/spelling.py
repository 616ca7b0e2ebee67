"""Spelling variants: words at one edit, found by search schemes on bidirectional FM-indexes.

Of two words at one edit, one half of either word is met unchanged in the other.  Words are
therefore dealt to shards by their possible halves, and each shard's vocabulary, written with
delimiters, gets a bidirectional FM-index: the Burrows-Wheeler transforms of the text and of
its reverse, with suffix-rank intervals kept in step (Lam et al., "High Throughput Short Read
Alignment via Bi-directional BWT", 2009).  A search matches one half exactly from its middle
end to the delimiter, then extends across the other half and allows one error there.  Searches
of many words advance together in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import ascii_lower
from sievework.session import stage

#: Lower-cased words: runs of Latin letters.
RUN = "[a-zÀ-ÿ]+"
#: Symbols of a shard on average, and of one block of a shard at most (a word is never cut).
SHARD_SYMBOLS, BLOCK_SYMBOLS = 200_000, 400_000
#: Shards of one side at most; beyond that blocks grow in number.  The table of their sizes is broadcast.
SHARDS = 32_768
#: Words searched at a time; positions between two stored rank rows.
TOGETHER, STRIDE = 8_192, 16
#: A chain of forms grows by the factor each step, so this many doublings follow any of them.
DOUBLINGS = 7


# ------------------------------------------------------------------ the index


def rotations(text: np.ndarray, width: int) -> np.ndarray:
    """Starts of the sorted rotations of ``text`` (symbols below ``2**width``), by prefix doubling."""
    n = len(text)
    reach = max(1, 62 // width)
    key = np.zeros(n, np.int64)
    for k in range(reach):
        key = key << width | np.roll(text, -k)
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        if rank[order[-1]] == n - 1 or reach >= n:
            return order
        key = rank * n + np.roll(rank, -reach)
        reach *= 2


class Transform:
    """The Burrows-Wheeler transform of a text with ranks at every ``STRIDE``-th position."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.n, self.symbols = len(text), symbols
        self.order = rotations(text, max(1, (symbols - 1).bit_length()))
        rows = -(-self.n // STRIDE)
        bwt = np.full(rows * STRIDE, symbols, np.uint8)  # the last row is filled with a symbol of its own
        bwt[:self.n] = text[self.order - 1]
        self.bwt = bwt.reshape(rows, STRIDE)
        counts = np.zeros((rows + 1, symbols), np.int32)
        for c in range(symbols):
            counts[1:, c] = (self.bwt == c).sum(axis=1)
        self.ranks = np.cumsum(counts, axis=0, dtype=np.int32)
        self.before = np.concatenate([[0], np.cumsum(self.ranks[-1])])  # rows that begin with a smaller symbol

    def rank(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """How often each ``symbol`` stands before position ``at`` of the transform."""
        row, rest = at // STRIDE, at % STRIDE
        block = self.bwt[np.minimum(row, len(self.bwt) - 1)]
        inside = (block == symbol[:, None]) & (np.arange(STRIDE) < rest[:, None])
        return self.ranks[row, symbol] + inside.sum(axis=1)

    def all_ranks(self, at: np.ndarray) -> np.ndarray:
        """The same for every symbol: a row per position."""
        row, rest = at // STRIDE, at % STRIDE
        found = self.ranks[row].astype(np.int64)
        block = self.bwt[np.minimum(row, len(self.bwt) - 1)]
        lines = np.arange(len(at))
        for k in range(STRIDE - 1):
            use = np.flatnonzero(rest > k)
            found[lines[use], block[use, k]] += 1
        return found

    def step(self, low: np.ndarray, size: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals extended by one symbol."""
        first = self.rank(low, symbol)
        return self.before[symbol] + first, self.rank(low + size, symbol) - first


class Bidirectional:
    """Both transforms of the delimited words; symbol 0 is the delimiter."""

    def __init__(self, words: list[str]):
        letters = sorted(set().union(*words))
        self.code = {c: k + 1 for k, c in enumerate(letters)}
        joined = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le"), np.uint32)
        points = np.array([0, *map(ord, letters)], np.uint32)
        text = np.searchsorted(points, joined).astype(np.uint8)
        self.symbols = len(points)
        self.n = len(text)
        self.delimiters = np.cumsum(text == 0) - 1  # number of the delimiter at or before a position
        # Extending to the left asks the text's transform, to the right that of its reverse.
        self.leftward, self.rightward = Transform(text, self.symbols), Transform(text[::-1], self.symbols)

    def encoded(self, words: list[str]) -> np.ndarray:
        """Symbols of words of equal length; letters that no indexed word has are the last symbol."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        unknown = self.symbols
        kinds, back = np.unique(points, return_inverse=True)
        known = np.array([self.code.get(chr(p), unknown) for p in kinds], np.int64)
        return known[back].reshape(len(words), -1)

    def near(self, words: list[str], half: int, left_exact: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, indexed word) pairs at one edit whose one half is met unchanged.

        ``words`` have one length and ``half`` is where their second half starts.  With
        ``left_exact`` the first half is met and the error lies behind it, otherwise the second
        half is met and the error lies before it.
        """
        codes = self.encoded(words)
        if left_exact:
            inner, outer, exact, rest = self.leftward, self.rightward, codes[:, :half][:, ::-1], codes[:, half:]
        else:
            inner, outer, exact, rest = self.rightward, self.leftward, codes[:, half:], codes[:, :half][:, ::-1]
        query = np.flatnonzero((exact < self.symbols).all(axis=1))
        exact = np.concatenate([exact, np.zeros((len(exact), 1), np.int64)], axis=1)
        low = np.zeros(len(query), np.int64)  # the interval that is extended now
        other = low.copy()                    # the one of the other transform, kept in step
        size = np.full(len(query), self.n, np.int64)
        for k in range(exact.shape[1]):
            symbol = exact[query, k]
            first = inner.all_ranks(low)
            counts = inner.all_ranks(low + size) - first
            lines = np.arange(len(query))
            below = np.cumsum(counts, axis=1) - counts
            low = inner.before[symbol] + first[lines, symbol]
            other = other + below[lines, symbol]
            size = counts[lines, symbol]
            alive = np.flatnonzero(size)
            query, low, other, size = query[alive], low[alive], other[alive], size[alive]
        return self._across(outer, query, other, size, rest, left_exact)

    def _across(self, side: Transform, query, low, size, rest: np.ndarray, left_exact: bool):
        """Extend matched halves across the other half with exactly one error, to the delimiter."""
        unknown = self.symbols
        none = np.zeros(0, np.int64)
        wrong = (none, none, none)  # query, low, size after the error

        def extended(states, symbol):
            q, lo, n = states
            known = symbol < unknown
            q, lo, n = q[known], lo[known], n[known]
            lo, n = side.step(lo, n, symbol[known])
            alive = n > 0
            return q[alive], lo[alive], n[alive]

        def branches(states):
            """Every state extended by every letter, with the letter."""
            q, lo, n = states
            first = side.all_ranks(lo)
            counts = side.all_ranks(lo + n) - first
            line, letter = np.nonzero(counts[:, 1:])
            letter = letter + 1
            return (q[line], side.before[letter] + first[line, letter], counts[line, letter]), letter

        def joined(*parts):
            return tuple(np.concatenate(p) for p in zip(*parts))

        right = (query, low, size)
        for k in range(rest.shape[1]):
            due = rest[:, k]
            spread, letter = branches(right)
            replaced = letter != due[spread[0]]
            wrong = joined(
                extended(wrong, due[wrong[0]]),
                tuple(x[replaced] for x in spread),         # another letter in its place
                extended(spread, due[spread[0]]),           # one more letter before it
                right)                                      # the letter is missing
            right = extended(right, due[right[0]])
            if not len(wrong[0]) and not len(right[0]):
                break
        wrong = joined(wrong, branches(right)[0])           # one more letter at the end
        query, low, _ = extended(wrong, np.zeros(len(wrong[0]), np.int64))
        start = side.order[low]
        # The text's own transform gives the first delimiter of the word, the other its last one.
        found = self.delimiters[self.n - 1 - start] - 1 if left_exact else self.delimiters[start]
        pairs = np.unique(np.stack([query, found], axis=1), axis=0)
        return pairs[:, 0], pairs[:, 1]


# ------------------------------------------------------------------ the words


def word_counts(docs: DataFrame, id_column: str, text_column: str, min_length: int, min_count: int,
                every: int | None) -> DataFrame:
    """``word``, ``n`` of the words that are long and frequent enough.

    Counts are combined before the exchange, so a word that every text has costs a row a task.
    """
    runs = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), F.explode(
        F.regexp_extract_all(ascii_lower(F.col(text_column).cast("string")), F.lit(RUN), F.lit(0))).alias("run"))
    word: Column = F.col("run")
    if every is not None:
        h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        at = (h % F.length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        word = F.when(h % every == 0, cut).otherwise(word)
    return (runs.filter(F.length("run") >= min_length).select(word.alias("word"))
            .filter(F.length("word") >= min_length)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count))


# ------------------------------------------------------------------ shards


def _halves(words: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """Index rows and query rows with their shards; second halves use the shards above ``shards``."""
    length = F.length("word")

    def shard(side: int, part: Column) -> Column:
        return F.pmod(F.xxhash64(part), F.lit(shards)).cast("int") + side * shards

    def first(k: Column) -> Column:
        return shard(0, F.substring(F.col("word"), F.lit(1), k))

    def second(k: Column) -> Column:
        return shard(1, F.substring(F.col("word"), length - k + 1, k))

    # A word of length m is met by those of length m - 1 to m + 1, under the half of their length.
    own = [((length + d) / 2).cast("int") for d in (-1, 0, 1)]
    rest = [((length + d + 1) / 2).cast("int") for d in (-1, 0, 1)]
    index = words.select("word", "n", F.explode(F.array_distinct(F.array(
        *map(first, own), *map(second, rest)))).alias("shard"))
    queries = words.select("word", F.lit(None).cast("long").alias("n"), F.explode(F.array(
        first(own[1]), second(rest[1]))).alias("shard"))
    return index, queries


def near_words(words: DataFrame, shard_symbols: int = SHARD_SYMBOLS, block_symbols: int = BLOCK_SYMBOLS) -> DataFrame:
    """Per word that has one: ``word``, ``n_near`` and ``best`` (struct of ``n``, ``word``: its most
    frequent near word, ties to the smallest).

    ``words`` are staged rows of distinct ``word`` (two letters or more) and ``n``.  A shard with
    more symbols than a block may have, such as that of a half which many words share, is cut
    into blocks of words, and every block of its searches meets every block of its index.
    """
    symbols = words.agg(F.coalesce(F.sum(F.length("word") + 1), F.lit(0)).alias("s")).first()["s"]
    # A word has an index row under one or two halves of each side.
    shards = max(1, min(SHARDS, -(-symbols * 7 // (4 * shard_symbols))))
    index, queries = _halves(words, shards)
    sizes = stage(index.groupBy("shard").agg(F.ceil(
        F.sum(F.length("word") + 1) / block_symbols).cast("int").alias("blocks")), "shard-sizes")

    def dealt(rows: DataFrame, seed: int, own: str, other: str) -> DataFrame:
        blocks = F.col("blocks")
        return rows.join(F.broadcast(sizes), "shard").select(
            "shard", "word", "n", F.pmod(F.xxhash64(F.lit(seed), "word"), blocks).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), blocks - 1)).alias(other))

    rows = dealt(index, 1, "in", "of").unionByName(dealt(queries, 2, "of", "in"))

    def search(table: pa.Table) -> pa.Table:
        indexed = table.filter(pa.compute.is_valid(table["n"]))
        asked = table.filter(pa.compute.is_null(table["n"]))["word"].to_pylist()
        count = dict(zip(indexed["word"].to_pylist(), indexed["n"].to_pylist()))
        names = sorted(count)
        found: dict[str, list] = {}
        if names and asked:
            ends = Bidirectional(names)
            left_exact = table["shard"][0].as_py() < shards
            for batch, half in _batches(asked):
                for q, v in zip(*[x.tolist() for x in ends.near(batch, half, left_exact)]):
                    word, other = batch[q], names[v]
                    if not left_exact and other[:half] == word[:half]:
                        continue  # met with its first half as well
                    best = found.setdefault(word, [0, 0, ""])
                    best[0] += 1
                    if (-count[other], other) < (-best[1], best[2]):
                        best[1:] = count[other], other
        return pa.table([pa.array(list(found), pa.string()), *[
            pa.array([b[k] for b in found.values()], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string()))]],
            names=["word", "n_near", "best_n", "best"])

    met = rows.groupBy("shard", "in", "of").applyInArrow(search, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", F.struct((-F.col("best.n")).alias("n"), F.col("best.word").alias("word")).alias("best"))


def _batches(words: list[str]) -> Iterator[tuple[list[str], int]]:
    """Words of one length, at most so many at a time, with the start of their second half."""
    by_length: dict[int, list[str]] = {}
    for word in words:
        by_length.setdefault(len(word), []).append(word)
    for length, group in sorted(by_length.items()):
        cut = max(1, min(TOGETHER, 2_000_000 // length))
        for at in range(0, len(group), cut):
            yield group[at:at + cut], length // 2


def roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root`` for rows of ``word``, ``form`` (not null): the end of each chain, by
    doubling the followed steps; every round is written."""
    chain = stage(forms.select("word", F.col("form").alias("root")), "chains")
    for _ in range(DOUBLINGS):
        further = chain.select(F.col("word").alias("__at"), F.col("root").alias("__next"))
        met = stage(chain.join(further, F.col("root") == F.col("__at"), "left").select(
            "word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved")), "chains")
        chain = met.drop("moved")
        if met.filter("moved").isEmpty():
            break
    return chain


def spelling_variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_length: int = 6,
                      min_count: int = 5, ratio: int = 5, every: int | None = 199,
                      shard_symbols: int = SHARD_SYMBOLS, block_symbols: int = BLOCK_SYMBOLS) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of every word of all texts.

    Words are runs of Latin letters with A-Z lower-cased, of at least ``min_length`` code points
    (4 or more) and ``min_count`` occurrences overall.  With ``every``, a run whose crc32 with the
    row's id it divides first loses one code point, at that crc32 modulo its length.  Two words
    are near at exactly one inserted, deleted or replaced code point.  ``form`` is the near word
    with the largest count, ties to the smallest in code-point order, if that count is at least
    ``ratio`` times the word's own, else null; ``root`` is the end of the chain of forms, or the
    word itself.

    A null or empty text has no words, a null id counts as an empty one.  Repeated rows count
    each, other columns are ignored whatever their names, texts and words may be of any length,
    and an empty table gives no rows.
    """
    if min_length < 4 or ratio < 2:
        raise ValueError("words need four code points or more and a ratio of two or more")
    words = stage(word_counts(docs, id_column, text_column, min_length, min_count, every), "words")
    near = near_words(words, shard_symbols, block_symbols)
    formed = stage(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(F.col("best.n") >= ratio * F.col("n"), F.col("best")).alias("best")), "forms")
    ends = roots(formed.filter("best is not null").select("word", F.col("best.word").alias("form")))
    return formed.join(ends, "word", "left").select(
        "word", F.col("best.word").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near",
        F.col("best.n").alias("form_n"))
