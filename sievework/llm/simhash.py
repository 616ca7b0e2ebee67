"""SimHash near-duplicates with bit-sliced comparison.

A fingerprint's bits are cut into pieces; two fingerprints within the radius agree on some
choice of whole pieces, so distinct fingerprints meet in buckets of such choices.  In a
bucket the fingerprints stand vertically: one 64-bit word holds one bit of 64 of them.  A
fingerprint is compared with a word column by column, carry-save counters add up 64
distances at once, and a word is abandoned as soon as all of them exceed the radius.
Buckets send back a spanning forest of their links, not the pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.bitmap import bitmap_of
from sievework.llm.common import batches, free_name, give_back, kept, rows_of
from sievework.llm.components import components
from sievework.session import stage

#: Fingerprints of one bucket that meet in one task; larger buckets are cut and cut pairs meet.
CELL = 2048
#: Comparisons (fingerprint, word of 64) in one numpy step.
STEP = 1 << 15
SEED = 42


def fingerprints(texts: list[str | None], words: int = 4) -> list[int]:
    """Signed 64-bit SimHash of each text over its shingles; 0 for a text without words."""
    split, hashed = re.compile(rb"[^\x20\x09-\x0D]+").findall, xxhash.xxh64_intdigest
    out = []
    for text in texts:
        # encode() keeps A-Z folding to ASCII: bytes.lower() leaves other letters alone.
        found = split((text or "").encode("utf-8", "surrogatepass").lower())
        if not found:
            out.append(0)
            continue
        line = b" ".join(found)
        if len(found) <= words:
            h = np.array([hashed(line, SEED)], np.uint64)
        else:
            ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            h = np.fromiter((hashed(line[a:b], SEED) for a, b in zip(
                starts[:len(found) - words + 1].tolist(), ends[words - 1:].tolist())), np.uint64)
        bits = np.zeros(64, np.int64)
        for at in range(0, len(h), 1 << 16):
            part = h[at:at + (1 << 16)]
            bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        value = sum(1 << k for k in np.flatnonzero(2 * bits > len(h)).tolist())
        out.append(value - (1 << 64) if value >> 63 else value)
    return out


def with_fingerprints(docs: DataFrame, id_column: str, text_column: str, words: int) -> DataFrame:
    """Staged rows ``id``, ``fp``; whole texts are read, nothing is exchanged."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("simhash")
        for part in parts:
            found = [f for b in batches(rows_of(part, 1), 0) for f in fingerprints([t for t, in b], words)]
            # A column of a batch holds on to the whole; a copy lets the texts go before the next batch comes.
            ids = part.column(0).take(pa.array(np.arange(part.num_rows)))
            del part
            give_back()
            yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.int64())], names=["id", "fp"])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, fp long"
    return stage(rows.mapInArrow(task, schema), "fingerprints")


def pieces_for(distinct: int, radius: int) -> tuple[int, int]:
    """Pieces and pieces chosen, so that a bucket holds few strangers at this number of
    fingerprints.  Every choice is exact: ``radius`` changed bits spoil ``radius`` pieces."""
    best, least = (radius + 1, 1), float("inf")
    for chosen in range(1, 6):
        parts = radius + chosen
        keys, bits = comb(parts, chosen), 64 * chosen // parts
        cost = keys * distinct * (60 + distinct / 2 ** (bits - 1))
        if cost < least:
            best, least = (parts, chosen), cost
    return best


def bucket_keys(radius: int, parts: int, chosen: int) -> list[int]:
    """Bit masks; two fingerprints within the radius agree under at least one of them."""
    cuts = [64 * k // parts for k in range(parts + 1)]
    masks = [((1 << cuts[k + 1]) - 1) ^ ((1 << cuts[k]) - 1) for k in range(parts)]
    return [sum(masks[k] for k in c) for c in combinations(range(parts), chosen)]


def near(planes: np.ndarray, left: np.ndarray, word: np.ndarray, radius: int) -> np.ndarray:
    """For each comparison of ``left`` (fingerprint) with ``word`` (column of ``planes``), a
    64-bit mask of the slots within ``radius``; 0 for abandoned words."""
    out = np.zeros(len(left), np.uint64)
    live = np.arange(len(left))
    depth = (radius + 1).bit_length()
    counters = [np.zeros(len(left), np.uint64) for _ in range(depth)]
    over = np.zeros(len(left), np.uint64)
    for bit in range(64):
        ones = np.negative((left >> np.uint64(bit)) & np.uint64(1))  # all ones if set
        carry = planes[bit, word] ^ ones
        for c in counters:  # carry-save: add one to each slot whose bits differ
            c ^= carry
            carry &= ~c
        over |= carry
        if bit % 6 == 5 or bit == 63:
            # A slot exceeds the radius if its count overflowed once or stands above it.
            above, equal = np.zeros(len(live), np.uint64), np.full(len(live), ~np.uint64(0))
            for k in reversed(range(depth)):
                if radius >> k & 1:
                    equal &= counters[k]
                else:
                    above |= equal & counters[k]
                    equal &= ~counters[k]
            over |= above
            keep = ~over != 0
            if bit == 63:
                out[live] = ~over
            elif keep.mean() < 0.7:
                live, left, word, over = live[keep], left[keep], word[keep], over[keep]
                counters = [c[keep] for c in counters]
                if not len(live):
                    break
    return out


def cell_links(fps: np.ndarray, group: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (spanning forest) of fingerprints in cells.

    Rows are sorted by ``group``.  ``side`` 0 and 1 are the two cuts of a bucket that meet,
    2 marks a cell of one cut, whose rows all meet.
    """
    n = len(fps)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, n])
    # Right-hand rows: cut 1, or all rows of a cell of one cut; 64 to a word, cells apart.
    right = np.flatnonzero(side != 0)
    cell_of = np.repeat(np.arange(len(starts)), sizes)
    per_cell = np.bincount(cell_of[right], minlength=len(starts))
    words = -(-per_cell // 64)
    first_word = np.r_[0, np.cumsum(words)]
    rank = np.arange(len(right)) - np.r_[0, np.cumsum(per_cell)][cell_of[right]]
    slot_word, slot_bit = first_word[cell_of[right]] + rank // 64, rank % 64
    planes = np.zeros((64, max(1, first_word[-1])), np.uint64)
    slots = np.full((max(1, first_word[-1]), 64), -1, np.int64)
    slots[slot_word, slot_bit] = right
    column = np.arange(64, dtype=np.uint64)
    for at in range(0, len(slots), 4096):
        part = slots[at:at + 4096]
        values = fps[np.maximum(part, 0)]
        for bit in range(64):
            planes[bit, at:at + 4096] = (((values >> np.uint64(bit)) & np.uint64(1)) << column).sum(1, dtype=np.uint64)
    used = np.zeros(len(slots), np.uint64)
    np.bitwise_or.at(used, slot_word, np.uint64(1) << slot_bit.astype(np.uint64))
    left = np.flatnonzero(side != 1)
    # In a cell of one cut, a row meets the words from its own onward.
    own = np.zeros(n, np.int64)
    own[right] = slot_word
    begin = np.where(side[left] == 2, own[left], first_word[cell_of[left]])
    many = first_word[cell_of[left] + 1] - begin
    link = np.arange(n)
    for lo, hi in _slices(many, STEP):
        rows = np.repeat(left[lo:hi], many[lo:hi])
        base = np.repeat(begin[lo:hi] - np.r_[0, np.cumsum(many[lo:hi])[:-1]], many[lo:hi])
        word = base + np.arange(len(rows))
        mask = near(planes, fps[rows], word, radius) & used[word]
        some = np.flatnonzero(mask)
        for at in range(0, len(some), 4096):
            part = some[at:at + 4096]
            r, b = np.nonzero((mask[part][:, None] >> column) & np.uint64(1))
            a, z = rows[part[r]], slots[word[part[r]], b]
            apart = a != z
            link = _join(link, a[apart], z[apart])
    moved = np.flatnonzero(link != np.arange(n))
    return fps[moved], fps[link[moved]]


def _slices(many: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    total = np.cumsum(many)
    lo = 0
    while lo < len(many):
        done = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, done + most, "right")))
        yield lo, hi
        lo = hi


def _join(link: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hook the roots of ``a`` and ``b`` together; ``link`` stays a forest of stars."""
    while len(a):
        ra, rb = link[a], link[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(link, np.maximum(ra, rb), np.minimum(ra, rb))
        while (step := link[link]).tobytes() != link.tobytes():
            link = step
    return link


def links(distinct: DataFrame, count: int, radius: int, cell: int = CELL) -> DataFrame:
    """Links ``a``, ``b`` of the fingerprints in ``fp`` whose components are those of all
    pairs within ``radius`` bits."""
    masks = bucket_keys(radius, *pieces_for(count, radius))
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("v"))
                     for k, m in enumerate(signed)])
    keyed = distinct.select("fp", F.explode(keys).alias("key")).select("fp", "key.k", "key.v")
    sizes = stage(keyed.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    met = keyed.join(sizes, ["k", "v"]).withColumn("cuts", F.ceil(F.col("n") / cell).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
    cells = met.select("fp", "k", "v", "own", other.alias("other")).select(
        "fp", "k", "v", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"))
    order = ["k", "v", "lo", "hi"]
    dealt = cells.repartition(*order).sortWithinPartitions(*order)

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0

        def compared() -> pa.RecordBatch:
            nonlocal held, rows
            table = [np.concatenate(c) for c in zip(*held)]
            cut = 0
            if not final:  # the last cell may go on in the next batch
                same = np.ones(rows, bool)
                for c in table[1:5]:
                    same &= c == c[-1]
                cut = int(same.sum())
            now, rest = [c[:rows - cut] for c in table], [c[rows - cut:] for c in table]
            held, rows = ([rest], cut) if cut else ([], 0)
            if not len(now[0]):
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, names=["a", "b"])
            new = np.zeros(len(now[0]), bool)
            for c in now[1:5]:
                new[1:] |= c[1:] != c[:-1]
            a, b = cell_links(now[0].view(np.uint64), np.cumsum(new), now[5], radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        final = False
        kept("simhash")
        for part in parts:
            held.append([part.column(i).to_numpy(zero_copy_only=False) for i in range(6)])
            rows += part.num_rows
            if rows >= 50_000:
                yield compared()
        final = True
        if rows:
            yield compared()

    found = dealt.select("fp", *order, "side").mapInArrow(task, "a long, b long")
    return stage(found.distinct(), "near-links")


def near_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                words: int = 4, radius: int = 4) -> DataFrame:
    """Per row: the id, ``fp`` (signed 64-bit) and ``component_id``.

    Texts are lower-cased A-Z only and cut at ASCII white space; a text with fewer words
    than a shingle is one shingle, one without words (or null) has fingerprint 0 and links
    like any other.  Rows are linked when their fingerprints differ in at most ``radius``
    bits; ``component_id`` is the smallest id reachable (null if only null ids are).  Equal
    ids and repeated rows keep a row each; other columns are ignored; an empty table gives
    no rows.
    """
    rows, named = _named(docs, id_column, text_column, words, radius)
    return rows.join(named, "fp").select(F.col("id").alias(id_column), "fp", "component_id")


def _named(docs: DataFrame, id_column: str, text_column: str, words: int,
           radius: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprint of each row, and the component of each fingerprint; both staged."""
    rows = with_fingerprints(docs, id_column, text_column, words)
    classes = stage(rows.groupBy("fp").agg(F.min("id").alias("least")), "fingerprint-classes")
    roots = stage(components(links(classes.select("fp"), classes.count(), radius)), "near-roots")
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "least")
    rooted = stage(rooted, "rooted-classes")
    least = stage(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "near-components")
    return rows, stage(rooted.join(least, "root").select("fp", "component_id"), "near-names")


def drop_near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                     words: int = 4, radius: int = 4) -> DataFrame:
    """One row of ``docs`` per component, that with its ``component_id``, with all columns.

    Rows that share that id in one component are thinned to one.  Ids of lost rows go to a
    bitmap; rows it does not hit stay where they are, and the others are looked at again.
    """
    rows, named = _named(docs, id_column, text_column, words, radius)
    lost = rows.join(named, "fp").groupBy("id", "component_id").agg(F.count(F.lit(1)).alias("n"))
    lost = stage(lost.filter(~F.col("id").eqNullSafe(F.col("component_id")) | (F.col("n") > 1))
                 .select(F.xxhash64("id").alias("hash")), "near-lost")
    hit, own, known, component = (free_name(docs, n) for n in ("id_hit", "own_fp", "known_fp", "component"))
    marked = bitmap_of(lost, F.col("hash"), lost.count()).marked(docs, F.xxhash64(id_column), hit)

    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        kept("simhash")
        return pd.Series(fingerprints([t if isinstance(t, str) else None for t in texts], words), dtype="int64")

    again = marked.filter(hit).withColumn(own, fingerprint(F.col(text_column).cast("string"))).join(
        named.toDF(known, component), F.col(own) == F.col(known))
    staying = again.filter(F.col(id_column).eqNullSafe(F.col(component))).dropDuplicates([component])
    return marked.filter(~F.col(hit)).select(*docs.columns).unionByName(staying.select(*docs.columns))
