"""Packing of documents into fixed windows: best-fit decreasing on a capacity tree.

A document's ids, with the end id, are cut into full windows and one rest.  Rests are
placed longest first, each into the open window with the least room that still takes it;
a segment tree indexed by remaining room finds that window.  Every task packs the rests
of its own rows, a bounded number at a time, so nothing is exchanged: each batch costs at
most one window that later rests might have filled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm.common import batches, crc32, drop, give_back, rows_of
from sievework.llm.tokens import MEMO_PIECES, ids_of

#: Tokens of rests that a task holds before it packs them (8 MB of ids), and pieces of one
#: batch that it gives to Spark (at most 4 MB of ids each 1,000).
HELD_TOKENS, BATCH_PIECES = 2_000_000, 2_000
#: Sequence numbers of one task; task p uses p * TASK_SEQUENCES and above.
TASK_SEQUENCES = 1 << 36


class CapacityTree:
    """Counts of open windows by remaining room; finds the least room that is enough."""

    def __init__(self, window: int):
        self.size = 1
        while self.size <= window:
            self.size *= 2
        self.counts = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, number: int) -> None:
        self.open[room].append(number)
        node = room + self.size
        while node:
            self.counts[node] += 1
            node //= 2

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, number) of the tightest window with room for ``need``."""
        counts, node = self.counts, need + self.size
        if not counts[node]:
            while node > 1 and (node % 2 or not counts[node + 1]):
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if counts[2 * node] else 2 * node + 1
        room = node - self.size
        while node:
            counts[node] -= 1
            node //= 2
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[tuple[int, int]], int]:
    """(window number, offset) for each length of at most ``window``, and the windows used."""
    tree, places, used = CapacityTree(window), [(0, 0)] * len(lengths), 0
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        room, number = tree.take(lengths[k]) or (window, used)
        used += number == used
        places[k] = (number, window - room)
        if room > lengths[k]:
            tree.add(room - lengths[k], number)
    return places, used


def pack(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text",
         window: int = 1024, end_id: int = 0, held_tokens: int = HELD_TOKENS,
         memo_pieces: int = MEMO_PIECES, special_as_text: bool = False, keep_memo: bool = True) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most ``window`` tokens.

    Returns the id column, ``start`` and ``length`` in the document, ``ids`` (little-endian
    unsigned 32-bit, binary) and their unsigned ``ids_crc32``, ``doc_tokens``, ``sequence_id`` (unique, not dense) and
    ``offset``.  A null or empty text is one piece, the end id.  Repeated rows are packed
    once each, rows with equal ids keep them, other columns are ignored, and an empty table
    gives no rows.  ``sequences`` puts the pieces together.  ``memo_pieces`` bounds the memory
    a worker spends on words it has encoded; with ``keep_memo=False`` it is given up at the end
    of a task, for plans whose other stages need it.  Neither changes the result.  The string of
    a special token in a text is that token's id unless ``special_as_text`` is set.
    """
    id_type = docs.schema[id_column].dataType
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    end = end_id.to_bytes(4, "little")
    schema = T.StructType([
        T.StructField(id_column, id_type), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType())])

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ids_of(tokenizer, memo_pieces, special_as_text)
        types: list[pa.DataType] = []
        sequence = TaskContext.get().partitionId() * TASK_SEQUENCES

        def arrow(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out))
            kinds = [types[0], pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=schema.names)

        def placed(rests: list[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            places, used = best_fit_decreasing([r[2] for r in rests], window)
            for at in range(0, len(rests), BATCH_PIECES):
                yield arrow([(*r, sequence + n, o) for r, (n, o) in
                             zip(rests[at:at + BATCH_PIECES], places[at:at + BATCH_PIECES])])
            sequence += used

        rests: list[tuple] = []
        held = 0
        for part in parts:
            types[:] = [part.schema.field(0).type]
            for batch in batches(rows_of(part, 0, 1), 1, max(400_000, 5 * memo_pieces)):
                out = []
                for (key, _), data in zip(batch, encoder.encode([t for _, t in batch])):
                    data += end
                    n = len(data) // 4
                    for start in range(0, n, window):
                        length = min(window, n - start)
                        ids = data[4 * start:4 * (start + length)]
                        piece = (key, start, length, ids, crc32(ids), n)
                        if length == window:
                            out.append((*piece, sequence, 0))
                            sequence += 1
                        else:
                            rests.append(piece)
                            held += length
                if out:
                    yield arrow(out)
                if held >= held_tokens:
                    yield from placed(rests)
                    rests, held = [], 0
        if rests:
            yield from placed(rests)
        rests.clear()
        if not keep_memo:
            del encoder
            drop("tokens")
        give_back()

    return rows.mapInArrow(task, schema)


def sequences(pieces: DataFrame, window: int = 1024, pad_id: int = 0) -> DataFrame:
    """One row per sequence: ``ids`` (binary, in order of offset), ``n_tokens``, ``padding``.

    A sequence whose length is a power of two stays as it is; others are padded to ``window``.
    A sequence has at most ``window`` pieces, so a group is bounded.
    """
    whole = pieces.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"),
        F.sum("length").alias("n_tokens"))
    ids = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    short = F.bit_count(F.col("n_tokens")) != 1
    padding = F.when(short, window - F.col("n_tokens")).otherwise(F.lit(0)).cast("long")
    pad = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), padding.cast("int")))
    return whole.select("sequence_id", F.concat(ids, pad).alias("ids"), "n_tokens", padding.alias("padding"))
