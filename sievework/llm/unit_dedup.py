"""Repeated lines and sentences across documents, by hashing units.

Every line, and every sentence of a line that has several, is normalised and digested.  The
first digest half is counted after combining in each task; a bitmap of the halves that occur
again decides from a broadcast which units go on, so only those are exchanged with their
places.  The earliest occurrence stays, the others are returned with their offsets.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.bitmap import bitmap_of
from sievework.llm.common import batches, free_name, kept, rows_of
from sievework.session import stage

LINE = re.compile(r"[^\n]+")
SENTENCE = re.compile(r"[^.!?]+[.!?]*|[.!?]+")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Fewest words of a line and of a sentence that can repeat.
LINE_WORDS, SENTENCE_WORDS = 3, 8


def units(text: str, line_words: int = LINE_WORDS, sentence_words: int = SENTENCE_WORDS) -> list[tuple]:
    """(is a whole line, start, end, digest) of each unit; offsets in code points.

    The digest is the MD5 of the words with A-Z lower-cased, joined by single spaces.
    """
    out = []
    for line in LINE.finditer(text):
        parts = SENTENCE.findall(line[0])
        spans = [(True, line.start(), line[0], line_words)]
        if len(parts) > 1:
            at = line.start()
            for part in parts:
                spans.append((False, at, part, sentence_words))
                at += len(part)
        for whole, start, part, least in spans:
            words = WORD.findall(part.encode("utf-8", "surrogatepass").lower())
            if len(words) >= least:
                out.append((whole, start, start + len(part), hashlib.md5(b" ".join(words)).digest()))
    return out


def located(rows: DataFrame, line_words: int, sentence_words: int) -> DataFrame:
    """Staged units of ``rows`` (row, id, text): row, id, start, stop, whole, high, low."""
    schema = f"row long, id {rows.schema['id'].dataType.simpleString()}, start int, stop int, whole boolean, high long, low long"

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("units")
        for part in parts:
            for batch in batches(rows_of(part, 0, 1, 2), 2):
                out = [(row, key, start, stop, whole, int.from_bytes(d[:8], "big", signed=True),
                        int.from_bytes(d[8:], "big", signed=True))
                       for row, key, text in batch if text
                       for whole, start, stop, d in units(text, line_words, sentence_words)]
                if out:
                    kinds = [pa.int64(), part.column(1).type, pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                        names=["row", "id", "start", "stop", "whole", "high", "low"])

    return stage(rows.select("row", "id", "text").mapInArrow(task, schema), "units")


def _repeats(found: DataFrame) -> DataFrame:
    """Units that occur earlier, in order of (id, start, row): their columns and ``keep``."""
    again = stage(found.groupBy("high").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("high"), "repeated-halves")
    marked = bitmap_of(again, F.xxhash64("high"), again.count()).marked(found, F.xxhash64("high"), "again")
    kept = marked.filter("again").drop("again")
    first = stage(kept.groupBy("high", "low").agg(
        F.min(F.struct("id", "start", "row")).alias("keep"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").drop("n"), "first-units")
    return kept.join(first, ["high", "low"]).filter((F.col("keep.row") != F.col("row")) | (F.col("keep.start") != F.col("start")))


def repeated_units(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                   line_words: int = LINE_WORDS, sentence_words: int = SENTENCE_WORDS) -> DataFrame:
    """Every unit that is to go: the id, ``start`` and ``stop`` (code points), ``whole_line``,
    ``digest``, and the id and start of the occurrence that stays, ``keep_id``, ``keep_start``.

    Units are lines of at least ``line_words`` words and, in lines of several sentences,
    sentences of at least ``sentence_words``; case (A-Z) and white space do not count.  The
    earliest by (id, start) stays; nulls rank first, and of repeated rows one counts as
    earlier.  Null and empty texts have no units; an empty table gives no rows.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"),
                       F.col(text_column).cast("string").alias("text"))
    return _repeats(located(rows, line_words, sentence_words)).select(
        F.col("id").alias(id_column), F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"),
        F.col("whole").alias("whole_line"),
        F.lower(F.concat(F.lpad(F.hex("high"), 16, "0"), F.lpad(F.hex("low"), 16, "0"))).alias("digest"),
        F.col("keep.id").alias("keep_id"), F.col("keep.start").cast("long").alias("keep_start"))


def cut_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                line_words: int = LINE_WORDS, sentence_words: int = SENTENCE_WORDS) -> DataFrame:
    """``docs`` with the repeated units cut out of the text, and the cuts as ``removed`` (array
    of start and stop in the original text, merged where they touch).

    Rows are numbered in a written copy first, so that repeated ids stay apart.
    """
    row, removed = free_name(docs, "row_number"), free_name(docs, "removed")
    numbered = stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    rows = numbered.select(F.col(row).alias("row"), F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    spans = _repeats(located(rows, line_words, sentence_words)).groupBy(F.col("row").alias(row)).agg(
        F.sort_array(F.collect_list(F.struct("start", "stop"))).alias(removed))
    met = numbered.join(stage(spans, "removed-spans"), row, "left").drop(row)
    at, spot = met.columns.index(text_column), met.columns.index(removed)

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts, cuts = [], []
            for text, found in zip(part.column(at).to_pylist(), part.column(spot).to_pylist()):
                merged: list[dict] = []
                for s in found or []:
                    if merged and s["start"] <= merged[-1]["stop"]:
                        merged[-1]["stop"] = max(merged[-1]["stop"], s["stop"])
                    else:
                        merged.append(dict(s))
                for s in reversed(merged):
                    text = text[:s["start"]] + text[s["stop"]:]
                texts.append(text)
                cuts.append(merged)
            columns = list(part.columns)
            columns[at], columns[spot] = pa.array(texts, pa.string()), pa.array(cuts, part.column(spot).type)
            yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    schema = ", ".join(f"`{f.name}` {'string' if f.name == text_column else f.dataType.simpleString()}" for f in met.schema)
    return met.mapInArrow(task, schema)
