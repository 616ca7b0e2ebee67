"""Records of CSV files with line breaks inside quotes, read by many tasks per file.

Where a record starts depends on whether a quote is open, and that on everything before.  A
line maps each of two states (a quote is open or not) to the next, and such maps combine: a
first pass finds the map of every split and how many records start in it for either state, the
driver combines one row per split, and a second pass cuts every split into records knowing its
state and the number of its first record.  What a record has in later splits is joined to it.
"""

from __future__ import annotations

import csv
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.session import ship_package

#: What closes a quoted value: a quote that is not doubled.
CLOSING = re.compile(rb'(?:[^"]++|"")*+"')
#: Splits of one scan at most; the tasks get 26 bytes for each.
SPLITS = 4_000_000


def open_after(line: bytes, inside: bool) -> bool:
    """Whether a quote is open behind a line, from whether one is open before it.

    A quote opens at the start of a value only.  What follows a closing quote, up to the next
    comma, belongs to the value, quotes included.
    """
    at = 0
    while True:
        if inside:
            closed = CLOSING.match(line, at)
            if not closed:
                return True
            at = line.find(b",", closed.end()) + 1
            if not at:
                return False
        if line[at:at + 1] != b'"':
            at = line.find(b',"', at) + 1
            if not at:
                return False
        at, inside = at + 1, True


@dataclass
class Split:
    """What one split does to either state (0: no quote is open): the next one, records started."""

    after: list[int] = field(default_factory=lambda: [0, 1])
    records: list[int] = field(default_factory=lambda: [0, 0])
    header: list[bytes] | None = None

    def lines(self, lines: list[bytes], quoted: np.ndarray, blank: np.ndarray, multi_line: bool) -> None:
        if not multi_line:
            self.records[0] += len(lines) - int(blank.sum())
            return
        at = 0
        for k in [*np.flatnonzero(quoted).tolist(), len(lines)]:
            plain = k - at - int(blank[at:k].sum())  # lines without quotes change no state
            for s in (0, 1):
                if not self.after[s]:
                    self.records[s] += plain + (k < len(lines))
            if k < len(lines):
                both = {s: open_after(lines[k], bool(s)) for s in set(self.after)}
                self.after = [int(both[s]) for s in self.after]
            at = k + 1


def _batches(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[bytes], np.ndarray, np.ndarray]]:
    """(file, split, lines, which have quotes, which are blank), never across two splits."""
    for part in parts:
        file, block = (np.asarray(part.column(k)) for k in (0, 1))
        cuts = np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1
        edges = [0, *cuts.tolist(), part.num_rows]
        for a, b in zip(edges, edges[1:]):
            if a < b:
                text = part.column(2).slice(a, b - a)
                quoted = np.asarray(pc.match_substring(text, '"'), bool)
                blank = np.asarray(pc.is_in(text, pa.array([b"", b"\r"], pa.binary())), bool)
                yield int(file[a]), int(block[a]), text.to_pylist(), quoted, blank


def pinned_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Physical lines of the files: ``file`` (hash of its path), ``split``, ``line`` (binary), ``path``.

    The files are listed in a session of their own, which fixes how they are split: a lost
    executor or a changed setting must not move splits between the passes.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.files.minPartitionNum", str(
        spark.conf.get("spark.sql.files.minPartitionNum", None) or spark.sparkContext.defaultParallelism))
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        own.conf.set(name, spark.conf.get(name))
    view = f"lines_{uuid.uuid4().hex}"
    where = F.col("_metadata.file_path")
    own.read.option("lineSep", "\n").text(path).select(
        F.xxhash64(where).alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.col("value").cast("binary").alias("line"), where.alias("path")).createGlobalTempView(view)
    return spark.table(f"{spark.conf.get('spark.sql.globalTempDatabase', 'global_temp')}.{view}")


def survey(lines: DataFrame, multi_line: bool) -> pa.Table:
    """First pass, one row per split: states after it, records started, and the header."""
    names = "file long, split long, after0 int, after1 int, records0 long, records1 long, header binary, path string"

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], Split] = {}
        paths: dict[int, str] = {}

        def paired() -> Iterator[pa.RecordBatch]:
            for part in parts:
                for k in np.unique(np.asarray(part.column(0)), return_index=True)[1].tolist():
                    paths[part.column(0)[k].as_py()] = part.column(3)[k].as_py()
                yield part

        for file, split, texts, quoted, blank in _batches(paired()):
            known = held.setdefault((file, split), Split(header=None if split else []))
            if known.header is not None and not (known.header and known.header[-1] is None):
                inside = bool(known.header) and multi_line  # a header may hold line breaks as well
                for line, empty in zip(texts, blank):
                    if not inside and empty:
                        continue
                    inside = multi_line and open_after(line, inside)
                    known.header.append(line)
                    if not inside:
                        known.header.append(None)  # type: ignore[arg-type]
                        break
            known.lines(texts, quoted, blank, multi_line)
        for (file, split), s in held.items():
            header = b"\n".join(x for x in s.header if x is not None) if s.header else None
            yield pa.RecordBatch.from_arrays(
                [pa.array([file]), pa.array([split]), *[pa.array([x], pa.int32()) for x in s.after],
                 *[pa.array([x]) for x in s.records], pa.array([header], pa.binary()), pa.array([paths[file]])],
                names=[n.split()[0] for n in names.split(", ")])

    return lines.mapInArrow(task, names).toArrow()  # a row per split, as many as the scan has anyway


@dataclass(frozen=True)
class Places:
    """Sorted splits with their state, number of their first record, and header number."""

    file: np.ndarray
    split: np.ndarray
    inside: np.ndarray
    first: np.ndarray
    header: np.ndarray
    crlf: np.ndarray

    def at(self, file: int, split: int) -> int:
        low, high = np.searchsorted(self.file, [file, file + 1]) if file < 2 ** 63 - 1 else (
            np.searchsorted(self.file, file), len(self.file))
        k = low + np.searchsorted(self.split[low:high], split)
        if k >= high or self.split[k] != split:
            raise RuntimeError("a file changed while it was read")
        return int(k)


def header_names(text: bytes) -> list[str]:
    """Column names of a header record, as the CSV reader makes them: an empty one by its place,
    repeated ones (case aside) with their place behind them."""
    shown = text.decode("utf-8", "replace").removeprefix("﻿")
    names = next(csv.reader([shown.removesuffix("\r")], doublequote=True), []) if "\n" not in shown else next(
        csv.reader(shown.removesuffix("\r").splitlines(keepends=True)), [])
    low = [n.lower() for n in names]
    return [f"_c{k}" if not n else f"{n}{k}" if low.count(n.lower()) > 1 else n for k, n in enumerate(names)]


def combine(found: pa.Table) -> tuple[Places, list[bytes], list[str]]:
    """States and record numbers of all splits, in order of path and split, from one row each."""
    if found.num_rows > SPLITS:
        raise ValueError(f"{found.num_rows} splits: raise spark.sql.files.maxPartitionBytes")
    rows = found.sort_by([("path", "ascending"), ("split", "ascending")]).to_pydict()
    n = found.num_rows
    inside, first, header, crlf = np.zeros(n, np.int8), np.zeros(n, np.int64), np.zeros(n, np.int32), np.zeros(n, bool)
    headers: dict[bytes, int] = {}
    state = number = 0
    for k in range(n):
        if not k or rows["file"][k] != rows["file"][k - 1]:
            state, text = 0, rows["header"][k] or b""
            own, ends = headers.setdefault(text, len(headers)), text.endswith(b"\r")
            number -= bool(text)  # the header is a record without a number
        inside[k], first[k], header[k], crlf[k] = state, number, own, ends
        number += rows[f"records{state}"][k]
        state = rows[f"after{state}"][k]
    file, split = np.array(rows["file"], np.int64), np.array(rows["split"], np.int64)
    order = np.lexsort((split, file))
    return Places(*[x[order] for x in (file, split, inside, first, header, crlf)]), list(headers), sorted(set(rows["path"]))


def cut_records(lines: DataFrame, places: Places, multi_line: bool) -> DataFrame:
    """Second pass: ``row_id``, ``header`` (number), ``record`` (text without its line end)."""
    shared = lines.sparkSession.sparkContext.broadcast(places)  # bounded by SPLITS

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Places = shared.value
        where: tuple[int, int] | None = None
        begun: list[bytes] = []      # lines of the record that is not closed
        number, place, inside, spans, skip = 0, 0, False, False, False
        out: list[tuple] = []

        def add(text: bytes, whole: bool) -> None:
            # ``part`` orders the pieces of a record that several splits hold.
            if not (skip and number == header_number):
                out.append((number, None if whole else int(known.split[place]), int(known.header[place]),
                            text[:-1] if known.crlf[place] and text.endswith(b"\r") and not inside else text))

        def flushed() -> Iterator[pa.RecordBatch]:
            nonlocal out
            if out:
                columns = list(zip(*out))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                                 names=["row_id", "part", "header", "record"])
                out = []

        header_number = -1
        for file, split, texts, quoted, blank in _batches(parts):
            if where != (file, split):
                if begun:
                    add(b"\n".join(begun), False)
                    begun = []
                where, place = (file, split), known.at(file, split)
                inside = spans = bool(known.inside[place])
                number = int(known.first[place]) - 1  # the last record that started
                skip = split == 0
                header_number = number + 1
            for line, has, empty in zip(texts, quoted.tolist(), blank.tolist()):
                if not inside:
                    if empty:
                        continue
                    number += 1
                if has and multi_line:
                    inside = open_after(line, inside)
                if begun or spans or inside:
                    begun.append(line)
                    if not inside:
                        add(b"\n".join(begun), not spans)
                        begun, spans = [], False
                else:
                    add(line, True)
            yield from flushed()
        if begun:
            add(b"\n".join(begun), False)
        yield from flushed()

    found = lines.select("file", "split", "line").mapInArrow(
        task, "row_id long, part long, header int, record binary")
    if not multi_line:
        return found.drop("part")
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("part", "record"))), lambda p: p["record"])
    text: Column = F.aggregate(pieces, F.lit(None).cast("binary"), lambda a, p: F.coalesce(
        F.concat(a, F.lit(b"\n"), p), p))
    spread = found.filter(F.col("part").isNotNull()).groupBy("row_id").agg(
        F.first("header").alias("header"), text.alias("record"))
    return found.filter(F.col("part").isNull()).drop("part").unionByName(spread)


def read_records(spark: SparkSession, path: str | list[str], multi_line: bool = True
                 ) -> tuple[DataFrame | None, list[Sequence[str]]]:
    """Records of all files with their row numbers, and the column names of each header number."""
    ship_package(spark)
    lines = pinned_lines(spark, path)
    found = survey(lines, multi_line)
    if not found.num_rows:
        return None, []
    places, headers, _ = combine(found)
    return cut_records(lines, places, multi_line), [header_names(h) for h in headers]
