"""What several operators share: reading tables, free column names, text batches, unsigned crc32."""

from __future__ import annotations

import ctypes
import gc
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.session import ship_package

#: Upper- and lower-case ASCII letters, for the contracts that fold A-Z only.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; the path may be in any store Spark reads."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


#: What worker processes keep between tasks, by operator.
KEPT: dict[str, dict] = {}


def kept(operator: str) -> dict:
    """This worker's store for one operator; those of other operators are given up.

    Workers are reused by later stages, and a store that nobody asks for would stay.
    """
    others = [k for k in KEPT if k != operator]
    for other in others:
        del KEPT[other]
    if others:
        give_back()
    return KEPT.setdefault(operator, {})


def drop(operator: str) -> None:
    """Give up this worker's store for one operator."""
    KEPT.pop(operator, None)


def give_back() -> None:
    """Give freed memory back to the machine, not only to this process."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def rows_of(part: pa.RecordBatch, *columns: int) -> Iterator[tuple]:
    """Rows of some columns as Python values, a few hundred at a time."""
    for at in range(0, part.num_rows, 256):
        yield from zip(*[part.column(c).slice(at, 256).to_pylist() for c in columns])


def batches(rows: Iterable[tuple], size_at: int, limit: int = 1_000_000) -> Iterator[list[tuple]]:
    """Cut rows into lists whose texts (element ``size_at``) add up to about ``limit`` characters."""
    held: list[tuple] = []
    chars = 0
    for row in rows:
        held.append(row)
        chars += len(row[size_at] or "") + 64
        if chars >= limit:
            yield held
            held, chars = [], 0
    if held:
        yield held


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
