"""Per-key building blocks that stay even when one key holds much of the data.

They pre-aggregate before the exchange and never sort or collect a whole key in
one task.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.session import stage

#: A key is hot when it holds at least this share of the rows, so at most
#: ``HOT_KEYS`` keys are hot whatever the data.
HOT_KEYS = 500

#: Hot keys that a sketch returns at most, the items it keeps track of, and the rows of one key
#: that stay together in a join.
SKETCH_KEYS, SKETCH_ITEMS, PART_ROWS = 4_096, 65_536, 250_000

#: Rows of one key that one task may pair with each other.
BLOCK_ROWS = 4096


def computed_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """``withColumns`` for costly expressions that later filters look at.

    Spark pushes a filter below a projection by repeating the projected expressions
    in it.  Columns that come out of a one-element ``inline`` stay where they are.
    """
    made = F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select("*", made.alias(*columns))


def hot_keys(df: DataFrame, keys: Sequence[str], limit: int = HOT_KEYS) -> DataFrame:
    """The keys holding at least ``1/limit`` of all rows: never more than ``limit``."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    rows = counts.agg(F.sum("__n").alias("__rows")).scalar()
    return counts.filter(F.col("__n") * F.lit(limit) >= rows).select(*keys)


def heavy_hitters(df: DataFrame, keys: Sequence[str], part_rows: int) -> DataFrame | None:
    """Hash and number of parts (``__h``, ``__parts``) of the keys with more than ``part_rows``
    rows, by a frequent-items sketch of bounded size in one pass; None if there are none.

    At most ``SKETCH_KEYS`` keys are returned, the most frequent by the sketch, so a key that is
    left whole holds no more than ``part_rows`` rows or about 1 in ``SKETCH_KEYS`` of all.
    """
    hashed = df.select(F.xxhash64(*keys).alias("__h"))
    items = hashed.agg(F.expr(f"approx_top_k(__h, {SKETCH_KEYS}, {SKETCH_ITEMS})")).first()[0]
    hot = [(i["item"], -(-i["count"] // part_rows)) for i in items or [] if i["count"] > part_rows]
    return df.sparkSession.createDataFrame(hot, "__h long, __parts int") if hot else None


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
           part_rows: int = PART_ROWS, hot: DataFrame | None = None, merge: bool = False) -> DataFrame:
    """Join ``left`` to ``right``, which has one row per key, safely for hot keys.

    A sketch of the keys of ``left`` finds the hot ones.  Their rows are cut by a hash of the
    whole row into parts of about ``part_rows``, and their rows of ``right`` are repeated for
    every part, so no task gets a whole hot key.  ``left`` is read twice, the first time for
    its keys alone, so stage it first when those are expensive; callers that know the counts
    give ``hot`` instead, as ``heavy_hitters`` returns it, of at most ``SKETCH_KEYS`` rows.
    Keys must not be null; rows that repeat whole (maps aside) share a part.  With ``merge`` neither
    side is broadcast, however small its files are: ids pack into a few per cent of their size in memory.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    keys = list(keys)
    if hot is None:
        hot = heavy_hitters(left, keys, part_rows)
    if hot is None or hot.isEmpty():
        return left.join(right.hint("merge") if merge else right, keys, how)

    def with_parts(df: DataFrame, salt: Callable[[Column], Column]) -> DataFrame:
        met = df.withColumn("__h", F.xxhash64(*keys)).join(F.broadcast(hot), "__h", "left")  # at most SKETCH_KEYS rows
        return met.withColumn("__salt", salt(F.coalesce("__parts", F.lit(1)))).drop("__h", "__parts")

    plain = [F.col(f"`{f.name}`") for f in left.schema if "map<" not in f.dataType.simpleString()]
    cut = with_parts(left, lambda parts: F.pmod(F.xxhash64(F.lit(17), *plain), parts).cast("int"))
    spread = with_parts(right, lambda parts: F.explode(F.sequence(F.lit(0), parts - 1)))
    return cut.join(spread.hint("merge") if merge else spread, [*keys, "__salt"], how).drop("__salt")


def first_per_key(df: DataFrame, keys: Sequence[str], order: str = "row_id") -> DataFrame:
    """Keep each key's row with the smallest ``order``, a unique non-null column.

    Only keys and ``order`` are exchanged: the minimum is combined before the exchange,
    and the rows that are not first are told apart by the unique column, so no exchange
    is keyed on a skewed value.  Their ids are written out; where those are few, as
    repeats mostly are, the planner broadcasts them and the wide rows stay in place.
    """
    narrow = df.select(*keys, order)
    firsts = narrow.groupBy(*keys).agg(F.min(order).alias(order)).select(order)
    repeats = stage(narrow.select(order).join(firsts, order, "left_anti"), "repeats")
    return df.join(repeats, order, "left_anti")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep each key's row with the largest ``order``; ties fall to the largest hash of the other
    columns, of which maps may be some but do not count."""
    rest = [c for c in df.columns if c not in keys]
    plain = [f.name for f in df.schema if f.name in rest and "map<" not in f.dataType.simpleString()]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order, F.xxhash64(F.lit(0), *plain))).alias("__row"))
    return newest.select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(*df.columns)


def previous_value(df: DataFrame, key: str, order: Sequence[str], value: str, name: str,
                   bucket: Column) -> DataFrame:
    """``lag(value)`` within ``key``, split by ``bucket`` so that a long key spreads out.

    ``bucket`` must not decrease along ``order``.  Inside a bucket a window finds the
    previous row; a bucket's first row takes the last value of the key's previous
    bucket, found among one row per bucket.  Rows with a null key are one key.
    """
    ordered = F.struct(*order)
    tagged = df.withColumn("__bucket", bucket)
    ends = tagged.groupBy(key, "__bucket").agg(
        F.max_by(F.struct(F.col(value).alias("v")), ordered).alias("__end")
    )
    before = ends.select(
        key, "__bucket",
        F.lag("__end").over(Window.partitionBy(key).orderBy("__bucket")).alias("__before"),
    )
    within = Window.partitionBy(key, "__bucket").orderBy(*order)
    lagged = tagged.withColumn("__prev", F.lag(F.struct(F.col(value).alias("v"))).over(within))
    before = before.withColumnsRenamed({key: "__key", "__bucket": "__at"})
    same = F.col(key).eqNullSafe(F.col("__key")) & F.col("__bucket").eqNullSafe(F.col("__at"))
    joined = lagged.join(before, same, "left").drop("__key", "__at")
    return joined.withColumn(
        name, F.when(F.col("__prev").isNotNull(), F.col("__prev")["v"])
        .otherwise(F.col("__before")["v"])
    ).drop("__bucket", "__prev", "__before")


def pair_blocks(df: DataFrame, keys: Sequence[str], item: str, rows_in_key: Column,
                on: Callable[[str, str], Column] | None = None,
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every two rows of a key once, cut into bounded blocks.

    A key with ``n`` rows is cut into ``ceil(n / block_rows)`` hashed blocks and each
    pair of blocks becomes a join key of its own, so that one task pairs about
    ``block_rows`` rows with as many others however large the key is.  ``on`` gets the
    suffixes of both sides and is evaluated inside the join: pairs that fail it are
    never emitted.  Returns the keys and all other columns with suffixes ``_a`` and
    ``_b``; which row of a pair is ``a`` is not specified.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    blocks = F.greatest(F.lit(1), F.ceil(rows_in_key / F.lit(float(block_rows)))).cast("int")
    cut = df.withColumn("__blocks", blocks).withColumn(
        "__own", F.pmod(F.xxhash64(item), F.col("__blocks")).cast("int"))
    own = F.col("__own")
    left = cut.select(
        *keys, own.alias("__lo"), F.explode(F.sequence(own, F.col("__blocks") - 1)).alias("__hi"),
        *[F.col(c).alias(f"{c}_a") for c in rest])
    right = cut.select(
        *[F.col(k).alias(f"__{k}") for k in keys],
        F.explode(F.sequence(F.lit(0), own)).alias("__low"), own.alias("__high"),
        *[F.col(c).alias(f"{c}_b") for c in rest])
    condition = (F.col("__lo") == F.col("__low")) & (F.col("__hi") == F.col("__high"))
    for k in keys:
        condition = condition & (F.col(k) == F.col(f"__{k}"))
    # Two blocks meet in one cell only; within a block each pair is taken in order.
    condition = condition & (
        (F.col("__lo") < F.col("__hi")) | (F.col(f"{item}_a") < F.col(f"{item}_b")))
    if on is not None:
        condition = condition & on("_a", "_b")
    return left.join(right, condition).select(
        *keys, *[f"{c}_a" for c in rest], *[f"{c}_b" for c in rest])
