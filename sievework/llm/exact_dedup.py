"""Exact duplicates by progressive refinement: length, prefix hash, full digest.

The first pass reads lengths alone.  The second hashes a short prefix of the texts whose length
several rows share, the third digests the texts whose length and prefix hash several rows
share.  Bitmaps of bounded size carry what is shared from pass to pass, so no text is exchanged;
a false hit costs one hash, and the groups themselves are made on length and full digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.bitmap import Bitmap, bitmap_of
from sievework.llm.common import ascii_lower, free_name
from sievework.operators.keyed import SKETCH_KEYS, lookup
from sievework.session import stage

#: Characters of the prefix that the second refinement hashes.
PREFIX = 64
#: Rows of one group of copies that stay together in a join: less where they carry their texts.
PART_ROWS, PART_TEXTS = 250_000, 2_000


def _key(text: Column) -> tuple[Column, Column]:
    return F.length(text), F.xxhash64(ascii_lower(F.substring(text, 1, PREFIX)))


def survivors(docs: DataFrame, text: Column) -> Bitmap:
    """The (length, prefix hash) keys that several rows share, of lengths that several share."""
    length, _ = _key(text)
    lengths = stage(docs.select(length.alias("length")).groupBy("length").agg(F.count(F.lit(1)).alias("n"))
                    .filter("n > 1").select("length"), "shared-lengths")
    known = bitmap_of(lengths, F.xxhash64("length"), lengths.count())
    met = known.marked(docs.select(text.alias("text"), length.alias("length")), F.xxhash64("length"), "hit").filter("hit")
    _, prefix = _key(F.col("text"))
    shared = stage(met.select("length", prefix.alias("prefix")).groupBy("length", "prefix").agg(
        F.count(F.lit(1)).alias("n")).filter("n > 1").select("length", "prefix"), "shared-prefixes")
    return bitmap_of(shared, F.xxhash64("length", "prefix"), shared.count())


def digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
            all_rows: bool = False) -> DataFrame:
    """One staged row per input row: ``row``, ``id``, ``length``, ``shared``, ``digest``.

    ``digest`` is the SHA-256 (lowercase hex) of the text with A-Z lower-cased, null for rows
    whose length or prefix nobody shares, unless ``all_rows`` asks for every digest.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    known = survivors(docs, text)
    length, prefix = _key(text)
    keyed = docs.select(F.col(id_column).alias("id"), text.alias("text"), length.alias("length"), prefix.alias("prefix"))
    met = known.marked(keyed, F.xxhash64("length", "prefix"), "shared")
    digest = F.sha2(ascii_lower(F.col("text")), 256)
    return stage(met.select(
        F.monotonically_increasing_id().alias("row"), "id", "length", "shared",
        (digest if all_rows else F.when(F.col("shared"), digest)).alias("digest")), "digests")


def groups(hashed: DataFrame) -> DataFrame:
    """Texts of two or more rows: ``digest``, ``keep`` (struct of id and row), ``group_size``."""
    return stage(
        hashed.filter("shared").groupBy("length", "digest")
        .agg(F.max(F.struct("id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1").drop("length"), "copy-groups")


def hot_groups(found: DataFrame, part_rows: int) -> DataFrame:
    """The largest groups of more than ``part_rows`` rows and their parts, for ``lookup``."""
    large = found.filter(F.col("group_size") > part_rows).orderBy(F.desc("group_size")).limit(SKETCH_KEYS)
    return stage(large.select(F.xxhash64("digest").alias("__h"), F.ceil(
        F.col("group_size") / F.lit(float(part_rows))).cast("int").alias("__parts")), "hot-groups")


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 all_digests: bool = False) -> DataFrame:
    """Per row: the id, ``keep_id``, ``group_size``, ``kept`` and ``digest``.

    Texts are equal when identical after lower-casing A-Z only; a null is an empty text.  Of
    equal texts the row with the largest id stays; nulls rank lowest, and of rows that repeat
    an id with its text exactly one stays.  Other columns are ignored; an empty table gives
    no rows.
    """
    hashed = digests(docs, id_column, text_column, all_digests)
    found = groups(hashed)
    # Rows that share nothing have no group, and without all digests no key either.
    met = lookup(hashed.filter("shared"), found, ["digest"], "left", hot=hot_groups(found, PART_ROWS)).select(
        *hashed.columns, "keep", "group_size").unionByName(hashed.filter("not shared"), allowMissingColumns=True)
    alone = F.col("group_size").isNull()
    return met.select(
        F.col("id").alias(id_column),
        F.when(alone, F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (alone | (F.col("keep.row") == F.col("row"))).alias("kept"), "digest")


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; the same rules as above.

    Ids of dropped rows go to a bitmap.  Rows it does not hit stay where they are; the others
    are digested once more and compared with the kept row of their text.
    """
    hashed = digests(docs, id_column, text_column)
    found = groups(hashed)
    lost = stage(lookup(hashed.filter("shared"), found, ["digest"], hot=hot_groups(found, PART_ROWS))
                 .filter("keep.row <> row").select(F.xxhash64("id").alias("hash")), "lost-ids")
    hit, digest, kept, known = (free_name(docs, n) for n in ("id_hit", "text_digest", "kept_id", "kept_digest"))
    marked = bitmap_of(lost, F.col("hash"), lost.count()).marked(docs, F.xxhash64(id_column), hit)
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    again = marked.filter(hit).withColumn(digest, F.sha2(ascii_lower(text), 256))
    keep = found.select(F.col("digest").alias(digest), F.col("digest").alias(known), F.col("keep.id").alias(kept))
    again = lookup(again, keep, [digest], "left", hot=hot_groups(found, PART_TEXTS)).filter(
        F.col(known).isNull() | F.col(id_column).eqNullSafe(F.col(kept)))
    return marked.filter(~F.col(hit)).select(*docs.columns).unionByName(
        again.dropDuplicates([id_column, digest]).select(*docs.columns))
