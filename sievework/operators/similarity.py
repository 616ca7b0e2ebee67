"""Exact thresholded cosine joins within a question.

TF-IDF pairs follow Bayardo, Ma and Srikant, "Scaling Up All Pairs Similarity Search"
(WWW 2007): equal answers are collapsed first, terms are ordered from rare to common,
and only the leading part of a vector whose remainder is still long enough to reach
the threshold is compared.  Vectors lie in bounded blocks, written once; each two blocks of a question
meet in one task that reads them, where every pair is added up and bounded, and survivors get an exact dot product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework import lexicons as lx
from sievework.functions import text as tx
from sievework.functions.rules import strikes_for
from sievework.functions.text import let
from sievework.operators import pivots
from sievework.operators.keyed import BLOCK_ROWS, lookup, pair_blocks
from sievework.session import new_path, ship_package, stage

#: ``lx.TOKEN_PATTERN`` without its boundaries, which a greedy run has anyway.
TOKEN_SCAN = lx.TOKEN_PATTERN.removeprefix(r"\b").removesuffix(r"\b")
#: Slack for the floating-point bounds of the filters; the last test has none.
SLACK = 1e-9
#: The same where weights travel in single precision.
FLOAT_SLACK = 1e-6
#: Postings of a block at most; a block of heads has as many for each of its rows.
POSTING_BLOCK = 512
#: Blocks that the vectors of a question are dealt to at least, if there are rows enough, and those of
#: all questions together: a question gets no more than its share of them.
SPREAD, ALL_SPREAD = 8, 64
#: Rows of small questions that meet at a time; no question is cut for it.
MEETING_ROWS = 1024
#: Pairs that a task adds up at a time, and products.
CELLS = 1 << 18
#: Shared terms count while the norms from them on multiply to this share of the floor.
CLOSE = 0.96
#: Postings that a task packs for their slots at a time, and answers whose terms it reads at a time.
PACKED, BATCH_ROWS = 1 << 20, 1000
#: Tasks at most that pairs of blocks are dealt to.
MOST_TASKS = 20_000
#: Hash buckets of the first step of the most-frequent-terms cut.
VOCAB_BUCKETS = 64
#: Terms that are broadcast at most: those with at least this share of all postings.
COMMON_TERMS = 400_000


def english_stop_words(spark) -> list[str]:
    """Spark's own English list."""
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords("english")


def term_counts(text: Column | str, stop_words: Sequence[str] = ()) -> Column:
    """Sorted ``ARRAY<STRUCT<term, tf>>`` of a text, from one sort inside the row."""
    column = F.col(text) if isinstance(text, str) else text
    tokens = F.regexp_extract_all(
        F.lower(F.coalesce(column, F.lit(""))), F.lit(tx.pattern(TOKEN_SCAN)), F.lit(0))
    if stop_words:
        tokens = F.filter(tokens, lambda t: ~t.isin(list(stop_words)))

    def runs(s: Column) -> Column:
        starts = F.filter(
            F.transform(s, lambda t, i: F.when(
                ~F.get(s, i - 1).eqNullSafe(t), i)),
            lambda i: i.isNotNull())
        return let(starts, lambda at: F.transform(at, lambda i, k: F.struct(
            F.get(s, i).alias("term"),
            (F.coalesce(F.get(at, k + 1), F.size(s)) - i).alias("tf"))))

    return let(F.sort_array(tokens), runs)


def _uncounted(counted: str) -> Column:
    """``term_counts`` from a string of terms and counts with spaces between them."""
    return let(F.split(counted, " "), lambda s: F.filter(F.transform(s, lambda t, i: F.when(i % 2 == 0, F.struct(
        t.alias("term"), F.get(s, i + 1).cast("int").alias("tf")))), lambda e: e["tf"].isNotNull()))


@dataclass
class Vectors:
    """Staged parts of a TF-IDF model.

    ``members``: question_id, gid, row_id, candidate_id - each non-blank answer and the
    group of answers with the same terms.  ``vectors``: slot, gid, question_id, single, ids, tf,
    idf of each group, terms from rare to common; the first ``single`` of them no other answer
    has.  ``vocabulary``: question_id, term, df, idf, n_answers, term_id.  ``groups``: question_id,
    gid, n of all groups that have terms, also of those that a cut of the vocabulary leaves
    without a vector.  ``gid`` and ``term_id`` are unique over all questions.  ``blocks`` are
    the slots that ``vectors`` lie in.
    """

    members: DataFrame
    vectors: DataFrame
    vocabulary: DataFrame
    groups: DataFrame
    blocks: "Blocks"


@dataclass
class Blocks:
    """Folders of vectors under ``path``, one for each slot.

    ``large`` has for each question of several blocks its first slot and their number; slots
    from ``bins`` on hold whole small questions.  Both are bounded by the postings, not by the
    questions.
    """

    path: str
    large: list[tuple[int, int]]
    bins: int
    slots: int

    def meetings(self) -> int:
        """Pairs of slots of one question, a slot with itself among them."""
        return sum(k * (k + 1) // 2 for _, k in self.large) + self.slots - self.bins

    def meeting(self, number: int) -> tuple[int, int]:
        """The two slots (lo <= hi) of one of the meetings."""
        for base, k in self.large:
            if number < k * (k + 1) // 2:
                hi = (math.isqrt(8 * number + 1) - 1) // 2
                return base + number - hi * (hi + 1) // 2, base + hi
            number -= k * (k + 1) // 2
        return self.bins + number, self.bins + number

    def read(self, slot: int, columns: Sequence[str]) -> pa.Table:
        """The vectors of a slot, in a worker."""
        store, folder = pafs.FileSystem.from_uri(f"{self.path}/slot={slot}")
        found = store.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        files = sorted(f.path for f in found if f.base_name.startswith("part-"))
        parts = []
        for file in files:
            with store.open_input_file(file) as source:
                parts.append(pq.ParquetFile(source).read(list(columns)))
        return pa.concat_tables(parts) if parts else pa.table({c: pa.array([], pa.null()) for c in columns})


def _idf(n_answers: Column, df: Column) -> Column:
    return F.log((n_answers + 1.0) / (df + 1.0)) + 1.0


def _vocabulary(reps: DataFrame, places: DataFrame, max_features: int | None) -> DataFrame:
    """Most frequent terms per question with their smoothed idf; ``places`` has ``reps`` without their terms."""
    counted = reps.select("question_id", "n", F.explode("terms").alias("t")).groupBy(
        "question_id", F.col("t.term").alias("term")).agg(
        F.sum("n").alias("df"), F.sum(F.col("n") * F.col("t.tf")).alias("freq"))
    if max_features is not None:
        # The cut is made per hash bucket first: whatever is among the most frequent
        # overall is so in its bucket, and the final window sees a bounded number.
        best = [F.desc("freq"), F.asc("term")]
        counted = counted.withColumn("__b", F.pmod(F.xxhash64("term"), F.lit(VOCAB_BUCKETS)))
        for keys in (["question_id", "__b"], ["question_id"]):
            counted = counted.withColumn(
                "__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))
            ).filter(F.col("__r") <= max_features)
        counted = counted.drop("__b", "__r")
    sizes = places.groupBy("question_id").agg(F.sum("n").alias("n_answers"))
    return counted.join(sizes, "question_id").select(
        "question_id", "term", "df", _idf(F.col("n_answers"), F.col("df")).alias("idf"), "n_answers",
        F.monotonically_increasing_id().alias("term_id"))


def unit_weights(ends: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists of weights, given by their ends, divided by their norm each, and the norm ``after`` each weight."""
    starts = np.r_[0, ends[:-1]]
    # Squares behind each element: added up from the back of its own list.
    behind = np.zeros(len(w))
    for a, b in zip(starts.tolist(), ends.tolist()):
        behind[a:b] = np.cumsum((w[a:b] * w[a:b])[::-1])[::-1]
    norm = np.repeat(np.sqrt(behind[starts]), ends - starts) if len(w) else w
    after = np.sqrt(np.maximum(0.0, behind - w * w)) / norm
    after[ends - 1] = 0.0
    return w / norm, after


def _postings(reps: DataFrame, vocabulary: DataFrame, kept: Sequence[str]) -> DataFrame:
    """The ``kept`` columns of each group, once for each of its terms that the vocabulary has.

    Terms with 1 in ``COMMON_TERMS`` of all postings or more, so no more than that many, are
    broadcast and their postings stay where they are.  Only the rest are exchanged by term; none
    of those has more postings than that share.  The planner knows postings by the files of the places they
    were read from, so a merge is asked for: it would broadcast them.
    """
    keys = ["question_id", "term"]
    flat = reps.select(*kept, F.explode("terms").alias("t")).select(*kept, "t.term", "t.tf")
    least = (vocabulary.agg(F.sum("df")).first()[0] or 0) / COMMON_TERMS
    common = F.broadcast(vocabulary.filter(F.col("df") >= least))
    rest = flat.join(common.select(*keys), keys, "left_anti").join(vocabulary.filter(F.col("df") < least).hint("merge"), keys)
    return flat.join(common, keys).unionByName(rest)


def _with_terms(reps: DataFrame, vocabulary: DataFrame, entry: Column) -> DataFrame:
    """Per group its ``entry`` list ``e`` over the terms that the vocabulary has: gid, question_id, n, e."""
    return _postings(reps, vocabulary, ["question_id", "gid", "n"]).groupBy("gid").agg(
        F.first("question_id").alias("question_id"), F.first("n").alias("n"), F.collect_list(entry).alias("e"))


def pack_postings(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings (slot, gid, question_id, n_answers, df, term_id, tf), ``PACKED`` or so at a time, as one compressed
    table per slot: slot, packed."""

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        slot, gid, term = (table.column(c).to_numpy() for c in ("slot", "gid", "term_id"))
        order = np.lexsort((term, gid, slot))
        table, slot = table.take(pa.array(order)), slot[order]
        # Ids in order: their steps are short.
        for c, ids in (("gid", gid[order]), ("term_id", term[order])):
            table = table.set_column(table.column_names.index(c), c, pa.array(np.diff(ids, prepend=0)))
        at = table.column_names.index("question_id")
        table = table.set_column(at, "question_id", table.column("question_id").combine_chunks().dictionary_encode()).combine_chunks()
        starts = np.r_[0, np.flatnonzero(np.diff(slot)) + 1, len(slot)].tolist()
        out = []
        for a, b in zip(starts, starts[1:]):
            sink = pa.BufferOutputStream()
            # The first steps of a slot lead from the slot before it: the ids themselves are kept beside them.
            first = {"gid": str(gid[order[a]]), "term_id": str(term[order[a]])}
            part = table.slice(a, b - a).drop_columns(["slot"]).replace_schema_metadata(first)
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as file:
                file.write_table(part)
            out.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(slot[starts[:-1]], pa.int32()), pa.array(out, pa.binary())], names=["slot", "packed"])

    held: list[pa.RecordBatch] = []
    many = 0
    for part in parts:
        if part.num_rows:
            held.append(part)
            many += part.num_rows
        if many >= PACKED:
            yield packed(held)
            held, many = [], 0
    if held:
        yield packed(held)


def list_postings(key, rows):
    """The postings of a slot as one row per group, terms from rare to common: the inverse of ``pack_postings``."""
    parts = []
    for data in rows.column("packed").to_pylist():
        part = pa.ipc.open_stream(data).read_all()
        for c, first in part.schema.metadata.items():
            steps = part.column(c.decode()).to_numpy().copy()
            steps[0] = int(first)
            part = part.set_column(part.column_names.index(c.decode()), c.decode(), pa.array(np.cumsum(steps)))
        at = part.column_names.index("question_id")
        parts.append(part.set_column(at, "question_id", pc.cast(part.column("question_id"), part.schema.field(at).type.value_type)))
    table = pa.concat_tables([p.replace_schema_metadata(None) for p in parts]).combine_chunks()
    gid, df, term, tf = (table.column(c).to_numpy() for c in ("gid", "df", "term_id", "tf"))
    order = np.lexsort((tf, term, df, gid))
    gid, df, term, tf = gid[order], df[order], term[order], tf[order]
    starts = np.r_[0, np.flatnonzero(np.diff(gid)) + 1]
    offsets = pa.array(np.r_[starts, len(gid)], pa.int32())
    of = table.select(["question_id", "n_answers"]).take(pa.array(order[starts]))
    return pa.table({
        "slot": pa.array(np.full(len(starts), key[0].as_py(), np.int32)), "gid": gid[starts],
        "question_id": of.column("question_id"), "n_answers": of.column("n_answers"),
        "single": pa.array(np.add.reduceat(df == 1, starts, dtype=np.int32)),
        "ids": pa.ListArray.from_arrays(offsets, pa.array(term)), "tf": pa.ListArray.from_arrays(offsets, pa.array(tf)),
        "df": pa.ListArray.from_arrays(offsets, pa.array(df))})


def _dealt(reps: DataFrame, groups: DataFrame, block_rows: int) -> tuple[DataFrame, Blocks]:
    """``reps`` with their ``slot``, and the slots.

    A slot has about ``block_rows * POSTING_BLOCK`` postings at most, and less if they would
    not make ``SPREAD`` slots of a question.  A question that needs several has them for itself.
    """
    spark = reps.sparkSession
    capacity, least = float(block_rows * POSTING_BLOCK), float(max(1, block_rows // 16))

    def needed(postings: Column, rows: Column, total: float) -> Column:
        return F.greatest(F.lit(1), F.ceil(postings / capacity), F.least(
            F.lit(SPREAD), F.ceil(postings * F.lit(float(ALL_SPREAD)) / F.lit(max(1.0, total))), F.ceil(rows / least))).cast("int")

    sizes = stage(groups.filter("worded AND question_id IS NOT NULL").groupBy("question_id").agg(
        F.sum("words").alias("postings"), F.count(F.lit(1)).alias("rows")), "question-sizes")
    total = float(sizes.agg(F.sum("postings")).first()[0] or 0)
    sized = sizes.withColumn("blocks", needed(F.col("postings"), F.col("rows"), total))
    # No more than twice the postings divided by those of a slot.
    rows = sorted(sized.filter("blocks > 1").select("question_id", "blocks").collect(), key=lambda r: str(r[0]))
    bases = np.cumsum([0, *[r["blocks"] for r in rows]]).tolist()
    small = sized.filter("blocks = 1").agg(needed(F.sum("postings"), F.sum("rows"), total).alias("n")).first()["n"] or 1
    kind = reps.schema["question_id"].dataType.simpleString()
    large = spark.createDataFrame([(r[0], base, r["blocks"]) for r, base in zip(rows, bases)],
                                  f"question_id {kind}, base int, blocks int")
    slot = F.coalesce(F.col("base") + F.pmod(F.xxhash64("gid"), F.col("blocks")),
                      F.lit(bases[-1]) + F.pmod(F.xxhash64("question_id"), F.lit(small)))
    blocks = Blocks(new_path(spark, "vectors"), [(base, r["blocks"]) for r, base in zip(rows, bases)], bases[-1], bases[-1] + small)
    return reps.join(F.broadcast(large), "question_id", "left").withColumn("slot", slot.cast("int")), blocks


def _tfidf_parts(answers: DataFrame, stop_words: Sequence[str],
                 max_features: int | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Members, groups, representatives with their terms, and vocabulary of a model.

    The terms of an answer are written once and not exchanged as lists.
    """
    ship_package(answers.sparkSession)
    counted = F.array_join(F.transform("terms", lambda t: F.concat_ws(" ", t["term"], t["tf"])), " ")
    bags = stage(
        answers.filter(tx.strip("answer_text") != "").select(
            "question_id", "row_id", "candidate_id",
            term_counts("answer_text", stop_words).alias("terms"),
        ).withColumn("bag", F.sha2(counted, 256)), "bags", None, "zstd")
    groups = stage(bags.groupBy("question_id", "bag").agg(
        F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("n"),
        F.max(F.size("terms") > 0).alias("worded"), F.max(F.size("terms")).alias("words")).withColumn(
        "gid", F.monotonically_increasing_id()), "bag-groups")
    members = stage(lookup(
        bags.select("question_id", "bag", "row_id", "candidate_id"),
        groups.select("question_id", "bag", "gid"), ["question_id", "bag"]).drop("bag"), "members")
    places = stage(bags.select(
        "question_id", "row_id", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).join(
        groups.select("question_id", "row_id", "n", "gid"), ["question_id", "row_id"]).drop("row_id"), "representatives")
    reps = _representatives(bags, places)
    return members, groups, reps, stage(_vocabulary(reps, places, max_features), "vocabulary")


def _representatives(bags: DataFrame, places: DataFrame) -> DataFrame:
    """question_id, n, gid and terms of each group.

    Only the ``places`` of representatives in the files of ``bags`` are exchanged; the task that gets those of a
    file reads the terms there.
    """
    kind = bags.schema["question_id"].dataType.simpleString()
    lists = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())]))

    def terms_of(key, rows):
        store, file = pafs.FileSystem.from_uri(key[0].as_py())
        rows = rows.sort_by("at")
        at = rows.column("at").to_numpy()
        parts, begin = [], 0
        with store.open_input_file(file) as source:
            for batch in pq.ParquetFile(source).iter_batches(BATCH_ROWS, columns=["terms"]):
                a, b = np.searchsorted(at, (begin, begin + batch.num_rows))
                parts.append(batch.column(0).cast(lists).take(pa.array(at[a:b] - begin)))
                begin += batch.num_rows
        return rows.select(["question_id", "n", "gid"]).append_column("terms", pa.chunked_array(parts, lists))

    # Few bytes but much work each: a number of partitions that is asked for is not reduced.
    files = max(1, min(4 * len(bags.inputFiles()), MOST_TASKS))
    return places.repartition(files, "file").groupBy("file").applyInArrow(
        terms_of, f"question_id {kind}, n bigint, gid bigint, terms array<struct<term:string,tf:int>>")


def tfidf_model(answers: DataFrame, stop_words: Sequence[str] = (),
                max_features: int | None = lx.MAX_FEATURES, block_rows: int = BLOCK_ROWS) -> Vectors:
    """TF-IDF vectors per question from (question_id, row_id, candidate_id, answer_text).

    ``row_id`` is unique within a question.  Ids are numbered in tables that are written
    once, so they stay what they are.  Postings go to the slot of their group in one exchange, packed, and
    are written there with counts and idf, of which there are few, in place of weights.
    """
    members, groups, reps, vocabulary = _tfidf_parts(answers, stop_words, max_features)
    dealt, blocks = _dealt(reps, groups, block_rows)
    kept = ["slot", "gid", "question_id"]
    kind = answers.schema["question_id"].dataType.simpleString()
    packed = _postings(dealt, vocabulary, kept).select(*kept, "n_answers", "df", "term_id", "tf").mapInArrow(
        pack_postings, "slot int, packed binary").repartition(max(blocks.slots, min(4 * blocks.slots, 256)), "slot")
    listed = packed.groupBy("slot").applyInArrow(
        list_postings, f"slot int, gid bigint, question_id {kind}, n_answers bigint, single int, ids array<bigint>, tf array<int>, df array<bigint>")
    vectors = listed.select(
        *kept, "single", "ids", "tf", F.transform("df", lambda df: _idf(F.col("n_answers"), df)).alias("idf"))
    vectors.write.option("compression", "zstd").partitionBy("slot").parquet(blocks.path)
    stored = answers.sparkSession.read.schema(vectors.schema).parquet(blocks.path)
    return Vectors(members, stored, vocabulary, groups.filter("worded").select("question_id", "gid", "n"), blocks)


def tfidf_vectors(answers: DataFrame, stop_words: Sequence[str] = (),
                  max_features: int | None = lx.MAX_FEATURES) -> DataFrame:
    """One row per answer and term: question_id, row_id, term, weight (unit norm).

    A group's terms meet its answers as one list, so neither ids nor terms are exchanged by row.
    """
    members, _, reps, vocabulary = _tfidf_parts(answers, stop_words, max_features)
    lists = _with_terms(reps, vocabulary.drop("term_id"), F.struct("term", (F.col("tf") * F.col("idf")).alias("w"))).select(
        "gid", "e", F.sqrt(F.aggregate("e", F.lit(0.0), lambda acc, t: acc + t["w"] * t["w"])).alias("norm"))
    met = lookup(members.select("question_id", "gid", "row_id"), lists, ["gid"], part_rows=BLOCK_ROWS, merge=True)
    return met.select("question_id", "row_id", "norm", F.explode("e").alias("t")).select(
        "question_id", "row_id", "t.term", (F.col("t.w") / F.col("norm")).alias("weight"))


def posting_blocks(heads: DataFrame, block_rows: int) -> DataFrame:
    """Postings (gid, term_id, w, after) of terms with two or more, with their ``block``.

    A list of more than ``block_rows`` is ordered by the norm behind the term, in steps of
    1/32, and a step that is still too long is cut by a hash.
    """
    lengths = stage(heads.groupBy("term_id").agg(F.count(F.lit(1)).alias("n_heads")).filter("n_heads > 1"), "posting-lengths")
    listed = lookup(heads, lengths, ["term_id"]).withColumn("step", F.when(
        F.col("n_heads") > block_rows, F.floor(F.col("after") * 32)).otherwise(F.lit(-1)).cast("int")).drop("n_heads")
    steps = heads.sparkSession.createDataFrame([], "term_id long, step int, parts int")
    long_lists = lengths.filter(F.col("n_heads") > block_rows)
    if not long_lists.isEmpty():
        listed = stage(listed, "postings")
        steps = stage(listed.filter("step >= 0").groupBy("term_id", "step").agg(F.ceil(
            F.count(F.lit(1)) / F.lit(float(block_rows))).cast("int").alias("parts")).filter("parts > 1"), "long-steps")
        # Steps that are cut are as many as the postings divided by the block rows at most.
        listed = listed.join(steps, ["term_id", "step"], "left")
    else:
        listed = listed.withColumn("parts", F.lit(None).cast("int"))
    part = F.pmod(F.xxhash64("gid"), F.coalesce("parts", F.lit(1))).cast("int")
    return listed.select("gid", "term_id", "w", "after", F.concat_ws("-", "step", part).alias("block"))


def posting_block_pairs(postings: DataFrame, floor: float) -> DataFrame:
    """Pairs of blocks of one term (lo <= hi) whose greatest values can reach ``floor``."""
    zones = stage(postings.groupBy("term_id", "block").agg(
        F.max("w").alias("w"), F.max("after").alias("after")), "posting-zones")
    l, r = (zones.select("term_id", F.col("block").alias(s), F.col("w").alias(f"w_{s}"), F.col("after").alias(f"after_{s}"))
            for s in ("lo", "hi"))
    bound = F.col("w_lo") * F.col("w_hi") + F.col("after_lo") * F.col("after_hi")
    return l.join(r, "term_id").filter((F.col("lo") <= F.col("hi")) & (bound >= floor)).select("term_id", "lo", "hi")


@dataclass
class HeadIndex:
    """A block of heads (gid, tail, ids, w) by row and by term.

    By row, terms from rare to common: ``w``, the norm ``after`` it, ``whole`` from it on, its ``row`` and the
    ``place`` of its term among the ``terms``.  ``by`` puts them in order of the terms, the largest ``whole``
    first; ``key`` is that order as a number and ``firsts`` where each term begins.  ``plain``: no row has a term twice,
    as those of answers that share a ``row_id`` do.
    """

    gid: np.ndarray
    tail: np.ndarray
    w: np.ndarray
    after: np.ndarray
    whole: np.ndarray
    row: np.ndarray
    place: np.ndarray
    terms: np.ndarray
    by: np.ndarray
    key: np.ndarray
    firsts: np.ndarray
    plain: bool

    @classmethod
    def of(cls, side: pa.Table) -> "HeadIndex":
        gid, tail = (side.column(c).to_numpy() for c in ("gid", "tail"))
        lists = side.column("ids").combine_chunks()
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        w = side.column("w").combine_chunks().flatten().to_numpy().astype(np.float64)
        row = np.repeat(np.arange(len(counts)), counts)
        total = np.cumsum(w * w)
        after = np.sqrt(np.maximum(0.0, total[np.cumsum(counts) - 1][row] - total) + (tail * tail)[row])
        whole = np.minimum(1.0, np.sqrt(w * w + after * after))
        terms, place = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        key = place * 2.0 + (1.0 - whole)
        by = np.argsort(key, kind="stable")
        many = np.bincount(place, minlength=len(terms))
        plain = not ((place[1:] == place[:-1]) & (row[1:] == row[:-1])).any()
        return cls(gid, tail, w, after, whole, row, place, terms, by, key[by], np.cumsum(many) - many, plain)


def head_meetings(left: pa.Table | HeadIndex, right: pa.Table | HeadIndex, floor: float, same: bool) -> pa.Table:
    """Pairs of two blocks of heads (gid, tail, ids, w) whose cosine can reach ``floor``: ``gid_a``
    of ``left`` and ``gid_b`` of ``right``, in a block with itself (``same``) gid_a < gid_b.

    A shared term counts while the norms from it on multiply to ``CLOSE`` of the floor or more; along a pair's shared
    terms they only fall.  What follows the last one that counts is bounded by the norms behind it, and also
    by that share of the floor or, where a head ends first, by its tail and the other norm.  So the first shared
    term of a pair that reaches the floor counts, and few others need to; where rows have terms twice all count.  A stretch of rows of ``left`` meets all of ``right``
    through an index of its terms; products are added up in a dense table of at most about ``CELLS`` pairs, so
    memory is bounded.
    """
    gids = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    a, b = (x if isinstance(x, HeadIndex) else HeadIndex.of(x) for x in (left, right))
    if len(a.terms) and len(b.terms):
        close = CLOSE * floor if a.plain and b.plain else 0.0
        at = np.minimum(np.searchsorted(b.terms, a.terms), len(b.terms) - 1)
        met = np.flatnonzero((b.terms[at] == a.terms)[a.place])
        rank = at[a.place[met]]
        first = b.firsts[rank]
        many = np.searchsorted(b.key, rank * 2.0 + np.clip(1.0 - close / a.whole[met] + FLOAT_SLACK, -0.5, 1.0), "right") - first
        some = many > 0
        met, first, many = met[some], first[some], many[some]
        w_a, after_a, own_a = a.w[met], a.after[met], a.row[met]
        own_b, w_b, after_b = b.row[b.by], b.w[b.by], b.after[b.by]
        done = np.cumsum(np.bincount(own_a, many, minlength=len(a.gid)))
        width = len(b.gid)
        lo = 0
        while lo < len(a.gid):
            most = int(np.searchsorted(done, (done[lo - 1] if lo else 0) + CELLS, "right"))
            hi = max(lo + 1, min(len(a.gid), lo + CELLS // width, most))
            s, e = np.searchsorted(own_a, (lo, hi))
            if s < e:
                n = many[s:e]
                ends = np.cumsum(n)
                y = np.arange(ends[-1]) + np.repeat(first[s:e] - ends + n, n)
                cell = np.repeat((own_a[s:e] - lo) * width, n) + own_b[y]
                partial = np.bincount(cell, np.repeat(w_a[s:e], n) * w_b[y], minlength=(hi - lo) * width)
                # Terms of a row come from rare to common, so the last one written is the last shared one.
                last = np.zeros(len(partial), np.int32)
                last[cell] = np.arange(len(cell), dtype=np.int32)
                hit = np.flatnonzero(partial)
                y = y[last[hit]]
                x = s + np.searchsorted(ends, last[hit], "right")
                i, j, behind_a, behind_b = own_a[x], own_b[y], after_a[x], after_b[y]
                rest = np.maximum(close, np.maximum(a.tail[i] * behind_b, behind_a * b.tail[j]))
                near = partial[hit] + np.minimum(behind_a * behind_b, rest) >= floor
                i, j = a.gid[i[near]], b.gid[j[near]]
                once = i < j if same else slice(None)
                gids[0].append(i[once])
                gids[1].append(j[once])
            lo = hi
    return pa.table({"gid_a": np.concatenate(gids[0]), "gid_b": np.concatenate(gids[1])})


def heads_of(vectors: pa.Table, floor: float) -> pa.Table:
    """Heads (gid, tail, ids, w, and question_id if given) of vectors as they are written; terms that only one answer
    has and vectors that have no others in their head are left out."""
    ends, ids, w, after = _unit(vectors)
    starts = np.r_[0, ends[:-1]]
    owner = np.repeat(np.arange(len(ends)), ends - starts)
    inside = w * w + after * after >= floor * floor
    last = starts + np.bincount(owner[inside], minlength=len(ends)) - 1
    inside &= np.arange(len(w)) >= (starts + vectors.column("single").to_numpy())[owner]
    many = np.bincount(owner[inside], minlength=len(ends))
    has = many > 0
    offsets = pa.array(np.r_[0, np.cumsum(many[has])], pa.int32())
    heads = pa.table({"gid": vectors.column("gid").to_numpy()[has], "tail": after[last[has]],
                      "ids": pa.ListArray.from_arrays(offsets, ids[inside]),
                      "w": pa.ListArray.from_arrays(offsets, w[inside])})
    if "question_id" in vectors.column_names:
        heads = heads.append_column("question_id", vectors.column("question_id").filter(pa.array(has)))
    return heads


def _written_heads(spark: SparkSession, blocks: Blocks, kind: str, floor: float) -> Blocks:
    """The heads of the vectors of each slot, written once in single precision, in slots of the same numbers."""

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for number in part.column(0).to_pylist():
                vectors = blocks.read(number, ["gid", "question_id", "single", "ids", "tf", "idf"])
                if vectors.num_rows:
                    heads = heads_of(vectors, floor)
                    slot = pa.array(np.full(heads.num_rows, number, np.int32))
                    singles = heads.set_column(3, "w", heads.column("w").cast(pa.list_(pa.float32())))
                    yield from singles.add_column(0, "slot", slot).to_batches(BATCH_ROWS)

    heads = replace(blocks, path=new_path(spark, "heads"))
    written = spark.range(0, blocks.slots, 1, max(1, min(blocks.slots, MOST_TASKS))).mapInArrow(
        cut, f"slot int, gid bigint, tail double, ids array<bigint>, w array<float>, question_id {kind}")
    written.write.option("compression", "zstd").partitionBy("slot").parquet(heads.path)
    return heads


def _unit(vectors: pa.Table) -> tuple[np.ndarray, ...]:
    """Ends of the lists of vectors as they are written; id, unit weight and norm behind it of each term."""
    lists = {c: vectors.column(c).combine_chunks() for c in ("ids", "tf", "idf")}
    ends = np.cumsum(pc.list_value_length(lists["ids"]).to_numpy(zero_copy_only=False))
    ids, tf, idf = (lists[c].flatten().to_numpy() for c in lists)
    return ends, ids, *unit_weights(ends, tf * idf)


def whole_questions(vectors: pa.Table) -> Iterator[pa.Table]:
    """Vectors of a slot, cut between questions into parts of some ``MEETING_ROWS`` rows."""
    question = vectors.column("question_id").combine_chunks().dictionary_encode().indices.to_numpy()
    order = np.argsort(question, kind="stable")
    vectors, question = vectors.take(pa.array(order)), question[order]
    starts = np.r_[0, np.flatnonzero(np.diff(question)) + 1, len(question)]
    begin = 0
    for end in starts[1:].tolist():
        if end - begin >= MEETING_ROWS or end == len(question):
            yield vectors.slice(begin, end - begin)
            begin = end


def _similar_groups(spark: SparkSession, blocks: Blocks, kind: str, threshold: float) -> DataFrame:
    """Pairs of distinct vectors with cosine >= threshold: question_id, gid_a, gid_b, cosine.

    All that two vectors share lies at or behind their first shared term in the order from rare
    to common.  A head ends once what follows stays below the threshold, so a pair that
    reaches the threshold shares a term of both heads.  Each two blocks of a question meet in one
    task, which reads them where they are written and adds up the shared terms of all pairs of
    their heads (without terms that only one answer has) without writing them out.  Everything
    else that a pair shares lies behind the earlier of the two head ends, so one of them
    contributes no more than its tail and the other no more than what follows their last shared
    head term.  Only pairs that then can still reach the threshold leave the task, each once; the
    task that they are exchanged to reads the vectors of the two blocks for exact dot products.  However many
    blocks a question has, vectors and heads are written once and not exchanged.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be above 0: pairs that share no term never meet")
    ship_package(spark)
    floor = float(threshold) - SLACK
    needed = ["gid", "question_id", "single", "ids", "tf", "idf"]

    heads = _written_heads(spark, blocks, kind, floor)
    least = floor - FLOAT_SLACK

    def meet(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, HeadIndex | None] = (-1, None)
        for part in parts:
            for number in part.column(0).to_pylist():
                lo, hi = blocks.meeting(number)
                left = heads.read(lo, ["gid", "question_id", "tail", "ids", "w"])
                if not left.num_rows:
                    continue
                if lo == hi:
                    indexes = (HeadIndex.of(some) for some in whole_questions(left))
                    found = [head_meetings(x, x, least, True) for x in indexes]
                else:
                    if held[0] != hi:  # meetings that follow each other share a slot
                        right = heads.read(hi, ["gid", "tail", "ids", "w"])
                        held = hi, HeadIndex.of(right) if right.num_rows else None
                    if held[1] is None:
                        continue
                    found = [head_meetings(left, held[1], least, False)]
                for pairs in found:
                    slots = [pa.array(np.full(pairs.num_rows, slot, np.int32)) for slot in (lo, hi)]
                    yield from pa.table([*slots, *pairs.columns], names=["lo", "hi", "gid_a", "gid_b"]).to_batches(100_000)

    many = blocks.meetings()
    numbers = spark.range(0, many, 1, max(1, min(many, MOST_TASKS)))
    candidates = stage(numbers.mapInArrow(meet, "lo int, hi int, gid_a bigint, gid_b bigint"), "candidates")

    def whole(slot: int, wanted: pa.ChunkedArray) -> pa.Table:
        found = blocks.read(slot, needed)
        found = found.filter(pc.is_in(found.column("gid"), wanted.combine_chunks()))
        ends, ids, w, _ = _unit(found)
        offsets = pa.array(np.r_[0, ends], pa.int32())
        return pa.table({"gid": found.column("gid"), "question_id": found.column("question_id"),
                         "ids": pa.ListArray.from_arrays(offsets, ids), "w": pa.ListArray.from_arrays(offsets, w)})

    def verify(key, pairs):
        left, right = whole(key[0].as_py(), pairs.column("gid_a")), whole(key[1].as_py(), pairs.column("gid_b"))
        order = np.argsort(pairs.column("gid_a").to_numpy(), kind="stable")
        gid_a, gid_b = (pairs.column(c).to_numpy()[order] for c in ("gid_a", "gid_b"))
        gids = left.column("gid").to_numpy()
        first, last = np.searchsorted(gid_a, gids, "left"), np.searchsorted(gid_a, gids, "right")
        partners = pa.array([gid_b[a:b] for a, b in zip(first.tolist(), last.tolist())], pa.list_(pa.int64()))
        found = exact_cosines(left.append_column("partners", partners), right, threshold)
        # A pair is in order of the gids, so its question is that of either side.
        question = dict(zip(gids.tolist(), left.column("question_id").to_pylist()))
        question.update(zip(right.column("gid").to_pylist(), right.column("question_id").to_pylist()))
        of = pa.array([question[g] for g in found.column("gid_a").to_pylist()], left.schema.field("question_id").type)
        return pa.table([of, *found.columns], names=["question_id", *found.column_names])

    # Few bytes but much work each: a number of partitions that is asked for is not reduced.
    return candidates.repartition(max(1, min(many, MOST_TASKS)), "lo", "hi").groupBy("lo", "hi").applyInArrow(
        verify, f"question_id {kind}, gid_a bigint, gid_b bigint, cosine double")


def exact_cosines(left: pa.Table, right: pa.Table, threshold: float) -> pa.Table:
    """Exact dot products of the ``partners`` of ``left`` in ``right``, added up in the order of
    the term ids, of at least ``threshold``: gid_a < gid_b and cosine."""

    def by_term(side: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for part in side.select(["gid", "ids", "w"]).to_batches():
            for gid, ids, w in zip(*part.columns):
                ids, w = ids.values.to_numpy(), w.values.to_numpy()
                order = np.argsort(ids)
                yield gid.as_py(), ids[order], w[order]

    known = {gid: (ids, w) for gid, ids, w in by_term(right)}
    out: list[tuple[int, int, float]] = []
    partners = (x for chunk in left.column("partners").chunks for x in chunk)
    for (gid, ids, w), others in zip(by_term(left), partners):
        for other in others.values.to_numpy().tolist():
            ids_b, w_b = known[other]
            at = np.minimum(np.searchsorted(ids_b, ids), len(ids_b) - 1)
            both = np.flatnonzero(ids_b[at] == ids)
            cosine = float(np.cumsum(w[both] * w_b[at[both]])[-1])
            if cosine >= threshold:
                out.append((min(gid, other), max(gid, other), cosine))
    columns = list(zip(*out)) if out else [(), (), ()]
    return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())],
                    names=["gid_a", "gid_b", "cosine"])


@dataclass
class SimilarGroups:
    """Similar answers without writing out pairs inside groups of copies.

    ``links``: question_id, gid_a, gid_b, cosine between different term vectors.
    ``copies``: question_id, gid, n for groups of answers with the same vector, whose
    members are all similar to each other with cosine 1.  ``members`` as in ``Vectors``.
    """

    members: DataFrame
    links: DataFrame
    copies: DataFrame


def similar_groups(answers: DataFrame, threshold: float = lx.SIMILARITY_WARN,
                   stop_words: Sequence[str] = (), max_features: int | None = lx.MAX_FEATURES,
                   block_rows: int = BLOCK_ROWS) -> SimilarGroups:
    model = tfidf_model(answers, stop_words, max_features, block_rows)
    kind = answers.schema["question_id"].dataType.simpleString()
    links = stage(_similar_groups(answers.sparkSession, model.blocks, kind, threshold), "links")
    copies = model.groups.filter(F.col("n") > 1)
    return SimilarGroups(model.members, links, copies)


def _expand(groups: SimilarGroups, block_rows: int) -> DataFrame:
    """Links and copies to pairs of answers: question_id, row and applicant of both, cosine."""
    sized = groups.members.join(groups.copies.select("gid", "n"), "gid", "left")
    copied = sized.filter("n > 1").select("question_id", "gid", "row_id", "candidate_id", "n")
    inside = pair_blocks(copied, ["question_id", "gid"], "row_id", F.col("n"),
                         block_rows=block_rows).select(
        "question_id", "row_id_a", "candidate_id_a", "row_id_b", "candidate_id_b",
        F.lit(1.0).alias("cosine"))

    # A large group is cut into hashed parts that meet their links in different tasks.
    parts = F.ceil(F.coalesce("n", F.lit(1)) / F.lit(float(block_rows))).cast("int")
    cut = sized.withColumn("part", F.pmod(F.xxhash64("row_id"), parts).cast("int"))
    n_parts = groups.copies.select("gid", parts.alias("parts"))

    def spread(links: DataFrame, s: str) -> DataFrame:
        counted = links.join(n_parts.withColumnsRenamed({"gid": f"gid{s}", "parts": f"parts{s}"}),
                             f"gid{s}", "left")
        last = F.coalesce(F.col(f"parts{s}"), F.lit(1)) - 1
        return counted.withColumn(f"part{s}", F.explode(F.sequence(F.lit(0), last))).join(
            cut.select(*[F.col(c).alias(c + s) for c in ("gid", "part", "row_id", "candidate_id")]),
            [f"gid{s}", f"part{s}"])

    across = spread(spread(groups.links, "_a"), "_b").select(*inside.columns)
    both = inside.unionByName(across)
    in_order = F.col("row_id_a") < F.col("row_id_b")

    def ordered(c: str, first: bool) -> Column:
        mine, other = ("_a", "_b") if first else ("_b", "_a")
        return F.when(in_order, F.col(c + mine)).otherwise(F.col(c + other))

    return both.select("question_id", "cosine", *[
        ordered(c, first).alias(c + s) for c in ("row_id", "candidate_id")
        for first, s in ((True, "_a"), (False, "_b"))])


def expand_pairs(groups: SimilarGroups, answers: DataFrame, same_candidate: bool = False,
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every pair of similar answers with names, rounded similarity, severity and previews.

    The output of a group of n copies is n(n-1)/2 rows by definition; use
    ``pair_totals`` where only counts or strikes are needed.
    """
    pairs = _expand(groups, block_rows)
    if not same_candidate:
        pairs = pairs.filter(F.col("candidate_id_a") != F.col("candidate_id_b"))
    shown = answers.select("question_id", "row_id", "name",
                           tx.preview("answer_text").alias("preview"))
    for s in ("a", "b"):
        info = shown.select(
            "question_id", F.col("row_id").alias(f"row_id_{s}"),
            F.col("name").alias(f"candidate_{s}_name"), F.col("preview").alias(f"text_{s}_preview"))
        pairs = pairs.join(info, ["question_id", f"row_id_{s}"])
    return pairs.select(
        "question_id", F.col("row_id_a").alias("row_a"), F.col("row_id_b").alias("row_b"), F.col("candidate_id_a").alias("candidate_a"), "candidate_a_name",
        F.col("candidate_id_b").alias("candidate_b"), "candidate_b_name",
        tx.round_half_even("cosine", 4).alias("similarity"),
        F.when(F.col("cosine") >= lx.SIMILARITY_HIGH, F.lit("high"))
        .otherwise(F.lit("medium")).alias("severity"),
        "text_a_preview", "text_b_preview")


def similar_pairs(answers: DataFrame, threshold: float = lx.SIMILARITY_WARN,
                  stop_words: Sequence[str] = (), max_features: int | None = lx.MAX_FEATURES,
                  same_candidate: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All pairs of answers to one question with TF-IDF cosine >= threshold."""
    groups = similar_groups(answers, threshold, stop_words, max_features, block_rows)
    return expand_pairs(groups, answers, same_candidate, block_rows)


def pair_totals(groups: SimilarGroups, same_candidate: bool = False,
                key: str = "candidate_id") -> DataFrame:
    """Pairs and strikes per applicant, computed from group sizes: no pair is written out.

    Columns ``key``, n_pairs, n_strikes.  With ``key="row_id"`` applicants who share an id
    are counted apart; their common pairs still count only with ``same_candidate``.
    """
    names = groups.members.groupBy("gid", *dict.fromkeys(["candidate_id", key])).agg(F.count(F.lit(1)).alias("m"))
    return names.join(_per_answer(groups, same_candidate), ["gid", "candidate_id"]).groupBy(key).agg(
        F.sum(F.col("m") * F.col("partners")).alias("n_pairs"),
        F.sum(F.col("m") * F.col("strikes")).alias("n_strikes")).filter(F.col("n_pairs") > 0)


def _per_answer(groups: SimilarGroups, same_candidate: bool) -> DataFrame:
    """For one answer of an applicant in a group: how many partners, and their strikes."""
    own = groups.members.groupBy("gid", "candidate_id").agg(F.count(F.lit(1)).alias("m"))
    sized = _reach(groups)
    touched = own.join(sized, "gid")
    if same_candidate:
        itself = F.when(F.col("gid") == F.col("other"), F.lit(1)).otherwise(F.lit(0))
        partners = F.col("n_other") - itself
    else:
        theirs = own.select(F.col("gid").alias("other"), "candidate_id", F.col("m").alias("m_other"))
        touched = touched.join(theirs, ["other", "candidate_id"], "left")
        partners = F.col("n_other") - F.coalesce("m_other", F.lit(0))
    return touched.groupBy("gid", "candidate_id").agg(
        F.sum(partners).alias("partners"), F.sum(partners * F.col("each")).alias("strikes"))


def _reach(groups: SimilarGroups) -> DataFrame:
    """Each group with the groups its answers are similar to: gid, other, n_other, each (strikes)."""
    sizes = groups.copies.select(F.col("gid").alias("other"), F.col("n").alias("n_other"))
    links = groups.links
    reach = links.select(F.col("gid_a").alias("gid"), F.col("gid_b").alias("other"), "cosine").unionByName(
        links.select(F.col("gid_b").alias("gid"), F.col("gid_a").alias("other"), "cosine")).unionByName(
        groups.copies.select("gid", F.col("gid").alias("other"), F.lit(1.0).alias("cosine")))
    return reach.join(sizes, "other", "left").select(
        "gid", "other", F.coalesce("n_other", F.lit(1)).alias("n_other"),
        strikes_for(tx.round_half_even("cosine", 4)).alias("each"))


# --------------------------------------------------------------- embeddings

#: Rows of one block in the embedding join: two blocks are multiplied at a time.
VECTOR_BLOCK = 2048


def unit_vectors(df: DataFrame, question: str, item: str, vector: str) -> DataFrame:
    """``q``, ``id`` and the vector ``v`` of norm 1 (a zero vector stays zero)."""
    norm = F.greatest(F.sqrt(F.aggregate(
        F.transform(vector, lambda x: x.cast("double") * x.cast("double")),
        F.lit(0.0), lambda acc, x: acc + x)), F.lit(1e-8))
    return df.select(
        F.col(question).alias("q"), F.col(item).cast("bigint").alias("id"),
        let(norm, lambda n: F.transform(vector, lambda x: x.cast("double") / n)).alias("v"))


def embedding_cosine(df: DataFrame, question: str, item: str, vector: str,
                     threshold: float = lx.SIMILARITY_WARN, block_rows: int = VECTOR_BLOCK) -> DataFrame:
    """Pairs within a question with embedding cosine >= threshold: exact.

    Vectors lie in the bounded blocks of a pivot tree; pairs of blocks, and whole pairs of
    nodes above them, that the triangle inequality rules out are skipped.  Each remaining pair
    of blocks is one group of at most about ``2 * block_rows`` rows, multiplied as matrices;
    only hits are emitted.  A zero vector has cosine 0 with all; it has no angle, so from a
    threshold of 0 down all pairs of blocks are multiplied.
    """
    tree = pivots.grow(unit_vectors(df, question, item, vector), block_rows)
    limit = float(np.arccos(np.clip(threshold, -1.0, 1.0))) if threshold > 0 else 4.0
    meetings = pivots.block_pairs(tree, limit)
    cut = tree.rows

    def rows_of(side: str) -> DataFrame:
        block = cut.select("q", F.col("block").alias(side), "id", "v")
        return meetings.join(block, ["q", side]).select(
            F.col("q").alias(f"q_{side}"), F.col("lo").alias(f"lo_{side}"),
            F.col("hi").alias(f"hi_{side}"), F.col("id").alias("id"), F.col("v").alias("v"))

    def multiply(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"q": [], "id_a": [], "id_b": [], "cosine": []})
        a, b = left["id"].to_numpy(), right["id"].to_numpy()
        cosines = np.stack(left["v"].to_numpy()) @ np.stack(right["v"].to_numpy()).T
        hit = cosines >= threshold
        if key[1] == key[2]:
            hit &= a[:, None] < b[None, :]
        i, j = np.nonzero(hit)
        return pd.DataFrame({"q": key[0], "id_a": np.minimum(a[i], b[j]),
                             "id_b": np.maximum(a[i], b[j]), "cosine": cosines[i, j]})

    kind = df.schema[question].dataType.simpleString()

    def grouped(side: str):
        return rows_of(side).groupBy(f"q_{side}", f"lo_{side}", f"hi_{side}")

    hits = grouped("lo").cogroup(grouped("hi")).applyInPandas(
        multiply, f"q {kind}, id_a bigint, id_b bigint, cosine double")
    return hits.withColumnRenamed("q", question)
