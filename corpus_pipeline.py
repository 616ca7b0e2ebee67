"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage takes what the one before kept and is written as Parquet before the next reads
it, so a lost executor costs one stage at most.  All but the last return the columns of
``documents``; rows may have nulls in any column and may repeat.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import free_name
from sievework.llm.exact_dedup import drop_copies
from sievework.llm.language import held_out, identify, samples
from sievework.llm.mixing import mix_by_weight
from sievework.llm.packing import pack
from sievework.llm.simhash import drop_near_copies
from sievework.session import ship_package, stage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language (no text, or no letter in it) go.

    Rows are judged each by its whole text, so repeated rows and ids share their fate; other
    columns pass through, also ones named like the results.  An empty table stays empty.
    """
    lang, score = free_name(docs, "lang_pred"), free_name(docs, "score")
    found = identify(docs, samples(docs, ~held_out()), lang_name=lang, score_name=score)
    return found.filter(F.col(lang) != "und").select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays.

    Texts are compared whole, a null one as empty; null ids rank lowest, and of rows that repeat
    an id with its text one stays.  Other columns pass through; an empty table stays empty.
    """
    return drop_copies(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the one with the smallest doc_id stays.

    Fingerprints are those of whole texts, and texts without words share one; of rows that
    repeat the smallest id one stays.  Other columns pass through; an empty table stays empty.
    """
    return drop_near_copies(docs, words=4, radius=4)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source takes them, up to three times.

    Null texts have no words and are not taken; ties, repeated rows, very long texts and
    clashing names are as ``mix_by_weight`` states.  An empty table stays empty.
    """
    return mix_by_weight(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, with their ids, in sequences of at most 1024 tokens.

    A null or empty text is one piece, its end id; a very long one fills windows of its own.
    Rows that repeat are packed each, other columns are left out, no rows give no pieces.
    """
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), window=1024, end_id=0, memo_pieces=40_000, keep_memo=False)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("simhash_near_dedup", simhash_near_dedup),
          ("mixing", mixing), ("packing", packing)]

#: Language identification and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
