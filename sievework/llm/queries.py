"""The registered queries of the operators, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import LOWER, UPPER, table
from sievework.llm.exact_dedup import exact_groups
from sievework.llm.hard_negatives import mine
from sievework.llm.language import held_out, identify, samples
from sievework.llm.licenses import scan_licenses
from sievework.llm.mixing import broadcast_rows, mix, targets, weighted_quotas, words_in
from sievework.llm.neighbours import nearest
from sievework.llm.packing import pack
from sievework.llm.pii import find, labelled, train
from sievework.llm.simhash import near_groups
from sievework.llm.spelling import spelling_variants
from sievework.llm.token_files import read_tokens, write_tokens
from sievework.llm.unit_dedup import LINE_WORDS, SENTENCE_WORDS, repeated_units
from sievework.llm.warc import archive, read_archive

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Tokenizer files of the contracts; the operators take any path.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = samples(docs, ~held_out())
    found = identify(docs.select("doc_id", "text"), learned)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", words_in(F.col("text")).alias("size"))
    known: dict = {}

    def quotas(sizes: dict) -> dict:
        known.update(sizes)
        return weighted_quotas()(sizes)

    mixed = mix(docs, F.array("source"), F.col("size"), quotas, F.xxhash64(F.lit(42), "doc_id", "size"))
    want = targets(known)
    facts = broadcast_rows(spark, [(s, n, want[s]) for s, n in known.items()],
                           "of string, source_size long, target double")
    met = mixed.join(facts, F.col("source").eqNullSafe(F.col("of")))
    return met.select("doc_id", "size", "source_size", "target",
                      (F.col("copies") * F.col("size")).cast("long").alias("taken"))


@query
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), train(labelled()))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


@query
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_tokens(table(spark, sf_dir, "documents"), WORD_BPE, end_id=2)
    return read_tokens(spark, path).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


@query
def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query
def op6_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_units(table(spark, sf_dir, "documents"))
    return found.withColumnsRenamed({"keep_id": "keep_doc_id"})


ORACLES["op6_unit_dedup"] = rf"""
WITH lines AS (
    SELECT doc_id, text, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) AS k
    FROM documents WHERE text IS NOT NULL),
placed AS (
    SELECT doc_id, k, part, sum(length(part) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(part) - 1 AS start
    FROM lines),
cut AS (
    SELECT doc_id, k, start, regexp_extract_all(part, '[^.!?]+[.!?]*|[.!?]+') AS parts FROM placed),
sentences AS (
    SELECT doc_id, k, start AS base, unnest(parts) AS part, generate_subscripts(parts, 1) AS j
    FROM cut WHERE len(parts) > 1),
spans AS (
    SELECT doc_id, true AS whole_line, start, part, {LINE_WORDS} AS least FROM placed
    UNION ALL
    SELECT doc_id, false, base + sum(length(part)) OVER (PARTITION BY doc_id, k ORDER BY j) - length(part), part, {SENTENCE_WORDS}
    FROM sentences),
units AS (
    SELECT doc_id, whole_line, CAST(start AS BIGINT) AS start, CAST(start + length(part) AS BIGINT) AS stop,
           md5(array_to_string(regexp_extract_all(translate(part, '{UPPER}', '{LOWER}'), '[^ 	-
]+'), ' ')) AS digest
    FROM spans WHERE len(regexp_extract_all(part, '[^ 	-
]+')) >= least),
ranked AS (
    SELECT *, first_value(doc_id) OVER w AS keep_doc_id, first_value(start) OVER w AS keep_start
    FROM units WINDOW w AS (PARTITION BY digest ORDER BY doc_id, start))
SELECT doc_id, start, stop, whole_line, digest, keep_doc_id, keep_start
FROM ranked WHERE doc_id <> keep_doc_id OR start <> keep_start
"""


@query
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_groups(table(spark, sf_dir, "documents"), all_digests=True)
    return found.withColumnRenamed("digest", "text_sha256")


ORACLES["op7_exact_dedup"] = f"""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents)
WINDOW same AS (PARTITION BY text_sha256)
"""


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"), words=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = archive(table(spark, sf_dir, "pages"), min_bytes=0)
    back = read_archive(spark, path, "record_type string, record_id string, refers_to string, "
                                     "payload_digest string, payload_length long", verify=True)
    number = lambda c: F.nullif(F.regexp_extract(c, r"x-page:(-?[0-9]+)$", 1), F.lit("")).cast("long")
    return back.select(
        number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"),
        F.substring("payload_digest", 6, 32).alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))


ORACLES["op9_warc"] = """
WITH hashed AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
quads AS (  -- five hex digits are four base32 digits
    SELECT page_id, payload_bytes, hex, [CAST('0x' || substr(hex, 5 * k + 1, 5) AS INTEGER) for k in range(8)] AS parts
    FROM hashed),
named AS (
    SELECT page_id, payload_bytes, array_to_string([
               substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((parts[1 + (k // 4)] >> (15 - 5 * (k % 4))) & 31 AS INTEGER) + 1, 1)
               for k in range(32)], '') AS payload_digest
    FROM quads),
kept AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS keep FROM named)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM kept
"""


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), BYTE_BPE, window=1024, end_id=0, memo_pieces=300_000).drop("ids")


@query
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved))


ORACLES["op12_hard_negatives"] = """
WITH whole AS (
    SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.r AS a_r, a.vec_id AS anchor_id, b.r AS b_r, b.vec_id, a.label = b.label AS same,
           CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
    FROM whole a JOIN whole b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
positives AS (
    SELECT a_r, b_r, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY a_r ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id,
       positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.a_r = p.a_r AND NOT s.same
     AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
WINDOW w AS (PARTITION BY p.a_r, p.b_r ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 5
"""


@query
def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
