"""Adapters from generic document, conversation and event tables to this package's inputs.

They are deterministic in the tables' ids, keep every row and the whole text of each
document, and have line-by-line equivalents in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.sources.applicants import normalise, resolve_columns
from sievework.operators.keyed import previous_value

# Rule tables made of fragments that occur in the generated prose.

STOP_WORDS = ["the", "that", "was", "for", "with", "und", "der", "die", "les", "des", "que", "los"]

ROLE_TERMS = {
    "ai_agent_developer": [
        "the", "that", "was", "for", "with", "this", "from", "ing", "tion", "der", "und",
        "sich", "eau", "ment", "keit", "ung", "que", "los", "ent", "ver", "ant", "elle",
        "which", "have", "were", "not", "are", "his", "had",
    ],
    "src1": ["tion", "ment", "keit", "the", "ing", "und"],
    "src2": ["qu", "sch", "wh", "ou", "ei", "que", "which", "der", "this", "ing", "ed"],
}

QUALITY_RULES = [
    (r"\d+", 0.5),
    (r"the |und ", 0.3),
    (r"tion|keit", 0.3),
    (r"[,;] ?wh", 0.2),
    (r"that|with", 0.4),
    (r"\(\d+\)|@", 0.3),
    (r"eau|sch", 0.2),
    (r"ing\.|ed\.", 0.3),
    (r"http|www", 0.3),
]

PHRASES = [
    "of the", "in the", "and the", "that the", "was the", "to the", "de la", "et le",
    "in der", "und die", "en el", "de los", "the thing", "is not", "this is",
]

PATTERNS = [
    (r"\d+\.?\d*", "numbers"),
    (r"[a-z]+tion", "abstract nouns"),
    (r"ing[,.]", "gerunds at a pause"),
    (r"[a-z]+@[a-z]+", "addresses"),
]

WORK_REFERENCES = ["the", "und"]

TRANSITIONS = ["the thing", "with", "this", "which", "from the", "that in", "not"]
FORMAL = [r"that th", r"of [a-z]+ing", r"was [a-z]+ed", r"und der", r"de l[ea]"]

CODE_MARKERS = ["Der ", "Que ", "Los ", "}"]
VAGUE_PHRASES = ["the ", "and ", "of ", "in ", "le ", "la ", "und ", "de "]
TECH_PATTERNS = [r"[a-z]+ing", r"tion", r"eau|elle", r"sch|keit", r"\d+", r"ment"]
TECH_TERM_PATTERN = r"the|tion|und|que"

REPLY_RULES = {
    "code_markers": CODE_MARKERS, "vague_phrases": VAGUE_PHRASES, "tech_patterns": TECH_PATTERNS}
SCORE_RULES = {
    "lexicon": ROLE_TERMS, "quality_rules": QUALITY_RULES, "phrases": PHRASES,
    "patterns": PATTERNS, "work_references": WORK_REFERENCES}
AI_RULES = {"transitions": TRANSITIONS, "formal": FORMAL}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of texts; one that comes in fewer pieces than there are cores is spread."""
    df = table(spark, folder, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def applicants_wide(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as an applicant file: aliased headers, strings, three question columns.

    The answers are the first line, the second line, and everything after.
    """
    doc = F.col("doc_id")
    lines = F.split("text", "\n")
    github = (
        F.when(doc % 5 == 1, F.concat(F.lit("https://github.com/user"), doc))
        .when(doc % 5 == 2, F.concat(F.lit("https://github.com/test"), doc))
        .when(doc % 5 == 3, F.concat(F.lit("  handle"), doc))
        .when(doc % 5 == 4, F.concat(F.lit("http://GitHub.com/user"), doc, F.lit("/")))
    )
    email = (
        F.when(doc % 17 == 0, F.lit(""))
        .when(doc % 40 == 23, F.concat(F.lit("U"), doc - 20, F.lit("@x.test ")))
        .when(doc % 40 == 27, F.concat(F.lit("u"), doc - 1, F.lit("@x.test")))
        .otherwise(F.concat(F.lit("u"), doc, F.lit("@x.test")))
    )
    return texts(spark, folder, "documents").select(
        doc.cast("bigint").alias("row_id"),
        F.when(doc % 50 != 49, F.concat(F.lit("c"), doc)).alias("Applicant_ID"),
        F.when(doc % 51 != 0, F.concat(F.lit("Doc   "), doc, F.lit(" "))).alias(" full_name"),
        email.alias("email"), F.col("source").alias("position"), github.alias("github"),
        F.when(doc % 3 != 0, F.concat(F.lit("person"), doc)).alias("linkedin_profile"),
        F.get(lines, F.lit(0)).alias("q1_first_line"),
        F.get(lines, F.lit(1)).alias("q2_second_line"),
        F.array_join(F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(0))), "\n")
        .alias("q3"),
        F.when(doc % 90 == 89, F.lit("n/a?")).when(doc % 90 == 88, F.lit("NA"))
        .otherwise((doc * 7 % 900).cast("string")).alias("time_taken"),
    )


def applicants(spark: SparkSession, folder: str) -> DataFrame:
    """The same with canonical columns, before validation and normalising."""
    return resolve_columns(applicants_wide(spark, folder))


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a canonical candidate."""
    return normalise(applicants(spark, folder))


def document_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as an answer to the question of its language."""
    return texts(spark, folder, "documents").select(
        F.col("lang").alias("question_id"), F.col("doc_id").alias("row_id"),
        # The id that the candidate of the same document has: a missing one is filled from the row.
        F.concat(F.when(F.col("doc_id") % 50 != 49, F.lit("c")).otherwise(F.lit("auto_")), "doc_id").alias("candidate_id"),
        F.concat(F.lit("Doc "), "doc_id").alias("name"), F.col("text").alias("answer_text"))


def replies(spark: SparkSession, folder: str) -> DataFrame:
    """User turns as replies; the turn number gives round and time."""
    return texts(spark, folder, "conversations").filter(F.col("role") == "user").select(
        F.concat(F.lit("t"), "conv_id").alias("thread_id"), F.col("turn").alias("seq"),
        (F.timestamp_seconds(F.lit(1704067200) + F.col("turn") * 3600)).alias("received_at"),
        F.col("text").alias("body"), (F.col("turn") % 4).cast("int").alias("round"))


def reply_threads(spark: SparkSession, folder: str) -> DataFrame:
    """One thread per conversation."""
    conv = F.col("conv_id")
    return table(spark, folder, "conversations").groupBy("conv_id").agg(
        F.max("turn").alias("__t")).select(
        F.concat(F.lit("t"), conv).alias("thread_id"), F.concat(F.lit("c"), conv).alias("candidate_id"),
        F.concat(F.lit("Conv "), conv).alias("name"),
        F.concat(F.lit("u"), conv, F.lit("@x.test")).alias("email"),
        F.lit("Engineer").alias("role"), (conv % 3 + 1).cast("int").alias("round"))


def state_of(event_type: Column) -> Column:
    """A thread state for each kind of event."""
    return (
        F.when(event_type == "signup", F.lit("awaiting_reply"))
        .when(event_type == "view", F.lit("follow_up_sent"))
        .when(event_type == "click", F.lit("replied"))
        .when(event_type == "purchase", F.lit("completed")).otherwise(F.lit("awaiting_reply"))
    )


def thread_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as transitions of the user's thread."""
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        F.concat(F.lit("t"), "user_id").alias("thread_id"),
        F.concat(F.lit("c"), "user_id").alias("candidate_id"),
        F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"),
        kind.alias("event"), state_of(kind).alias("to_state"),
        (kind == "view").alias("advance_round"))


def event_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Seconds since the user's previous event, NaN at the first."""
    events = table(spark, folder, "events").select(
        "user_id", "event_id", F.col("ts").cast("timestamp").alias("at"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    lagged = previous_value(events, "user_id", ["at", "event_id"], "us", "previous",
                            F.date_trunc("hour", "at"))
    return lagged.select("event_id", F.coalesce(
        (F.col("us") - F.col("previous")) / F.lit(1e6), F.lit(float("nan"))).alias("seconds"))
