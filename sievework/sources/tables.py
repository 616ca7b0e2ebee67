"""Stored tables: appends, upserts, last-write-wins reads and JSON output.

Plain Parquet has no in-place merge: ``upsert_candidates`` returns the merged table, and
``upsert_into`` keeps a stored table in buckets of its key and rewrites only the buckets that
new rows fall into.  Logs are only ever appended to.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework import lexicons as lx
from sievework.operators.keyed import latest_per_key
from sievework.session import stage

UPSERT_KEY = ("email", "role")
#: The partition column of a table that is upserted in place.
BUCKET = "upsert_bucket"


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def read_table(spark: SparkSession, path: str, candidate_id: str | None = None) -> DataFrame:
    """A stored table, or only one applicant's rows of it (pushed into the scan)."""
    table = spark.read.parquet(path)
    return table if candidate_id is None else table.filter(F.col("candidate_id") == candidate_id)


def flag_counts(flags: DataFrame) -> DataFrame:
    return flags.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n_flags"))


def upsert_candidates(old: DataFrame, new: DataFrame, key: Sequence[str] = UPSERT_KEY,
                      keep: Sequence[str] = ("candidate_id",), order: str = "row_id") -> DataFrame:
    """Merge ``new`` into ``old`` on ``key``; ``keep`` columns stay the old row's.

    Within ``new`` the last row per key supplies the values and the first its ``keep``
    columns, as if the rows had been upserted one by one.  Both sides reach the join
    with one row per key.
    """
    key, keep = list(key), list(keep)
    values = [c for c in old.columns if c not in key + keep]
    batch = new.groupBy(*key).agg(
        F.max_by(F.struct(*values), order).alias("__new"),
        F.min_by(F.struct(*keep), order).alias("__first"))
    stored = old.select(*key, F.struct(*values).alias("__old"), F.struct(*keep).alias("__kept"))
    merged = stored.join(batch, key, "full_outer")
    row = F.coalesce("__new", "__old")
    ids = F.coalesce("__kept", "__first")
    return merged.select(
        *key, *[ids[c].alias(c) for c in keep], *[row[c].alias(c) for c in values]
    ).select(*old.columns)


def upsert_into(new: DataFrame, path: str, key: Sequence[str] = UPSERT_KEY, keep: Sequence[str] = ("candidate_id",),
                order: str = "row_id", buckets: int = 64) -> None:
    """``upsert_candidates`` into the table at ``path``, which is made if it is not there.

    Rows lie in folders by a hash of the key (``upsert_bucket``).  The buckets of the new rows,
    at most ``buckets`` numbers, prune the read of the old table; only these are merged,
    written aside and then put in place by a dynamic partition overwrite, so a small update
    neither reads nor rewrites the rest.  One writer at a time; ``buckets`` is that of the
    first write.
    """
    spark = new.sparkSession
    bucketed = new.withColumn(BUCKET, F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    try:
        old = spark.read.parquet(path)
    except AnalysisException:
        old = bucketed.limit(0)
    touched = [r[0] for r in bucketed.select(BUCKET).distinct().collect()]  # at most ``buckets`` numbers
    merged = upsert_candidates(old.filter(F.col(BUCKET).isin(touched)).select(*new.columns), new, key, keep, order)
    fresh = stage(merged.withColumn(BUCKET, F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")), "upserted")
    fresh.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        BUCKET).parquet(path)


def read_upserted(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table that ``upsert_into`` keeps."""
    return spark.read.parquet(path).drop(BUCKET)


def latest_answers(answers: DataFrame, order: Sequence[str]) -> DataFrame:
    """Answers are only appended; reruns are resolved here, last write first."""
    return latest_per_key(answers, ["candidate_id", "question_id"], order)


def replace_scores(old: DataFrame, new: DataFrame, order: str = "scored_at") -> DataFrame:
    """Last write per applicant over both tables."""
    return latest_per_key(old.unionByName(new), ["candidate_id"], [order])


def log_rows(df: DataFrame, event_type: str, fields: Mapping[str, Column], at: Column) -> DataFrame:
    """Interaction-log rows with the payload as JSON."""
    payload = F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
    return df.select("candidate_id", F.lit(event_type).alias("event_type"),
                     payload.alias("event_data"), at.alias("created_at"))


def ingested_log(candidates: DataFrame, source: str, at: Column) -> DataFrame:
    return log_rows(candidates, "ingested", {
        "source": F.lit(source), "answers_count": F.size("answers")}, at)


def scored_log(scores: DataFrame, at: Column) -> DataFrame:
    return log_rows(scores, "scored", {
        "total_score": F.col("total_score"), "tier": F.col("tier")}, at)


def typed_events(at: Column, scores: DataFrame | None = None, outbox: DataFrame | None = None,
                 replies: DataFrame | None = None, strikes: DataFrame | None = None,
                 outcomes: DataFrame | None = None) -> DataFrame:
    """The named event kinds as one interaction log, from whichever tables are given."""
    parts = []
    if scores is not None:
        dims = F.struct(*[F.col(d) for d in lx.DIMENSIONS])
        parts.append(log_rows(scores, "score_assigned", {
            "scores": dims, "tier": F.col("tier"), "timestamp": at}, at))
    if outbox is not None:
        parts.append(log_rows(outbox, "email_sent", {
            "template": F.col("template"), "round": F.col("round")}, at))
    if replies is not None:
        parts.append(log_rows(replies, "reply_received", {
            "response_type": F.col("response_type"), "round": F.col("round")}, at))
    if strikes is not None:
        parts.append(log_rows(strikes, "cheat_flagged", {
            "flag_type": F.col("source"), "severity": F.col("severity")}, at))
    if outcomes is not None:
        parts.append(log_rows(outcomes, "outcome", {
            "outcome": F.col("outcome"), "notes": F.coalesce("notes", F.lit(""))}, at))
    if not parts:
        raise ValueError("give at least one table")
    log = parts[0]
    for part in parts[1:]:
        log = log.unionByName(part)
    return log


def weight_rows(spark: SparkSession, weights: Mapping[str, float], version: int, reason: str,
                at: Column) -> DataFrame:
    """A weight map as rows of the ``weights`` table."""
    rows = [(version, d, float(w), reason) for d, w in weights.items()]
    frame = spark.createDataFrame(rows, "version INT, dimension STRING, weight DOUBLE, reason STRING")
    return frame.withColumn("created_at", at)


def current_weights(weights: DataFrame) -> DataFrame:
    """The rows of the highest version."""
    newest = weights.agg(F.max("version").alias("v")).scalar()
    return weights.filter(F.col("version") == newest)


def weights_as_map(weights: DataFrame) -> dict[str, float]:
    """The current weights as a dictionary: one row per scoring dimension reaches the driver.

    A dimension that occurs more than once in the newest version is an error.
    """
    kept = current_weights(weights).filter(F.col("dimension").isin(lx.DIMENSIONS))
    rows = kept.groupBy("dimension").agg(F.count(F.lit(1)).alias("n"), F.first("weight").alias("weight")).collect()
    if repeated := sorted(r["dimension"] for r in rows if r["n"] > 1):
        raise ValueError(f"the newest version has several weights of {', '.join(repeated)}")
    return {r["dimension"]: r["weight"] for r in rows}


def json_sink(df: DataFrame, path: str) -> None:
    """One JSON object per row, written by all tasks."""
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)
