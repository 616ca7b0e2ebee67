"""Routing, messages, replies and thread state."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework import lexicons as lx
from sievework.functions import rules
from sievework.functions import text as tx
from sievework.operators.keyed import lookup, previous_value

THREAD_EVENT_COLUMNS = [
    "thread_id", "candidate_id", "at", "seq", "event", "to_state", "advance_round"]


# ------------------------------------------------------------- dimensions


def decision_table(spark: SparkSession, decisions: Sequence[tuple] = lx.DECISIONS) -> DataFrame:
    return spark.createDataFrame(
        list(decisions), "response_type STRING, action STRING, template STRING, "
        "advance_round BOOLEAN, description STRING")


def question_table(spark: SparkSession, questions: Mapping[int, str] = lx.QUESTIONS) -> DataFrame:
    return spark.createDataFrame(list(questions.items()), "round INT, question STRING")


def with_question(df: DataFrame, round_col: str = "round",
                  questions: Mapping[int, str] = lx.QUESTIONS,
                  default: str = lx.NEXT_QUESTION_DEFAULT) -> DataFrame:
    """Adds the ``question`` of a round; the table has one row per round."""
    table = question_table(df.sparkSession, questions).withColumnRenamed("round", round_col)
    return df.join(F.broadcast(table), round_col, "left").withColumn(
        "question", F.coalesce("question", F.lit(default)))


def render(template: Column | str, context: Mapping[str, Column],
           templates: Mapping[str, str] = lx.TEMPLATES) -> Column:
    """Fill ``{key}`` placeholders in one pass; unknown keys stay, no template gives ''."""
    name = F.col(template) if isinstance(template, str) else template

    def filled(body: str) -> Column:
        pieces = re.split(r"\{(\w+)\}", body)
        parts = [F.lit(pieces[0])]
        for key, literal in zip(pieces[1::2], pieces[2::2]):
            placeholder = F.lit("{" + key + "}")
            parts.append(F.coalesce(context[key], placeholder) if key in context else placeholder)
            parts.append(F.lit(literal))
        return F.concat(*parts)

    out = F
    for key, body in templates.items():
        out = out.when(name == key, filled(body))
    return out.otherwise(F.lit(""))


# ---------------------------------------------------------------- outreach


def route(scored: DataFrame) -> DataFrame:
    """What happens to each scored applicant, and why."""
    rejected = F.col("tier") == "Reject"
    held = F.col("tier") == "Review"
    return scored.withColumns({
        "action": F.when(rejected, F.lit("skipped")).when(held, F.lit("held_for_review"))
        .otherwise(F.lit("email_sent")),
        "reason": F.when(rejected, F.concat(
            F.lit("Tier: "), "tier", F.lit(" (score: "), tx.number_text(F.col("total_score")),
            F.lit(")"))).when(held, F.lit("Manual review required before engagement")),
    })


def open_threads(routed: DataFrame, run_id: str, now: Column) -> DataFrame:
    """One thread per applicant to be written to; the id depends only on applicant and run."""
    thread_id = F.substring(F.sha2(F.concat_ws("|", "candidate_id", F.lit(run_id)), 256), 1, 32)
    return routed.filter(F.col("action") == "email_sent").select(
        thread_id.alias("thread_id"), "candidate_id", "name", "email", "role", "tier",
        F.lit("awaiting_reply").alias("state"), F.lit(1).alias("round"),
        now.alias("created_at"), now.alias("last_activity"),
        F.lit(lx.TIMEOUT_HOURS).alias("timeout_hours"))


def opening_events(threads: DataFrame) -> DataFrame:
    return threads.select(
        "thread_id", "candidate_id", F.col("created_at").alias("at"),
        F.lit(0).cast("bigint").alias("seq"), F.lit("email_sent").alias("event"),
        F.lit("awaiting_reply").alias("to_state"), F.lit(False).alias("advance_round"))


def _outbox(df: DataFrame, subject: Column, body: Column) -> DataFrame:
    return df.withColumns({"subject": subject, "body": body}).withColumn(
        "body_preview", F.concat(F.substring("body", 1, 200), F.lit("..."))).select(
        "thread_id", "candidate_id", F.col("email").alias("to"), "subject", "template", "round",
        "body", "body_preview")


def first_messages(threads: DataFrame, questions: Mapping[int, str] = lx.QUESTIONS,
                   templates: Mapping[str, str] = lx.TEMPLATES) -> DataFrame:
    """The outbox rows that open each thread."""
    asked = with_question(threads, "round", questions, lx.FIRST_QUESTION_DEFAULT).withColumn(
        "template", F.lit("initial_outreach"))
    context = {"name": tx.first_name("name"), "role": F.col("role"), "question": F.col("question")}
    subject = F.concat(F.lit("Your application for "), "role", F.lit(" — Technical Discussion"))
    return _outbox(asked, subject, render("template", context, templates))


# ----------------------------------------------------------------- replies


def classify_replies(replies: DataFrame, text: str = "body", **lexicons) -> DataFrame:
    """Adds ``response_type`` and ``confidence``; also runs on a stream."""
    return replies.withColumn("__c", rules.classify_reply(text, **lexicons)).withColumns({
        "response_type": F.col("__c.response_type"), "confidence": F.col("__c.confidence"),
    }).drop("__c")


def next_action(replies: DataFrame, text: str = "body", round_col: str = "round",
                max_rounds: int = lx.MAX_ROUNDS, decisions: Sequence[tuple] = lx.DECISIONS,
                **lexicons) -> DataFrame:
    """Adds class and decision; from the last round on the only action is ``complete``."""
    done = F.col(round_col) >= max_rounds
    table = decision_table(replies.sparkSession, decisions)
    decided = classify_replies(replies, text, **lexicons).join(
        F.broadcast(table), "response_type", "left")
    return decided.withColumns({
        "action": F.when(done, F.lit("complete")).otherwise(F.col("action")),
        "template": F.when(~done, F.col("template")),
        "advance_round": ~done & F.coalesce("advance_round", F.lit(False)),
        "description": F.when(done, F.lit("Max rounds reached")).otherwise(F.col("description")),
    })


def process_replies(replies: DataFrame, threads: DataFrame, max_rounds: int = lx.MAX_ROUNDS,
                    decisions: Sequence[tuple] = lx.DECISIONS,
                    questions: Mapping[int, str] = lx.QUESTIONS, **lexicons) -> DataFrame:
    """Replies (thread_id, seq, received_at, body) with their thread, class and decision.

    A reply is judged at the round its thread stands at; one that advances gets
    ``next_round`` and that round's ``question``.  Replies to unknown threads drop out.
    """
    known = threads.select("thread_id", "candidate_id", "name", "email", "role", "round")
    joined = lookup(replies, known, ["thread_id"])
    decided = next_action(joined, "body", "round", max_rounds, decisions, **lexicons)
    stepped = decided.withColumn("next_round", F.col("round") + F.col("advance_round").cast("int"))
    asked = with_question(stepped, "next_round", questions)
    return asked.withColumn("question", F.when(F.col("advance_round"), F.col("question")))


def reply_events(processed: DataFrame) -> DataFrame:
    """Thread events of processed replies: ``replied``, then ``follow_up_sent`` if advanced.

    ``context`` is JSON: class and confidence of the reply, or what the follow-up sends.
    """
    received = processed.select(
        "thread_id", "candidate_id", F.col("received_at").alias("at"),
        (F.col("seq") * 2).cast("bigint").alias("seq"), F.lit("reply_received").alias("event"),
        F.lit("replied").alias("to_state"), F.lit(False).alias("advance_round"),
        F.to_json(F.struct("response_type", "confidence")).alias("context"))
    followed = processed.filter("advance_round").select(
        "thread_id", "candidate_id", F.col("received_at").alias("at"),
        (F.col("seq") * 2 + 1).cast("bigint").alias("seq"), F.lit("follow_up").alias("event"),
        F.lit("follow_up_sent").alias("to_state"), F.lit(True).alias("advance_round"),
        F.to_json(F.struct("template", F.col("next_round").alias("round"))).alias("context"))
    return received.unionByName(followed)


def follow_ups(processed: DataFrame, context: Mapping[str, Column] | None = None,
               templates: Mapping[str, str] = lx.TEMPLATES) -> DataFrame:
    """Outbox rows for the replies that advance their thread."""
    filled = {"name": tx.first_name("name"), "role": F.col("role"),
              "question": F.col("question"), **(context or {})}
    subject = F.concat(F.lit("Re: Your application for "), "role")
    moving = processed.filter("advance_round").drop("round").withColumnRenamed("next_round", "round")
    return _outbox(moving, subject, render("template", filled, templates))


def classify_batch(texts: DataFrame, text: str, round_col: str,
                   ai_rules: Mapping[str, Sequence[str]] | None = None, **lexicons) -> DataFrame:
    """Reply class, next action and machine-text verdict of a text column together.

    ``ai_rules`` are the phrase and pattern lists of ``detect_ai``, ``lexicons`` those of replies.
    """
    from sievework.operators.forensics import detect_ai

    return detect_ai(next_action(texts, text, round_col, **lexicons), text, **dict(ai_rules or {}))


# ------------------------------------------------------------ thread state


def thread_history(events: DataFrame) -> DataFrame:
    """Each transition with the state it came from and its ``context``, if the events have one;
    long threads are split by hour."""
    lagged = previous_value(events, "thread_id", ["at", "seq"], "to_state", "from_state",
                            F.date_trunc("hour", "at"))
    return lagged.withColumn("from_state", F.coalesce("from_state", F.lit("initiated")))


def thread_state(events: DataFrame) -> DataFrame:
    """Current state of each thread; combined before the exchange."""
    return events.groupBy("thread_id").agg(
        F.max_by("to_state", F.struct("at", "seq")).alias("state"),
        (F.lit(1) + F.count_if("advance_round")).alias("round"),
        F.min("at").alias("created_at"), F.max("at").alias("last_activity"),
        F.count(F.lit(1)).alias("n_events"))


def active_threads(threads: DataFrame) -> DataFrame:
    return threads.filter(~F.col("state").isin(lx.CLOSED_STATES))


def stalled_threads(threads: DataFrame, now: Column,
                    timeout_hours: float = lx.TIMEOUT_HOURS) -> DataFrame:
    """Waiting threads whose last activity is strictly longer ago than the timeout."""
    idle = F.unix_micros(now.cast("timestamp")) - F.unix_micros(
        F.col("last_activity").cast("timestamp"))
    return threads.filter(
        F.col("state").isin(lx.WAITING_STATES) & (idle > int(timeout_hours * 3_600_000_000)))


def thread_counts(threads: DataFrame) -> DataFrame:
    """Threads per state, zeros included."""
    states = threads.sparkSession.createDataFrame([(s,) for s in lx.THREAD_STATES], "state STRING")
    counts = threads.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    return states.join(counts, "state", "left").select(
        "state", F.coalesce("n", F.lit(0)).alias("n_threads"))


def thread_totals(threads: DataFrame, outbox: DataFrame) -> DataFrame:
    """Threads in all, active ones, and messages sent."""
    sent = outbox.agg(F.count(F.lit(1)).alias("n")).scalar()
    return threads.agg(
        F.count(F.lit(1)).alias("total_threads"),
        F.count_if(~F.col("state").isin(lx.CLOSED_STATES)).alias("active"),
        sent.alias("emails_sent"))
