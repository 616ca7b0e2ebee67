"""Queries on routing, replies, thread state and the streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as S
from checks.queries_scores import scores_table
from checks.registry import query
from sievework import fixtures as fx
from sievework import lexicons as lx
from sievework.functions import text as tx
from sievework.operators import engagement as en
from sievework.session import new_path
from sievework.streaming import jobs

NOW = "2024-02-15 00:00:00"
NOW_US = 1707955200000000
ROUTED = """ro AS (SELECT *, CASE tier WHEN 'Reject' THEN 'skipped' WHEN 'Review' THEN 'held_for_review' ELSE 'email_sent' END AS action FROM s)"""
OPENED = "op AS (SELECT *, substring(sha256(candidate_id || '|run-1'), 1, 32) AS thread_id FROM ro WHERE action = 'email_sent')"


def now():
    return F.lit(NOW).cast("timestamp")


def routed(spark, d):
    return en.route(scores_table(spark, d))


def opened(spark, d):
    return en.open_threads(routed(spark, d), "run-1", now())


def threads(spark, d):
    return en.thread_state(fx.thread_events(spark, d))


def _score_text(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) || '.0' ELSE CAST({x} AS VARCHAR) END"


@query("route", S.with_(S.SCORES + [ROUTED], f"""SELECT candidate_id, action, CASE tier WHEN 'Reject' THEN 'Tier: Reject (score: ' || {_score_text('total_score')} || ')'
  WHEN 'Review' THEN 'Manual review required before engagement' END AS reason FROM ro"""))
def route(spark, d):
    return routed(spark, d).select("candidate_id", "action", "reason")


@query("open_threads", S.with_(S.SCORES + [ROUTED, OPENED], f"SELECT thread_id, candidate_id, 'awaiting_reply' AS state, 1 AS round, {NOW_US} AS created_us FROM op"))
def open_threads(spark, d):
    return opened(spark, d).select("thread_id", "candidate_id", "state", "round", F.unix_micros("created_at").alias("created_us"))


def _filled(template: str, context: dict[str, str]) -> str:
    out = S.q(lx.TEMPLATES[template])
    for key, value in context.items():
        out = f"replace({out}, '{{{key}}}', {value})"
    return out


_FIRST = _filled("initial_outreach", {
    "name": f"coalesce({S.words('name')}[1], 'there')", "role": "role", "question": S.q(lx.QUESTIONS[1])})


@query("template_join", S.with_(S.SCORES + [ROUTED, OPENED], f"SELECT thread_id, 'Your application for ' || role || ' — Technical Discussion' AS subject, {_FIRST} AS body FROM op"))
def template_join(spark, d):
    return en.first_messages(opened(spark, d)).select("thread_id", "subject", "body")


_FOLLOW = {name: _filled(name, {
    "name": f"coalesce({S.words('name')}[1], 'there')", "role": "role", "question": "coalesce(q_text, 'Tell me more.')"})
    for name in ("technical_followup", "code_feedback")}
PROCESSED = [S.REPLIES.replace(", CAST(turn % 4 AS INTEGER) AS round", ""), S.REPLY_THREADS,
             "jn AS (SELECT rep.*, thr.candidate_id, thr.name, thr.email, thr.role, thr.round FROM rep JOIN thr USING (thread_id))",
             S.classified("jn"), S.DECISIONS, S.decided("cl"), S.QUESTIONS,
             "pp AS (SELECT nx.*, round + CAST(advance_round AS INTEGER) AS next_round, q_text FROM nx LEFT JOIN qs ON q_round = round + CAST(advance_round AS INTEGER))"]


def processed(spark, d):
    return en.process_replies(fx.replies(spark, d).drop("round"), fx.reply_threads(spark, d), **fx.REPLY_RULES)


_ANY = " ".join(f"WHEN {S.q(name)} THEN {_filled(name, {'name': f"coalesce({S.words('name')}[1], 'there')", 'role': 'role', 'question': "coalesce(q_text, '{question}')", 'previous_topic': 'response_type'})}"
                for name in lx.TEMPLATES)


@query("render_messages", S.with_(PROCESSED + ["tp AS (SELECT * FROM (VALUES " + ", ".join(f"({S.q(n)})" for n in lx.TEMPLATES) + ") AS x(kind))"],
  f"""SELECT thread_id, seq, kind, CASE kind {_ANY} END AS body FROM (
  SELECT * REPLACE (CASE WHEN advance_round THEN coalesce(q_text, 'Tell me more.') END AS q_text) FROM pp) CROSS JOIN tp"""))
def render_messages(spark, d):
    # Every reply with every template; what the context lacks stays a placeholder.
    p = processed(spark, d).withColumn("kind", F.explode(F.array(*map(F.lit, lx.TEMPLATES))))
    context = {"name": tx.first_name("name"), "role": F.col("role"), "question": F.col("question"),
               "previous_topic": F.col("response_type")}
    return p.select("thread_id", "seq", "kind", en.render("kind", context).alias("body"))


@query("follow_ups", S.with_(PROCESSED, """SELECT thread_id, email AS "to", 'Re: Your application for ' || role AS subject, template,
  next_round AS round, count(*) AS n FROM pp WHERE advance_round GROUP BY ALL"""))
def follow_ups(spark, d):
    return en.follow_ups(processed(spark, d)).groupBy("thread_id", "to", "subject", "template", "round").agg(
        F.count(F.lit(1)).alias("n"))


@query("classify_reply", S.with_([S.REPLIES, S.classified("rep")], "SELECT thread_id, seq, response_type, confidence FROM cl"))
def classify_reply(spark, d):
    return en.classify_replies(fx.replies(spark, d), **fx.REPLY_RULES).select(
        "thread_id", "seq", "response_type", "confidence")


@query("classify_documents", S.with_([S.classified("documents", "text")], "SELECT doc_id, response_type, confidence FROM cl"))
def classify_documents(spark, d):
    return en.classify_replies(fx.texts(spark, d, "documents"), "text", **fx.REPLY_RULES).select(
        "doc_id", "response_type", "confidence")


NEXT = [S.REPLIES, S.classified("rep"), S.DECISIONS, S.decided("cl")]


@query("next_action", S.with_(NEXT, "SELECT thread_id, seq, action, template, advance_round, description FROM nx"))
def next_action(spark, d):
    return en.next_action(fx.replies(spark, d), **fx.REPLY_RULES).select(
        "thread_id", "seq", "action", "template", "advance_round", "description")


@query("decision_join", S.with_(NEXT[:3], "SELECT response_type, d_action AS action, d_template AS template, count(*) AS n FROM cl JOIN dt USING (response_type) GROUP BY ALL"))
def decision_join(spark, d):
    classes = en.classify_replies(fx.replies(spark, d), **fx.REPLY_RULES).select("response_type")
    return classes.join(F.broadcast(en.decision_table(spark)), "response_type").groupBy(
        "response_type", "action", "template").agg(F.count(F.lit(1)).alias("n"))


@query("question_join", S.with_([S.REPLIES, S.QUESTIONS], "SELECT thread_id, seq, coalesce(q_text, 'Tell me more.') AS question FROM rep LEFT JOIN qs ON q_round = round"))
def question_join(spark, d):
    return en.with_question(fx.replies(spark, d)).select("thread_id", "seq", "question")


@query("reply_join", S.with_(PROCESSED[:3], "SELECT thread_id, seq, candidate_id, email, round FROM jn"))
def reply_join(spark, d):
    from sievework.operators.keyed import lookup

    known = fx.reply_threads(spark, d)
    return lookup(fx.replies(spark, d).drop("round"), known, ["thread_id"]).select(
        "thread_id", "seq", "candidate_id", "email", "round")


@query("process_replies", S.with_(PROCESSED, """SELECT thread_id, seq, response_type, confidence, action, advance_round, next_round,
  CASE WHEN advance_round THEN coalesce(q_text, 'Tell me more.') END AS question FROM pp"""))
def process_replies(spark, d):
    return processed(spark, d).select("thread_id", "seq", "response_type", "confidence", "action",
                                      "advance_round", "next_round", "question")


_REPLY_EVENTS = """re AS (SELECT thread_id, received_us, seq * 2 AS seq, 'replied' AS to_state,
  '{"response_type":"' || response_type || '","confidence":' || confidence || '}' AS context FROM pp
  UNION ALL SELECT thread_id, received_us, seq * 2 + 1, 'follow_up_sent',
  '{"template":"' || template || '","round":' || next_round || '}' FROM pp WHERE advance_round)"""


@query("reply_events", S.with_(PROCESSED + [_REPLY_EVENTS], "SELECT thread_id, received_us, seq, to_state, context FROM re"))
def reply_events(spark, d):
    return en.reply_events(processed(spark, d)).select(
        "thread_id", F.unix_micros("at").alias("received_us"), "seq", "to_state", "context")


@query("thread_history", S.with_(PROCESSED + [_REPLY_EVENTS], """SELECT thread_id, received_us, seq, coalesce(lag(to_state) OVER (
  PARTITION BY thread_id ORDER BY received_us, seq), 'initiated') AS from_state, to_state, context FROM re"""))
def thread_history(spark, d):
    history = en.thread_history(en.reply_events(processed(spark, d)))
    return history.select("thread_id", F.unix_micros("at").alias("received_us"), "seq", "from_state", "to_state", "context")


@query("classify_batch", S.with_(NEXT + [S.signals("nx", "body")], """SELECT thread_id, seq, response_type, confidence, action, ai_probability, verdict FROM g"""))
def classify_batch(spark, d):
    batch = en.classify_batch(fx.replies(spark, d), "body", "round", fx.AI_RULES, **fx.REPLY_RULES)
    return batch.select("thread_id", "seq", "response_type", "confidence", "action", "ai_probability", "verdict")


@query("thread_state", S.with_([S.EVENTS, S.THREADS], "SELECT thread_id, state, round, created_us, last_us, n_events FROM th"))
def thread_state(spark, d):
    return threads(spark, d).select("thread_id", "state", "round", F.unix_micros("created_at").alias("created_us"),
                                    F.unix_micros("last_activity").alias("last_us"), "n_events")


@query("thread_prev_state", S.with_([S.EVENTS], """SELECT thread_id, seq, to_state, coalesce(lag(to_state) OVER (
  PARTITION BY thread_id ORDER BY us, seq), 'initiated') AS from_state FROM ev"""))
def thread_prev_state(spark, d):
    return en.thread_history(fx.thread_events(spark, d)).select("thread_id", "seq", "to_state", "from_state")


@query("active_threads", S.with_([S.EVENTS, S.THREADS], "SELECT thread_id, state FROM th WHERE state NOT IN ('completed', 'stalled', 'eliminated')"))
def active_threads(spark, d):
    return en.active_threads(threads(spark, d)).select("thread_id", "state")


@query("stalled_threads", S.with_([S.EVENTS, S.THREADS], f"""SELECT thread_id, state FROM th WHERE state IN ('awaiting_reply', 'follow_up_sent')
  AND {NOW_US} - last_us > 48 * 3600000000"""))
def stalled_threads(spark, d):
    return en.stalled_threads(threads(spark, d), now()).select("thread_id", "state")


@query("thread_counts", S.with_([S.EVENTS, S.THREADS], "SELECT x.state, count(th.thread_id) AS n_threads FROM (VALUES "
       + ", ".join(f"('{s}')" for s in lx.THREAD_STATES) + ") AS x(state) LEFT JOIN th USING (state) GROUP BY x.state"))
def thread_counts(spark, d):
    return en.thread_counts(threads(spark, d))


@query("thread_totals", S.with_(PROCESSED + [S.EVENTS, S.THREADS], """SELECT count(*) AS total_threads,
  count(*) FILTER (WHERE state NOT IN ('completed', 'stalled', 'eliminated')) AS active,
  (SELECT count(*) FROM pp WHERE advance_round) AS emails_sent FROM th"""))
def thread_totals(spark, d):
    return en.thread_totals(threads(spark, d), en.follow_ups(processed(spark, d)))


# ------------------------------------------------------------- streaming


@query("stream_classify", S.with_(["rep AS (SELECT conv_id, turn, role, text FROM conversations)", S.classified("rep", "text")],
  "SELECT conv_id, turn, response_type, confidence FROM cl WHERE role = 'user'"))
def stream_classify(spark, d):
    source = jobs.stream_parquet(spark, d, "conversations.parquet").filter(F.col("role") == "user")
    classes = jobs.stream_classify(source, "text", **fx.REPLY_RULES)
    return jobs.run_available(classes.select("conv_id", "turn", "response_type", "confidence"), "classified")


@query("stream_strikes", """SELECT 'c' || user_id AS candidate_id, CAST(sum(CASE WHEN value / 100.0::DOUBLE > 0.8 THEN 2 ELSE 1 END) AS BIGINT) AS strikes,
  sum(CASE WHEN value / 100.0::DOUBLE > 0.8 THEN 2 ELSE 1 END) >= 3 AS eliminated FROM events GROUP BY ALL""")
def stream_strikes(spark, d):
    source = jobs.stream_parquet(spark, d, "events.parquet")
    flags = source.select(F.concat(F.lit("c"), "user_id").alias("candidate_id"), (F.col("value") / 100.0).alias("severity"))
    return jobs.run_updates(jobs.stream_strikes(flags), "strikes", ["candidate_id"])


@query("stream_threads", S.with_([S.EVENTS], """SELECT thread_id, us AS last_us, to_state AS state FROM (SELECT *, lead(us) OVER (
  PARTITION BY thread_id ORDER BY us, seq) AS next_us, max(us) OVER () - 3600000000 AS watermark FROM ev)
  WHERE to_state IN ('awaiting_reply', 'follow_up_sent') AND coalesce(next_us, watermark) - us > 48 * 3600000000"""))
def stream_threads(spark, d):
    source = jobs.stream_parquet(spark, d, "events.parquet")
    kind = F.col("event_type")
    events = source.select(F.concat(F.lit("t"), "user_id").alias("thread_id"), F.col("ts").cast("timestamp").alias("at"),
                           F.col("event_id").alias("seq"), fx.state_of(kind).alias("to_state"))
    stalls = jobs.run_available(jobs.stream_threads(events), "stalls")
    return stalls.select("thread_id", F.unix_micros("last_activity").alias("last_us"), "state")


_PARTS, _LATENESS = 6, 2000


@query("stream_fates", f"""WITH o AS (SELECT o_orderkey, 'u' || o_custkey AS email, o_orderpriority AS role, o_orderdate AS moment,
  o_orderkey % {_PARTS} AS part FROM orders),
  tops AS (SELECT part, max(moment) AS top FROM o GROUP BY part),
  marks AS (SELECT part, max(top) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL {_LATENESS} DAY AS mark FROM tops),
  judged AS (SELECT o.*, coalesce(moment < mark, false) AS late FROM o JOIN marks USING (part))
  SELECT o_orderkey, email, role, CASE WHEN late THEN 'late' WHEN row_number() OVER (
    PARTITION BY email, role, late ORDER BY part, moment, o_orderkey) = 1 THEN 'kept' ELSE 'duplicate' END AS fate FROM judged""")
def stream_fates(spark, d):
    # Orders in several files, one after the other: each is a batch that moves the watermark.
    folder = new_path(spark, "order-files")
    orders = fx.table(spark, d, "orders").select(
        "o_orderkey", F.concat(F.lit("u"), "o_custkey").alias("email"), F.col("o_orderpriority").alias("role"),
        F.col("o_orderdate").cast("timestamp").alias("at"))
    for part in range(_PARTS):
        orders.filter(F.col("o_orderkey") % _PARTS == part).coalesce(1).write.mode("append").parquet(folder)
    source = jobs.stream_parquet(spark, folder, "*.parquet")
    fates = jobs.stream_fates(source, order=("o_orderkey",), horizon="4000 days", lateness=f"{_LATENESS} days")
    return jobs.run_available(fates, "fates", "fate").select("o_orderkey", "email", "role", "fate")


@query("stream_dedup", "SELECT DISTINCT 'u' || o_custkey AS email, o_orderpriority AS role FROM orders")
def stream_dedup(spark, d):
    source = jobs.stream_parquet(spark, d, "orders.parquet").select(
        F.concat(F.lit("u"), "o_custkey").alias("email"), F.col("o_orderpriority").alias("role"),
        F.col("o_orderdate").cast("timestamp").alias("at"))
    return jobs.run_available(jobs.stream_dedup(source, horizon="4000 days"), "applications").select("email", "role")
