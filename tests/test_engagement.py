from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sievework import lexicons as lx
from sievework.operators import engagement as en
from sievework.operators import learning
from sievework.sources import tables as tb

LONG = " ".join(f"w{i}" for i in range(25))
REPLIES = [
    ("", "minimal", .95), ("one two three", "minimal", .95), ("please see def main here", "code_submission", .85),
    ("what is your stack here?", "question", .75), (LONG + " really here also now yes?", "vague", .50),
    ("the api and the database train a model here", "technical", .80), ("hash of a tree is 40% of sql", "technical", .80),
    ("I am interested, thanks for the offer and " + LONG, "vague", .70), ("short answer with nothing", "vague", .70),
    ("our docker setup is fine now", "technical", .60), (LONG, "vague", .50), ("DEF MAIN is upper case here", "vague", .70),
]


@pytest.fixture(scope="module")
def replies(spark):
    return spark.createDataFrame([(f"t{i}", i, body, 1) for i, (body, _, _) in enumerate(REPLIES)],
                                 "thread_id STRING, seq BIGINT, body STRING, round INT")


def test_reply_classes(replies):
    got = {r.seq: (r.response_type, r.confidence) for r in en.classify_replies(replies).collect()}
    assert got == {i: (kind, c) for i, (_, kind, c) in enumerate(REPLIES)}


def test_next_action(replies):
    rows = {r.seq: r for r in en.next_action(replies).collect()}
    decisions = {d[0]: d for d in lx.DECISIONS}
    for i, (_, kind, _) in enumerate(REPLIES):
        assert (rows[i].action, rows[i].template, rows[i].advance_round) == decisions[kind][1:4]
    done = en.next_action(replies.withColumn("round", F.lit(3))).collect()
    assert {(r.action, r.template, r.advance_round) for r in done} == {("complete", None, False)}
    assert {r.action for r in en.next_action(replies.withColumn("round", F.lit(3)), max_rounds=4).collect()} != {"complete"}


def test_render_is_one_pass(spark):
    df = spark.createDataFrame([("a", "{role}"), ("b", "x"), ("none", "x")], "template STRING, name STRING")
    templates = {"a": "Hi {name}, {other} {name}", "b": "{name}{role}"}
    context = {"name": F.col("name"), "role": F.lit("Dev")}
    got = [r[0] for r in df.select(en.render("template", context, templates)).collect()]
    assert got == ["Hi {role}, {other} {role}", "xDev", ""]


def scored(spark):
    return spark.createDataFrame(
        [("a", "Ann Lee", "a@x", "Dev", "Fast-Track", 90.5), ("b", "", "b@x", "Dev", "Standard", 70.0),
         ("c", "Cy", "c@x", "Dev", "Review", 50.0), ("d", "Di", "d@x", "Dev", "Reject", 10.25)],
        "candidate_id STRING, name STRING, email STRING, role STRING, tier STRING, total_score DOUBLE")


def test_route_and_first_messages(spark):
    routed = en.route(scored(spark))
    assert {r.candidate_id: (r.action, r.reason) for r in routed.collect()} == {
        "a": ("email_sent", None), "b": ("email_sent", None),
        "c": ("held_for_review", "Manual review required before engagement"), "d": ("skipped", "Tier: Reject (score: 10.25)")}
    now = F.lit("2024-01-01").cast("timestamp")
    threads = en.open_threads(routed, "run", now)
    assert [r.thread_id for r in threads.orderBy("candidate_id").collect()] == [
        r.thread_id for r in en.open_threads(routed, "run", now).orderBy("candidate_id").collect()]
    sent = {r.candidate_id: r for r in en.first_messages(threads).collect()}
    assert sent["a"].body == lx.TEMPLATES["initial_outreach"].format(name="Ann", role="Dev", question=lx.QUESTIONS[1])
    assert sent["b"].body.startswith("Hi there,") and sent["a"].to == "a@x"
    assert sent["a"].body_preview == sent["a"].body[:200] + "..."
    assert sent["a"].subject == "Your application for Dev — Technical Discussion"


def test_replies_move_threads(spark):
    threads = spark.createDataFrame([("t1", "a", "Ann Lee", "a@x", "Dev", 1), ("t2", "b", "Bo", "b@x", "Dev", 3), ("t3", "c", "Cy", "c@x", "Dev", 2)],
                                    "thread_id STRING, candidate_id STRING, name STRING, email STRING, role STRING, round INT")
    at = datetime(2024, 1, 2)
    replies = spark.createDataFrame([("t1", 1, at, "our docker setup is fine now"), ("t2", 2, at, "our docker setup is fine now"),
                                     ("t3", 3, at, "ok"), ("t9", 4, at, "who knows this thread")],
                                    "thread_id STRING, seq BIGINT, received_at TIMESTAMP, body STRING")
    p = en.process_replies(replies, threads)
    got = {r.thread_id: (r.action, r.next_round, r.question) for r in p.collect()}
    assert got == {"t1": ("ask_deeper", 2, lx.QUESTIONS[2]), "t2": ("complete", 3, None), "t3": ("request_elaboration", 2, None)}
    events = en.reply_events(p)
    assert sorted((r.thread_id, r.seq, r.to_state) for r in events.collect()) == [
        ("t1", 2, "replied"), ("t1", 3, "follow_up_sent"), ("t2", 4, "replied"), ("t3", 6, "replied")]
    mail = en.follow_ups(p, {"previous_topic": F.lit("docker")}).collect()
    assert len(mail) == 1 and mail[0].body.startswith("Hi Ann,\n\nGreat answer on docker. {specific_feedback}")
    state = {r.thread_id: (r.state, r.round) for r in en.thread_state(events).collect()}
    assert state["t1"] == ("follow_up_sent", 2)
    history = {(r.thread_id, r.seq): r.from_state for r in en.thread_history(events).collect()}
    assert history["t1", 2] == "initiated" and history["t1", 3] == "replied"


def test_stalls_are_strict_and_counts_have_zeros(spark):
    rows = [("t1", "awaiting_reply", datetime(2024, 1, 1, 0, 0, 0)), ("t2", "awaiting_reply", datetime(2024, 1, 1, 0, 0, 0, 1)),
            ("t3", "follow_up_sent", datetime(2023, 12, 1)), ("t4", "replied", datetime(2023, 12, 1)), ("t5", "completed", datetime(2023, 1, 1))]
    threads = spark.createDataFrame(rows, "thread_id STRING, state STRING, last_activity TIMESTAMP")
    now = F.lit("2024-01-03 00:00:00.000001").cast("timestamp")
    assert {r.thread_id for r in en.stalled_threads(threads, now).collect()} == {"t1", "t3"}
    counts = {r.state: r.n_threads for r in en.thread_counts(threads).collect()}
    assert counts == {s: {"awaiting_reply": 2, "follow_up_sent": 1, "replied": 1, "completed": 1}.get(s, 0) for s in lx.THREAD_STATES}
    totals = en.thread_totals(threads, threads.limit(2)).first()
    assert (totals.total_threads, totals.active, totals.emails_sent) == (5, 4, 2)
    assert en.active_threads(threads).count() == 4


def test_classify_batch(spark):
    df = spark.createDataFrame([("our docker setup is fine now", 1)], "text STRING, round INT")
    row = en.classify_batch(df, "text", "round").first()
    assert (row.response_type, row.action, row.verdict) == ("technical", "ask_deeper", "likely_human")


# ------------------------------------------------------------------ learning


def tiers(spark, **counts):
    names = {"fast": "Fast-Track", "standard": "Standard", "review": "Review", "reject": "Reject"}
    rows = [(names[k], float(i), []) for k, n in counts.items() for i in range(n)]
    return spark.createDataFrame(rows, "tier STRING, total_score DOUBLE, flags ARRAY<STRING>")


def test_upper_median(spark):
    scores = [91.12, 88.35, 83.4, 64.21, 40.79, 3.64]
    df = spark.createDataFrame([(s,) for s in scores], "total_score DOUBLE")
    row = learning.score_stats(df).first()
    assert (row.total_candidates, row.mean, row.min, row.max, row.median) == (6, 61.92, 3.64, 91.12, 83.4)
    assert learning.score_stats(df.limit(0)).first().total_candidates == 0


@pytest.mark.parametrize("rejects,others,warning", [(61, 39, "too strict"), (60, 40, None), (10, 90, None), (9, 91, "too lenient")])
def test_reject_warning(spark, rejects, others, warning):
    row = learning.reject_warning(tiers(spark, reject=rejects, standard=others)).first()
    assert (row.warning is None) if warning is None else row.warning.endswith(warning)


def test_recommend_and_apply(spark):
    stored = tb.weight_rows(spark, lx.WEIGHTS, 1, "initial", F.lit("2024-01-01").cast("timestamp"))
    fast = learning.recommend_weights(tiers(spark, fast=2, standard=1, review=1, reject=2))
    assert [(r.dimension, r.delta, r.reason) for r in fast.collect()] == [
        ("technical_relevance", .03, "Many fast-track (33%) — suggest increasing technical_relevance weight to raise bar")]
    assert {r.dimension: r.weight for r in learning.apply_weights(stored, fast).collect()} == {
        "technical_relevance": .3204, "answer_quality": .2427, "profile_credibility": .1942, "specificity": .1456, "timing": .0971}
    strict = learning.recommend_weights(tiers(spark, reject=3, fast=2)).collect()
    assert {r.dimension for r in strict} == {"specificity", "technical_relevance"}
    assert learning.recommend_weights(tiers(spark, reject=1, review=1)).count() == 0
    same = learning.apply_weights(stored, learning.recommend_weights(tiers(spark, review=1)))
    assert {r.dimension: r.weight for r in same.collect()} == lx.WEIGHTS


def test_bounded_deltas_and_snapshots(spark):
    at = F.lit("2024-01-01").cast("timestamp")
    stored = tb.weight_rows(spark, lx.WEIGHTS, 1, "initial", at)
    adjust = spark.createDataFrame([("timing", -1.0), ("unknown", 1.0)], "dimension STRING, delta DOUBLE")
    new = learning.apply_weights(stored, adjust)
    got = {r.dimension: r.weight for r in new.collect()}
    assert got["timing"] == round(0.05 / 0.95, 4) and len(got) == 5
    both = stored.unionByName(learning.snapshot_weights(new, stored, "test", at))
    assert tb.weights_as_map(both) == got and tb.current_weights(both).first().version == 2


def test_repeated_weights_are_an_error(spark):
    stored = tb.weight_rows(spark, lx.WEIGHTS, 1, "initial", F.lit("2024-01-01").cast("timestamp"))
    assert tb.weights_as_map(stored) == lx.WEIGHTS
    with pytest.raises(ValueError, match="several weights of .*timing"):
        tb.weights_as_map(stored.unionByName(stored))


def test_tier_profile(people):
    df = people({"answers": ["the api and a database", ""]}, {"answers": ["no", "docker docker"]}, {"answers": ["x y z"]})
    df = df.withColumn("tier", F.when(F.col("row_id") < 2, "Reject").otherwise("Fast-Track"))
    rows = {r.tier: r for r in learning.tier_text_profile(df).collect()}
    assert (rows["Reject"].n_answers, rows["Reject"].avg_words, rows["Reject"].avg_terms) == (4, 2.0, 1.0)
    assert {r.insight for r in learning.tier_insights(learning.tier_text_profile(df)).collect()} == {
        "Rejected candidates average 2 words/answer with 1.0 technical terms",
        "Fast-Track candidates average 3 words/answer with 0.0 technical terms"}


def test_headline(spark):
    row = learning.headline_counts(tiers(spark, fast=2, reject=3).withColumn("flags", F.array(F.lit("X"), F.lit("Y")))).first()
    assert (row.total, row.fast_track, row.rejected, row.flags) == (5, 2, 3, 10)
