"""Queries on machine-text signals, similarity, strikes and the composed plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as S
from checks.queries_scores import default_weights, scored
from checks.registry import query
from sievework import fixtures as fx
from sievework import lexicons as lx
from sievework.functions import rules
from sievework.functions import text as tx
from sievework.operators import forensics, keyed, similarity
from sievework.plans.pipeline import full_pipeline as run_pipeline
from sievework.session import stage
from sievework.sources import applicants as ap

NOW = "2024-02-15 00:00:00"


def signals(spark, d):
    return forensics.ai_signals(fx.candidates(spark, d), **fx.AI_RULES)


def document_pairs(spark, d, threshold=lx.SIMILARITY_WARN):
    return similarity.similar_pairs(fx.document_answers(spark, d), threshold, fx.STOP_WORDS)


GAP_SEVERITY = "CASE WHEN isnan(seconds) OR seconds <= 0 THEN 0.0 WHEN seconds < 10 THEN 0.9 WHEN seconds < 30 AND 200 / seconds > 5 THEN 0.6 ELSE 0.0 END"
DOC_PAIRS = S.tfidf(S.DOCUMENT_ANSWERS, fx.STOP_WORDS) + S.pairs(lx.SIMILARITY_WARN)
SIDES = """sd AS (SELECT row_a AS row_id, candidate_a AS candidate_id, candidate_b AS other_id, candidate_b_name AS other_name, question_id, similarity FROM p
  UNION ALL SELECT row_b, candidate_b, candidate_a, candidate_a_name, question_id, similarity FROM p)"""
DOCS = "doc AS (SELECT 'c' || doc_id AS candidate_id, doc_id, text FROM documents)"


@query("uniformity", f"SELECT doc_id, {S.uniformity('text')} AS uniformity, {S.uniformity_detail('text')} AS detail FROM documents")
def uniformity(spark, d):
    judged = keyed.computed_once(fx.texts(spark, d, "documents").select("doc_id", "text"), {"s": rules.uniformity_signal("text")})
    return judged.select("doc_id", F.col("s.score").alias("uniformity"), "s.detail")


@query("vocab_signals", f"SELECT doc_id, round_even({S.vocab('text')}, 4) AS vocab, {S.vocab_detail('text')} AS detail FROM documents")
def vocab_signals(spark, d):
    judged = keyed.computed_once(fx.texts(spark, d, "documents").select("doc_id", "text"), {
        "s": rules.vocab_signal("text", fx.TRANSITIONS, fx.FORMAL)})
    return judged.select("doc_id", tx.round_half_even("s.score", 4).alias("vocab"), "s.detail")


@query("ai_verdict", S.with_(S.BASE + [S.signals("c", "raw_text")], f"""SELECT candidate_id, ai_probability, verdict,
  {S.uniformity_detail('raw_text')} AS uniformity_detail, {S.vocab_detail('raw_text')} AS vocab_detail FROM g"""))
def ai_verdict(spark, d):
    return signals(spark, d).select("candidate_id", "ai_probability", "verdict", "uniformity_detail", "vocab_detail")


TIMING_TEXT = f"""CASE flag_kind WHEN 'paste' THEN 'Response in ' || {S.number_text('seconds')} || 's — likely copy-paste'
  WHEN 'typed' THEN 'Typed ' || format('{{:.1f}}', {S.TOTAL_WORDS} / seconds) || ' words/sec — faster than average typing' END"""


@query("timing_flags", S.with_(S.BASE + [S.FLAGGED], f"SELECT candidate_id, severity, {TIMING_TEXT} AS flag FROM f"))
def timing_flags(spark, d):
    return forensics.timing_flags(fx.candidates(spark, d)).select("candidate_id", "severity", "flag")


@query("timing_flags_events", S.with_([S.GAPS], f"SELECT event_id, CAST({GAP_SEVERITY} AS DOUBLE) AS severity FROM gp"))
def timing_flags_events(spark, d):
    # Gaps between a user's events as response times, with 200 words each.
    return fx.event_gaps(spark, d).select(
        "event_id", rules.timing_flag("seconds", F.lit(200))["severity"].alias("severity"))


@query("name_lookup", S.with_(S.BASE + [S.FLAGGED], "SELECT candidate_id, name AS shown_name, severity FROM f WHERE flag_kind IS NOT NULL"))
def name_lookup(spark, d):
    c = fx.candidates(spark, d)
    flags = forensics.timing_flags(c).filter(F.col("flag").isNotNull())
    return forensics.with_names(flags, c).select("candidate_id", "shown_name", "severity")


@query("tfidf_vectors", S.with_(S.tfidf(S.DOCUMENT_ANSWERS, fx.STOP_WORDS), "SELECT question_id, row_id, term, round_even(weight, 6) AS weight FROM v"))
def tfidf_vectors(spark, d):
    vectors = similarity.tfidf_vectors(fx.document_answers(spark, d), fx.STOP_WORDS)
    return vectors.withColumn("weight", tx.round_half_even("weight", 6))


@query("similar_pairs", S.with_(DOC_PAIRS, """SELECT question_id, candidate_a, candidate_a_name, candidate_b, candidate_b_name,
  similarity, severity, substring(text_a, 1, 100) AS text_a_preview, substring(text_b, 1, 100) AS text_b_preview FROM p"""))
def similar_pairs(spark, d):
    return document_pairs(spark, d).drop("row_a", "row_b")


@query("pair_join", S.with_(S.tfidf(S.DOCUMENT_ANSWERS, fx.STOP_WORDS) + S.pairs(0.5), "SELECT question_id, candidate_a, candidate_b, similarity FROM p"))
def pair_join(spark, d):
    return document_pairs(spark, d, 0.5).select("question_id", "candidate_a", "candidate_b", "similarity")


@query("pair_totals", S.with_(DOC_PAIRS + [SIDES], """SELECT candidate_id, count(*) AS n_pairs,
  CAST(sum(CASE WHEN similarity > 0.8 THEN 2 ELSE 1 END) AS BIGINT) AS n_strikes FROM sd GROUP BY ALL"""))
def pair_totals(spark, d):
    return similarity.pair_totals(similarity.similar_groups(fx.document_answers(spark, d), stop_words=fx.STOP_WORDS))


@query("pairs_by_candidate", S.with_(DOC_PAIRS + [SIDES], "SELECT candidate_id, other_id, other_name, question_id, similarity FROM sd"))
def pairs_by_candidate(spark, d):
    return forensics.pair_sides(document_pairs(spark, d)).drop("severity", "row_id")


@query("embedding_cosine", """SELECT label, id_a, id_b, round_even(cosine, 5) AS cosine FROM (
  SELECT a.label, a.vec_id AS id_a, b.vec_id AS id_b, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS cosine
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id) WHERE cosine >= 0.3""")
def embedding_cosine(spark, d):
    pairs = similarity.embedding_cosine(fx.table(spark, d, "embeddings"), "label", "vec_id", "embedding", 0.3)
    return pairs.withColumn("cosine", tx.round_half_even("cosine", 5))


STRIKES = """st AS (SELECT row_id, candidate_id, 'ai' AS source, ai_probability AS severity, CASE WHEN ai_probability > 0.8 THEN 2 ELSE 1 END AS n_strikes FROM g WHERE verdict = 'likely_ai'
  UNION ALL SELECT row_id, candidate_id, 'similarity', similarity, CASE WHEN similarity > 0.8 THEN 2 ELSE 1 END FROM sd
  UNION ALL SELECT row_id, candidate_id, 'timing', severity, CASE WHEN severity > 0.8 THEN 2 ELSE 1 END FROM f WHERE severity > 0.5)"""
SCREENED = S.BASE + [S.signals("c", "raw_text"), S.FLAGGED] + DOC_PAIRS + [SIDES, STRIKES]
TOTALS = """tot AS (SELECT c.row_id, c.candidate_id, c.name, CAST(coalesce(sum(n_strikes), 0) AS BIGINT) AS strikes, coalesce(sum(n_strikes), 0) >= 3 AS eliminated
  FROM c LEFT JOIN st USING (row_id) GROUP BY ALL)"""


def strike_rows(spark, d):
    return forensics.strike_events(
        signals(spark, d), document_pairs(spark, d), forensics.timing_flags(fx.candidates(spark, d)))


@query("strike_events", S.with_(SCREENED, "SELECT candidate_id, source, severity, n_strikes FROM st"))
def strike_events(spark, d):
    return strike_rows(spark, d).drop("reason", "row_id")


@query("strike_reasons", S.with_(SCREENED, """SELECT candidate_id, 'AI-generated text detected (p=' || format('{:.2f}', ai_probability) || ')' AS reason FROM g WHERE verdict = 'likely_ai'
  UNION ALL SELECT candidate_id, 'Similar answer to ' || other_name || ' on Q' || question_id || ' (sim=' || format('{:.2f}', similarity) || ')' FROM sd
  UNION ALL SELECT candidate_id, 'Timing anomaly: ' || """ + TIMING_TEXT + " FROM f WHERE severity > 0.5"))
def strike_reasons(spark, d):
    return strike_rows(spark, d).select("candidate_id", "reason")


@query("strike_totals", S.with_(SCREENED + [TOTALS], "SELECT candidate_id, strikes, eliminated FROM tot"))
def strike_totals(spark, d):
    return report(spark, d).select("candidate_id", "strikes", "eliminated")


def report(spark, d):
    """Per-applicant report; the document pairs stand in for the answer pairs."""
    c = fx.candidates(spark, d)
    ai = stage(signals(spark, d), "ai-signals")
    timing = stage(forensics.timing_flags(c), "timing-flags")
    groups = similarity.similar_groups(fx.document_answers(spark, d), stop_words=fx.STOP_WORDS)
    pairs = stage(similarity.pair_totals(groups, key="row_id"), "pair-totals")
    parts = [forensics.ai_strikes(ai), forensics.timing_strikes(timing), pairs]
    strikes = parts[0].select("row_id", "n_strikes")
    for part in parts[1:]:
        strikes = strikes.unionByName(part.select("row_id", "n_strikes"))
    return forensics.cheat_report(c, ai, pairs, timing, forensics.strike_totals(c, strikes))


REPORT = """rpt AS (SELECT tot.candidate_id, tot.name, g.ai_probability, g.verdict, coalesce(np.n_pairs, 0) AS n_pairs,
  f.severity AS timing_severity, strikes, eliminated FROM tot JOIN g USING (row_id) JOIN f USING (row_id)
  LEFT JOIN (SELECT row_id, count(*) AS n_pairs FROM sd GROUP BY ALL) np USING (row_id))"""


@query("cheat_report", S.with_(SCREENED + [TOTALS, REPORT], "SELECT * FROM rpt"))
def cheat_report(spark, d):
    return report(spark, d).drop("timing_flag", "row_id")


@query("cheat_summary", S.with_(SCREENED + [TOTALS], """SELECT count(*) AS total_candidates, count(*) FILTER (WHERE strikes > 0) AS flagged,
  count(*) FILTER (WHERE eliminated) AS eliminated, count(*) FILTER (WHERE strikes = 0) AS clean FROM tot"""))
def cheat_summary(spark, d):
    return forensics.cheat_summary(report(spark, d))


@query("cheat_join", S.with_(SCREENED + [S.DIMENSIONS, S.SCORED, TOTALS], "SELECT s.candidate_id, total_score, strikes, eliminated FROM s JOIN tot USING (row_id)"))
def cheat_join(spark, d):
    totals = report(spark, d).select("row_id", "strikes", "eliminated")
    return scored(spark, d).select("row_id", "candidate_id", "total_score").join(totals, "row_id", "left").drop("row_id")


@query("anomaly_counts", S.with_(SCREENED, """SELECT (SELECT count(*) FROM p) AS similar_pairs,
  (SELECT count(*) FROM f WHERE flag_kind IS NOT NULL) AS timing_anomalies"""))
def anomaly_counts(spark, d):
    groups = similarity.similar_groups(fx.document_answers(spark, d), stop_words=fx.STOP_WORDS)
    return forensics.anomaly_counts(similarity.pair_totals(groups), forensics.timing_flags(fx.candidates(spark, d)))


@query("candidate_detail", S.with_(SCREENED + [S.DIMENSIONS, S.SCORED], """SELECT candidate_id, s.name, s.email, s.role, s.total_score, s.tier, s.flags,
  g.ai_probability, g.verdict, f.severity AS timing_severity, sd.other_id, sd.question_id, sd.similarity
  FROM s JOIN g USING (candidate_id) JOIN f USING (candidate_id) LEFT JOIN sd USING (candidate_id) WHERE candidate_id = 'c3'"""))
def candidate_detail(spark, d):
    c = fx.candidates(spark, d)
    detail = forensics.candidate_detail(
        "c3", c, scored(spark, d), signals(spark, d), forensics.timing_flags(c),
        forensics.pair_sides(document_pairs(spark, d)))
    return detail.drop("timing_flag").withColumn("flags", F.array_join("flags", ","))


# ------------------------------------------------------------ composed plan

ANSWER_PAIRS = S.tfidf(S.FLAT_ANSWERS, fx.STOP_WORDS) + S.pairs(lx.SIMILARITY_WARN)
PIPELINE = S.KEPT + [S.DIMENSIONS, S.SCORED, S.signals("c", "raw_text"), S.FLAGGED] + ANSWER_PAIRS + [SIDES, STRIKES, TOTALS]
RETIERED = "rt AS (SELECT s.*, tot.strikes, tot.eliminated, CASE WHEN tot.eliminated THEN 'Reject' ELSE s.tier END AS new_tier FROM s JOIN tot USING (row_id))"

def pipeline(spark, d):
    kept = ap.normalise(ap.dedup_first(ap.valid_rows(fx.applicants(spark, d))))
    return run_pipeline(
        kept, default_weights(spark), "run-1", F.lit(NOW).cast("timestamp"), stop_words=fx.STOP_WORDS,
        score_options=fx.SCORE_RULES, ai_options=fx.AI_RULES, tech_regex=fx.TECH_TERM_PATTERN)


@query("full_pipeline", S.with_(PIPELINE + [RETIERED],
    """SELECT candidate_id, row_number() OVER (ORDER BY total_score DESC, row_id) AS rank, total_score, new_tier AS tier, strikes, eliminated, CASE new_tier WHEN 'Reject' THEN 'skipped'
  WHEN 'Review' THEN 'held_for_review' ELSE 'email_sent' END AS action FROM rt"""))
def full_pipeline(spark, d):
    result = pipeline(spark, d)
    report = result.report.select("candidate_id", "strikes", "eliminated")
    ranks = result.ranks.select("candidate_id", "rank")
    return result.routed.join(report, "candidate_id").join(ranks, "candidate_id").select(
        "candidate_id", "rank", "total_score", "tier", "strikes", "eliminated", "action")
