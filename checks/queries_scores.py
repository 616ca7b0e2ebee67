"""Queries on scoring, ranking, feedback and dashboard counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as S
from checks.registry import query
from sievework import fixtures as fx
from sievework import lexicons as lx
from sievework.functions import rules
from sievework.functions import text as tx
from sievework.operators import forensics, learning, scoring
from sievework.session import stage
from sievework.sources import tables as tb


def scored(spark, d, explain=False, weights=lx.WEIGHTS):
    return scoring.score_candidates(fx.candidates(spark, d), weights, explain=explain, **fx.SCORE_RULES)


def scores_table(spark, d):
    """Scores written once, as every run leaves them for later steps."""
    return stage(scored(spark, d).drop("answers"), "scores")


def dimensions(spark, d):
    return scoring.score_dimensions(fx.candidates(spark, d), **fx.SCORE_RULES)


@query("join_text", S.with_(S.BASE, "SELECT candidate_id, md5(all_text) AS lowered, md5(raw_text) AS plain FROM c"))
def join_text(spark, d):
    return fx.candidates(spark, d).select(
        "candidate_id", F.md5(rules.joined_answers("answers")).alias("lowered"),
        F.md5(rules.joined_answers("answers", lower=False, keep_empty=False)).alias("plain"))


@query("role_lexicon_join", S.with_(S.BASE, f"""SELECT candidate_id, len({S.found('all_text', S.role_terms())}) AS n_terms FROM c"""))
def role_lexicon_join(spark, d):
    lexicon = spark.createDataFrame(list(fx.ROLE_TERMS.items()), "role_key STRING, terms ARRAY<STRING>")
    joined = scoring.with_role_terms(fx.candidates(spark, d), lexicon)
    return joined.select("candidate_id", F.size(
        rules.terms_in(rules.joined_answers("answers"), F.col("terms"))).alias("n_terms"))


for _dim in lx.DIMENSIONS:
    _name = "timing_score" if _dim == "timing" else _dim

    def _run(spark, d, dim=_dim, name=_name):
        return dimensions(spark, d).select("candidate_id", tx.round_half_even(dim, 4).alias(name))

    query(_name, S.with_(S.BASE + [S.DIMENSIONS], f"SELECT candidate_id, round_even({_dim}, 4) AS {_name} FROM d"))(_run)


@query("timing_score_events", S.with_([S.GAPS], f"SELECT event_id, {S.timing('seconds')} AS score FROM gp"))
def timing_score_events(spark, d):
    return fx.event_gaps(spark, d).select("event_id", rules.timing_score("seconds").alias("score"))


@query("weighted_total", S.with_(S.BASE + [S.DIMENSIONS], f"SELECT candidate_id, round_even({S.WEIGHTED}, 4) AS weighted_total FROM d"))
def weighted_total(spark, d):
    return dimensions(spark, d).select("candidate_id", tx.round_half_even(rules.weighted_total(), 4).alias("weighted_total"))


@query("penalties", S.with_(S.SCORES, "SELECT candidate_id, flags, round_even(raw_total, 4) AS raw_total FROM s"))
def penalties(spark, d):
    return scoring.total_and_tier(dimensions(spark, d)).select(
        "candidate_id", F.array_join("flags", ",").alias("flags"), tx.round_half_even("raw_total", 4).alias("raw_total"))


@query("tier", S.with_(S.SCORES, "SELECT candidate_id, tier FROM s"))
def tier(spark, d):
    return scored(spark, d).select("candidate_id", "tier")


@query("round_scores", S.with_(S.SCORES, "SELECT candidate_id, total_score, "
       + ", ".join(f"round_even({x}, 2) AS {x}" for x in lx.DIMENSIONS) + " FROM s"))
def round_scores(spark, d):
    return scored(spark, d).select("candidate_id", "total_score", *lx.DIMENSIONS)


def _oracle_explanation() -> str:
    found = "array_to_string(list_sort(" + S.found("all_text", S.role_terms()) + ")[1:10], ', ')"
    parts = [
        f"CASE WHEN {S.strip('all_text')} = '' THEN 'No answer text provided' ELSE 'Found ' || n_found || ' technical terms: ' || {found} END",
        f"CASE WHEN {S.strip('all_text')} <> '' AND {S.any_('all_text', lx.VERSION_PATTERN)} THEN 'Mentions specific versions/numbers: shows precision' END"]
    for i in (1, 2, 3):
        n = S.wc(f"a{i}")
        head = f"'Q ''q{i}'': "
        parts.append(f"CASE WHEN {n} = 0 THEN {head}Empty answer' WHEN {n} <= 5 THEN {head}Extremely short (' || {n} || ' words)' "
                     f"WHEN {n} <= 20 THEN {head}Brief response (' || {n} || ' words)' "
                     f"WHEN {n} > 150 THEN {head}Detailed response (' || {n} || ' words)' END")
        parts.append(f"CASE WHEN {n} > 0 AND {S.share(f'a{i}')} < 0.4 THEN {head}Repetitive vocabulary (ratio: ' || format('{{:.2f}}', {S.share(f'a{i}')}) || ')' END")
    missing = "coalesce(github_url, '') = ''"
    parts += [
        f"CASE WHEN {missing} THEN 'No GitHub profile provided' WHEN {S.FAKE} THEN 'GitHub URL looks suspicious: ' || github_url ELSE 'GitHub profile provided: ' || github_url END",
        f"CASE WHEN NOT ({missing}) AND NOT ({S.FAKE}) AND {S.phrases('all_text', lx.WORK_REFERENCES)} > 0 THEN 'References GitHub work in answers' END",
        "CASE WHEN coalesce(linkedin_url, '') = '' THEN 'No LinkedIn profile' ELSE 'LinkedIn profile provided' END"]
    listed = f"list_filter([{S.items(fx.PHRASES)}], lambda t: contains(all_text, t))"
    parts.append(f"CASE WHEN len({listed}) > 0 THEN 'Found ' || len({listed}) || ' generic phrases: ' || array_to_string({listed}[1:5], ', ') END")
    for regex, what in fx.PATTERNS:
        hits = S.hits("all_text", regex)
        parts.append(f"CASE WHEN {hits} > 0 THEN 'Contains {what} (' || {hits} || ' instances)' END")
    shown = S.number_text("seconds") + " || 's'"
    parts.append(
        f"CASE WHEN isnan(seconds) THEN 'Slow response: ' || {shown} || ' — may indicate disengagement' "
        f"WHEN seconds <= 0 THEN 'No timing data available' WHEN seconds < 10 THEN 'Suspiciously fast response: ' || {shown} || ' — possible copy-paste' "
        f"WHEN seconds < 30 THEN 'Very fast response: ' || {shown} WHEN seconds < 60 THEN 'Quick response: ' || {shown} "
        f"WHEN seconds < 300 THEN 'Thoughtful response time: ' || {shown} WHEN seconds < 600 THEN 'Deliberate response time: ' || {shown} "
        f"ELSE 'Slow response: ' || {shown} || ' — may indicate disengagement' END")
    parts += ["CASE WHEN email = '' THEN 'Major penalty: no email provided' END",
              "CASE WHEN minimal THEN 'All answers are minimal (≤5 words each)' END"]
    return "list_filter([" + ",\n".join(parts) + "], lambda x: x IS NOT NULL)"


EXPLAINED = f"""e AS (SELECT * REPLACE (list_concat(['Rank: #' || row_number() OVER (ORDER BY total_score DESC, row_id)
  || ' of ' || count(*) OVER ()], explanation) AS explanation) FROM (SELECT *, {_oracle_explanation()} AS explanation FROM s))"""


def ranked(spark, d):
    """Scores with their reasons, the rank first."""
    return scoring.rank_scores(stage(scored(spark, d, explain=True).drop("answers"), "explained"), prefix_explanation=True)


@query("explanations", S.with_(S.SCORES + [EXPLAINED], "SELECT candidate_id, array_to_string(explanation, ' / ') AS explanation FROM e"))
def explanations(spark, d):
    return ranked(spark, d).select("candidate_id", F.array_join("explanation", " / ").alias("explanation"))


@query("project_results", S.with_(S.SCORES + [EXPLAINED], "SELECT candidate_id, name, email, total_score, tier, "
       + ", ".join(f"round_even({x}, 2) AS {x}" for x in lx.DIMENSIONS)
       + ", flags, array_to_string(explanation[1:5], ' / ') AS top_explanations FROM e"))
def project_results(spark, d):
    return scoring.project_results(ranked(spark, d)).withColumns({
        "flags": F.array_join("flags", ","), "top_explanations": F.array_join("top_explanations", " / ")})


@query("tier_filter", S.with_(S.SCORES, "SELECT candidate_id, total_score FROM s WHERE tier = 'Standard'"))
def tier_filter(spark, d):
    return scoring.tier_filter(scores_table(spark, d), "Standard").select("candidate_id", "total_score")


@query("rank_scores", S.with_(S.SCORES, """SELECT candidate_id, total_score,
  row_number() OVER (ORDER BY total_score DESC, row_id) AS rank, count(*) OVER () AS n_ranked FROM s"""))
def rank_scores(spark, d):
    narrow = stage(scored(spark, d).select("candidate_id", "row_id", "total_score"), "scores")
    return scoring.rank_scores(narrow).select("candidate_id", "total_score", "rank", "n_ranked")


@query("top_k", S.with_(S.SCORES, "SELECT candidate_id, total_score FROM s ORDER BY total_score DESC, row_id LIMIT 5"))
def top_k(spark, d):
    return scoring.top_k(scored(spark, d)).select("candidate_id", "total_score")


@query("tier_distribution", S.with_(S.SCORES, "SELECT tier, count(*) AS n FROM s GROUP BY tier"))
def tier_distribution(spark, d):
    return learning.tier_distribution(scored(spark, d))


@query("score_stats", S.with_(S.SCORES, """SELECT count(*) AS total_candidates, round_even(avg(total_score), 2) AS mean,
  min(total_score) AS min, max(total_score) AS max, quantile_disc(total_score, 0.5 ORDER BY total_score DESC) AS median FROM s"""))
def score_stats(spark, d):
    return learning.score_stats(stage(scored(spark, d).select("total_score"), "scores"))


@query("reject_warning", S.with_(S.SCORES, """SELECT r AS reject_share, CASE WHEN r > 0.6 THEN 'Over 60% of candidates are being rejected — scoring may be too strict'
  WHEN r < 0.1 THEN 'Less than 10% rejection rate — scoring may be too lenient' END AS warning
  FROM (SELECT avg(CAST(tier = 'Reject' AS DOUBLE)) AS r FROM s)"""))
def reject_warning(spark, d):
    return learning.reject_warning(scored(spark, d))


_HITS = S.total([S.hits(f"lower(a{i})", fx.TECH_TERM_PATTERN) for i in (1, 2, 3)])
PROFILE = f"""pr AS (SELECT tier, 3 * count(*) AS n_answers, sum({S.TOTAL_WORDS}) / (3 * count(*)) AS avg_words,
  sum({_HITS}) / (3 * count(*)) AS avg_terms FROM s GROUP BY tier)"""


@query("tier_text_profile", S.with_(S.SCORES + [PROFILE], """SELECT tier, CAST(n_answers AS BIGINT) AS n_answers,
  round_even(avg_words, 6) AS avg_words, round_even(avg_terms, 6) AS avg_terms FROM pr"""))
def tier_text_profile(spark, d):
    profile = learning.tier_text_profile(scored(spark, d), fx.TECH_TERM_PATTERN)
    return profile.withColumns({c: tx.round_half_even(c, 6) for c in ("avg_words", "avg_terms")})


@query("tier_insights", S.with_(S.SCORES + [PROFILE], """SELECT tier, CASE tier WHEN 'Reject' THEN 'Rejected' ELSE tier END ||
  ' candidates average ' || CAST(round_even(avg_words, 0) AS INTEGER) || ' words/answer with ' || format('{:.1f}', avg_terms) || ' technical terms' AS insight
  FROM pr WHERE tier IN ('Fast-Track', 'Reject')"""))
def tier_insights(spark, d):
    return learning.tier_insights(learning.tier_text_profile(scored(spark, d), fx.TECH_TERM_PATTERN))


@query("headline_counts", S.with_(S.SCORES, """SELECT count(*) AS total, count(*) FILTER (WHERE tier = 'Fast-Track') AS fast_track,
  count(*) FILTER (WHERE tier = 'Reject') AS rejected, CAST(sum(n_flags) AS BIGINT) AS flags FROM s"""))
def headline_counts(spark, d):
    return learning.headline_counts(scored(spark, d))


# A mix of tiers that calls for both adjustments: a strict set of weights on the
# same rows for the rejects, and labels as a second batch for the fast tier.
_LABEL_TIERS = "lt AS (SELECT CASE WHEN quality = 1 THEN 'Fast-Track' WHEN toxic = 1 THEN 'Standard' ELSE 'Reject' END AS tier FROM labels)"
_ADJUST = """mx AS (SELECT avg(CAST(tier = 'Reject' AS DOUBLE)) AS r, avg(CAST(tier = 'Fast-Track' AS DOUBLE)) AS f FROM {0}),
  adj AS (SELECT 'specificity' AS dimension, -0.03::DOUBLE AS delta, 'High rejection rate (' || CAST(round_even(r * 100, 0) AS INTEGER) || '%) — suggest reducing specificity weight by 3%' AS reason FROM mx WHERE r > 0.5
  UNION ALL SELECT 'technical_relevance', 0.03::DOUBLE, 'Many fast-track (' || CAST(round_even(f * 100, 0) AS INTEGER) || '%) — suggest increasing technical_relevance weight to raise bar' FROM mx WHERE f > 0.3)"""
_WEIGHTS = ("wt AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in lx.WEIGHTS.items())
            + ") AS x(dimension, weight))")
_APPLIED = """ap AS (SELECT dimension, round_even(w / sum(w) OVER (), 4) AS weight FROM (SELECT wt.dimension,
  CASE WHEN delta IS NULL THEN weight ELSE least(0.5::DOUBLE, greatest(0.05::DOUBLE, weight + delta)) END AS w
  FROM wt LEFT JOIN adj USING (dimension)))"""


def label_tiers(spark, d):
    quality, toxic = F.col("quality") == 1, F.col("toxic") == 1
    return fx.table(spark, d, "labels").select(
        F.when(quality, F.lit("Fast-Track")).when(toxic, F.lit("Standard")).otherwise(F.lit("Reject")).alias("tier"))


def default_weights(spark):
    return tb.weight_rows(spark, lx.WEIGHTS, 1, "initial", F.lit("2024-01-01").cast("timestamp"))


@query("recommend_weights", S.with_([_LABEL_TIERS, _ADJUST.format("lt")], "SELECT dimension, delta, reason FROM adj"))
def recommend_weights(spark, d):
    return learning.recommend_weights(label_tiers(spark, d))


@query("apply_weights", S.with_([_LABEL_TIERS, _ADJUST.format("lt"), _WEIGHTS, _APPLIED], "SELECT dimension, weight FROM ap"))
def apply_weights(spark, d):
    return learning.apply_weights(default_weights(spark), learning.recommend_weights(label_tiers(spark, d)))


@query("learning_report", S.with_(S.SCORES + [PROFILE, _ADJUST.format("s"), _WEIGHTS, _APPLIED],
  """SELECT 'distribution' AS section, tier AS key, CAST(count(*) AS DOUBLE) AS value FROM s GROUP BY tier
  UNION ALL SELECT 'mean', 'all', round_even(avg(total_score), 2) FROM s
  UNION ALL SELECT 'median', 'all', quantile_disc(total_score, 0.5 ORDER BY total_score DESC) FROM s
  UNION ALL SELECT 'words', tier, round_even(avg_words, 4) FROM pr
  UNION ALL SELECT 'weight', dimension, weight FROM ap
  UNION ALL SELECT 'snapshot 2 batch_analysis_auto_adjustment', dimension, weight FROM ap WHERE (SELECT count(*) FROM adj) > 0"""))
def learning_report(spark, d):
    rows = stage(scored(spark, d), "scores")
    report = learning.learning_report(rows, default_weights(spark), fx.TECH_TERM_PATTERN)

    def part(df, section, key, value):
        return df.select((section if not isinstance(section, str) else F.lit(section)).alias("section"), key.alias("key"), value.cast("double").alias("value"))

    everyone = F.lit("all")
    return (
        part(report["distribution"], "distribution", F.col("tier"), F.col("n"))
        .unionByName(part(report["stats"], "mean", everyone, F.col("mean")))
        .unionByName(part(report["stats"], "median", everyone, F.col("median")))
        .unionByName(part(report["profile"], "words", F.col("tier"), tx.round_half_even("avg_words", 4)))
        .unionByName(part(report["new_weights"], "weight", F.col("dimension"), F.col("weight")))
        .unionByName(part(report["snapshot"].withColumn("section", F.concat_ws(
            " ", F.lit("snapshot"), "version", "reason")), F.col("section"), F.col("dimension"), F.col("weight"))))


@query("retier", S.with_(S.SCORES + [S.signals("c", "raw_text"), S.FLAGGED, """x AS (
  SELECT g.candidate_id, (CASE WHEN verdict = 'likely_ai' THEN CASE WHEN g.ai_probability > 0.8 THEN 2 ELSE 1 END ELSE 0 END)
  + (CASE WHEN severity > 0.8 THEN 2 WHEN severity > 0.5 THEN 1 ELSE 0 END) AS strikes, ai_probability
  FROM g JOIN f USING (candidate_id))"""],
  """SELECT candidate_id, total_score, CASE WHEN strikes >= 3 THEN 'Reject' ELSE tier END AS tier,
  array_to_string(list_filter([nullif(flags, ''), CASE WHEN strikes >= 3 THEN 'CHEAT_DETECTED' WHEN strikes > 0 THEN 'STRIKES_' || strikes END], lambda v: v IS NOT NULL), ',') AS flags,
  CASE WHEN strikes > 0 THEN ai_probability ELSE 0.0 END AS cheat_probability FROM s JOIN x USING (candidate_id)"""))
def retier(spark, d):
    c = fx.candidates(spark, d)
    # Strikes and probabilities both need the signals of every text: worked out once.
    ai = stage(forensics.ai_signals(c, **fx.AI_RULES), "ai-signals")
    timing = forensics.timing_flags(c)
    strikes = forensics.ai_strikes(ai).unionByName(forensics.timing_strikes(timing))
    cheat = forensics.strike_totals(c, strikes).join(ai.select("candidate_id", "ai_probability"), "candidate_id")
    return scoring.retier(scored(spark, d), cheat).select(
        "candidate_id", "total_score", "tier", F.array_join("flags", ",").alias("flags"), "cheat_probability")
