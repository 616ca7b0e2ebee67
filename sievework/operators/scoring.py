"""Scoring a candidates table.  Everything up to the rank is one narrow projection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework import lexicons as lx
from sievework.functions import rules
from sievework.functions import text as tx
from sievework.operators import selection
from sievework.operators.forensics import applicant_key
from sievework.operators.keyed import computed_once, lookup


#: Version-like tokens, answer shapes, generic phrases and evidence counts of a row.
MEASURES = ("__versions", "__shapes", "__phrases", "__evidence")


def with_role_terms(candidates: DataFrame, lexicon: DataFrame, default: str = lx.DEFAULT_ROLE,
                    ) -> DataFrame:
    """Attach ``terms`` from a (role_key, terms) table; unknown roles get the default's.

    The lexicon is shuffled or, when its files are small, broadcast by the planner;
    hot roles are answered from a bounded broadcast.  A repeated default role is an error.
    """
    keyed = candidates.withColumn("role_key", rules.role_key("role"))
    fallback = lexicon.filter(F.col("role_key") == default).select("terms").scalar()
    joined = lookup(keyed, lexicon, ["role_key"], how="left")
    return joined.withColumn("terms", F.coalesce(
        "terms", fallback, F.array().cast("array<string>")))


def score_dimensions(candidates: DataFrame, lexicon: Mapping[str, Sequence[str]] = lx.ROLE_TERMS,
                     default_role: str = lx.DEFAULT_ROLE, word_boundary: bool = False,
                     quality_rules=lx.QUALITY_RULES, phrases=lx.GENERIC_PHRASES,
                     patterns=lx.CONCRETE_PATTERNS, fake_tokens=lx.FAKE_HANDLE_TOKENS,
                     work_references=lx.WORK_REFERENCES, keep_measures: bool = False) -> DataFrame:
    """Adds the five dimensions, ``flags``, ``all_text`` and ``found_terms``.

    A ``terms`` column, as left by ``with_role_terms``, takes the place of ``lexicon``.
    Each text is measured once; ``keep_measures`` leaves the measures, as the columns
    ``MEASURES``, to ``with_explanations``.
    """
    terms = F.col("terms") if "terms" in candidates.columns else rules.role_terms(
        "role", lexicon, default_role)
    texts = candidates.withColumn("all_text", rules.joined_answers("answers"))
    found = texts.withColumn("found_terms", rules.terms_in("all_text", terms, word_boundary))
    measured = computed_once(found, dict(zip(MEASURES, [
        rules.version_hits("all_text"), rules.answer_shapes("answers"),
        tx.phrases_found("all_text", phrases), rules.evidence_hits("all_text", patterns)])))
    versions, shapes, phrased, evidence = map(F.col, MEASURES)
    scored = computed_once(measured, {
        "technical_relevance": rules.technical_relevance("all_text", F.size("found_terms"), versions),
        "answer_quality": rules.answer_quality("answers", quality_rules, shapes),
        "profile_credibility": rules.profile_credibility(
            "github_url", "linkedin_url", "all_text", fake_tokens, work_references),
        "specificity": rules.specificity("all_text", phrases, patterns, phrased, evidence),
        "timing": rules.timing_score("response_time_seconds"),
        "flags": rules.penalty_flags("email", "answers", shapes),
    })
    return scored if keep_measures else scored.drop(*MEASURES)


def total_and_tier(dimensions: DataFrame, weights: Mapping[str, float] = lx.WEIGHTS) -> DataFrame:
    """Adds ``raw_total`` (after penalties), ``tier`` and ``total_score``.

    The tier looks at the unrounded total; what is reported is rounded half-even.
    """
    return (
        dimensions.withColumn("raw_total", rules.penalised(rules.weighted_total(weights), "flags"))
        .withColumns({
            "tier": rules.tier("raw_total", "flags"),
            "total_score": tx.round_half_even("raw_total", 2),
        })
    )


def round_dimensions(scored: DataFrame) -> DataFrame:
    return scored.withColumns({d: tx.round_half_even(d, 2) for d in lx.DIMENSIONS})


def with_explanations(scored: DataFrame, phrases=lx.GENERIC_PHRASES,
                      patterns=lx.CONCRETE_PATTERNS) -> DataFrame:
    """Adds ``explanation``: the ordered reasons behind each dimension.

    Measures that ``score_dimensions`` kept are used, which must be of the same phrases and
    patterns; without them the texts are read again.
    """
    kept = set(MEASURES) <= set(scored.columns)
    versions, shapes, found, evidence = map(F.col, MEASURES) if kept else (None,) * 4
    return scored.withColumn("explanation", F.concat(
        rules.explain_terms("all_text", "found_terms", versions),
        rules.explain_answers("answers", shapes),
        rules.explain_profile("github_url", "linkedin_url", "all_text"),
        rules.explain_specificity("all_text", phrases, patterns, found, evidence),
        rules.explain_timing("response_time_seconds"),
        rules.explain_penalties("flags"),
    ))


def score_candidates(candidates: DataFrame, weights: Mapping[str, float] = lx.WEIGHTS,
                     explain: bool = True, **options) -> DataFrame:
    """All of scoring for each row, without a shuffle; ``cheat_probability`` starts at 0."""
    scored = total_and_tier(score_dimensions(candidates, keep_measures=True, **options), weights)
    if explain:
        scored = with_explanations(
            scored, options.get("phrases", lx.GENERIC_PHRASES),
            options.get("patterns", lx.CONCRETE_PATTERNS))
    return round_dimensions(scored).drop("all_text", "terms", "role_key", *MEASURES).withColumn(
        "cheat_probability", F.lit(0.0))


def rank_scores(scored: DataFrame, score: str = "total_score", row_id: str = "row_id",
                bits: int | None = None, prefix_explanation: bool = False) -> DataFrame:
    """Adds ``rank`` and ``n_ranked``: descending score, ties in ``row_id`` order.

    Scores may be any doubles.  Only score and id are sorted, in ranges (as many as the shuffle
    has partitions, at most ``2**bits``); the ranks then meet the wide rows by the unique,
    non-null ``row_id``.
    """
    ranges = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered, n = selection.ranks(scored, score, row_id, ranges if bits is None else min(ranges, 1 << bits))
    ranked = scored.join(numbered, row_id).withColumn("n_ranked", F.lit(n).cast("long"))
    columns = scored.columns + ["rank", "n_ranked"]
    return (_rank_line(ranked) if prefix_explanation else ranked).select(*columns)


def _rank_line(ranked: DataFrame) -> DataFrame:
    head = F.concat(F.lit("Rank: #"), F.col("rank").cast("string"), F.lit(" of "), F.col("n_ranked").cast("string"))
    return ranked.withColumn("explanation", F.concat(F.array(head), F.col("explanation")))


def with_rank_line(scored: DataFrame, ranks: DataFrame, row_id: str = "row_id") -> DataFrame:
    """``rank``, ``n_ranked`` and the rank as first explanation, from ranks found before."""
    return _rank_line(scored.join(ranks.select(row_id, "rank", "n_ranked"), row_id))


def top_k(scored: DataFrame, k: int = 5, score: str = "total_score") -> DataFrame:
    """The best ``k`` rows; each task keeps ``k`` and the driver merges those."""
    return scored.orderBy(F.desc(score), "row_id").limit(k)


def project_results(scored: DataFrame, reasons: int | None = 5) -> DataFrame:
    """Result columns with the first ``reasons`` explanations (``None``: all), after
    ``rank_scores(..., prefix_explanation=True)`` the rank first."""
    shown = F.col("explanation") if reasons is None else F.slice("explanation", 1, reasons)
    return scored.select(
        "candidate_id", "name", "email", "total_score", "tier", *lx.DIMENSIONS, "flags",
        shown.alias("top_explanations"))


def tier_filter(scored: DataFrame, tier: str = "all") -> DataFrame:
    return scored if tier == "all" else scored.filter(F.col("tier") == tier)


def retier(scored: DataFrame, cheat: DataFrame) -> DataFrame:
    """Cheat results onto scores: flags, tier and probability; total and rank stay."""
    key = applicant_key(scored, cheat)
    findings = cheat.select(
        key, F.col("strikes").alias("__strikes"),
        F.col("eliminated").alias("__out"), F.col("ai_probability").alias("__p"))
    struck = F.coalesce(F.col("__strikes"), F.lit(0)) > 0
    out = F.coalesce(F.col("__out"), F.lit(False))
    flag = F.when(out, F.lit("CHEAT_DETECTED")).otherwise(
        F.concat(F.lit("STRIKES_"), F.col("__strikes").cast("string")))
    return scored.join(findings, key, "left").select(
        *[c for c in scored.columns if c not in ("flags", "tier", "cheat_probability")],
        F.when(struck | out, F.array_append("flags", flag)).otherwise(F.col("flags")).alias("flags"),
        F.when(out, F.lit("Reject")).otherwise(F.col("tier")).alias("tier"),
        F.when(struck | out, F.col("__p")).otherwise(F.col("cheat_probability"))
        .alias("cheat_probability"),
    ).select(*scored.columns)
