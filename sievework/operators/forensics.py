"""Machine-text signals, timing flags and strike accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework import lexicons as lx
from sievework.functions import rules
from sievework.functions import text as tx
from sievework.operators.keyed import computed_once


def detect_ai(df: DataFrame, text: str, transitions=lx.AI_TRANSITIONS,
              formal=lx.FORMAL_PATTERNS) -> DataFrame:
    """Adds ``uniformity``, ``vocab``, their details, ``ai_probability`` and ``verdict`` for a text column."""
    signals = computed_once(df, {
        "__u": rules.uniformity_signal(text), "__v": rules.vocab_signal(text, transitions, formal)}).withColumns({
            "uniformity": F.col("__u.score"), "uniformity_detail": F.col("__u.detail"),
            "vocab": F.col("__v.score"), "vocab_detail": F.col("__v.detail")}).drop("__u", "__v")
    composite = rules.ai_composite("uniformity", "vocab")
    return signals.withColumns({
        "ai_probability": tx.round_half_even(composite, 3),
        "verdict": rules.ai_verdict(composite),
    })


def ai_signals(candidates: DataFrame, **lexicons) -> DataFrame:
    """Signals over each applicant's non-empty answers taken together."""
    texts = candidates.withColumn(
        "__text", rules.joined_answers("answers", lower=False, keep_empty=False))
    return detect_ai(texts, "__text", **lexicons).select(
        "candidate_id", "row_id", "name", "uniformity", "uniformity_detail", "vocab", "vocab_detail", "ai_probability", "verdict")


def timing_flags(candidates: DataFrame) -> DataFrame:
    """``flag`` and ``severity`` of every applicant's response time."""
    judged = candidates.withColumn("__t", rules.timing_flag(
        "response_time_seconds", rules.total_words("answers")))
    return judged.select(
        "candidate_id", "row_id", "name", "response_time_seconds",
        F.col("__t.flag").alias("flag"), F.col("__t.severity").alias("severity"))


def applicant_key(*frames: DataFrame) -> str:
    """``row_id``, which is unique, where all frames have it; else ``candidate_id``.

    Applicants of a merged file may share a ``candidate_id``; joining on it would multiply
    their rows and add up their strikes.
    """
    return "row_id" if all("row_id" in f.columns for f in frames) else "candidate_id"


def with_names(flags: DataFrame, candidates: DataFrame) -> DataFrame:
    """Adds ``shown_name``: the applicant's name, or the id where there is none."""
    key = applicant_key(flags, candidates)
    names = candidates.select(key, F.col("name").alias("__name"))
    base = flags.drop("name")
    return base.join(names, key, "left").withColumn(
        "shown_name", F.coalesce("__name", "candidate_id")).drop("__name")


def _events(df: DataFrame, source: str, reason, severity) -> DataFrame:
    return df.select(
        "candidate_id", *[c for c in ("row_id",) if c in df.columns],
        F.lit(source).alias("source"), reason.alias("reason"),
        severity.alias("severity"), rules.strikes_for(severity).alias("n_strikes"))


def ai_strikes(ai: DataFrame) -> DataFrame:
    reason = F.concat(F.lit("AI-generated text detected (p="),
                      tx.fixed("ai_probability", 2), F.lit(")"))
    return _events(ai.filter(F.col("verdict") == "likely_ai"), "ai", reason,
                   F.col("ai_probability"))


def timing_strikes(timing: DataFrame) -> DataFrame:
    reason = F.concat(F.lit("Timing anomaly: "), F.col("flag"))
    return _events(timing.filter(F.col("severity") > 0.5), "timing", reason, F.col("severity"))


def pair_sides(pairs: DataFrame) -> DataFrame:
    """One row per side of each pair, naming the other side; ``row_id`` where the pairs have it."""
    def side(me: str, other: str) -> DataFrame:
        return pairs.select(
            *[F.col(c).alias("row_id") for c in (f"row_{me}",) if c in pairs.columns],
            F.col(f"candidate_{me}").alias("candidate_id"),
            F.col(f"candidate_{other}").alias("other_id"),
            F.col(f"candidate_{other}_name").alias("other_name"),
            "question_id", "similarity", "severity")

    return side("a", "b").unionByName(side("b", "a"))


def pair_strikes(pairs: DataFrame) -> DataFrame:
    """Every pair strikes both of its sides."""
    reason = F.concat(
        F.lit("Similar answer to "), F.col("other_name"), F.lit(" on Q"), F.col("question_id"),
        F.lit(" (sim="), tx.fixed("similarity", 2), F.lit(")"))
    return _events(pair_sides(pairs), "similarity", reason, F.col("similarity"))


def strike_events(ai: DataFrame, pairs: DataFrame, timing: DataFrame) -> DataFrame:
    """All strikes in one table; ``row_id`` is kept where every source has it."""
    parts = [ai_strikes(ai), pair_strikes(pairs), timing_strikes(timing)]
    if not all("row_id" in p.columns for p in parts):
        parts = [p.drop("row_id") for p in parts]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def strike_totals(candidates: DataFrame, strikes: DataFrame,
                  limit: int = lx.STRIKE_LIMIT) -> DataFrame:
    """Strikes and elimination of every applicant; ``strikes`` needs only the key
    (``row_id``, or else ``candidate_id``) and ``n_strikes`` and is summed before it is
    exchanged."""
    key = applicant_key(candidates, strikes)
    sums = strikes.groupBy(key).agg(F.sum("n_strikes").alias("strikes"))
    return candidates.select(*dict.fromkeys(["candidate_id", key])).join(sums, key, "left").select(
        *dict.fromkeys(["candidate_id", key]), F.coalesce("strikes", F.lit(0)).alias("strikes"),
        (F.coalesce("strikes", F.lit(0)) >= limit).alias("eliminated"))


def cheat_report(candidates: DataFrame, ai: DataFrame, pair_counts: DataFrame, timing: DataFrame,
                 totals: DataFrame) -> DataFrame:
    """One row per applicant: verdict, pairs, timing, strikes, elimination.

    ``pair_counts`` is (key, n_pairs).  All inputs have one row per applicant, who is told
    apart by ``row_id`` where every input has it.  Narrow inputs are stacked and added up
    by the key in one exchange.
    """
    key = applicant_key(candidates, ai, pair_counts, timing, totals)
    facts = {"candidate_id": (candidates, "candidate_id"), "name": (candidates, "name"),
             "ai_probability": (ai, "ai_probability"), "verdict": (ai, "verdict"),
             "n_pairs": (pair_counts, "n_pairs"), "timing_flag": (timing, "flag"),
             "timing_severity": (timing, "severity"), "strikes": (totals, "strikes"),
             "eliminated": (totals, "eliminated")}
    kinds = {n: df.schema[c].dataType for n, (df, c) in facts.items()}
    stacked = None
    for source in (candidates, ai, pair_counts, timing, totals):
        part = source.select(F.col(key).alias("__key"), F.lit(source is candidates).alias("__is"), *[
            (F.col(c) if df is source else F.lit(None).cast(kinds[n])).alias(n) for n, (df, c) in facts.items()])
        stacked = part if stacked is None else stacked.unionByName(part)
    report = stacked.groupBy("__key").agg(F.max("__is").alias("__is"), *[F.max(n).alias(n) for n in facts]).filter("__is")
    shown = [F.col("__key").alias("row_id")] if key == "row_id" else []
    return report.select("candidate_id", *shown, *list(facts)[1:]).withColumn(
        "n_pairs", F.coalesce("n_pairs", F.lit(0)))


def cheat_summary(report: DataFrame) -> DataFrame:
    flagged = F.count_if(F.col("strikes") > 0)
    return report.agg(
        F.count(F.lit(1)).alias("total_candidates"), flagged.alias("flagged"),
        F.count_if(F.col("eliminated")).alias("eliminated"),
        (F.count(F.lit(1)) - flagged).alias("clean"))


def anomaly_counts(pair_counts: DataFrame, timing: DataFrame) -> DataFrame:
    """Number of similar pairs and of applicants with a timing flag.

    ``pair_counts`` is that of ``pair_totals``: every pair is in the counts of both its
    sides, so no pair needs to be written out.
    """
    n_pairs = pair_counts.agg(F.coalesce(F.sum("n_pairs") / 2, F.lit(0)).cast("bigint").alias("n")).scalar()
    return timing.agg(
        n_pairs.alias("similar_pairs"),
        F.count_if(F.col("flag").isNotNull()).alias("timing_anomalies"))


def candidate_detail(candidate_id: str, candidates: DataFrame, scores: DataFrame, ai: DataFrame,
                     timing: DataFrame, sides: DataFrame) -> DataFrame:
    """Everything known about one applicant, one row per similar answer.

    The id is filtered in every input before the joins.  Give a stored table of ``sides``;
    otherwise all pairs are computed for one id.
    """
    def only(df: DataFrame) -> DataFrame:
        return df.filter(F.col("candidate_id") == candidate_id)

    return (
        only(candidates).select("candidate_id", "name", "email", "role")
        .join(only(scores).select("candidate_id", "total_score", "tier", "flags"),
              "candidate_id", "left")
        .join(only(ai).select("candidate_id", "ai_probability", "verdict"), "candidate_id", "left")
        .join(only(timing).select("candidate_id", F.col("flag").alias("timing_flag"),
                                  F.col("severity").alias("timing_severity")),
              "candidate_id", "left")
        .join(only(sides).select("candidate_id", "other_id", "question_id", "similarity"),
              "candidate_id", "left")
    )
