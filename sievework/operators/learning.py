"""Batch feedback: score statistics, tier profiles and bounded weight updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework import lexicons as lx
from sievework.functions import rules
from sievework.functions import text as tx
from sievework.operators import selection
from sievework.session import stage
from sievework.sources.tables import current_weights


def tier_distribution(scored: DataFrame) -> DataFrame:
    return scored.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


def score_stats(scored: DataFrame, score: str = "total_score") -> DataFrame:
    """Count, mean, min, max and upper median, rounded; null statistics without rows.

    Scores may be any doubles: the median is selected exactly, by a few bounded histograms of
    the written scores.  Null and NaN scores count as candidates only.
    """
    values = stage(scored.select(F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double")).alias("s")), "scores")
    seen = values.agg(F.count(F.lit(1)).alias("rows"), F.count("s").alias("n"), F.sum("s").alias("sum"),
                      F.min("s").alias("low"), F.max("s").alias("high")).first()
    median = selection.kth_smallest(values, "s", seen["n"] // 2, seen["low"], seen["high"]) if seen["n"] else None
    row = scored.sparkSession.createDataFrame(
        [(seen["rows"], seen["sum"] / seen["n"] if seen["n"] else None, seen["low"], seen["high"], median)],
        "total_candidates long, mean double, min double, max double, median double")
    return row.select("total_candidates", *[tx.round_half_even(c, 2).alias(c) for c in ("mean", "min", "max", "median")])


def reject_warning(scored: DataFrame) -> DataFrame:
    """Share of rejects and a warning outside 10% to 60%."""
    shares = scored.agg(F.avg((F.col("tier") == "Reject").cast("double")).alias("reject_share"))
    return shares.withColumn(
        "warning",
        F.when(F.col("reject_share") > 0.6, F.lit(
            "Over 60% of candidates are being rejected — scoring may be too strict"))
        .when(F.col("reject_share") < 0.1, F.lit(
            "Less than 10% rejection rate — scoring may be too lenient")))


def tier_text_profile(scored: DataFrame, regex: str = lx.TECH_TERM_PATTERN) -> DataFrame:
    """Per tier: answers, mean words and mean term hits per answer.

    Each row adds up its own answers first; then four small sums are exchanged.
    """
    hits = F.aggregate("answers", F.lit(0), lambda acc, a: acc + tx.regex_hits(
        F.lower(a["answer_text"]), regex))
    per_row = scored.select(
        "tier", F.size("answers").alias("n"), rules.total_words("answers").alias("w"),
        hits.alias("h"))
    return per_row.groupBy("tier").agg(
        F.sum("n").alias("n_answers"),
        (F.sum("w") / F.greatest(F.sum("n"), F.lit(1))).alias("avg_words"),
        (F.sum("h") / F.greatest(F.sum("n"), F.lit(1))).alias("avg_terms"))


def tier_insights(profile: DataFrame) -> DataFrame:
    """The profile of the best and the rejected tier as sentences."""
    who = F.when(F.col("tier") == "Fast-Track", F.lit("Fast-Track")).otherwise(F.lit("Rejected"))
    return profile.filter(F.col("tier").isin("Fast-Track", "Reject")).select(
        "tier", F.concat(
            who, F.lit(" candidates average "), tx.fixed("avg_words", 0),
            F.lit(" words/answer with "), tx.fixed("avg_terms", 1),
            F.lit(" technical terms")).alias("insight"))


def _percent(share: Column) -> Column:
    return F.concat(tx.round_half_even(share * 100, 0).cast("int").cast("string"), F.lit("%"))


def recommend_weights(scored: DataFrame) -> DataFrame:
    """Rows (dimension, delta, reason) that the tier mix calls for."""
    def share(tier: str) -> Column:
        return F.avg((F.col("tier") == tier).cast("double"))

    mix = scored.agg(share("Reject").alias("r"), share("Fast-Track").alias("f"))

    def row(dimension: str, delta: float, reason: Column) -> Column:
        return F.struct(F.lit(dimension).alias("dimension"), F.lit(delta).alias("delta"),
                        reason.alias("reason"))

    stricter = F.when(F.col("r") > 0.5, row("specificity", -0.03, F.concat(
        F.lit("High rejection rate ("), _percent(F.col("r")),
        F.lit(") — suggest reducing specificity weight by 3%"))))
    higher = F.when(F.col("f") > 0.3, row("technical_relevance", 0.03, F.concat(
        F.lit("Many fast-track ("), _percent(F.col("f")),
        F.lit(") — suggest increasing technical_relevance weight to raise bar"))))
    return mix.select(F.explode(F.array(stricter, higher)).alias("x")).filter(
        F.col("x").isNotNull()).select("x.dimension", "x.delta", "x.reason")


def apply_weights(weights: DataFrame, adjustments: DataFrame, max_delta: float = lx.MAX_DELTA,
                  bounds: tuple[float, float] = lx.WEIGHT_BOUNDS) -> DataFrame:
    """(dimension, weight) moved by bounded deltas, scaled to sum 1, rounded to 4.

    Both inputs have one row per dimension; adjustments of unknown dimensions are
    ignored, scaling may carry a weight past its bounds, and weights that are all 0 stay.
    """
    deltas = adjustments.select("dimension", tx.clamp(
        F.col("delta"), -max_delta, max_delta).alias("__d"))
    moved = weights.select("dimension", "weight").join(deltas, "dimension", "left").select(
        "dimension", F.when(F.col("__d").isNull(), F.col("weight")).otherwise(
            tx.clamp(F.col("weight") + F.col("__d"), *bounds)).alias("weight"))
    total = moved.agg(F.sum("weight").alias("s")).scalar()
    share = F.when(total == 0, F.col("weight")).otherwise(F.col("weight") / total)
    return moved.select("dimension", tx.round_half_even(share, 4).alias("weight"))


def snapshot_weights(new: DataFrame, stored: DataFrame, reason: str, at: Column) -> DataFrame:
    """Rows to append to the ``weights`` table under the next version number."""
    version = stored.agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("v")).scalar()
    return new.select(version.cast("int").alias("version"), "dimension", "weight",
                      F.lit(reason).alias("reason"), at.alias("created_at"))


def learning_report(scored: DataFrame, weights: DataFrame, regex: str = lx.TECH_TERM_PATTERN,
                    reason: str = lx.SNAPSHOT_REASON, at: Column | None = None) -> dict[str, DataFrame]:
    """All feedback tables of one batch; ``new_weights`` equal the old without adjustments.

    ``snapshot`` has the rows to append to the ``weights`` table: the new weights under the
    next version, or none without adjustments.
    """
    adjustments = recommend_weights(scored)
    profile = tier_text_profile(scored, regex)
    current = current_weights(weights)
    moved = apply_weights(current, adjustments)
    some = adjustments.agg((F.count(F.lit(1)) > 0).alias("some")).scalar()
    return {
        "distribution": tier_distribution(scored),
        "stats": score_stats(scored),
        "warning": reject_warning(scored),
        "profile": profile,
        "insights": tier_insights(profile),
        "adjustments": adjustments,
        "new_weights": moved,
        "snapshot": snapshot_weights(moved, weights, reason, at if at is not None else F.current_timestamp()).filter(some),
    }


def headline_counts(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("tier") == "Fast-Track").alias("fast_track"),
        F.count_if(F.col("tier") == "Reject").alias("rejected"),
        F.coalesce(F.sum(F.size("flags")), F.lit(0)).alias("flags"))
