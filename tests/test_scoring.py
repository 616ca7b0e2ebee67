import re

import pytest
from pyspark.sql import functions as F

from sievework import lexicons as lx
from sievework.functions import rules
from sievework.operators import scoring


def filler(n):
    return " ".join("ab" + chr(97 + i % 26) + chr(97 + i // 26) for i in range(n))


def score(people, *rows, **options):
    return {r.candidate_id: r for r in scoring.score_candidates(people(*rows), **options).collect()}


def test_term_ladder(people):
    steps = [(0, 10), (1, 10), (2, 35), (4, 35), (5, 55), (9, 55), (10, 75), (14, 75), (15, 90)]
    terms = ["langchain", "redis", "kafka", "flink", "docker", "kubernetes", "mongodb", "sqlite", "latency", "accuracy",
             "rmse", "recall", "celery", "openai", "tokenizer"]
    got = score(people, *[{"answers": ["zz " + " ".join(terms[:n])]} for n, _ in steps])
    assert [got[f"p{i}"].technical_relevance for i in range(len(steps))] == [b for _, b in steps]


def test_terms_are_substrings_unless_asked(people):
    text = {"answers": ["storage rapid"]}
    assert score(people, text)["p0"].explanation[0] == "Found 2 technical terms: api, rag"
    assert score(people, text, word_boundary=True)["p0"].explanation[0] == "Found 0 technical terms: "
    assert score(people, {"answers": ["  ", ""]})["p0"].technical_relevance == 0


def test_version_bonus_equals_plain_pattern(people, spark):
    texts = ["python3 v2 spark 4.1 abc-v3. x9y9 node v18 a1b2 10k", "no digits", "p99 p95. abcv1 abc v1", "é3 z é-4"]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    got = [r[0] for r in df.select(F.regexp_count("t", F.lit("(?U)" + rules.VERSION_SCAN))).collect()]
    assert got == [len(re.findall(lx.VERSION_PATTERN, t)) for t in texts]


def test_unknown_role_and_own_lexicon(people):
    rows = [{"role": "Data Smith", "answers": ["anvil hammer"]}, {"role": "None such", "answers": ["anvil"]}]
    lexicon = {"data_smith": ["anvil", "hammer"], "ai_agent_developer": ["tongs"]}
    got = score(people, *rows, lexicon=lexicon)
    assert (got["p0"].technical_relevance, got["p1"].technical_relevance) == (35, 10)


def test_lexicon_table_equals_dictionary(people, spark):
    rows = [{"role": r, "answers": ["anvil hammer redis kafka"]} for r in ("Data Smith", "Else", "Else", "Else")]
    lexicon = {"data_smith": ["anvil"], "ai_agent_developer": ["redis", "kafka", "tongs"]}
    table = spark.createDataFrame(list(lexicon.items()), "role_key STRING, terms ARRAY<STRING>")
    joined = scoring.score_candidates(scoring.with_role_terms(people(*rows), table)).collect()
    assert {r.candidate_id: r.technical_relevance for r in joined} == {
        k: v.technical_relevance for k, v in score(people, *rows, lexicon=lexicon).items()}


def test_length_ladder(people):
    steps = [(1, 15), (5, 15), (6, 30), (20, 30), (21, 60), (50, 60), (51, 80), (150, 80), (151, 90)]
    got = score(people, *[{"answers": [filler(n)]} for n, _ in steps])
    assert [got[f"p{i}"].answer_quality for i in range(len(steps))] == [p for _, p in steps]


def test_answer_quality_bonuses_and_empty_answers(people):
    # 20 for length, 10 for variety, then 2.5, 1.5, 1.5, 1, 2, 1.5, 1, 1.5 and 1.5
    text = "Saved 40% in 20ms for $5 (1) TRIED it didn't work because trade-offs lesson"
    assert score(people, {"answers": [text]})["p0"].answer_quality == 20 + 10 + 14
    assert score(people, {"answers": [text, "", ""]})["p0"].answer_quality == round((20 + 10 + 14) / 3, 2)
    assert score(people, {"answers": []})["p0"].answer_quality == 0
    assert score(people, {"answers": ["go go go go go go go"]})["p0"].answer_quality == 10


def test_profile(people):
    cases = [
        (None, None, "x", 35), ("https://github.com/ann", None, "x", 65),
        ("https://github.com/ann", "https://l/in/a", "my repo", 95),
        ("https://github.com/latest", "https://l/in/a", "my repo", 45),
        ("https://github.com/test/", None, "x", 65), ("https://github.com/dev404", None, "x", 25)]
    got = score(people, *[{"github": g, "linkedin": li, "answers": [t]} for g, li, t, _ in cases])
    assert [got[f"p{i}"].profile_credibility for i in range(len(cases))] == [c[3] for c in cases]


def test_specificity(people):
    got = score(people, {"answers": ["I am a fast learner, team player"]}, {"answers": ["built 10K, 5%, at our 7M built built deployed"]},
                {"answers": [" ".join(lx.GENERIC_PHRASES)]})
    assert got["p0"].specificity == 60 - 16
    assert got["p1"].specificity == 60 + 5 + 10 + 15 + 5
    assert got["p2"].specificity == 0


def test_timing(people):
    steps = [(-1, 50), (0, 50), (0.5, 15), (9.99, 15), (10, 40), (29.9, 40), (30, 65), (59.9, 65), (60, 85),
             (299.9, 85), (300, 70), (599.9, 70), (600, 50), (float("nan"), 50)]
    got = score(people, *[{"seconds": float(s), "answers": ["x"]} for s, _ in steps])
    assert [got[f"p{i}"].timing for i in range(len(steps))] == [p for _, p in steps]


def test_penalties_multiply_and_flag(people):
    long = filler(60)
    got = score(people, {"answers": [long]}, {"answers": [long], "email": ""}, {"answers": ["short"], "email": ""}, {"answers": []})
    full = got["p0"]
    assert full.flags == [] and got["p1"].flags == ["MISSING_EMAIL"]
    assert got["p1"].total_score == pytest.approx(full.total_score / 2, abs=0.01)
    assert got["p2"].flags == ["MISSING_EMAIL", "ALL_MINIMAL_ANSWERS"] and got["p3"].flags == ["ALL_MINIMAL_ANSWERS"]
    dims = [getattr(got["p2"], d) for d in lx.DIMENSIONS]
    assert got["p2"].total_score == round(sum(d * w for d, w in zip(dims, lx.WEIGHTS.values())) * 0.5 * 0.3, 2)
    assert got["p2"].explanation[-2:] == ["Major penalty: no email provided", "All answers are minimal (≤5 words each)"]


def test_weights_replace(people):
    only = score(people, {"answers": ["x"], "seconds": 100.0}, weights={"timing": 1.0})["p0"]
    assert only.total_score == 85 * 0.3 and only.tier == "Reject"


@pytest.mark.parametrize("total,flags,tier", [
    (85.0, [], "Fast-Track"), (84.999, [], "Standard"), (65.0, [], "Standard"), (64.999, [], "Review"), (45.0, [], "Review"),
    (44.999, [], "Reject"), (99.0, ["COPIED_RESPONSE"], "Reject"), (99.0, ["CHEAT_DETECTED"], "Reject"), (99.0, ["STRIKES_1"], "Fast-Track")])
def test_tiers(spark, total, flags, tier):
    df = spark.createDataFrame([(total, flags)], "t DOUBLE, f ARRAY<STRING>")
    assert df.select(rules.tier("t", "f")).first()[0] == tier


def test_explanations_in_order(people):
    row = score(people, {"answers": ["redis in v2", ""], "seconds": 5.0, "github": "https://github.com/null"})["p0"]
    assert row.explanation == [
        "Found 1 technical terms: redis", "Mentions specific versions/numbers: shows precision",
        "Q 'q1': Extremely short (3 words)", "Q 'q2': Empty answer",
        "GitHub URL looks suspicious: https://github.com/null", "No LinkedIn profile",
        "Suspiciously fast response: 5.0s — possible copy-paste", "All answers are minimal (≤5 words each)"]


def test_rank_goes_first_in_explanations(people):
    scored = scoring.score_candidates(people({"answers": ["x"]}, {"answers": [filler(80)]}))
    ranked = {r.candidate_id: r for r in scoring.rank_scores(scored, prefix_explanation=True).collect()}
    assert ranked["p1"].explanation[0] == "Rank: #1 of 2" and ranked["p0"].rank == 2


def test_retier_keeps_total(people, spark):
    scored = scoring.score_candidates(people(*[{"answers": [filler(80)]}] * 4))
    cheat = spark.createDataFrame([("p0", 3, True, 0.7), ("p1", 2, False, 0.2), ("p2", 0, False, 0.1)],
                                  "candidate_id STRING, strikes INT, eliminated BOOLEAN, ai_probability DOUBLE")
    was = {r.candidate_id: r for r in scored.collect()}
    got = {r.candidate_id: r for r in scoring.retier(scored, cheat).collect()}
    assert (got["p0"].tier, got["p0"].flags, got["p0"].cheat_probability) == ("Reject", ["CHEAT_DETECTED"], 0.7)
    assert (got["p1"].tier, got["p1"].flags, got["p1"].cheat_probability) == (was["p1"].tier, ["STRIKES_2"], 0.2)
    assert got["p2"] == was["p2"] and got["p3"] == was["p3"] and got["p0"].total_score == was["p0"].total_score


def test_explained_scores_scan_each_text_once(people, monkeypatch):
    rows = people({"answers": ["we built v2 api, python 3.11 and 40% more", "", "short"]}, {"answers": [None]}, {"answers": []})
    scans, regex_hits = [], rules.tx.regex_hits
    monkeypatch.setattr(rules.tx, "regex_hits", lambda *a, **k: scans.append(a) or regex_hits(*a, **k))
    explained = scoring.score_candidates(rows)
    assert len(scans) == 1 + len(lx.CONCRETE_PATTERNS)
    assert not set(scoring.MEASURES) & set(explained.columns)
    # The same reasons as from the texts themselves.
    apart = scoring.with_explanations(scoring.total_and_tier(scoring.score_dimensions(rows)))
    assert {r["candidate_id"]: r["explanation"] for r in explained.collect()} == {
        r["candidate_id"]: r["explanation"] for r in apart.collect()}
