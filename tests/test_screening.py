import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievework import lexicons as lx
from sievework.functions import rules
from sievework.operators import forensics, keyed, similarity
from sievework.plans.pipeline import full_pipeline, screen
from sievework.sources.applicants import flatten_answers
from sievework.sources.tables import weight_rows

SENTENCE = "alpha beta gamma delta epsilon zeta eta theta"


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t STRING").select(column).first()[0]


@pytest.mark.parametrize("text,score", [
    ("too short. really. yes.", 0.0), (f"{SENTENCE} {SENTENCE} {SENTENCE}. {SENTENCE}", 0.0), (f"{SENTENCE}. " * 4, 0.85),
    (f"{SENTENCE}. {SENTENCE} iota kappa. {SENTENCE} iota kappa lam mu. {SENTENCE} iota kappa lam mu nu xi.", 0.5),
    (f"one. two. {SENTENCE} {SENTENCE} {SENTENCE}.", 0.1), (None, 0.0)])
def test_uniformity(spark, text, score):
    assert one(spark, rules.uniformity("t"), text) == score


def test_vocab_signals(spark):
    vocab = rules.vocab_signals("t")
    plain = " ".join(f"w{i}" for i in range(60))
    assert one(spark, vocab, " ".join(f"w{i}" for i in range(19))) == 0.0
    assert one(spark, vocab, plain) == 0.2
    assert one(spark, vocab, plain + " don't") == 0.0
    assert one(spark, vocab, plain + " Moreover furthermore") == pytest.approx(0.5)
    assert one(spark, vocab, plain + " this ensures x, it is crucial y") == pytest.approx(0.4)
    half = " ".join([f"w{i}" for i in range(50)] + ["same"] * 50)
    assert one(spark, vocab, half) == pytest.approx(0.35)
    everything = half + " " + " ".join(lx.AI_TRANSITIONS) + " this ensures this allows"
    assert one(spark, vocab, everything) == 1.0


def test_verdicts(spark):
    df = spark.createDataFrame([(0.65,), (0.651,), (0.4,), (0.401,)], "c DOUBLE")
    assert [r[0] for r in df.select(rules.ai_verdict("c")).collect()] == [
        "suspicious", "likely_ai", "likely_human", "suspicious"]


@pytest.mark.parametrize("seconds,words,severity,flag", [
    (0.0, 9, 0.0, None), (9.9, 1, 0.9, "Response in 9.9s — likely copy-paste"), (10.0, 51, 0.6, "Typed 5.1 words/sec — faster than average typing"),
    (10.0, 50, 0.0, None), (30.0, 999, 0.0, None), (float("nan"), 999, 0.0, None)])
def test_timing_flags(people, seconds, words, severity, flag):
    row = forensics.timing_flags(people({"seconds": seconds, "answers": ["w " * words]})).first()
    assert (row.severity, row.flag) == (severity, flag)


def brute_pairs(rows, threshold, features=5000, stop=()):
    """Plain TF-IDF cosine over all pairs of a question."""
    out = set()
    for q in {r[0] for r in rows}:
        docs = [(i, c, [t for t in re.findall(r"\b\w\w+\b", x.lower()) if t not in stop]) for qq, i, c, x in rows if qq == q and x.strip()]
        freq = Counter(t for _, _, d in docs for t in d)
        vocab = sorted(freq, key=lambda t: (-freq[t], t))[:features]
        df = Counter(t for _, _, d in docs for t in set(d))
        vecs = []
        for i, c, d in docs:
            tf = Counter(t for t in d if t in set(vocab))
            v = {t: n * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t, n in tf.items()}
            norm = math.sqrt(sum(w * w for w in v.values()))
            vecs.append((i, c, {t: w / norm for t, w in v.items()}))
        for a, (i, ci, x) in enumerate(vecs):
            for j, cj, y in vecs[a + 1:]:
                s = sum(w * y.get(t, 0.0) for t, w in x.items())
                if s >= threshold - 1e-12 and ci != cj:
                    out.add((q, *((ci, cj) if i < j else (cj, ci)), round(s, 4)))
    return out


def answer_rows(seed=0, n=90, copies=30):
    """Short answers over a small vocabulary; a third are copies of one text."""
    rng = random.Random(seed)
    terms = ["t%02d" % i for i in range(40)]
    rows = []
    for i in range(n):
        if i % 3 == 0 and copies:
            text = "Shared answer, t01 t02 copied!" if i % 2 else "shared ANSWER t02 copied t01"
        elif i % 7 == 0:
            text = ["", "the of", " . "][i % 3]
        else:
            text = " ".join(rng.choices(terms, k=rng.randrange(2, 9)))
        rows.append((f"q{i % 2}" if i % 3 else "q1", i, f"c{i % 80}", text))
    return rows


@pytest.fixture(scope="module")
def answers(spark):
    rows = answer_rows()
    df = spark.createDataFrame(rows, "question_id STRING, row_id BIGINT, candidate_id STRING, answer_text STRING")
    return rows, df.withColumn("name", F.upper("candidate_id")).repartition(3)


@pytest.mark.parametrize("threshold,block,features", [(0.8, 4096, 5000), (0.5, 5, 5000), (0.8, 7, 12)])
def test_similar_pairs_equal_brute_force(answers, threshold, block, features):
    rows, df = answers
    pairs = similarity.similar_pairs(df, threshold, ["the", "of"], features, block_rows=block).collect()
    got = [(r.question_id, r.candidate_a, r.candidate_b, r.similarity) for r in pairs]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows, threshold, features, {"the", "of"})
    assert all((r.severity == "high") == (r.similarity >= 0.92) for r in pairs if abs(r.similarity - 0.92) > 1e-3)


def test_pair_totals_equal_expanded_pairs(answers):
    _, df = answers
    for same in (False, True):
        groups = similarity.similar_groups(df, 0.5, ["the", "of"], block_rows=6)
        counted = {r.candidate_id: (r.n_pairs, r.n_strikes) for r in similarity.pair_totals(groups, same).collect()}
        want: dict = {}
        for r in forensics.pair_strikes(similarity.expand_pairs(groups, df, same, 6)).collect():
            n, s = want.get(r.candidate_id, (0, 0))
            want[r.candidate_id] = (n + 1, s + r.n_strikes)
        assert counted == want


def test_tfidf_terms_are_exchanged_by_group_only(spark, monkeypatch):
    # Many postings of few terms: with the common terms broadcast, only rare ones travel by term.
    monkeypatch.setattr(similarity, "COMMON_TERMS", 8)
    rows = [("q", i, f"c{i}", "n", f"alpha beta gamma rare{i}") for i in range(40)] + [("q", 40, "c40", "n", "alpha beta gamma rare0")]
    df = spark.createDataFrame(rows, "question_id string, row_id long, candidate_id string, name string, answer_text string")
    _, _, reps, vocabulary = similarity._tfidf_parts(df, (), None)
    lists = similarity._with_terms(reps, vocabulary, F.struct("term", "tf"))
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan
    assert sorted(len(r["e"]) for r in lists.collect()) == [4] * 40
    weights = {(r["row_id"], r["term"]): r["weight"] for r in similarity.tfidf_vectors(df).collect()}
    assert len(weights) == 41 * 4
    assert weights[0, "rare0"] == weights[40, "rare0"]
    common, rare = 1.0 + math.log(42 / 42), 1.0 + math.log(42 / 2)
    assert weights[1, "rare1"] == pytest.approx(rare / math.sqrt(3 * common ** 2 + rare ** 2))
    assert weights[1, "alpha"] == pytest.approx(common / math.sqrt(3 * common ** 2 + rare ** 2))


def test_tfidf_vectors_are_unit(answers):
    _, df = answers
    norms = similarity.tfidf_vectors(df, ["the", "of"]).groupBy("question_id", "row_id").agg(
        F.sum(F.col("weight") * F.col("weight")).alias("n")).collect()
    assert norms and all(abs(r.n - 1) < 1e-9 for r in norms)


@pytest.mark.parametrize("threshold,block", [(0.9, 16), (0.3, 7)])
def test_embedding_join_equals_brute_force(spark, threshold, block):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(5, 8))
    vectors = [centers[i % 5] * (1 + i % 3) + rng.normal(scale=0.3, size=8) for i in range(120)] + [np.zeros(8)]
    labels = ["a" if i % 3 else "b" for i in range(121)]
    df = spark.createDataFrame([(labels[i], i, [float(x) for x in v]) for i, v in enumerate(vectors)],
                               "label STRING, id BIGINT, v ARRAY<DOUBLE>").repartition(3)
    got = {(r.label, r.id_a, r.id_b) for r in similarity.embedding_cosine(df, "label", "id", "v", threshold, block).collect()}
    unit = [v / max(np.linalg.norm(v), 1e-8) for v in vectors]
    want = {(labels[i], i, j) for i in range(121) for j in range(i + 1, 121)
            if labels[i] == labels[j] and unit[i] @ unit[j] >= threshold}
    assert got == want


def test_strikes_and_elimination(spark, people):
    ai = spark.createDataFrame([("p0", 0.85, "likely_ai"), ("p1", 0.7, "likely_ai"), ("p2", 0.5, "suspicious")],
                               "candidate_id STRING, ai_probability DOUBLE, verdict STRING")
    pairs = spark.createDataFrame([("q1", "p1", "Bo", "p2", "Cy", 0.8, "medium"), ("q2", "p1", "Bo", "p3", "Di", 0.8001, "medium")],
                                  "question_id STRING, candidate_a STRING, candidate_a_name STRING, candidate_b STRING, "
                                  "candidate_b_name STRING, similarity DOUBLE, severity STRING")
    timing = spark.createDataFrame([("p3", 0.9, "f"), ("p2", 0.0, None)], "candidate_id STRING, severity DOUBLE, flag STRING")
    events = forensics.strike_events(ai, pairs, timing)
    reasons = {(r.candidate_id, r.reason) for r in events.filter("source = 'similarity'").collect()}
    assert ("p1", "Similar answer to Cy on Qq1 (sim=0.80)") in reasons and ("p2", "Similar answer to Bo on Qq1 (sim=0.80)") in reasons
    totals = forensics.strike_totals(people(*[{}] * 5), events)
    assert {r.candidate_id: (r.strikes, r.eliminated) for r in totals.collect()} == {
        "p0": (2, False), "p1": (4, True), "p2": (1, False), "p3": (4, True), "p4": (0, False)}


def test_names_fall_back_to_ids(spark, people):
    flags = spark.createDataFrame([("p0", 0.9), ("gone", 0.9)], "candidate_id STRING, severity DOUBLE")
    got = {r.candidate_id: r.shown_name for r in forensics.with_names(flags, people({"name": "Ann"})).collect()}
    assert got == {"p0": "Ann", "gone": "gone"}


def test_full_pipeline_on_an_acceptance_batch(spark, people):
    good = ("I built a langchain agent with redis, kafka and docker on kubernetes. Latency fell by 40% to 200ms at our shop, "
            "because we tried async calls versus threads. It failed at first! The lesson: benchmark recall, precision and "
            "accuracy of retrieval with embedding vectors in postgres before fine-tuning any llm or gpt pipeline. Costs: $30.")
    rows = [
        {"name": "Ann Strong", "answers": [good, good + " More on p99 throughput."], "github": "https://github.com/ann", "linkedin": "https://l/a", "seconds": 120.0},
        {"name": "Bob Copy", "answers": ['"' + good + '"', "Short note."], "seconds": 180.0},
        {"name": "Cy Generic", "answers": ["I am a fast learner and i would use best practices here now", "no"], "seconds": 15.0},
        {"name": "", "email": "", "answers": ["ok", ""], "seconds": 3.0},
    ]
    people_df = people(*rows)
    weights = weight_rows(spark, lx.WEIGHTS, 1, "initial", F.current_timestamp())
    result = full_pipeline(people_df, weights, "run-1", F.lit("2024-01-01").cast("timestamp"))
    report = {r.candidate_id: r for r in result.report.collect()}
    # One copied answer: two strikes on each side; three seconds: two strikes.
    assert {k: (v.n_pairs, v.strikes) for k, v in report.items()} == {"p0": (1, 2), "p1": (1, 2), "p2": (0, 0), "p3": (0, 2)}
    assert result.summary.first().asDict() == {"total_candidates": 4, "flagged": 3, "eliminated": 0, "clean": 1}
    retiered = {r.candidate_id: r for r in result.retiered.collect()}
    assert retiered["p0"].tier == "Fast-Track" and retiered["p0"].flags == ["STRIKES_2"]
    assert retiered["p3"].flags == ["MISSING_EMAIL", "ALL_MINIMAL_ANSWERS", "STRIKES_2"]
    sent = {r.candidate_id: r for r in result.outbox.collect()}
    assert "p0" in sent and sent["p0"].body.startswith("Hi Ann,") and "p3" not in sent
    ai, timing, groups, again = screen(people_df)
    assert {r.candidate_id: r.strikes for r in again.collect()} == {k: v.strikes for k, v in report.items()}
    assert flatten_answers(people_df).count() == 8


def test_rare_word_copies_survive_a_term_cut(spark):
    from sievework.operators import similarity
    common = ["alpha beta alpha", "beta alpha beta", "alpha alpha beta", "beta beta alpha"]
    rows = [("q", k, f"c{k}", f"n{k}", t) for k, t in enumerate([*common, "zebra quagga", "quagga zebra"])]
    answers = spark.createDataFrame(rows, "question_id string, row_id long, candidate_id string, name string, answer_text string")
    for cut in (2, None):
        pairs = similarity.similar_pairs(answers, 0.99, max_features=cut).collect()
        assert ("c4", "c5") in {(p.candidate_a, p.candidate_b) for p in pairs}
    with pytest.raises(ValueError):
        similarity.similar_pairs(answers, 0.0)


def test_a_repeated_id_keeps_its_rows_apart(spark, people):
    from pyspark.sql import functions as F
    from sievework.operators import forensics, scoring
    from sievework.plans import pipeline
    text = "I built a docker setup with kafka and measured 300 requests for every region"
    c = people({"id": "same", "answers": [text], "seconds": 5.0}, {"id": "same", "answers": ["quite another answer here"], "seconds": 200.0},
               {"id": "other", "answers": [text], "seconds": 200.0})
    ai, timing, groups, report = pipeline.screen(c)
    rows = {r.row_id: r for r in report.collect()}
    assert len(rows) == 3
    assert [rows[k].n_pairs for k in range(3)] == [1, 0, 1]
    assert rows[0].timing_severity == 0.9 and rows[1].timing_severity == 0.0 and rows[1].strikes == 0
    scored = scoring.score_candidates(c)
    again = scoring.retier(scored, report).collect()
    assert len(again) == 3 and [r.flags for r in again if r.row_id == 1] == [r.flags for r in scored.collect() if r.row_id == 1]
    flags = timing.filter(F.col("flag").isNotNull())
    assert forensics.with_names(flags, c).count() == flags.count()


def test_posting_blocks_are_skipped_by_their_greatest_values(spark):
    """A term in every vector: blocks ordered by the norm behind it rule most of their pairs out."""
    rng = np.random.default_rng(6)
    after = rng.uniform(0.0, 0.99, 4000)
    rows = [(k, 1, 0.1, float(x)) for k, x in enumerate(after)] + [(k, 2 + k // 2, 0.5, 0.8) for k in range(100)]
    heads = spark.createDataFrame(rows, "gid long, term_id long, w double, after double")
    postings = similarity.posting_blocks(heads, 100).cache()
    assert postings.count() == len(rows)
    assert max(r["count"] for r in postings.groupBy("term_id", "block").count().collect()) < 250
    pairs = similarity.posting_block_pairs(postings, 0.7).collect()
    n = postings.filter("term_id = 1").select("block").distinct().count()
    kept = {(r.lo, r.hi) for r in pairs if r.term_id == 1}
    assert n >= 32 and 0 < len(kept) < 0.3 * n * (n + 1) / 2
    blocks = {r.gid: r.block for r in postings.filter("term_id = 1").collect()}
    for _ in range(3000):  # no pair that reaches the floor lies in a pair of blocks left out
        i, j = (int(x) for x in rng.integers(0, 4000, 2))
        if 0.01 + after[i] * after[j] >= 0.7:
            assert tuple(sorted((blocks[i], blocks[j]))) in kept


def test_a_term_in_every_answer_is_cut_into_parts(spark):
    left = spark.range(3000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
        F.concat(F.lit("k"), F.col("id") % 700)).alias("key"))
    right = left.select("key").distinct().withColumn("value", F.upper("key"))
    hot = keyed.heavy_hitters(left, ["key"], 50).collect()
    assert [r["__parts"] for r in hot] == [20]
    joined = keyed.lookup(left, right, ["key"], part_rows=50)
    assert joined.count() == 3000 and joined.filter("value <> upper(key)").isEmpty()
    assert keyed.heavy_hitters(left.limit(0), ["key"], 50) is None


def test_pairs_that_share_one_rare_term_are_not_written(spark):
    """180 long answers share two rare terms in pairs but little else: none becomes a candidate."""
    rng = random.Random(3)
    rows = [("q", i, f"c{i}", " ".join([f"rare{i % 18}", f"rare{18 + i % 30}"] + rng.sample([f"w{k}" for k in range(4000)], 40)))
            for i in range(180)]
    rows += [("q", 180 + i, f"c{180 + i}", rows[i][3] + f" extra{i}") for i in range(5)]
    df = spark.createDataFrame(rows, "question_id STRING, row_id BIGINT, candidate_id STRING, answer_text STRING")
    written = {}
    kept_stage = similarity.stage

    def counted(frame, label, *rest):
        written[label] = kept_stage(frame, label, *rest)
        return written[label]

    similarity.stage = counted
    try:
        links = similarity.similar_groups(df, 0.8, block_rows=16).links.collect()
    finally:
        similarity.stage = kept_stage
    assert len(links) == 5
    wide = [label for label, frame in written.items() if "gid_a" in frame.columns and frame.count() > 20]
    assert not wide and "candidates" in written and "posting-blocks" not in written


def test_vectors_are_written_once_however_many_blocks_meet(spark, monkeypatch):
    """Blocks meet where they are written: neither heads nor vectors are exchanged for it."""
    rows = [(f"q{i % 3 if i < 60 else 0}", i, f"c{i}", f"c{i}", f"w{i % 37} w{i % 11} w{i % 5} word common t{i}") for i in range(240)]
    df = spark.createDataFrame(rows, "question_id STRING, row_id BIGINT, candidate_id STRING, name STRING, answer_text STRING")
    tables = {}
    kept_stage = similarity.stage
    monkeypatch.setattr(similarity, "stage", lambda frame, label, *rest: tables.setdefault(label, kept_stage(frame, label, *rest)))
    monkeypatch.setattr(similarity, "POSTING_BLOCK", 4)
    model = similarity.tfidf_model(df, (), None, 32)
    assert model.blocks.large and model.blocks.bins < model.blocks.slots and model.blocks.meetings() > 10
    assert sum(model.blocks.read(k, ["gid"]).num_rows for k in range(model.blocks.slots)) == model.vectors.count() == 240
    met = [model.blocks.meeting(k) for k in range(model.blocks.meetings())]
    assert len(set(met)) == len(met) and all(lo <= hi < model.blocks.slots for lo, hi in met)
    links = similarity.similar_groups(df, 0.3, max_features=None, block_rows=32)
    pairs = similarity.expand_pairs(links, df).collect()
    assert {(r.question_id, r.candidate_a, r.candidate_b, r.similarity) for r in pairs} == brute_pairs([(q, i, c, x) for q, i, c, _, x in rows], 0.3)
    assert "heads" not in tables and not any("ids" in t.columns or "lo" in t.columns and "w" in t.columns for t in tables.values())


def test_terms_and_counts_survive_their_string(spark):
    texts = ["beta alpha beta", "", "the", "Ünïcode x1 x1 x1 _a", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = similarity.term_counts("text", ["the"])
    both = df.select(counts.alias("a"), similarity._uncounted(F.array_join(F.transform(
        counts, lambda t: F.concat_ws(" ", t["term"], t["tf"])), " ")).alias("b"))
    assert all(r.a == r.b for r in both.collect())


def test_only_bags_and_slots_hold_terms_and_postings(spark, monkeypatch):
    rng = random.Random(3)
    rows = [("q%d" % (i % 2), i, f"c{i}", "n", " ".join(rng.choices([f"w{k}" for k in range(300)], k=20))) for i in range(400)]
    rows += [("q0", 400 + i, f"d{i}", "n", rows[0][4]) for i in range(5)]
    df = spark.createDataFrame(rows, "question_id string, row_id long, candidate_id string, name string, answer_text string")
    tables = {}
    kept = similarity.stage

    def seen(table, label, *more):
        tables[label] = kept(table, label, *more)
        return tables[label]

    monkeypatch.setattr(similarity, "stage", seen)
    _, _, reps, _ = similarity._tfidf_parts(df, (), None)
    assert set(tables["representatives"].columns) == {"question_id", "file", "at", "n", "gid"}
    assert [label for label, t in tables.items() if "terms" in t.columns] == ["bags"]
    texts = {tuple(sorted(Counter(r[4].split()).items())) for r in rows}
    found = reps.collect()
    assert len(found) == 400 and {tuple((t.term, t.tf) for t in r.terms) for r in found} == texts
    assert sorted(r.n for r in found) == [1] * 399 + [6]


def test_packed_postings_are_small_and_come_back():
    rng = np.random.default_rng(5)
    gid = np.repeat(rng.choice(1 << 40, 400, False), 250)
    postings = pa.table({
        "slot": pa.array(gid % 7, pa.int32()), "gid": gid, "question_id": [None if g % 7 else "q" for g in gid.tolist()], "n_answers": np.full(len(gid), 400),
        "df": np.zeros(len(gid), np.int64), "term_id": (rng.choice(20_000, len(gid)) | 3 << 33).astype(np.int64), "tf": rng.integers(1, 4, len(gid)).astype(np.int32)})
    df = 1 + postings.column("term_id").to_numpy() % 9
    postings = postings.set_column(4, "df", pa.array(df))
    packed = [b for b in similarity.pack_postings(iter(postings.to_batches(10_000)))]
    assert sum(b.num_rows for b in packed) == 7 and sum(b.column(1).nbytes for b in packed) < 6 * len(gid)
    back = {}
    for b in packed:
        for slot in range(b.num_rows):
            part = pa.Table.from_batches([b.slice(slot, 1)])
            for r in similarity.list_postings([part.column("slot")[0]], part).to_pylist():
                assert r["slot"] == r["gid"] % 7 and r["question_id"] == (None if r["slot"] else "q") and r["n_answers"] == 400
                assert r["single"] == r["df"].count(1)
                back[r["gid"]] = list(zip(r["df"], r["ids"], r["tf"]))
    want = {}
    for g, d, t, n in zip(gid.tolist(), df.tolist(), postings.column("term_id").to_pylist(), postings.column("tf").to_pylist()):
        want.setdefault(g, []).append((d, t, n))
    assert back == {g: sorted(x) for g, x in want.items()}


def test_postings_and_members_are_not_broadcast(spark):
    """Small files unpack to large tables: only what the operator asks for goes through the driver."""
    rows = [("q" if i % 3 else "r", i, f"c{i}", " ".join(f"w{k}" for k in range(i % 7, 40 + i % 11))) for i in range(60)]
    df = spark.createDataFrame(rows, "question_id STRING, row_id BIGINT, candidate_id STRING, answer_text STRING")
    vectors = similarity.tfidf_vectors(df)
    plan = vectors._jdf.queryExecution().sparkPlan().toString()
    assert not re.search(r"BroadcastHashJoin \[gid", plan) and plan.count("SortMergeJoin") >= 2
    norms = vectors.groupBy("row_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("s")).collect()
    assert len(norms) == 60 and all(abs(r.s - 1) < 1e-9 for r in norms)


def test_few_shared_terms_are_added_up(monkeypatch):
    """Terms that cannot be the first a pair shares, and do not tell much more, are not multiplied; no pair is lost."""
    rng = np.random.default_rng(5)
    df = np.sort(rng.zipf(1.3, 3000) % 400 + 2)  # term ids from rare to common
    lists = [np.sort(rng.choice(3000, rng.integers(5, 300), replace=False, p=df / df.sum())) for _ in range(250)]
    lists += [np.sort(np.r_[x[:-1], rng.integers(0, 3000)]) for x in lists[:60]]
    lists = [np.unique(x) for x in lists]
    tf = [rng.integers(1, 4, len(x)) for x in lists[:250]]
    tf += [np.resize(tf[k], len(lists[250 + k])) for k in range(60)]
    vectors = pa.table({"gid": np.arange(310), "single": np.zeros(310, np.int32), "ids": [x.tolist() for x in lists], "tf": [x.tolist() for x in tf],
                        "idf": [(np.log(400 / df[x]) + 1).tolist() for x in lists]})
    dense = np.zeros((310, 3000))
    for k, x in enumerate(lists):
        dense[k, x] = tf[k] * (np.log(400 / df[x]) + 1)
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    floor = 0.8 - 1e-9
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(dense @ dense.T >= floor)) if i < j}
    heads = similarity.heads_of(vectors, floor)
    shared = np.unique(np.concatenate(heads.column("ids").to_numpy()), return_counts=True)[1]
    added, plain = [], np.bincount

    def counted(x, weights=None, minlength=0):
        added.append(len(x) if weights is not None and weights.dtype == np.float64 else 0)
        return plain(x, weights, minlength)

    monkeypatch.setattr(np, "bincount", counted)
    found = similarity.head_meetings(heads, heads, floor - 1e-6, True)
    got = set(zip(found.column("gid_a").to_pylist(), found.column("gid_b").to_pylist()))
    assert len(want) >= 20 and want <= got and len(got) < 0.03 * 310 * 309 / 2
    assert sum(added) < 0.6 * (shared * shared).sum()


def test_heads_are_written_once_for_all_meetings(spark, monkeypatch):
    rng = random.Random(6)
    rows = [("q", i, f"c{i}", " ".join(rng.choices([f"w{k}" for k in range(200)], k=30))) for i in range(120)]
    rows += [("q", 120 + i, f"d{i}", rows[i][3] + " more") for i in range(9)]
    df = spark.createDataFrame(rows, "question_id STRING, row_id BIGINT, candidate_id STRING, answer_text STRING")
    paths, kept_path = [], similarity.new_path
    monkeypatch.setattr(similarity, "new_path", lambda s, label: paths.append((label, kept_path(s, label))) or paths[-1][1])
    links = similarity.similar_groups(df, 0.8, block_rows=16).links.collect()
    assert [label for label, _ in paths] == ["vectors", "heads"] and len(links) >= 9
    heads = spark.read.parquet(paths[1][1])
    assert heads.count() == heads.select("gid").distinct().count() > 0 and heads.select("slot").distinct().count() > 1


def test_rows_that_have_a_term_twice_count_all_shared_terms():
    """Answers that share a ``row_id`` give such rows; the shorter count holds for distinct terms only."""
    once = pa.table({"gid": [0, 1], "tail": [0.7, 0.7], "ids": [[1, 2], [1, 3]], "w": [[0.5, 0.5], [0.5, 0.5]]})
    twice = pa.table({"gid": [2], "tail": [0.7], "ids": [[1, 1, 2]], "w": [[0.4, 0.4, 0.4]]})
    index = similarity.HeadIndex.of(twice)
    assert similarity.HeadIndex.of(once).plain and not index.plain
    found = similarity.head_meetings(once, index, 0.8, False)
    assert found.column("gid_a").to_pylist() == [0, 1] and found.column("gid_b").to_pylist() == [2, 2]
