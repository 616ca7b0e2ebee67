"""Ingestion runs, tables that are upserted in place, and what a batch leaves behind."""

import json
import os

from pyspark.sql import functions as F

from sievework import lexicons as lx
from sievework.operators import engagement, keyed, learning
from sievework.sources import applicants as ap
from sievework.sources import tables as tb


def at():
    return F.lit("2024-01-01").cast("timestamp")


def csv(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_an_ingestion_run_stores_logs_and_rejects(spark, tmp_path):
    text = ("id,name,email,role,q1\n" "a,Ann,a@x.test,Eng,yes\n" "b,,,Eng,no\n" "c,Ann again,A@X.TEST,eng,hm\n"
            "d,Ann other,a@x.test,Ops,ok\n" "e,Eve,e@x.test,Eng,no,too,many\n" "f,Flo,f@x.test,Eng,fine\n")
    folder = str(tmp_path / "tables")
    raw = ap.scan_csv(spark, csv(tmp_path, "one.csv", text))
    run = ap.run_ingestion(raw, folder, "one.csv", at(), buckets=4).first().asDict()
    assert run == {"source": "one.csv", "status": "partial", "rows_read": 6, "kept": 2, "parse_errors": 1, "no_identity": 1,
                   "duplicates": 1, "same_identity": 1}
    rejects = {r.row_id: (r.reject_reason, r.duplicate_of, r.line) for r in spark.read.parquet(f"{folder}/rejects").collect()}
    assert rejects == {1: ("no_identity", None, None), 2: ("duplicate", "a", None), 3: ("same_identity", None, None),
                       4: ("parse_error", None, "e,Eve,e@x.test,Eng,no,too,many")}
    again = ap.scan_csv(spark, csv(tmp_path, "two.csv", "id,name,email,role\nz,Ann new,a@x.test,Eng\ng,Guy,g@x.test,Eng\n"))
    assert ap.run_ingestion(again, folder, "two.csv", at(), buckets=4).first()["status"] == "success"
    stored = {r.email: (r.candidate_id, r.name) for r in tb.read_upserted(spark, f"{folder}/candidates").collect()}
    assert stored == {"a@x.test": ("a", "Ann new"), "f@x.test": ("f", "Flo"), "g@x.test": ("g", "Guy")}
    assert spark.read.parquet(f"{folder}/interactions").count() == 4
    nobody = ap.scan_csv(spark, csv(tmp_path, "none.csv", "id,name,email\nx,,\n"))
    assert ap.run_ingestion(nobody, str(tmp_path / "other"), "none.csv", at()).first()["status"] == "error"


def test_a_small_upsert_leaves_other_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "people")
    rows = spark.range(1000).select(F.concat(F.lit("c"), "id").alias("candidate_id"), F.col("id").alias("row_id"),
                                    F.concat(F.lit("u"), "id").alias("email"), F.lit("r").alias("role"), F.lit(0).alias("value"))
    tb.upsert_into(rows, path, buckets=50)

    def files():
        return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}

    before = files()
    tb.upsert_into(rows.filter("row_id % 100 = 7").withColumns({"value": F.lit(1), "candidate_id": F.lit("new")}), path, buckets=50)
    kept = before & files()
    assert len(before) == 50 and 40 <= len(kept) < 50
    after = tb.read_upserted(spark, path)
    assert after.count() == 1000 and after.filter("value = 1").count() == 10 and after.filter("candidate_id = 'new'").isEmpty()


def test_latest_row_may_hold_a_map(spark):
    df = spark.createDataFrame([("a", 1, {"x": 1}), ("a", 2, {"x": 2}), ("b", 1, None)], "k string, at int, m map<string,int>")
    assert {r.k: r.m for r in keyed.latest_per_key(df, ["k"], ["at"]).collect()} == {"a": {"x": 2}, "b": None}


def test_a_snapshot_only_with_adjustments(spark):
    weights = tb.weight_rows(spark, lx.WEIGHTS, 3, "initial", at())
    make = lambda rejects: spark.createDataFrame(
        [("Reject" if k < rejects else "Standard", float(k), [], []) for k in range(100)],
        "tier string, total_score double, flags array<string>, answers array<struct<answer_text: string>>")
    some = learning.learning_report(make(61), weights, at=at())["snapshot"].collect()
    assert {(r.version, r.reason) for r in some} == {(4, "batch_analysis_auto_adjustment")}
    assert len(some) == len(lx.WEIGHTS) and abs(sum(r.weight for r in some) - 1) < 1e-3
    assert learning.learning_report(make(40), weights, at=at())["snapshot"].isEmpty()


def test_history_has_the_context_of_replies(spark):
    replies = spark.createDataFrame([("t", 1, "2024-01-01 00:00:00", "We used a model with a database and docker cache api")],
                                    "thread_id string, seq int, received_at string, body string").withColumn(
        "received_at", F.col("received_at").cast("timestamp"))
    threads = spark.createDataFrame([("t", "c", "Ann", "a@x.test", "Eng", 1)],
                                    "thread_id string, candidate_id string, name string, email string, role string, round int")
    history = engagement.thread_history(engagement.reply_events(engagement.process_replies(replies, threads))).orderBy("seq").collect()
    first = json.loads(history[0].context)
    assert (history[0].from_state, history[0].to_state) == ("initiated", "replied")
    assert set(first) == {"response_type", "confidence"} and 0 < first["confidence"] <= 1


def test_batch_classes_take_machine_text_rules(spark):
    text = "alpha beta gamma delta " * 8
    df = spark.createDataFrame([(text, 1)], "text string, round int")
    plain = engagement.classify_batch(df, "text", "round").first()
    ruled = engagement.classify_batch(df, "text", "round", {"transitions": ["alpha", "beta"], "formal": ["gamma", "delta"]}).first()
    assert ruled.vocab > plain.vocab and "AI-typical phrase: 'alpha'" in ruled.vocab_detail and "2 overly formal patterns" in ruled.vocab_detail
