from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sievework.operators import engagement as en
from sievework.streaming import jobs

START = datetime(2024, 1, 1)


def files(spark, folder, rows, schema, parts):
    """Rows in order, in ``parts`` files with increasing modification times."""
    import os

    size = -(-len(rows) // parts)
    for i in range(parts):
        batch = spark.createDataFrame(rows[i * size:(i + 1) * size], schema).coalesce(1)
        batch.write.mode("append").parquet(str(folder))
        for name in folder.glob("*.parquet"):
            if not hasattr(files, "seen") or name not in files.seen:
                files.seen = getattr(files, "seen", set()) | {name}
                os.utime(name, (1_700_000_000 + i * 10,) * 2)
    return jobs.stream_parquet(spark, str(folder), "*.parquet")


def test_classify_equals_batch(spark, tmp_path):
    rows = [(i, "our docker setup is fine now" if i % 2 else "ok") for i in range(20)]
    stream = files(spark, tmp_path / "in", rows, "id BIGINT, body STRING", 3)
    got = jobs.run_available(jobs.stream_classify(stream), "classify")
    batch = en.classify_replies(spark.createDataFrame(rows, "id BIGINT, body STRING"))
    assert sorted(got.select(batch.columns).collect()) == sorted(batch.collect())


def test_running_strikes(spark, tmp_path):
    rows = [(f"c{i % 4}" if i % 3 else "hot", 0.9 if i % 5 == 0 else 0.6) for i in range(60)]
    stream = files(spark, tmp_path / "in", rows, "candidate_id STRING, severity DOUBLE", 4)
    got = jobs.run_updates(jobs.stream_strikes(stream), "strikes", ["candidate_id"])
    want = {}
    for who, severity in rows:
        want[who] = want.get(who, 0) + (2 if severity > 0.8 else 1)
    assert {r.candidate_id: (r.strikes, r.eliminated) for r in got.collect()} == {k: (v, v >= 3) for k, v in want.items()}


def test_dedup_once_per_key(spark, tmp_path):
    rows = [(f"u{i % 7}" if i % 3 else "hot", "dev", START + timedelta(minutes=i)) for i in range(40)]
    stream = files(spark, tmp_path / "in", rows, "email STRING, role STRING, at TIMESTAMP", 4)
    got = jobs.run_available(jobs.stream_dedup(stream, horizon="2 hours"), "dedup")
    assert sorted((r.email, r.role) for r in got.collect()) == sorted({(e, r) for e, r, _ in rows})


@pytest.mark.parametrize("parts", [1, 6])
def test_stalls_do_not_depend_on_batches(spark, tmp_path, parts):
    hours = {"t1": [0, 1, 60, 61, 200], "t2": [5, 30, 70, 110, 150], "t3": [0, 49, 97.5], "t4": [2]}
    waits = lambda h: "replied" if h in (61, 30) else "awaiting_reply"
    rows = sorted((START + timedelta(hours=h), t, waits(h)) for t, hs in hours.items() for h in hs)
    rows.append((START + timedelta(hours=400), "end", "completed"))
    rows = [(t, at, i, state) for i, (at, t, state) in enumerate(rows)]
    stream = files(spark, tmp_path / f"in{parts}", rows, "thread_id STRING, at TIMESTAMP, seq BIGINT, to_state STRING", parts)
    got = jobs.run_available(jobs.stream_threads(stream), "stalls")
    found = sorted((r.thread_id, (r.last_activity - START).total_seconds() / 3600) for r in got.collect())
    # gaps over 48 h from a waiting state, and the last event of each thread
    assert found == [("t1", 1.0), ("t1", 200.0), ("t2", 150.0), ("t3", 0.0), ("t3", 49.0), ("t3", 97.5), ("t4", 2.0)]


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "thread_id STRING, at TIMESTAMP, seq BIGINT, to_state STRING"
    rows = [("t1", START + timedelta(hours=100), 1, "awaiting_reply"), ("x", START + timedelta(hours=300), 2, "completed"),
            ("t1", START + timedelta(hours=10), 3, "awaiting_reply"), ("y", START + timedelta(hours=301), 4, "completed")]
    stream = files(spark, tmp_path / "in", rows, schema, 4)
    got = jobs.run_available(jobs.stream_threads(stream), "stalls")
    # t1 timed out at hour 100; its row from hour 10 came long after the watermark.
    assert [(r.thread_id, (r.last_activity - START).total_seconds() / 3600) for r in got.collect()] == [("t1", 100.0)]


def test_late_copy_does_not_displace_the_one_on_time(spark, tmp_path):
    schema = "email STRING, role STRING, at TIMESTAMP, mark STRING"
    at = lambda h: START + timedelta(hours=h)
    rows = [("a", "dev", at(100), "first"), ("b", "dev", at(101), "b"), ("c", "dev", at(102), "c")]
    stream = files(spark, tmp_path / "in", rows, schema, 3)
    import os
    last = spark.createDataFrame([("x", "dev", at(1), "late"), ("x", "dev", at(103), "on time")], schema).coalesce(1)
    last.write.mode("append").parquet(str(tmp_path / "in"))
    for name in (tmp_path / "in").glob("*.parquet"):
        if name not in files.seen:
            os.utime(name, (1_700_001_000,) * 2)
    got = {(r.email, r.mark) for r in jobs.run_available(jobs.stream_dedup(stream, horizon="1 hour"), "dedup").collect()}
    assert got == {("a", "first"), ("b", "b"), ("c", "c"), ("x", "on time")}


@pytest.mark.parametrize("timeout,parts", [(0.5, 1), (0.5, 3), (0.1, 2), (1.5, 2)])
def test_stalls_below_one_hour(spark, tmp_path, timeout, parts):
    minutes = [0, 5, 50, 52, 54, 59, 61, 140, 141]
    rows = [("t", START + timedelta(minutes=m), i, "awaiting_reply") for i, m in enumerate(minutes)]
    rows.append(("end", START + timedelta(hours=400), 99, "completed"))
    stream = files(spark, tmp_path / "in", rows, "thread_id STRING, at TIMESTAMP, seq BIGINT, to_state STRING", parts)
    got = jobs.run_available(jobs.stream_threads(stream, timeout_hours=timeout), "stalls")
    found = sorted((r.last_activity - START).total_seconds() / 60 for r in got.collect())
    assert found == [a for a, b in zip(minutes, minutes[1:]) if b - a > 60 * timeout] + [minutes[-1]]


@pytest.mark.parametrize("parts", [1, 5])
def test_every_row_has_a_fate(spark, tmp_path, parts):
    """On time, late and duplicate rows add up, and the surviving rows are the right ones."""
    import random
    rng = random.Random(parts)
    schema = "email STRING, role STRING, at TIMESTAMP, mark INT"
    rows = [("hot" if k % 3 == 0 else f"u{rng.randrange(12)}", "dev", START + timedelta(minutes=10 * k - rng.choice([0, 0, 30, 400])), k)
            for k in range(200)]
    stream = files(spark, tmp_path / "in", rows, schema, parts)
    got = jobs.run_available(jobs.stream_fates(stream, order=("mark",), horizon="3 hours", lateness="2 hours"), "fates", "fate")
    want, kept, top, size = {}, {}, None, -(-len(rows) // parts)
    for a in range(0, len(rows), size):
        batch = rows[a:a + size]
        mark = top - timedelta(hours=2) if top else None
        for email, _, at, k in sorted(batch, key=lambda r: (r[2], r[3])):
            if mark and at < mark:
                want[k] = "late"
            elif email not in kept or at > kept[email] + timedelta(hours=3):
                kept[email], want[k] = at, "kept"
            else:
                want[k] = "duplicate"
        top = max([*([top] if top else []), *(r[2] for r in batch)])
    assert {r.mark: r.fate for r in got.collect()} == want and got.count() == len(rows)
    assert (parts == 1) == ("late" not in want.values())


@pytest.mark.parametrize("parts", [0, 3])
def test_streams_read_tables_of_one_file_or_several(spark, tmp_path, parts):
    rows = spark.range(20).withColumn("body", F.concat(F.lit("text "), "id"))
    if parts:
        rows.repartition(parts).write.parquet(str(tmp_path / "replies.parquet"))
    else:
        rows.toPandas().to_parquet(tmp_path / "replies.parquet")
    rows.limit(1).write.parquet(str(tmp_path / "others.parquet"))
    stream = jobs.stream_parquet(spark, str(tmp_path), "replies.parquet")
    assert sorted(r.id for r in jobs.run_available(stream, "read").collect()) == list(range(20))
