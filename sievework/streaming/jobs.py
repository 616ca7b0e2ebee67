"""Structured Streaming jobs over the same expressions as the batch operators."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sievework import lexicons as lx
from sievework.functions import rules
from sievework.operators.engagement import classify_replies
from sievework.operators.keyed import latest_per_key
from sievework.session import new_path, ship_package


def stream_parquet(spark: SparkSession, folder: str, glob: str, files_per_batch: int = 1) -> DataFrame:
    """A file stream over what matches ``glob`` in ``folder``: Parquet files, or tables of several files."""
    # A file stream takes a single file only by a pattern; braces match just the name in them.
    path = f"{folder}/{glob}" if set(glob) & set("*?[{") else f"{folder}/{{{glob}}}"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_available(stream: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Append what is available to a new Parquet table and return that table."""
    spark = stream.sparkSession
    path, state = new_path(spark, label), new_path(spark, label + "-state")
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_updates(stream: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """Store each batch's changed rows under its batch id; return the latest per key.

    A batch that is run again after a failure overwrites its own folder.
    """
    spark = stream.sparkSession
    path, state = new_path(spark, label), new_path(spark, label + "-state")

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(save).outputMode("update")
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    updates = spark.read.option("basePath", path).parquet(path)
    return latest_per_key(updates, keys, ["batch"]).drop("batch")


def stream_classify(replies: DataFrame, text: str = "body", **lexicons) -> DataFrame:
    """Stateless: every reply of the stream with its class."""
    return classify_replies(replies, text, **lexicons)


def stream_strikes(events: DataFrame, limit: int = lx.STRIKE_LIMIT) -> DataFrame:
    """Running strikes per applicant from (candidate_id, severity), for update mode."""
    return events.groupBy("candidate_id").agg(
        F.sum(rules.strikes_for(F.col("severity"))).alias("strikes")
    ).withColumn("eliminated", F.col("strikes") >= limit)


def stream_dedup(applications: DataFrame, at: str = "at", keys: tuple[str, ...] = ("email", "role"),
                 horizon: str = "1 hour") -> DataFrame:
    """One application per key within the horizon: the first on time to arrive.

    Rows that come after the watermark are left out before copies are looked for, so a
    late copy never stands in the way of one that is on time.
    """
    return applications.withWatermark(at, horizon).dropDuplicatesWithinWatermark(list(keys))


#: What becomes of a row of ``stream_fates``, and its number in the state function.
FATES = ("kept", "duplicate", "late")
KEPT, DUPLICATE, LATE = range(3)


def stream_fates(applications: DataFrame, at: str = "at", keys: tuple[str, ...] = ("email", "role"),
                 order: tuple[str, ...] = (), horizon: str = "1 hour", lateness: str = "1 hour",
                 buckets: int | None = None) -> DataFrame:
    """Every row of the stream with its ``fate``: ``kept``, ``duplicate`` or ``late``.

    A row is late if it lies before the watermark (``lateness`` behind the latest time of
    earlier batches) as its batch starts.  Of the others, the first of a key is kept, in order
    of arrival and within a batch of time and the ``order`` columns; rows of the key up to
    ``horizon`` behind the kept one are duplicates, the next one beyond is kept again.  Rows
    with a null time are late.  No row is lost: written partitioned by fate, late rows are a
    table of their own, and the three tables add up to what was read.

    Keys are dealt to ``buckets`` by a hash (by default four times the shuffle partitions; a
    stream that is restarted needs the number it began with); a bucket's state has the time of each key kept, and
    forgets those that the watermark has passed by ``horizon`` whenever it gets rows.
    """
    ship_package(applications.sparkSession)
    span_us = int(pd.Timedelta(horizon).total_seconds() * 1e6)
    columns = applications.columns
    moment, bucket = "__us", "__bucket"
    buckets = buckets or 4 * int(applications.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = applications.select("*", F.lit(0).alias("fate")).schema
    sort = [moment, *order]

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now_us = state.getCurrentWatermarkMs() * 1000
        rows = pd.concat(list(batches), ignore_index=True).sort_values(sort, kind="stable")
        known = json.loads(state.get[0]) if state.exists else {}
        kept = {k: us for k, us in known.items() if us + span_us >= now_us}
        fates = []
        for us, *names in zip(rows[moment], *(rows[k] for k in keys)):
            name = json.dumps(names, default=str)
            if pd.isna(us) or us < now_us:
                fates.append(LATE)
            elif name not in kept or us > kept[name] + span_us:
                kept[name] = int(us)
                fates.append(KEPT)
            else:
                fates.append(DUPLICATE)
        state.update((json.dumps(kept),))
        yield rows[columns].assign(fate=fates)

    timed = applications.withWatermark(at, lateness).withColumn(moment, F.unix_micros(F.col(at).cast("timestamp")))
    told = timed.withColumn(bucket, F.pmod(F.xxhash64(*keys), F.lit(buckets))).groupBy(bucket).applyInPandasWithState(
        follow, schema, "kept STRING", "append", GroupStateTimeout.NoTimeout)
    return told.withColumn("fate", F.get(F.array(*map(F.lit, FATES)), F.col("fate")))


STALL_SCHEMA = "thread_id STRING, last_activity TIMESTAMP, state STRING"
_STATE_SCHEMA = "last_us BIGINT, last_seq BIGINT, last_state STRING"
_SPAN_SCHEMA = ("thread_id STRING, at TIMESTAMP, first_us BIGINT, last_us BIGINT, "
                "last_seq BIGINT, last_state STRING")
_HOUR_US = 3_600_000_000


def stream_threads(events: DataFrame, timeout_hours: float = lx.TIMEOUT_HOURS,
                   lateness: str = "1 hour", waiting: tuple[str, ...] = tuple(lx.WAITING_STATES),
                   ) -> DataFrame:
    """A row for every time a waiting thread stays silent longer than the timeout.

    From thread events (thread_id, at, seq, to_state).  A silence that ends is seen
    between a thread's consecutive events; one that does not is found when the
    watermark passes its deadline, after which the thread's state is dropped.

    A busy thread shrinks before it is exchanged: only its first and last event in each
    span of time are kept.  A span is no longer than the timeout, so a silence that is too
    long never lies inside one.
    """
    ship_package(events.sparkSession)
    timeout_us = int(timeout_hours * _HOUR_US)
    width = max(1, min(_HOUR_US, timeout_us))

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            rows = batch.sort_values(["us", "seq"], kind="stable")
            rows["span"] = rows["us"] // width
            groups = rows.groupby(["thread_id", "span"], sort=False)
            out = groups.agg(first_us=("us", "first"), last_us=("us", "last"),
                             last_seq=("seq", "last"), last_state=("to_state", "last")).reset_index()
            out["at"] = pd.to_datetime(out["last_us"], unit="us")
            yield out[["thread_id", "at", "first_us", "last_us", "last_seq", "last_state"]]

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
               ) -> Iterator[pd.DataFrame]:
        stalls: list[tuple[int, str]] = []
        if state.hasTimedOut:
            last_us, _, last_state = state.get
            if last_state in waiting:
                stalls.append((last_us, last_state))
            state.remove()
        else:
            met: dict[int, list] = {}
            for batch in batches:
                for row in batch.itertuples(index=False):
                    slot = met.setdefault(
                        row.last_us // width, [row.first_us, row.last_us, row.last_seq, row.last_state])
                    slot[0] = min(slot[0], row.first_us)
                    if (row.last_us, row.last_seq) > (slot[1], slot[2]):
                        slot[1:] = [row.last_us, row.last_seq, row.last_state]
            spans = sorted(met.values())
            if state.exists:
                last_us, last_seq, last_state = state.get
                spans = sorted([*spans, [last_us, last_us, last_seq, last_state]])
            for before, after in zip(spans, spans[1:]):
                if before[3] in waiting and after[0] - before[1] > timeout_us:
                    stalls.append((before[1], before[3]))
            newest = max(spans, key=lambda s: (s[1], s[2]))
            state.update((int(newest[1]), int(newest[2]), newest[3]))
            deadline_ms = (int(newest[1]) + timeout_us) // 1000 + 1
            state.setTimeoutTimestamp(max(deadline_ms, state.getCurrentWatermarkMs() + 1))
        if stalls:
            yield pd.DataFrame({
                "thread_id": key[0],
                "last_activity": pd.to_datetime([us for us, _ in stalls], unit="us"),
                "state": [s for _, s in stalls]})

    slim = events.select(
        F.col("thread_id").cast("string").alias("thread_id"),
        F.unix_micros(F.col("at").cast("timestamp")).alias("us"),
        F.col("seq").cast("bigint").alias("seq"), "to_state")
    spans_of = slim.mapInPandas(ends, _SPAN_SCHEMA).withWatermark("at", lateness)
    return spans_of.groupBy("thread_id").applyInPandasWithState(
        follow, STALL_SCHEMA, _STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)
