"""Mixing of overlapping sources to target weights by min-cost flow.

Documents are added up by membership pattern, the set of sources they belong to.  A flow
sends each pattern's words to its sources up to their quotas; the first copy of a word is
free, every further one costs more, so repetition is used where nothing else is left.  The
graph has one node per pattern and source, whatever the number of documents.  Documents are
then taken in a seeded order, copy by copy, until the flow of their pattern is used up.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Mapping, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm.common import free_name
from sievework.session import stage

#: Cost of a word's first, second and further copies; convex, so they are used in this order.
COPY_COSTS = (0, 1, 3)
#: Patterns and sources that the driver solves for; more need a coarser notion of source.
PATTERNS = 50_000
#: Documents of a pattern that are looked at one by one where a quota ends.
BUCKET_ROWS, BUCKETS = 1024, 1 << 20
WEIGHTS = (5, 2, 1)


def words_in(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: Mapping[str | None, int], weights: Sequence[float] = WEIGHTS, most: float = 3.0) -> dict[str | None, float]:
    """Words each source should give: shares by weight of all words, at most ``most`` times its
    own; what a source cannot take is shared again by weight.

    Sources by code point, null last, take the weights in turn.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out: dict[str | None, float] = {}
    left, open_ = float(sum(sizes.values())), names
    while open_:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        full = [s for s in open_ if share[s] > most * sizes[s]]
        if not full:
            return out | share
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def flow(patterns: Mapping[tuple, int], quotas: Mapping[str | None, int],
         costs: Sequence[int] = COPY_COSTS) -> dict[tuple, int]:
    """Words sent per (pattern, copy number, source): a largest flow, and of those a cheapest.

    ``patterns`` are tuples of sources with their words.  Successive shortest augmenting
    paths, with potentials, over start - pattern (one arc per copy) - source - end.
    """
    nodes = {"start": 0, "end": 1}
    heads: list[list[int]] = [[], []]
    to: list[int] = []
    room: list[int] = []
    price: list[int] = []

    def node(key) -> int:
        if key not in nodes:
            nodes[key] = len(heads)
            heads.append([])
        return nodes[key]

    def arc(a: int, b: int, capacity: int, cost: int) -> int:
        for x, y, c, p in ((a, b, capacity, cost), (b, a, 0, -cost)):
            heads[x].append(len(to))
            to.append(y)
            room.append(c)
            price.append(p)
        return len(to) - 2

    supply, routes = {}, {}
    for pattern, words in sorted(patterns.items(), key=lambda x: [(s is None, s or "") for s in x[0]]):
        p = node(("pattern", pattern))
        supply[pattern] = [arc(0, p, words, cost) for cost in costs]
        for source in pattern:
            routes[pattern, source] = arc(p, node(("source", source)), words * len(costs), 0)
    for source, quota in quotas.items():
        arc(node(("source", source)), 1, quota, 0)
    potential = [0] * len(heads)
    while True:
        best, back = [None] * len(heads), [-1] * len(heads)
        best[0] = 0
        queue = [(0, 0)]
        while queue:
            d, at = heapq.heappop(queue)
            if d > best[at]:
                continue
            for e in heads[at]:
                if room[e] > 0:
                    new = d + price[e] + potential[at] - potential[to[e]]
                    if best[to[e]] is None or new < best[to[e]]:
                        best[to[e]], back[to[e]] = new, e
                        heapq.heappush(queue, (new, to[e]))
        if best[1] is None:
            break
        far = max(b for b in best if b is not None)
        potential = [p + (far if b is None else b) for p, b in zip(potential, best)]
        path, at = [], 1
        while at:
            path.append(back[at])
            at = to[back[at] ^ 1]
        amount = min(room[e] for e in path)
        for e in path:
            room[e] -= amount
            room[e ^ 1] += amount
    out = {}
    for pattern in patterns:
        # Copies fill up in order; sources share them in their order.
        copies = [[k, room[e ^ 1]] for k, e in enumerate(supply[pattern], 1)]
        for source in pattern:
            need = room[routes[pattern, source] ^ 1]
            for c in copies:
                used = min(need, c[1])
                if used:
                    out[pattern, c[0], source] = used
                    c[1] -= used
                    need -= used
    return out


def mix(docs: DataFrame, sources: Column, size: Column, quotas_of: Callable[[dict], Mapping],
        order: Column, costs: Sequence[int] = COPY_COSTS) -> DataFrame:
    """``docs`` with what the mix takes of each row: ``copies``, and ``routed``, an array of
    (source, copy) that says which source each copy goes to.

    ``sources`` is an array of strings (a null element is a source of its own), ``size`` a
    count of words, ``quotas_of`` a function from the words per source (a document counts in
    each of its sources) to the words wanted per source, and ``order`` a 64-bit hash that
    decides who is taken first, so that reruns agree.  Documents without words or sources
    are not taken.  Rows stay where they are, but for those of the few buckets of the seeded
    order in which a quota ends.

    A null size counts as 0.  Rows with equal ``order`` are taken by size, then by their string
    and number columns; rows that repeat whole are rows each, of which a quota that ends among
    them takes some.  Texts of any length are whole; a row larger than what is left of a quota
    is passed over.  Columns with the names of the results keep them, and the results get
    underscores in front.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    copies, routed, pattern, words, key, bucket = (free_name(docs, n) for n in (
        "copies", "routed", "mix_pattern", "mix_size", "mix_order", "mix_bucket"))
    named = F.coalesce(F.to_json(F.array_sort(F.array_distinct(sources))), F.lit("[]"))
    rows = docs.withColumns({pattern: named, words: F.coalesce(size, F.lit(0)).cast("long"), key: order})
    totals = rows.groupBy(pattern).agg(F.sum(words), F.count(F.lit(1))).limit(PATTERNS + 1).collect()
    if len(totals) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} membership patterns: use coarser sources")
    patterns = {tuple(json.loads(p)): w for p, w, _ in totals}
    names = {tuple(json.loads(p)): p for p, _, _ in totals}
    sizes: dict[str | None, int] = {}
    for sources_of, w in patterns.items():
        for s in sources_of:
            sizes[s] = sizes.get(s, 0) + w
    sent = flow({p: w for p, w in patterns.items() if p and w}, quotas_of(sizes), costs)
    # A pattern's seeded order is cut into buckets, each a bounded number of rows.
    cuts = {p: max(1, min(BUCKETS, -(-n // BUCKET_ROWS))) for p, _, n in totals}
    table = broadcast_rows(spark, sorted(cuts.items()), f"{pattern} string, buckets int")
    place = F.shiftrightunsigned(key, 43).cast("long")  # 21 bits of the hash
    dealt = rows.join(table, pattern).withColumn(
        bucket, F.shiftright(place * F.col("buckets"), 21).cast("int")).drop("buckets")
    sums = dealt.groupBy(pattern, bucket).agg(F.sum(words).alias("words"))
    before = Window.partitionBy(pattern).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = stage(sums.withColumn("from", F.coalesce(F.sum("words").over(before), F.lit(0)))
                 .withColumn("to", F.col("from") + F.col("words")), "mix-buckets")
    # Stretches: words lo to hi of a pattern's order whose copy number k goes to a source.
    stretches, filled = [], {}
    for (p, k, s), w in sorted(sent.items(), key=lambda x: (names[x[0][0]], x[0][1], x[0][2] is None, x[0][2] or "")):
        lo = filled.get((p, k), 0)
        filled[p, k] = lo + w
        stretches.append((names[p], k, s, lo, lo + w))
    planned = broadcast_rows(spark, stretches, f"{pattern} string, copy int, source string, lo long, hi long")
    met = sums.join(planned, pattern).filter((F.col("lo") < F.col("to")) & (F.col("hi") > F.col("from")))
    ends = (F.col("lo") > F.col("from")) | (F.col("hi") < F.col("to"))
    spots = met.groupBy(pattern, bucket).agg(
        F.max(ends).alias("parted"),
        F.sort_array(F.collect_list(F.struct("copy", "lo", "hi", "source", "from"))).alias("stretch"))
    # Whole buckets of one pattern with the same sources are runs: a few per stretch.
    whole = spots.filter("not parted").select(pattern, bucket, F.transform("stretch", lambda x: F.struct(
        x["source"].alias("source"), x["copy"].alias("copy"))).alias("stretch"))
    runs = stage(whole.groupBy(pattern, "stretch").agg(F.min(bucket).alias("first"), F.max(bucket).alias("last")), "mix-runs")
    parted = stage(spots.filter("parted").select(pattern, F.col(bucket).alias("at"), "stretch"), "mix-ends")
    most = len(stretches) + len(patterns)
    assert runs.count() <= 2 * most and parted.count() <= 2 * most, "runs follow from the stretches"
    split = dealt.join(F.broadcast(parted.select(pattern, F.col("at").alias(bucket), F.lit(True).alias("parted"))),
                       [pattern, bucket], "left")
    inside = split.filter("parted is null").join(
        F.broadcast(runs.withColumnRenamed(pattern, "of")),
        (F.col(pattern) == F.col("of")) & F.col(bucket).between(F.col("first"), F.col("last")), "left")
    kind = "array<struct<source:string,copy:int>>"
    # Runs of several stretches can interleave only where a bucket is parted, so at most one is met.
    plain = inside.select(*docs.columns, F.when(F.col(words) > 0, F.col("stretch")).cast(kind).alias(routed))
    edge = split.filter("parted").drop("parted").join(
        F.broadcast(parted.select(pattern, F.col("at").alias(bucket), "stretch")), [pattern, bucket])
    schema = T.StructType([*docs.schema.fields, T.StructField(routed, T._parse_datatype_string(kind))])

    kept = docs.columns
    told_apart = [f.name for f in docs.schema.fields if isinstance(f.dataType, (T.StringType, T.NumericType))]

    def fill(group: pa.Table) -> pa.Table:
        sizes_, keys = group.column(words).to_pylist(), group.column(key).to_pylist()
        shown = [group.column(c).to_pylist() for c in told_apart]
        ranked = sorted(range(len(sizes_)), key=lambda k: (keys[k], sizes_[k], *[(c[k] is None, str(c[k])) for c in shown]))
        got: list[list[dict]] = [[] for _ in sizes_]
        end = sum(sizes_)
        for copy, parts in groupby(group.column("stretch")[0].as_py(), key=lambda x: x["copy"]):
            free = [k for k in ranked if sizes_[k]]
            for part in parts:
                start = part["from"]
                goes_on, room = part["hi"] >= start + end, min(part["hi"], start + end) - max(part["lo"], start)
                rest = []
                for k in free:
                    if goes_on or sizes_[k] <= room:
                        room -= sizes_[k]
                        got[k].append({"source": part["source"], "copy": copy})
                    else:
                        rest.append(k)
                free = rest
        out = group.select(kept)
        routes = pa.array(got, pa.list_(pa.struct([("source", pa.string()), ("copy", pa.int32())])))
        return out.append_column(routed, routes)

    filled_in = edge.groupBy(pattern, bucket).applyInArrow(fill, schema)
    both = plain.unionByName(filled_in)
    return both.withColumn(copies, F.coalesce(F.size(routed), F.lit(0)))


def broadcast_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A driver-made table, as small as the flow's graph, marked for broadcast."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def weighted_quotas(weights: Sequence[float] = WEIGHTS, most: int = len(COPY_COSTS)) -> Callable[[dict], dict]:
    """Quotas for ``mix``: the ``targets`` in whole words."""
    return lambda sizes: {s: round(t) for s, t in targets(sizes, weights, most).items()}


def mix_by_weight(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                  source_column: str = "source", seed: int = 42) -> DataFrame:
    """``docs`` with each row as often as the mix of its source takes it, up to three times.

    A null text has no words and is not taken; a null source is a source of its own.  Ties,
    repeated rows, very long texts, clashing names and empty tables as in ``mix``.
    """
    mixed = mix(docs, F.array(F.col(source_column).cast("string")), words_in(F.col(text_column)), weighted_quotas(),
                F.xxhash64(F.lit(seed), F.col(id_column), F.col(text_column)))
    copies = mixed.columns[-1]
    return mixed.withColumn(copies, F.explode(F.array_repeat(F.lit(1), F.col(copies)))).select(*docs.columns)
