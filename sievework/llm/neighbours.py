"""Approximate nearest neighbours by inner product: an NN-descent graph and greedy search.

Vectors that are equal are one node.  Nodes lie in parts of bounded size around sampled
pivots.  The graph starts from the nearest nodes inside a part, then improves by joins:
around every node its neighbours and reverse neighbours are compared with each other, since
neighbours of neighbours are likely neighbours.  A part's task gets the vectors it needs
once each.  Queries walk the graph greedily: a task walks inside its part as far as a beam
leads, and what the beam reaches in other parts is the next round's start there.

For unequal norms the graph is built on vectors with one more component that makes all norms
equal, so that near in the graph means near in distance; search scores are plain inner products.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.session import stage

#: Neighbours a node keeps, reverse neighbours it takes into account, refinement rounds, and
#: the share of changed neighbours below which refinement ends.
NEIGHBOURS, REVERSE, ROUNDS, CHANGED = 24, 16, 5, 0.002
#: Nodes of a part, and pivots (a bounded sample of the vectors; 1 MB at 64 components).
PART_NODES, PIVOTS = 1536, 4096
#: Width of the beam of a search, and nodes of it whose neighbours are looked at together.
BEAM, STEP = 240, 16


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def node_table(rows: DataFrame, most: int) -> DataFrame:
    """Distinct vectors: ``node`` (least id), ``vec``, ``members`` (the ``most`` least ids).

    The row number is limited in each task before rows are exchanged, so a vector that very
    many rows share sends a few rows per task.
    """
    rank = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    few = rows.withColumn("rank", rank).filter(F.col("rank") <= most)
    return stage(few.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("members"))
                 .select(F.col("members")[0].alias("node"), "vec", "members"), "vector-nodes")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(array), -1) if len(array) else np.zeros((0, 1))


def extended(vectors: np.ndarray, norm: float) -> np.ndarray:
    """Vectors with a last component that gives all of them the norm ``norm``."""
    rest = np.sqrt(np.maximum(norm * norm - (vectors * vectors).sum(1), 0))
    return np.c_[vectors, rest]


def with_parts(nodes: DataFrame, count: int, seed: int, norm: float) -> DataFrame:
    """``nodes`` with ``part``: the nearest pivot, cut by hash where too many share it."""
    order = F.xxhash64("node", F.lit(seed))
    pivots = nodes.select("node", "vec").orderBy(order, "node").limit(max(1, min(PIVOTS, count // (PART_NODES // 2)))).collect()
    table = extended(np.array([p.vec for p in pivots], float), norm)

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            near = [(extended(_matrix(part.column(1).slice(at, 2000)), norm) @ table.T).argmax(1)
                    for at in range(0, part.num_rows, 2000)]
            cells = np.concatenate(near).astype(np.int32) if near else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells)], names=[*part.schema.names, "cell"])

    placed = stage(nodes.mapInArrow(task, "node long, vec array<float>, members array<long>, cell int"), "vector-cells")
    cuts = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART_NODES).alias("cuts"))  # a row per pivot at most
    cut = F.pmod(F.xxhash64("node", F.lit(seed + 1)), F.col("cuts"))
    return placed.join(F.broadcast(cuts), "cell").withColumn(
        "part", F.col("cell").cast("long") * (1 << 32) + cut).drop("cell", "cuts")


def _nearest(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` largest entries of each row."""
    if scores.shape[1] <= k:
        return np.argsort(-scores, axis=1, kind="stable")
    return np.argpartition(-scores, k - 1, axis=1)[:, :k]


def _edges(a: np.ndarray, b: np.ndarray, score: np.ndarray) -> pa.Table:
    return pa.table({"node": pa.array(a, pa.int64()), "other": pa.array(b, pa.int64()), "score": pa.array(score, pa.float64())})


EDGES = "node long, other long, score double"


def nearest_in_parts(parted: DataFrame, k: int, norm: float) -> DataFrame:
    """Edges from every node to the ``k`` nearest of its part; a part is bounded."""

    def task(group: pa.Table) -> pa.Table:
        ids, vec = group.column("node").to_numpy(), extended(_matrix(group.column("vec")), norm)
        a, b, s = [], [], []
        for at in range(0, len(ids), 512):
            score = vec[at:at + 512] @ vec.T
            score[np.arange(len(score)), np.arange(at, at + len(score))] = -np.inf
            top = _nearest(score, min(k, len(ids) - 1)) if len(ids) > 1 else np.zeros((len(score), 0), int)
            a.append(np.repeat(ids[at:at + 512], top.shape[1]))
            b.append(ids[top.ravel()])
            s.append(np.take_along_axis(score, top, 1).ravel())
        return _edges(*map(np.concatenate, (a, b, s)))

    return parted.select("part", "node", "vec").groupBy("part").applyInArrow(task, EDGES)


def best_edges(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` best distinct edges of each node; limited in each task before the exchange."""
    one = edges.groupBy("node", "other").agg(F.max("score").alias("score"), F.max("old").alias("old"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "other"))
    return one.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def neighbourhoods(graph: DataFrame, reverse: int) -> DataFrame:
    """Distinct (node, other, fresh): the graph's edges and each node's best reverse edges."""
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "other"))
    back = graph.select(F.col("other").alias("node"), F.col("node").alias("other"), "score", "old")
    back = back.withColumn("rank", rank).filter(F.col("rank") <= reverse).drop("rank")
    return graph.unionByName(back).groupBy("node", "other").agg(F.max("old").alias("old"))


def refined(graph: DataFrame, parted: DataFrame, k: int, reverse: int, norm: float) -> DataFrame:
    """One round of NN-descent: edges found around common neighbours, better than the worst kept."""
    where = parted.select("node", "part")
    hood = stage(neighbourhoods(graph, reverse).join(where, "node"), "neighbourhoods")
    worst = graph.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    floor = parted.select("node", "vec").join(worst, "node", "left").select(
        "node", "vec", F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(float("-inf"))).alias("floor"))
    needed = stage(hood.select("part", F.col("other").alias("node")).distinct().join(floor, "node"), "needed")

    def task(near: pa.Table, vectors: pa.Table) -> pa.Table:
        ids = vectors.column("node").to_numpy()
        order = np.argsort(ids)
        ids, vec = ids[order], extended(_matrix(vectors.column("vec"))[order], norm)
        floor_ = vectors.column("floor").to_numpy()[order]
        node, other = near.column("node").to_numpy(), np.searchsorted(ids, near.column("other").to_numpy())
        old = near.column("old").to_numpy(zero_copy_only=False)
        by = np.argsort(node, kind="stable")
        node, other, old = node[by], other[by], old[by]
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        sizes = np.diff(np.r_[starts, len(node)])
        width = int(sizes.max())
        slots = np.full((len(starts), width), -1)
        fresh = np.zeros((len(starts), width), bool)
        row = np.repeat(np.arange(len(starts)), sizes)
        column = np.arange(len(node)) - np.repeat(starts, sizes)
        slots[row, column], fresh[row, column] = other, old == 0
        keep: dict = {"a": [], "b": [], "s": []}
        for at in range(0, len(starts), 256):
            s, f = slots[at:at + 256], fresh[at:at + 256]
            v = vec[np.maximum(s, 0)]
            score = np.matmul(v, v.transpose(0, 2, 1))
            # Pairs of which one is fresh; others have met before.
            ok = (s[:, :, None] >= 0) & (s[:, None, :] >= 0) & (f[:, :, None] | f[:, None, :]) & (s[:, :, None] != s[:, None, :])
            ok &= score > floor_[np.maximum(s, 0)][:, :, None]
            g, i, j = np.nonzero(ok)
            keep["a"].append(s[g, i])
            keep["b"].append(s[g, j])
            keep["s"].append(score[g, i, j])
        a, b, s = (np.concatenate(keep[c]) for c in "abs")
        _, first = np.unique(a * len(ids) + b, return_index=True)
        a, b, s = a[first], b[first], s[first]
        # Of what a part finds for a node, only its k best can matter.
        ranked = np.lexsort((-s, a))
        a, b, s = a[ranked], b[ranked], s[ranked]
        place = np.arange(len(a)) - np.searchsorted(a, a, "left")
        good = place < k
        return _edges(ids[a[good]], ids[b[good]], s[good])

    return hood.groupBy("part").cogroup(needed.groupBy("part")).applyInArrow(task, EDGES)


def build(nodes: DataFrame, k: int = NEIGHBOURS, reverse: int = REVERSE, rounds: int = ROUNDS,
          seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The graph (node, other, score, old) of ``node_table`` rows, and the rows with ``part``."""
    count, norm = nodes.select(F.count(F.lit(1)), F.max(F.sqrt(F.aggregate(
        "vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))).first()
    norm = float(norm or 0.0)
    parted = stage(with_parts(nodes, count, seed, norm), "vector-parts")
    second = with_parts(nodes, count, seed + 100, norm)
    start = nearest_in_parts(parted, k, norm).unionByName(nearest_in_parts(second, k, norm))
    graph = stage(best_edges(start.withColumn("old", F.lit(0)), k), "graph")
    for _ in range(rounds):
        found = refined(graph, parted, k, reverse, norm).withColumn("old", F.lit(0))
        graph = stage(best_edges(graph.withColumn("old", F.lit(1)).unionByName(found), k), "graph")
        if graph.filter("old = 0").count() <= CHANGED * k * count:
            break
    return graph, parted


def shards(graph: DataFrame, parted: DataFrame, reverse: int) -> DataFrame:
    """What a part's search needs: its nodes with their neighbours, and the vectors of these.

    Rows: part, node, vec, home (the node's own part), near (array; null if not of this part).
    """
    hood = neighbourhoods(graph, reverse).groupBy("node").agg(F.sort_array(F.collect_list("other")).alias("near"))
    own = stage(parted.select("part", "node", "vec").join(hood, "node", "left").select(
        "part", "node", "vec", F.col("part").alias("home"),
        F.coalesce("near", F.array().cast("array<long>")).alias("near")), "own-nodes")
    outer = own.select("part", F.explode("near").alias("node")).distinct().join(
        own.select(F.col("part").alias("home"), "node", "vec"), "node").filter("part <> home")
    return stage(own.unionByName(outer.select("part", "node", "vec", "home", F.lit(None).cast("array<long>").alias("near"))),
                 "shards")


def walk(query: np.ndarray, entries: list[int], done: set[int], vec: np.ndarray, near: list, beam: int,
         held: Sequence[float] = (), known: np.ndarray | None = None) -> dict[int, tuple[float, bool]]:
    """Greedy search in one shard: position to (score, whether its neighbours were looked at).

    ``entries`` are the positions of the beam that lie in this shard, ``held`` the scores of
    those that do not, ``done`` positions whose neighbours other rounds have looked at, and ``known``
    tells where ``near`` is not None.  The ``STEP`` best of the beam that nobody looked at are looked at
    together.  Positions that do not reach the beam are left out.
    """
    known = np.array([n is not None for n in near], bool) if known is None else known
    unseen, looked, score = np.ones(len(vec), bool), np.zeros(len(vec), bool), np.empty(len(vec))
    looked[list(done)] = True
    best, least = np.asarray(held, float), -np.inf  # the beam's scores, and the least of a full one
    open_, met = np.zeros(0, np.int64), []
    new = np.unique(np.asarray(entries, np.int64))
    while len(new) or len(open_):
        if len(new):
            unseen[new] = False
            score[new] = (vec[new] * query).sum(1)
            best = np.r_[best, score[new]]
            if len(best) >= beam:
                best = np.partition(best, len(best) - beam)[len(best) - beam:]
                least = best[0]
            new = new[score[new] >= least]
            met.append(new)
            open_ = np.r_[open_, new[known[new] & ~looked[new]]]
        open_ = open_[score[open_] >= least]
        if len(open_) > STEP:
            first = np.argpartition(-score[open_], STEP - 1)
            ask, open_ = open_[first[:STEP]], open_[first[STEP:]]
        else:
            ask, open_ = open_, open_[:0]
        looked[ask] = True
        new = np.unique(np.concatenate([np.asarray(near[p], np.int64) for p in ask])) if len(ask) else ask
        new = new[unseen[new]]
    seen = np.concatenate(met) if met else open_
    seen = seen[score[seen] >= least]
    return dict(zip(seen.tolist(), zip(score[seen].tolist(), looked[seen].tolist())))


def search(queries: DataFrame, shard: DataFrame, beam: int = BEAM) -> DataFrame:
    """The ``beam`` nodes found for each query: query, node, score.

    ``queries``: query (a node's id) and qvec; a search starts at the query's own node.
    Rounds end when no node of any beam is left whose neighbours nobody looked at.
    """
    where = shard.filter("near is not null").select("node", "part")
    found = stage(queries.join(where, queries["query"] == where["node"]).select(
        "query", "node", F.lit(None).cast("double").alias("score"), F.lit(False).alias("seen"), F.col("part").alias("home")), "found")
    state = "query long, node long, score double, seen boolean, home long"

    def task(asked: pa.Table, local: pa.Table) -> pa.Table:
        ids = local.column("node").to_numpy()
        order = np.argsort(ids)
        ids, vec, homes = ids[order], _matrix(local.column("vec"))[order], local.column("home").to_numpy()[order]
        lists = local.column("near").combine_chunks()
        known = lists.is_valid().to_numpy(zero_copy_only=False)[order]
        ends = np.cumsum(pc.coalesce(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        targets = np.searchsorted(ids, lists.flatten().to_numpy())
        near = np.split(targets, ends[:-1])
        near = [near[k] if there else None for k, there in zip(order.tolist(), known.tolist())]
        beams = asked.column("held").combine_chunks()
        stops = np.cumsum(pc.list_value_length(beams).to_numpy(zero_copy_only=False)).tolist()
        node, score, seen = (beams.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("node", "score", "seen"))
        place = np.minimum(np.searchsorted(ids, node), len(ids) - 1)
        inside = ids[place] == node
        qvecs = _matrix(asked.column("qvec"))
        out = []
        for query, qvec, a, b in zip(asked.column("query").to_pylist(), qvecs, [0, *stops], stops):
            here, at = inside[a:b], place[a:b]
            old = {p: (s, looked) for p, s, looked in zip(at[here].tolist(), score[a:b][here].tolist(), seen[a:b][here].tolist())}
            got = walk(qvec, list(old), {p for p, (_, looked) in old.items() if looked}, vec, near, beam, score[a:b][~here], known)
            # Only what is new: nodes that reach the beam, and nodes looked at just now.
            out += [(query, int(ids[p]), s, looked, int(homes[p])) for p, (s, looked) in got.items()
                    if p not in old or np.isnan(old[p][0]) or looked and not old[p][1]]
        columns = list(zip(*out)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.int64()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["query", "node", "score", "seen", "home"])

    best = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    while True:
        pending = found.filter("not seen").select("query", F.col("home").alias("part")).distinct()
        if pending.isEmpty():
            return found.select("query", "node", "score")
        # Each part that is asked gets the query's whole beam, so that it stops where the beam ends.
        beams = found.groupBy("query").agg(F.collect_list(F.struct("node", "score", "seen")).alias("held"))
        asked = pending.join(beams, "query").join(queries, "query")
        news = asked.groupBy("part").cogroup(shard.groupBy("part")).applyInArrow(task, state)
        merged = found.filter("score is not null").unionByName(news).groupBy("query", "node").agg(
            F.max("score").alias("score"), F.max("seen").alias("seen"), F.max("home").alias("home"))
        found = stage(merged.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= beam).drop("rank"), "found")


def nearest(table: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id",
            vector_column: str = "embedding", beam: int = BEAM, neighbours: int = NEIGHBOURS) -> DataFrame:
    """For each row that ``is_query``: its ``k`` nearest other rows found, by inner product in
    double precision: ``query_id``, ``rank`` (from 1), the id, ``score``.

    Ties go to the smaller id.  Vectors that are null, zero or hold a null or non-finite
    component, and rows with a null id, take no part.  Repeated ids each count as a row of
    their class and are returned once.  With fewer than ``k`` other rows all are returned; an
    empty table gives no rows.  All vectors must have one length.
    """
    beam = max(beam, k + 1)
    rows = table.filter(F.col(id_column).isNotNull() & usable(F.col(vector_column)))
    rows = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<float>").alias("vec"),
                       F.coalesce(is_query, F.lit(False)).alias("asks")).dropDuplicates(["id"])
    rows = stage(rows, "vectors")
    nodes = node_table(rows.select("id", "vec"), k + 1)
    if nodes.isEmpty():
        return table.sparkSession.createDataFrame([], f"query_id long, rank int, `{id_column}` long, score double")
    graph, parted = build(nodes, max(neighbours, k))
    # Queries with one vector share one search.
    asking = stage(rows.filter("asks").join(nodes.select("vec", "node"), "vec").select("id", "node"), "asking")
    queries = asking.select(F.col("node").alias("query")).distinct().join(
        nodes.select(F.col("node").alias("query"), F.col("vec").alias("qvec")), "query")
    found = search(stage(queries, "queries"), shards(graph, parted, REVERSE), beam)
    members = found.join(nodes.select("node", "members"), "node").select(
        "query", "score", F.explode("members").alias("hit"))
    first = Window.partitionBy("query").orderBy(F.desc("score"), "hit")
    # The k + 1 best of a node hold the k best of each query with that vector.
    short = members.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k + 1)
    lists = stage(short.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "hit", "score"))).alias("hits")), "hits")
    met = asking.join(lists, asking["node"] == lists["query"])
    kept = F.slice(F.filter("hits", lambda h: h["hit"] != F.col("id")), 1, k)
    return met.select(F.col("id").alias("query_id"), F.posexplode(kept).alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("hit.hit").alias(id_column), F.col("hit.score").alias("score"))
