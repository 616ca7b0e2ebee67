"""Hard negatives: scores just under a positive's, found through zone maps of ordered blocks.

Rows are laid out by label and along a Hilbert curve and written as blocks, one Parquet row
each, beside a zone map: the least and largest value of every dimension.  Interval arithmetic
on a zone map bounds the score of an anchor with any row of the block, so an anchor reads only
blocks whose bounds meet one of its score windows.  A first round reads the most promising
blocks and raises the floors of the windows; a second reads what the raised floors leave.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.session import stage

#: Rows of a block, anchors of a chunk, zone maps of a page.
BLOCK_ROWS, CHUNK_ROWS, PAGE_ZONES = 2_048, 256, 512
#: Directions and bits of the Hilbert key, and rows of the sample that the directions are fitted to.
DIRECTIONS, BITS, SAMPLE = 8, 7, 4_096
#: Largest scores that doubles and longs hold exactly.
EXACT, LONG = 2.0 ** 53, 2.0 ** 63


# ------------------------------------------------------------------ the curve


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows of ``cells``, below ``2**bits``).

    The transpose form of Skilling, "Programming the Hilbert curve" (2004), for all points at
    once; ``bits`` times the number of dimensions must not exceed 63.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations of every level
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


class Curve:
    """Main directions of a sample and the cell borders along each, by quantiles."""

    def __init__(self, sample: np.ndarray):
        points = sample.astype(float)
        self.center = points.mean(axis=0) if len(points) else np.zeros(sample.shape[1])
        _, _, axes = np.linalg.svd(points - self.center, full_matrices=False)
        self.axes = axes[:DIRECTIONS].T
        cuts = np.linspace(0, 1, (1 << BITS) + 1)[1:-1]
        along = (points - self.center) @ self.axes
        self.borders = [np.quantile(column, cuts) for column in along.T] if len(points) else []

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        if not self.borders:
            return np.zeros(len(vectors), np.int64)
        along = (vectors.astype(float) - self.center) @ self.axes
        return hilbert_keys(np.stack([np.searchsorted(b, c) for b, c in zip(self.borders, along.T)], axis=1), BITS)


# ------------------------------------------------------------------ vectors


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """List column to a matrix; a shorter vector is filled with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.asarray(lists.offsets)
    values = np.asarray(lists.values.cast(pa.int64()))
    lengths = np.diff(ends)
    if len(lengths) and (lengths == width).all():
        return values[ends[0]:ends[-1]].reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    for k, (a, n) in enumerate(zip(ends[:-1].tolist(), lengths.tolist())):
        out[k, :n] = values[a:a + n]
    return out


def unpacked(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, "<i8").reshape(-1, width) if width else np.zeros((len(data) // 8, 0), np.int64)


class Exact:
    """Integer matrix products: in doubles where every partial sum is exact, else in longs."""

    def __init__(self, largest: float, width: int):
        bound = largest * largest * max(1, width)
        if bound >= LONG:
            raise ValueError("scores of these vectors do not fit a long")
        self.kind = np.float64 if bound < EXACT else np.int64

    def times(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(self.kind) @ b.astype(self.kind).T).astype(np.int64)

    def bounds(self, a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest product of each row of ``a`` with anything between ``low`` and ``high``."""
        up, down = np.maximum(a, 0), np.minimum(a, 0)
        return (self.times(up, low) + self.times(down, high), self.times(up, high) + self.times(down, low))


def _best(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, least: int) -> np.ndarray:
    """Positions of the first ``least`` allowed columns by score, largest first, ties by id."""
    at = np.flatnonzero(allowed)
    if len(at) > least:
        floor = np.partition(scores[at], len(at) - least)[len(at) - least]
        at = at[scores[at] >= floor]
    return at[np.lexsort((ids[at], -scores[at]))][:least]


# ------------------------------------------------------------------ layout


def _layout(rows: DataFrame, width: int, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Blocks (``block``, ``label``, ``ids``, ``vectors``) and their zone maps.

    Rows are dealt by ranges of label, place on the curve, id and row, so copies of a vector,
    of an id or of a whole row spread over tasks like any others.
    """
    sample = rows.select("v").orderBy(F.xxhash64("id", "row")).limit(SAMPLE).toArrow()["v"]
    curve = Curve(_matrix(sample, width) if len(sample) else np.zeros((0, width), np.int64))

    def keyed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            vectors = _matrix(part.column(3), width)
            packed = np.ascontiguousarray(vectors, "<i8")
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(2), pa.array(curve.keys(vectors)),
                 pa.array([r.tobytes() for r in packed], pa.binary())], names=["row", "id", "label", "place", "v"])

    kind = rows.schema["label"].dataType.simpleString()
    placed = stage(rows.select("row", "id", "label", "v").mapInArrow(
        keyed, f"row long, id long, label {kind}, place long, v binary"), "hilbert-places")
    order = ["label", "place", "id", "row"]

    def blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict = {"label": None, "ids": [], "v": []}

        def made(label_type: pa.DataType) -> pa.RecordBatch:
            nonlocal number
            vectors = unpacked(b"".join(held["v"]), width)
            row = [pa.array([number]), pa.array([held["label"]], label_type), pa.array([held["ids"]]),
                   pa.array([vectors.astype("<i8").tobytes()], pa.binary()),
                   pa.array([vectors.min(axis=0).tolist()], pa.list_(pa.int64())),
                   pa.array([vectors.max(axis=0).tolist()], pa.list_(pa.int64()))]
            held.update(ids=[], v=[])
            number += 1
            return pa.RecordBatch.from_arrays(row, names=["block", "label", "ids", "vectors", "low", "high"])

        label_type = pa.null()
        for part in parts:
            label_type = part.schema.field("label").type
            for label, key, v in zip(*[part.column(c).to_pylist() for c in ("label", "id", "v")]):
                if held["ids"] and (label != held["label"] or len(held["ids"]) == block_rows):
                    yield made(label_type)
                held["label"] = label
                held["ids"].append(key)
                held["v"].append(v)
        if held["ids"]:
            yield made(label_type)

    ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    written = stage(ranged.mapInArrow(
        blocks, f"block long, label {kind}, ids array<long>, vectors binary, low array<long>, high array<long>"), "blocks")
    return written.select("block", "label", "ids", "vectors"), written.select("block", "label", "low", "high")


def _chunks(blocks: DataFrame, every: int, width: int) -> DataFrame:
    """Anchors of the blocks: ``chunk``, ``label``, ``anchors``, their own ``places`` and ``vectors``.

    A chunk never spans blocks, so its anchors lie close on the curve.
    """
    kind = blocks.schema["label"].dataType.simpleString()

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for block, label, ids, data in zip(*[part.column(k).to_pylist() for k in range(4)]):
                keys = np.array(ids, np.int64)
                at = np.flatnonzero(keys % every == 0)
                vectors = unpacked(data, width)
                for k in range(0, len(at), CHUNK_ROWS):
                    own = at[k:k + CHUNK_ROWS]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([(block << 11) + k // CHUNK_ROWS]), pa.array([block]), pa.array([label], part.column(1).type),
                         pa.array([keys[own].tolist()]), pa.array([own.tolist()]),
                         pa.array([np.ascontiguousarray(vectors[own], "<i8").tobytes()], pa.binary())],
                        names=["chunk", "home", "label", "anchors", "places", "vectors"])

    return blocks.mapInArrow(cut, f"chunk long, home long, label {kind}, anchors array<long>, places array<long>, vectors binary")


# ------------------------------------------------------------------ reading


def _plan(chunks: DataFrame, pages: DataFrame, n_pages: int, exact: Exact, width: int, same: bool) -> DataFrame:
    """Blocks that each chunk must read: ``chunk``, ``block``, ``top`` (its largest upper bound).

    ``chunks`` has ``windows``: score ranges of its anchors.  A page of zone maps is bounded in
    rows; every chunk meets every page.
    """
    asked = chunks.select("chunk", "label", "vectors", "windows",
                          F.explode(F.sequence(F.lit(0), F.lit(n_pages - 1))).alias("page"))
    met = asked.join(pages, "page").select("chunk", "label", "vectors", "windows", "zones")

    def bound(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(part.num_rows):
                chunk, label, data, windows, zones = (part.column(c)[k] for c in range(5))
                windows = windows.as_py()
                flat = zones.values.flatten()
                block, of = np.asarray(flat[0]), flat[1].to_pylist()
                use = np.array([(x == label.as_py()) == same for x in of], bool)
                if not windows or not use.any():
                    continue
                low, high = (_matrix(flat[c], width)[use] for c in (2, 3))
                least, most = exact.bounds(unpacked(data.as_py(), width), low, high)
                at = np.array([w["anchor"] for w in windows])
                floor, ceiling = (np.array([w[n] for w in windows])[:, None] for n in ("low", "high"))
                needed = ((most[at] >= floor) & (least[at] <= ceiling)).any(axis=0)
                if needed.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(needed.sum(), chunk.as_py())), pa.array(block[use][needed]),
                         pa.array(most.max(axis=0)[needed])], names=["chunk", "block", "top"])

    return met.mapInArrow(bound, "chunk long, block long, top long")


def _read(plan: DataFrame, chunks: DataFrame, blocks: DataFrame, exact: Exact, width: int, least: int) -> DataFrame:
    """The first ``least`` rows of each window in each planned block.

    Chunks travel to the blocks they read, not the larger blocks to the chunks.
    """
    sent = plan.join(chunks.select("chunk", "home", "anchors", "places", F.col("vectors").alias("mine"), "windows"), "chunk")
    met = sent.join(blocks.select("block", "ids", "vectors"), "block").select(
        "chunk", "block", "home", "anchors", "places", "mine", "windows", "ids", "vectors")

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for r in range(part.num_rows):
                chunk, block, home, anchors, places, mine, windows, ids, data = (part.column(c)[r].as_py() for c in range(9))
                keys = np.array(ids, np.int64)
                scores = exact.times(unpacked(mine, width), unpacked(data, width))
                out: list[tuple] = []
                for w in windows:
                    line = scores[w["anchor"]]
                    allowed = (line >= w["low"]) & (line <= w["high"])
                    if block == home:
                        allowed[places[w["anchor"]]] = False
                    out += [(chunk, w["anchor"], w["k"], anchors[w["anchor"]], int(keys[at]), int(line[at]))
                            for at in _best(line, keys, allowed, least)]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 3))],
                        names=["chunk", "anchor", "k", "anchor_id", "id", "score"])

    return met.mapInArrow(score, "chunk long, anchor int, k int, anchor_id long, id long, score long")


def _first(found: DataFrame, least: int) -> DataFrame:
    """The first ``least`` rows of each window, with their ``rank``."""
    order = Window.partitionBy("chunk", "anchor", "k").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= least)


def _windows(chunks: DataFrame, ranges: DataFrame) -> DataFrame:
    """Chunks with ``windows`` from rows of ``chunk``, ``anchor``, ``k``, ``low``, ``high``; a chunk
    has a bounded number of anchors and an anchor of windows."""
    grouped = ranges.groupBy("chunk").agg(F.collect_list(F.struct("anchor", "k", "low", "high")).alias("windows"))
    return chunks.drop("windows").join(grouped, "chunk")


def _search(chunks: DataFrame, ranges: DataFrame, blocks: DataFrame, pages: DataFrame, n_pages: int,
            exact: Exact, width: int, same: bool, least: int, seeds: int) -> DataFrame:
    """The first ``least`` rows of every window, over all blocks that can hold one."""
    ranges = stage(ranges, "score-windows")
    asked = stage(_windows(chunks, ranges), "asked-chunks")
    plan = stage(_plan(asked, pages, n_pages, exact, width, same), "block-plan")
    promising = Window.partitionBy("chunk").orderBy(F.desc("top"), "block")
    early = stage(plan.withColumn("n", F.row_number().over(promising)).filter(F.col("n") <= seeds)
                  .select("chunk", "block"), "seed-plan")
    seeded = stage(_first(_read(early, asked, blocks, exact, width, least), least), "seed-rows")
    # A window that is full already needs nothing below its last row.
    full = seeded.filter(F.col("rank") == least).select("chunk", "anchor", "k", F.col("score").alias("floor"))
    raised = stage(ranges.join(full, ["chunk", "anchor", "k"], "left").select(
        "chunk", "anchor", "k", F.coalesce("floor", "low").alias("low"), "high"), "raised-windows")
    rest = stage(_windows(chunks, raised), "asked-chunks")
    later = stage(_plan(rest, pages, n_pages, exact, width, same).join(early, ["chunk", "block"], "left_anti"), "block-plan")
    found = _read(later, rest, blocks, exact, width, least)
    return stage(_first(seeded.drop("rank").unionByName(found), least), "window-rows")


def mine(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
         every: int = 100, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100),
         scale: int = 256, seeds: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    Components become ``floor(scale * x)``, scores are integer inner products, and higher scores
    come first, ties by smaller id.  Anchors are rows whose id ``every`` divides; an anchor's
    positives are its first ``positives`` other rows of its label.  For each, the first
    ``negatives`` rows of other labels follow whose score is at most the positive's and at least
    ``share`` (a fraction) of it.

    Rows with a null id or label, a null vector or a null or non-finite component take no part.
    Vectors of different lengths are filled with zeros.  Every row counts: a repeated row or id
    is another row, with results of its own if it is an anchor.  Other columns are ignored,
    whatever their names, an empty table gives no rows, and vectors whose scores would not fit
    a long raise an error.  ``seeds`` is the number of blocks of the first round (by default the
    root of the number of blocks) and, like ``block_rows``, does not change the result.
    """
    part, whole = share
    components = F.transform(F.col(vector_column), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    plain = table.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("id"),
        F.col(label_column).alias("label"), components.alias("d"), F.col(vector_column).alias("x")).filter(
        "id is not null and label is not null and x is not null").filter(
        F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))))
    most = plain.agg(F.max(F.size("d")).alias("width"), F.max(F.array_max(F.transform("d", F.abs))).alias("largest"),
                     F.count(F.lit(1)).alias("rows")).first()
    width = most["width"] or 0
    exact = Exact(most["largest"] or 0.0, width)
    rows = plain.select("row", "id", "label", F.transform("d", lambda x: x.cast("long")).alias("v"))
    blocks, zones = _layout(rows, width, block_rows)
    n_zones = zones.count()
    n_pages = max(1, -(-n_zones // PAGE_ZONES))
    seeds = seeds or max(1, round(n_zones ** 0.5))
    pages = stage(zones.select(F.pmod(F.xxhash64("block"), F.lit(n_pages)).cast("int").alias("page"),
                               F.struct("block", "label", "low", "high").alias("zone"))
                  .groupBy("page").agg(F.collect_list("zone").alias("zones")), "zone-pages")
    chunks = stage(_chunks(blocks, every, width), "anchor-chunks")
    limit = 2 ** 63 - 1
    anchors = chunks.select("chunk", F.posexplode("anchors").alias("anchor", "anchor_id"))
    everything = anchors.select("chunk", "anchor", F.lit(0).alias("k"), F.lit(-limit).cast("long").alias("low"),
                                F.lit(limit).cast("long").alias("high"))
    search = lambda ranges, same, least: _search(
        chunks, ranges, blocks, pages, n_pages, exact, width, same, least, seeds)
    near = search(everything, True, positives)
    # part * positive <= whole * negative, in whole numbers.
    low = F.ceil(F.expr(f"cast({part} as decimal(38, 0)) * score / {whole}")).cast("long")
    ranges = near.select("chunk", "anchor", F.col("rank").alias("k"), low.alias("low"), F.col("score").alias("high")).filter(
        F.col("low") <= F.col("high"))
    far = search(ranges, False, negatives)
    return far.join(near.select("chunk", "anchor", F.col("rank").alias("k"), F.col("id").alias("positive_id"),
                                F.col("score").alias("positive_score")), ["chunk", "anchor", "k"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
