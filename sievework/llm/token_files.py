"""Token ids in compressed files: an adaptive context-mixing range coder.

A file holds documents in ascending id order.  Their ids run through blocks of a fixed number
of tokens; a block starts with a fresh model and has a checksum, so it decodes alone.  Three
predictions are mixed for each id: order 2 and order 1 name the id that last followed the
same two ids or the same id in this block, order 0 is the block's own frequencies over those
of the file.  Their weights follow how often each prediction was right at the same confidence.
The mixture is one interval on the id line, which a range coder narrows.

Blocks are independent, so a task codes many side by side: each numpy step codes one token of
every block.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import batches, crc32, rows_of
from sievework.llm.tokens import ids_of
from sievework.session import new_path

MAGIC = b"TOKMIX1\n"
#: Tokens of a block; tokens after which the model's frequencies and weights are renewed.
BLOCK, EPOCH = 4096, 512
#: The id line of a file has 2**LINE places for order 0, or more for more ids, up to MOST_IDS;
#: shares of the mixture are in 1/SHARES.
LINE, SHARES, MOST_IDS = 16, 32, 1 << 22
#: Tokens of a file; a task that has more starts another.
FILE_TOKENS = 8_000_000
#: Bytes of the models that are coded side by side.
MODEL_BYTES = 96 << 20
#: How much the frequencies of the file count at the start of a block, and one token after it.
PRIOR, COUNT = 2048, 24
#: Slots of the order-2 context table.
SLOTS = 4096

_U = np.uint64


#: Next confidence (1 to 3) by 2 * confidence + hit: it rises while a prediction holds.
_NEXT = np.array([1, 1, 1, 2, 1, 3, 1, 3], np.int32)


def line_of(ids: int) -> int:
    """Bits of the id line for so many distinct ids: every id needs a place of its own."""
    if ids > MOST_IDS:
        raise ValueError(f"{ids} distinct ids in one file, more than {MOST_IDS}")
    return LINE if ids <= 1 << LINE else (ids - 1).bit_length() + 1


class Mixer:
    """The models of ``lanes`` blocks, all at the same token.  Tables are flat; each lane has
    its own stretch of them."""

    def __init__(self, lanes: int, prior: np.ndarray):
        self.lanes, self.size, self.line = lanes, len(prior), line_of(len(prior))
        self.prior = prior.astype(np.int64)
        lane = np.arange(lanes)
        self.base, self.base_cum, self.base2, self.base16 = (lane * n for n in (self.size, self.size + 1, SLOTS, 16))
        self.row_start = lane * ((1 << self.line) + 1)  # lanes apart in the starts that the decoder searches
        self.seen = np.zeros(lanes * self.size, np.int32)
        self.starts = np.zeros(lanes * (self.size + 1), np.int64)  # order-0 starts, one stride per lane apart
        # Contexts hold 4 * (id + 1) + confidence; 0 means not seen yet.
        self.one = np.zeros(lanes * self.size, np.int32)
        self.two = np.zeros(lanes * SLOTS, np.int32)
        # Per pair of confidences: right of order 2, right of order 1 alone, all; 20 bits each.
        self.stats = np.full(lanes * 16, (1 << 40) + (1 << 20) + 6, np.int64)
        self.last = np.zeros(lanes, np.int64)
        self.before = np.zeros(lanes, np.int64)
        self.at1 = self.base.copy()
        self.steps = 0

    def renew(self) -> None:
        """Order-0 intervals from the counts so far, and the shares of orders 2 and 1."""
        seen, starts = self.seen.reshape(self.lanes, -1), self.starts.reshape(self.lanes, -1)
        free = (1 << self.line) - self.size
        cut = max(1, (4 << 20) // max(1, self.size))
        for at in range(0, self.lanes, cut):
            weight = np.cumsum(self.prior[None, :] + COUNT * seen[at:at + cut], axis=1)
            starts[at:at + cut, 0] = self.row_start[at:at + cut]
            starts[at:at + cut, 1:] = (np.arange(1, self.size + 1) + free * weight // weight[:, -1:]
                                       + self.row_start[at:at + cut, None])
        mask = (1 << 20) - 1
        asked = (self.stats & mask) + 1
        sure = np.arange(16)
        share2 = (SHARES - 2) * (self.stats >> 40) // asked * np.tile(sure >> 2 > 0, self.lanes)
        share1 = (SHARES - 2) * (self.stats >> 20 & mask) // asked * np.tile(sure & 3 > 0, self.lanes)
        self.shares = share2 << 8 | share1

    def predict(self) -> None:
        if self.steps % EPOCH == 0:
            self.renew()
        self.steps += 1
        self.at2 = self.base2 + ((self.before * 40503 + self.last * 2654435 >> 5) & (SLOTS - 1))
        self.got2, self.got1 = self.two[self.at2], self.one[self.at1]
        self.id2, self.id1 = self.got2 >> 2, self.got1 >> 2  # one more than the id
        self.slot = self.base16 + ((self.got2 & 3) << 2 | self.got1 & 3)
        both = self.shares[self.slot]
        self.k2, self.k1 = both >> 8, both & 255
        self.k0 = SHARES - self.k2 - self.k1

    def interval(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of ids on a line of SHARES << line places."""
        at, y = self.base_cum + x, x + 1
        low = self.starts[at]
        width = self.k0 * (self.starts[at + 1] - low) + (self.k2 * (self.id2 == y) + self.k1 * (self.id1 == y) << self.line)
        start = self.k0 * (low - self.row_start) + (self.k2 * (self.id2 < y) + self.k1 * (self.id1 < y) << self.line)
        return start, width

    def find(self, place: np.ndarray) -> np.ndarray:
        """The id whose interval holds ``place``: a predicted id, or what order 0 has there
        once the predicted ids before it are taken off."""
        guess2, guess1 = np.maximum(self.id2 - 1, 0).astype(np.int64), np.maximum(self.id1 - 1, 0).astype(np.int64)
        start2, width2 = self.interval(guess2)
        start1, width1 = self.interval(guess1)
        past2, past1 = place >= start2 + width2, place >= start1 + width1
        plain = (place - (self.k2 * past2 + self.k1 * past1 << self.line)) // self.k0
        x = np.searchsorted(self.starts, self.row_start + np.clip(plain, 0, (1 << self.line) - 1), "right") - 1 - self.base_cum
        x = np.where((place >= start1) & ~past1, guess1, x)
        return np.where((place >= start2) & ~past2, guess2, x)

    def learn(self, x: np.ndarray) -> None:
        y = (x + 1).astype(np.int32)
        hit2, hit1 = self.id2 == y, self.id1 == y
        self.stats[self.slot] += 1 + (hit2.astype(np.int64) << 40) + ((hit1 & ~hit2).astype(np.int64) << 20)
        y <<= 2
        self.two[self.at2] = y | _NEXT[(self.got2 & 3) << 1 | hit2]
        self.one[self.at1] = y | _NEXT[(self.got1 & 3) << 1 | hit1]
        self.at1 = self.base + x
        self.seen[self.at1] += 1
        self.before, self.last = self.last, x


#: The coder's range stays above 2**28; 32-bit words leave it from bit 28 upward.
_TOP, _WORD = 28, 32
_SHARE_BITS = SHARES.bit_length() - 1
#: Bits of the whole line where LINE is enough.
_BITS = LINE + _SHARE_BITS


def encode_blocks(ids: np.ndarray, prior: np.ndarray) -> list[bytes]:
    """Code the rows of ``ids`` (blocks side by side, of equal length)."""
    lanes, length = ids.shape
    mixer = Mixer(lanes, prior)
    bits = mixer.line + _SHARE_BITS
    low, span = np.zeros(lanes, _U), np.full(lanes, 1 << 60, _U)
    words = np.zeros((lanes, length * (bits + 4) // _WORD + 4), _U)
    count = np.zeros(lanes, np.int64)

    def emit(which: np.ndarray) -> None:
        words[which, count[which]] = low[which] >> _U(_TOP)
        count[which] += 1
        low[which] = (low[which] & _U((1 << _TOP) - 1)) << _U(_WORD)

    for x in np.ascontiguousarray(ids.T).astype(np.int64):
        mixer.predict()
        start, width = mixer.interval(x)
        step = span >> _U(bits)
        low += step * start.astype(_U)
        span = step * width.astype(_U)
        small = np.flatnonzero(span < (1 << _TOP))
        if len(small):
            emit(small)
            span[small] <<= _U(_WORD)
        mixer.learn(x)
    for _ in range(2):
        emit(np.arange(lanes))
    while (carry := words >> _U(_WORD)).any():  # a carry goes to the word before
        words &= _U((1 << _WORD) - 1)
        words[:, :-1] += carry[:, 1:]
    return [w[:n].astype("<u4").tobytes() for w, n in zip(words, count.tolist())]


def decode_blocks(data: list[bytes], length: int, prior: np.ndarray) -> np.ndarray:
    """The inverse of ``encode_blocks``."""
    lanes = len(data)
    mixer = Mixer(lanes, prior)
    bits = mixer.line + _SHARE_BITS
    words = np.zeros((lanes, max(map(len, data)) // 4 + 2), _U)
    for k, d in enumerate(data):
        words[k, :len(d) // 4] = np.frombuffer(d, "<u4")
    # What is left of the code above the low end: 60 bits of it, then word by word.
    row, at = np.arange(lanes), np.full(lanes, 2)
    value = (words[:, 0] << _U(_TOP)) | (words[:, 1] >> _U(_WORD - _TOP))
    part = words[:, 1] & _U((1 << (_WORD - _TOP)) - 1)
    span = np.full(lanes, 1 << 60, _U)
    out = np.zeros((length, lanes), np.int64)
    for step_at in range(length):
        mixer.predict()
        step = span >> _U(bits)
        place = np.minimum(value // step, _U((1 << bits) - 1)).astype(np.int64)
        x = mixer.find(place)
        start, width = mixer.interval(x)
        value -= step * start.astype(_U)
        span = step * width.astype(_U)
        small = np.flatnonzero(span < (1 << _TOP))
        if len(small):
            word = words[small, at[small]]
            at[small] += 1
            held = _WORD - _TOP
            value[small] = (value[small] << _U(_WORD)) | (part[small] << _U(_WORD - held)) | (word >> _U(held))
            part[small] = word & _U((1 << held) - 1)
            span[small] <<= _U(_WORD)
        mixer.learn(x)
        out[step_at] = x
    return out.T


def _sides(lengths: list[int], size: int) -> Iterator[list[int]]:
    """Groups of blocks of one length that fit in memory side by side."""
    lanes = max(16, MODEL_BYTES // (16 * size + 4 * SLOTS + 8 * BLOCK))
    by: dict[int, list[int]] = {}
    for k, n in enumerate(lengths):
        by.setdefault(n, []).append(k)
    for _, group in sorted(by.items()):
        parts = -(-len(group) // lanes)
        for p in range(parts):
            yield group[p::parts]


def pack_file(keys: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A file: magic, header length and header (JSON), document table, ids in use with their
    frequencies, block table (bytes, checksum), blocks.  All checksummed by CRC-32."""
    used, dense = np.unique(ids, return_inverse=True)
    counts = np.bincount(dense, minlength=len(used)) if len(ids) else np.zeros(0, int)
    prior = np.maximum(1, PRIOR * counts // max(1, len(ids)))
    blocks = [dense[at:at + BLOCK] for at in range(0, len(ids), BLOCK)]
    sizes = [len(b) for b in blocks]
    coded: list[bytes] = [b""] * len(blocks)
    for group in _sides(sizes, len(used)):
        for k, data in zip(group, encode_blocks(np.stack([blocks[k] for k in group]), prior)):
            coded[k] = data
    sink = pa.BufferOutputStream()
    docs = pa.table({"id": keys, "n": pa.array(lengths, pa.int64())})
    with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(docs)
    table = sink.getvalue().to_pybytes()
    model = zlib.compress(np.diff(used, prepend=0).astype("<u4").tobytes() + prior.astype("<u4").tobytes())
    index = b"".join(struct.pack("<III", len(c), zlib.crc32(c), zlib.crc32(ids[k * BLOCK:(k + 1) * BLOCK].astype("<u4").tobytes()))
                     for k, c in enumerate(coded))
    head = json.dumps({"docs": len(lengths), "tokens": len(ids), "block": BLOCK, "line": line_of(len(used)), "table": len(table), "model": len(model),
                       "crc": zlib.crc32(table + model + index)}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, table, model, index, *coded])


def unpack_file(data: bytes, path: str = "file") -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Document ids, their token counts, and all ids.  A damaged part is an error."""
    if data[:len(MAGIC)] != MAGIC:
        raise ValueError(f"{path} is not a token file")
    at = len(MAGIC) + 4
    size = struct.unpack_from("<I", data, len(MAGIC))[0]
    head = json.loads(data[at:at + size])
    at += size
    blocks = -(-head["tokens"] // head["block"])
    end = at + head["table"] + head["model"] + 12 * blocks
    if zlib.crc32(data[at:end]) != head["crc"]:
        raise ValueError(f"{path}: its tables are damaged")
    docs = pa.ipc.open_stream(data[at:at + head["table"]]).read_all()
    at += head["table"]
    model = np.frombuffer(zlib.decompress(data[at:at + head["model"]]), "<u4").reshape(2, -1)
    used, prior = np.cumsum(model[0]), model[1]
    index = np.frombuffer(data, "<u4", 3 * blocks, at + head["model"]).reshape(-1, 3)
    starts = end + np.r_[0, np.cumsum(index[:, 0].astype(np.int64))]
    sizes = [min(head["block"], head["tokens"] - k * head["block"]) for k in range(blocks)]
    ids = np.zeros(head["tokens"], "<u4")
    for group in _sides(sizes, len(used)):
        coded = [data[starts[k]:starts[k + 1]] for k in group]
        for k, c in zip(group, coded):
            if zlib.crc32(c) != index[k, 1]:
                raise ValueError(f"{path}: block {k} is damaged")
        for k, x in zip(group, decode_blocks(coded, sizes[group[0]], prior)):
            ids[k * head["block"]:k * head["block"] + sizes[k]] = used[x]
    for k in range(blocks):
        if zlib.crc32(ids[k * head["block"]:(k + 1) * head["block"]].tobytes()) != index[k, 2]:
            raise ValueError(f"{path}: block {k} does not give its ids")
    return docs.column("id").combine_chunks(), docs.column("n").to_numpy(), ids


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def in_order(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``id``, ``text`` in ranges of ascending id, sorted; bounds come from the ids alone."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None,
                 id_column: str = "doc_id", text_column: str = "text") -> str:
    """Encode every text, with ``end_id`` behind it, into files in ascending id order.

    Returns the folder, with a list of the files in order.  A task names its files after its
    range; an attempt writes to names of its own, and only the files that a task reports are
    listed, so lost or repeated attempts do no harm.

    A null or empty text is its end id alone; null ids come first.  Rows with equal ids follow
    each other by text, repeated rows are written each, texts of any length are whole, other
    columns are ignored whatever their names, and an empty table gives a list of no files.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    end = end_id.to_bytes(4, "little")

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number = ids_of(tokenizer, 200_000), TaskContext.get().partitionId()
        store, folder = _store(path)
        store.create_dir(folder, recursive=True)
        keys: list = []
        data: list[bytes] = []
        held, written = 0, 0

        def flush(kind: pa.DataType) -> pa.RecordBatch:
            nonlocal keys, data, held, written
            lengths = np.array([len(d) // 4 for d in data], np.int64)
            ids = np.frombuffer(b"".join(data), "<u4")
            name = f"{number:06d}-{written:06d}-{uuid.uuid4().hex}.tok"
            with store.open_output_stream(f"{folder}/{name}", compression=None) as out:
                out.write(pack_file(pa.array(keys, kind), lengths, ids))
            row = pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([written]), pa.array([name]), pa.array([len(data)]), pa.array([len(ids)])],
                names=["range", "part", "name", "docs", "tokens"])
            keys, data, held, written = [], [], 0, written + 1
            return row

        kind = pa.null()
        for part in parts:
            kind = part.column(0).type
            for batch in batches(rows_of(part, 0, 1), 1):
                for (key, _), ids in zip(batch, encoder.encode([t for _, t in batch])):
                    keys.append(key)
                    data.append(ids + end)
                    held += len(ids) // 4 + 1
                if held >= FILE_TOKENS:
                    yield flush(kind)
        if keys:
            yield flush(kind)

    files = in_order(docs, id_column, text_column).mapInArrow(
        task, "range long, part long, name string, docs long, tokens long").collect()  # a row per file
    at, listed = 0, []
    for f in sorted(files, key=lambda f: (f["range"], f["part"])):
        listed.append({"name": f["name"], "docs": f["docs"], "tokens": f["tokens"], "start": at})
        at += f["tokens"]
    store, folder = _store(path)
    store.create_dir(folder, recursive=True)
    kind = docs.schema[id_column].dataType.simpleString()
    with store.open_output_stream(f"{folder}/files.json") as out:
        out.write(json.dumps({"id": kind, "files": listed}).encode())
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: ``id``, ``start`` (ids of all documents before it),
    ``n_tokens``, ``ids`` (little-endian unsigned 32-bit, binary), ``ids_crc32`` (unsigned)."""
    store, folder = _store(path)
    with store.open_input_stream(f"{folder}/files.json") as file:
        listed = json.loads(file.read())
    rows = [(f["name"], f["start"], k) for k, f in enumerate(listed["files"])]
    files = spark.createDataFrame(rows, "name string, start long, k int").repartitionByRange(max(1, len(rows)), "k")

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local, base = _store(path)
        for part in parts:
            for name, start in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                with local.open_input_stream(f"{base}/{name}", compression=None) as file:
                    keys, lengths, ids = unpack_file(file.read(), name)
                ends = np.cumsum(lengths)
                for at in range(0, len(lengths), 2000):
                    span = slice(at, at + 2000)
                    data = [ids[e - n:e].tobytes() for e, n in zip(ends[span].tolist(), lengths[span].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [keys[span], pa.array(start + ends[span] - lengths[span]), pa.array(lengths[span]),
                         pa.array(data, pa.binary()), pa.array([crc32(d) for d in data], pa.int64())],
                        names=["id", "start", "n_tokens", "ids", "ids_crc32"])

    return files.select("name", "start").mapInArrow(
        task, f"id {listed['id']}, start long, n_tokens long, ids binary, ids_crc32 long")
