import json
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sievework.llm import token_files
from sievework.session import new_path

PATH = public_tokenizers.path("word_bpe_49k.json")


def file_of(docs, seed=1):
    lengths = np.array([len(d) for d in docs], np.int64)
    ids = np.concatenate([np.array(d, "<u4") for d in docs] or [np.zeros(0, "<u4")])
    return token_files.pack_file(pa.array(range(len(docs)), pa.int64()), lengths, ids), ids, lengths


@pytest.mark.parametrize("kind", ["empty", "one", "same", "random", "text", "wide", "blocks"])
def test_round_trip(kind, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(token_files, "MODEL_BYTES", 3 << 20)  # several groups of blocks
    docs = {"empty": [], "one": [[2]], "same": [[7] * 9000], "random": [[rng.randrange(49_408) for _ in range(5000)]],
            "text": [[rng.choice([1, 2, 3, 5, 8, 13]) for _ in range(rng.randint(1, 900))] for _ in range(40)],
            "wide": [list(range(49_408))], "blocks": [[k % 97 for k in range(n)] for n in (4096, 4095, 4097, 1)]}[kind]
    data, ids, lengths = file_of(docs)
    keys, got_lengths, got = token_files.unpack_file(data)
    assert keys.to_pylist() == list(range(len(docs)))
    assert (got_lengths == lengths).all() and (got == ids).all()


def test_it_compresses_what_repeats():
    rng = random.Random(4)
    words = [[rng.randrange(3000) for _ in range(4)] for _ in range(60)]
    docs = [[x for _ in range(800) for x in rng.choice(words)] for _ in range(12)]
    data, ids, _ = file_of(docs)
    shares = np.bincount(ids) / len(ids)
    entropy = -(shares[shares > 0] * np.log2(shares[shares > 0])).sum()
    assert len(data) < 0.5 * len(ids) * entropy / 8  # what order 0 alone could reach


def test_damage_is_found():
    data, _, _ = file_of([[1, 2, 3] * 3000])
    for at in range(60, len(data), max(1, len(data) // 40)):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(Exception):
            token_files.unpack_file(bytes(broken))


def test_a_block_does_not_depend_on_others():
    rng = np.random.default_rng(5)
    ids, prior = rng.integers(0, 50, (6, 700)), np.full(50, 40)
    together = token_files.encode_blocks(ids, prior)
    assert [token_files.encode_blocks(row[None, :], prior)[0] for row in ids] == together
    assert (token_files.decode_blocks(together[3:4], 700, prior)[0] == ids[3]).all()


def test_intervals_tile_the_line():
    rng = np.random.default_rng(6)
    mixer = token_files.Mixer(1, np.array([5, 1, 1, 30, 2]))
    for x in rng.integers(0, 5, 1200):
        mixer.predict()
        at = 0
        for y in range(5):
            start, width = mixer.interval(np.array([y]))
            assert start[0] == at and width[0] > 0
            assert mixer.find(start)[0] == y and mixer.find(start + width - 1)[0] == y
            at += width[0]
        assert at == 1 << token_files._BITS
        mixer.learn(np.array([x]))


@pytest.mark.parametrize("file_tokens", [token_files.FILE_TOKENS, 300])
def test_documents_round_trip(spark, documents, monkeypatch, file_tokens):
    rng = random.Random(7)
    rows = [(rng.randrange(-50, 10_000), " ".join(rng.choices(["Alpha", "beta,", '"', "#gamma", "ñ 日本"], k=rng.randint(0, 90)))) for _ in range(150)]
    rows += [(20_000, None), (20_001, ""), (20_002, "long text " * 20_000), (20_003, "twice"), (20_003, "twice"), (None, "no id")]
    monkeypatch.setattr(token_files, "FILE_TOKENS", file_tokens)
    path = token_files.write_tokens(documents(*rows).repartition(4), PATH)
    got = token_files.read_tokens(spark, path).collect()
    plain = Tokenizer.from_file(PATH)
    want = sorted(((k is not None, k or 0, t or ""), [*plain.encode(t or "", add_special_tokens=False).ids, 2]) for k, t in rows)
    got = sorted(got, key=lambda r: r.start)
    assert [r.id for r in got] == [k if known else None for (known, k, _), _ in want]
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids) // 4, zlib.crc32(r.ids))
        at += r.n_tokens
    assert sorted(np.frombuffer(r.ids, "<u4").tolist() for r in got) == sorted(ids for _, ids in want)


def test_files_of_lost_attempts_are_not_read(spark, documents):
    path = token_files.write_tokens(documents((1, "a"), (2, "b")), PATH, path=new_path(spark, "tokens"))
    store, folder = token_files._store(path)
    with store.open_output_stream(f"{folder}/000000-000000-lost.tok") as out:
        out.write(b"half a file")
    assert token_files.read_tokens(spark, path).count() == 2
    with store.open_input_stream(f"{folder}/files.json") as file:
        assert sum(f["docs"] for f in json.loads(file.read())["files"]) == 2


def test_empty_table(spark, documents):
    assert token_files.read_tokens(spark, token_files.write_tokens(documents((1, "a")).limit(0), PATH)).collect() == []


def test_more_ids_than_the_line_has_places():
    """70,000 distinct ids: the line of the file is widened, up to a stated bound."""
    rng = np.random.default_rng(8)
    ids = np.concatenate([rng.permutation(70_000), rng.integers(0, 70_000, 1500)]).astype("<u4")
    lengths = np.array([40_000, 31_500])
    keys, counts, back = token_files.unpack_file(token_files.pack_file(pa.array([1, 2]), lengths, ids))
    assert (back == ids).all() and counts.tolist() == lengths.tolist()
    assert token_files.line_of(1 << 16) == 16 and token_files.line_of((1 << 16) + 1) == 18
    with pytest.raises(ValueError):
        token_files.line_of((1 << 22) + 1)
