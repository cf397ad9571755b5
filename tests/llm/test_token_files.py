"""Token files: ids as the library gives them, exact round trips, checkpoints, checksums."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tallyloom.llm import rans, tokenfiles, wordtokens

SCHEMA = "doc_id long, text string, start string, block int, ids string"


def brute(rows):
    library = Tokenizer.from_file(tokenfiles.default_path())
    out, start = [], 0
    for doc_id, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_pieces_are_the_librarys():
    tokens = wordtokens.BatchTokenizer(tokenfiles.default_path())
    assert tokens.cuts
    rng = random.Random(3)
    signs = [*"aAbzZ'’  \t\n\v.,;!?<|>_0129éÉÀ×÷ßÿŸİı́ ²½Ως中\U0001f600\x00\x1c\x85 ", "<|endoftext|>", "'s", "'LL", "don't", "\r\n", "Café", "≠"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(1500)] + ["", None, "word " * 5000, "x" * 100_000]
    ids, sizes = tokens.ids([t and t.encode() for t in texts])
    found = np.split(ids, np.cumsum(sizes)[:-1])
    for text, got in zip(texts, found, strict=True):
        assert got.tolist() == tokens.library.encode(text or "", add_special_tokens=False).ids
    tokens.most_pieces = 5  # forgetting changes nothing
    again, _ = tokens.ids([t and t.encode() for t in texts])
    assert again.tolist() == ids.tolist()


@pytest.mark.parametrize("n", [1, 127, 128, 129, 65_536, 70_001])
def test_frames_decode_whole_and_from_each_checkpoint(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 4999).astype(np.uint32)
    table = rans.table_of(np.bincount(ids[: n // 2], minlength=5000))  # ids that were never counted can be coded too
    docs = rans.Documents(np.array([7]), np.array([0]), np.array([0]), np.array([n]))
    frame = rans.Frame(rans.encode_blocks([(ids, docs), (ids[::-1].copy(), docs)], table)[0], table.crc)
    decoder = rans.Decoder(table)
    assert decoder.blocks([frame])[0].tolist() == ids.tolist()
    step = frame.every * frame.lanes
    for k in range(len(frame.ahead)):
        assert decoder.segments([(frame, k)])[0].tolist() == ids[k * step : (k + 1) * step].tolist()


def test_ids_take_about_their_entropy():
    rng = np.random.default_rng(1)
    p = 1 / np.arange(1, 5001)
    ids = rng.choice(5000, 131_072, p=p / p.sum()).astype(np.uint32)
    counts = np.bincount(ids, minlength=5000)
    share = counts[counts > 0] / len(ids)
    docs = rans.Documents(*[np.zeros(0, np.int64)] * 4)
    frames = rans.encode_blocks([(ids[i : i + 65_536], docs) for i in (0, 65_536)], rans.table_of(counts))
    assert sum(map(len, frames)) * 8 < 1.04 * len(ids) * -(share * np.log2(share)).sum()


def test_damage_is_told():
    ids = np.arange(1000, dtype=np.uint32) % 50
    table = rans.table_of(np.bincount(ids))
    data = bytearray(rans.encode_blocks([(ids, rans.Documents(*[np.zeros(0, np.int64)] * 4))], table)[0])
    data[len(data) // 2] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        rans.Frame(bytes(data), table.crc)
    other = rans.table_of(np.bincount(ids + 1))
    with pytest.raises(ValueError, match="table"):
        rans.Frame(rans.encode_blocks([(ids, rans.Documents(*[np.zeros(0, np.int64)] * 4))], table)[0], other.crc)


def test_checksums_of_parts():
    a, b = b"some bytes", b"more of them" * 99
    assert rans.crc32_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert rans.crc32_joined(0, zlib.crc32(b), len(b)) == zlib.crc32(b)
    assert rans.crc32_joined(zlib.crc32(a), 0, 0) == zlib.crc32(a)


def test_digests_against_brute_force(spark):
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma,", "délta", "it's", "42"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(200)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "long " * 200_000), (1003, "x" * 70_000), (-5, "first")]
    docs = spark.createDataFrame([(i, t, "s", 3, "x") for i, t in rows], SCHEMA).repartition(5)
    got = tokenfiles.token_file_digest(docs, block=1024, lanes=32, every=8)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == brute(sorted(rows))


def test_copies_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "none"), (3, "same"), (3, "same"), (3, "other text"), (None, "none")], "doc_id long, text string")
    got = sorted(map(tuple, tokenfiles.token_file_digest(docs).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, None, 3, 3, 3]
    assert sorted(r[2] for r in got[2:]) == sorted(r[2] for r in brute([(3, "same"), (3, "same"), (3, "other text")]))
    assert [r[1] for r in got] == np.append(0, np.cumsum([r[2] for r in got])[:-1]).tolist()


def test_files_read_back_whole_and_in_ranges(spark, tmp_path):
    rows = [(i, "one two three " * (i % 40)) for i in range(200)]
    path = str(tmp_path / "tokens")
    tokenfiles.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), path, block=512, lanes=16, every=4)
    library = Tokenizer.from_file(tokenfiles.default_path())
    want = {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in rows}
    assert {r["doc_id"]: r["ids"] for r in tokenfiles.read_documents(spark, path).collect()} == want
    flat = [x for i, _ in rows for x in want[i]]
    for first, stop in ((0, 10), (700, 1300), (len(flat) - 5, len(flat) + 50), (5, 5)):
        got = sorted(map(tuple, tokenfiles.read_range(spark, path, first, stop).collect()))
        assert [x for _, ids in got for x in ids] == flat[first:stop]
    with pytest.raises(Exception, match="(?i)exists"):
        tokenfiles.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), path)


def test_empty_table(spark):
    assert tokenfiles.token_file_digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []
