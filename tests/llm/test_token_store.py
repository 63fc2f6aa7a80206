import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from panelforge.llm import token_store as ts

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [0, 1, 5, 63, 1000, 70_001])
def test_coder_round_trip_and_parts(n):
    r = np.random.default_rng(n)
    ids = np.minimum(r.geometric(0.02, n), 5000).astype(np.int64)
    c = ts.Coder(ts.scale(np.bincount(ids, minlength=3), 14), 14)
    p = c.encode(ids, lanes=64, step=16)
    assert (c.decode(p) == ids).all()
    assert (np.concatenate([c.decode(p, k, k + 1) for k in range(struct.unpack_from("<I", p, 16)[0])] + [ids[:0]]) == ids).all()
    if n > 1000:
        assert len(p) < 2 * n
        bad = bytearray(p)
        bad[-9] ^= 1
        with pytest.raises(ValueError):
            c.decode(bytes(bad))


def test_scale_with_many_rare_ids():
    counts = np.ones(900, np.int64)
    counts[5] = 10**12
    f = ts.scale(counts, 10)
    assert f.sum() == 1024 and f.min() == 1
    assert ts.scale(np.array([7, 0, 7]), 10).sum() == 1024
    assert ts.scale(np.full(1000, 3), 10).sum() == 1024


def texts():
    r = random.Random(4)
    odd = [None, "", " \n\t", "don't I'LL we've", "<|endoftext|> x<|startoftext|>y", "É é ﬁ Σ ΑΣ ΑΣ b", "a\x1cb\x1dc d　e\x0b\x0cf\x85g",
           "x" * 3000, "123 4567", "日本語 テキスト 🎉", "́ a ́", "İ ı ß", "a`b ` c", "` x", "\u1fef y\u1fef z"]
    odd += ["".join(r.choice("abcé '1!\n 日") for _ in range(r.randint(0, 400))) for _ in range(200)]
    odd.append(" ".join("".join(r.choice("abcdef") for _ in range(5)) for _ in range(40_000)))
    return odd


def test_same_ids_as_the_library():
    own, lib = ts.WordTokenizer(PATH), Tokenizer.from_file(PATH)
    t = [x or "" for x in texts()]
    assert own.split
    raw = [x.encode() for x in t]
    off = np.concatenate([[0], np.cumsum(list(map(len, raw)))])
    want = [e.ids for e in lib.encode_batch(t, add_special_tokens=False)]
    for _ in range(2):
        ids, at = own.encode(np.frombuffer(b"".join(raw), np.uint8), off)
        assert [ids[at[i]:at[i + 1]].tolist() for i in range(len(t))] == want
        own.split = False


def test_store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ts, "BLOCK", 5000)
    rows = list(enumerate(texts()))
    random.Random(1).shuffle(rows)
    lib = Tokenizer.from_file(PATH)
    df = spark.createDataFrame([(i * 3, t, 1) for i, t in rows], "doc_id long, text string, ids int").repartition(3)
    ts.write(df, f"file://{tmp_path}/s", PATH, part_bytes=100_000)
    got = sorted(ts.read(spark, f"file://{tmp_path}/s").collect())
    at = 0
    for g, (i, t) in zip(got, sorted(rows, key=lambda x: x[0]), strict=True):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        assert (g.doc_id, g.start, g.n_tokens, g.ids) == (i * 3, at, len(ids), ids)
        assert g.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_empty_null_and_repeated(spark):
    assert ts.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
    df = spark.createDataFrame([(None, "a"), (2, None), (2, "b c"), (1, "")], "doc_id long, text string")
    got = [tuple(r)[:3] for r in ts.round_trip(df, PATH).collect()]
    assert got == [(None, 0, 2), (1, 2, 1), (2, 3, 1), (2, 4, 3)]
