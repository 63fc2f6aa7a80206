import hashlib
import random

import numpy as np
import public_tokenizers as P
import tiktoken

from panelforge.llm import bpe_matrix as bm

PATH = P.path("byte_bpe_50k.tiktoken")


def texts():
    r = random.Random(1)
    odd = [None, "", "a" * 3000, "".join(r.choice("abcdefghij") for _ in range(3000)), "日本語" * 200, "  \n\n x", "the" * 400, "<|endoftext|>"]
    return odd + ["".join(r.choice("abcdehinorst é日'") for _ in range(r.randint(0, 300))) for _ in range(300)]


def test_same_as_the_library_and_round_trip(spark):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bm.load_ranks(PATH), special_tokens={})
    rows = list(enumerate(texts())) + [(0, None), (None, "x")]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, ids string")
    out = bm.encode(df, PATH, P.PATTERN)
    got = out.collect()
    assert len(got) == len(rows)
    for g, (i, t) in zip(sorted(got, key=lambda g: (g.doc_id is None, g.doc_id or 0)), sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)), strict=True):
        want = enc.encode_ordinary(t or "")
        assert (g.doc_id, g.n_tokens, g.ids) == (i, len(want), want)
        assert g.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = {r.doc_id: bytes(r.decoded).decode() for r in bm.decode(out, PATH, P.PATTERN).collect()}
    assert all(back[i] == (t or "") for i, t in rows)


def test_one_merge_a_round_equals_the_queue():
    bpe = bm.MatrixBPE(bm.load_ranks(PATH))
    r = random.Random(2)
    pieces = ["".join(r.choice("aehinorst") for _ in range(r.randint(1, 200))).encode() for _ in range(200)]
    for p, m in zip(pieces, bpe.encode_pieces(pieces), strict=True):
        assert m.tolist() == (bpe._queue(p).tolist() if p not in bpe.ranks else [bpe.ranks[p]])


def test_empty(spark):
    assert bm.encode(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN).collect() == []


def test_very_long_texts_and_clashing_names(spark):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bm.load_ranks(PATH), special_tokens={})
    r = random.Random(5)
    long = ["".join(r.choice("aehinorstdlu") for _ in range(40_000)), "the old sea was calm. " * 40_000, "\n" * 20_000]
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in enumerate(long)], "doc_id int, text string, n_tokens string, ids_sha256 int, decoded string")
    got = sorted(bm.encode(df, PATH, P.PATTERN).collect())
    assert [list(g.ids) for g in got] == [enc.encode_ordinary(t) for t in long]
    assert [g.decoded_sha256 for g in got] == [hashlib.sha256(t.encode()).hexdigest() for t in long]
