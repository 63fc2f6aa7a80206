import random

import numpy as np
import pyarrow as pa

from panelforge.llm import common as co


def test_hash_index():
    r = np.random.default_rng(0)
    h, seen = co.HashIndex(4), {}
    for _ in range(30):
        k = np.unique(r.integers(0, 1 << 63, 200, dtype=np.uint64) >> np.uint64(50) << np.uint64(50))
        got = h.get(k)
        assert got.tolist() == [seen.get(int(x), -1) for x in k]
        new = k[got < 0]
        h.add(new)
        seen |= {int(x): len(seen) + i for i, x in enumerate(new)}
    assert h.n == len(seen)


def test_text_buffer_and_slices():
    a = pa.chunked_array([pa.array(["ab", None, "é"]), pa.array(["", "xyz"])])
    buf, off = co.text_buffer(a)
    assert buf.tobytes() == "abéxyz".encode() and off.tolist() == [0, 2, 2, 4, 4, 7]
    part = pa.array(["q", "ab", "c"])[1:]
    assert co.text_buffer(part)[0].tobytes() == b"abc"
    assert co.text_buffer(pa.chunked_array([], pa.string()))[1].tolist() == [0]
    assert list(co.slices(np.array([0, 5, 5, 100, 101, 102]), 6)) == [(0, 2), (2, 3), (3, 5)]


def test_word_spans_and_hashes():
    texts = [b"a  b\n", b"", b"cc", b"\x0bdd ee", b" "]
    buf = np.frombuffer(b"".join(texts), np.uint8)
    off = np.cumsum([0, *map(len, texts)])
    s, e, first = co.word_spans(buf, off)
    words = [buf[i:j].tobytes() for i, j in zip(s, e, strict=True)]
    assert [words[first[i]:first[i + 1]] for i in range(5)] == [t.split() for t in texts]
    two = np.frombuffer(b"xx abc yy abc", np.uint8)
    h = co.span_hashes(two, np.array([3, 10, 0]), np.array([6, 13, 2]))
    assert h[0] == h[1] != h[2]


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100 + r.randint(0, 60), 100 + r.randint(0, 60)) for _ in range(40)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = dict(map(tuple, co.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: find(x) for x in root}
    assert co.components(spark.createDataFrame([], "a long, b long")).collect() == []
