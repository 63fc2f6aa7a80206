import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from panelforge.llm import suffix_dedup as sd


def brute(rows, k=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - k + 1):
            w = b[p:p + k]
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - k + 1):
            if first[b[p:p + k]] < i:
                gone[p:p + k] = b"\1" * k
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def texts():
    r = random.Random(5)
    make = lambda n, s="abcdefgh é\n": "".join(r.choice(s) for _ in range(n))
    parts = [make(r.randint(30, 400)) for _ in range(12)]
    out = [None, "", "x" * 49, "x" * 50, "x" * 51, "x" * 4000, "ab" * 300, "b" + "ab" * 200]
    for _ in range(60):
        t = ""
        for _ in range(r.randint(0, 4)):
            p = r.choice(parts)
            a = r.randint(0, len(p) // 2)
            t += make(r.randint(0, 80)) + p[a:a + r.randint(20, len(p))]
        out.append(t)
    out += [parts[0], parts[0], parts[0] + "z", make(60_000, "ab"), make(3000, "a")]
    r.shuffle(out)
    return list(enumerate(out))


def test_same_as_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t, "q") for i, t in rows], "doc_id long, text string, blk string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.digests(df).collect()}
    assert got == brute(rows)
    back = {r.doc_id: r.text for r in sd.remove_repeats(df).collect()}
    want = brute(rows)
    assert all(len((back[i] or "").encode()) == want[i][0] - want[i][1] for i in back if (rows[i][1] or "").isascii())


@pytest.mark.parametrize(("spool", "chunk"), [(1 << 20, 1 << 18), (10, 1 << 18), (10, 1), (100, 7), (1 << 20, 64)])
def test_column_bwt(monkeypatch, spool, chunk):
    monkeypatch.setattr(sd, "SPOOL", spool)
    monkeypatch.setattr(sd, "CHUNK", chunk)
    r = random.Random(2)
    strings = sorted({bytes(r.choice(b"ab\0") for _ in range(r.randint(1, 30))) for _ in range(80)}, key=lambda _: r.random())
    data = np.frombuffer(b"".join(strings), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
    c = sd.ColumnBWT(data, off)
    want = sorted(([*[x + 1 for x in s[len(s) - n:]], i - 1000], n, i) for i, s in enumerate(strings) for n in range(len(s) + 1))
    assert [(n, i) for _, n, i in want] == list(zip(c.length.tolist(), c.sid.tolist(), strict=True))
    for k in range(1, len(want)):
        a, b = want[k - 1][0][:-1], want[k][0][:-1]
        p = 0
        while p < min(len(a), len(b)) and a[p] == b[p]:
            p += 1
        assert c.lcp[k] == p
    assert all(c.bwt[k] == (0 if n == len(strings[i]) else c.alphabet.tolist().index(strings[i][-n - 1]) + 1) for k, (_, n, i) in enumerate(want))


@pytest.mark.parametrize("chunk", [1 << 18, 3, 50])
def test_first_documents(monkeypatch, chunk):
    monkeypatch.setattr(sd, "CHUNK", chunk)
    r = random.Random(8)
    strings = sorted({bytes(r.choice(b"ab") for _ in range(r.randint(1, 25))) for _ in range(120)}, key=lambda _: r.random())
    doc = [r.randrange(1000) for _ in strings]
    off = np.concatenate([[0], np.cumsum([len(x) for x in strings])])
    got = {}
    for s, a, b, d in zip(*sd.first_documents(np.frombuffer(b"".join(strings), np.uint8), off, np.array(doc), 6), strict=True):
        got |= {(s, p): d for p in range(a, b)}
    first = {}
    for x, d in zip(strings, doc, strict=True):
        for p in range(len(x) - 5):
            first[x[p:p + 6]] = min(d, first.get(x[p:p + 6], d))
    assert got == {(i, p): first[x[p:p + 6]] for i, x in enumerate(strings) for p in range(len(x) - 5)}


def test_columns_are_never_in_memory(monkeypatch):
    """Read in chunks from files, a build takes a small part of the memory that
    it takes with whole columns; the rest is the strings and a few numbers for
    each."""
    import tracemalloc

    data = np.random.default_rng(1).integers(97, 100, 300_000).astype(np.uint8)
    off = np.arange(0, 300_001, 100)

    def peak(spool, chunk):
        monkeypatch.setattr(sd, "SPOOL", spool)
        monkeypatch.setattr(sd, "CHUNK", chunk)
        tracemalloc.start()
        sd.ColumnBWT(data, off)
        got = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return got

    few = peak(1, 2000)
    assert few < 2_000_000 and few < 0.3 * peak(1 << 30, 1 << 30)


class _Function:
    """Stands for a DataFrame and gives the function that its groups would go to."""

    repartition = groupBy = lambda self, *a: self

    def applyInArrow(self, run, schema):
        return run


def test_a_long_string_costs_other_collections_no_rounds(monkeypatch):
    """Collections of short strings aren't built along with long ones, whose
    rounds would read all columns; answers are those of a brute-force version."""
    r = random.Random(4)
    groups = []
    for k in range(40):
        core = bytes(r.choice(b"abcdefgh") for _ in range(111 if k in (7, 20) else 50))
        groups.append([core, core + b"x", b"y" + core])
    strings = [(v, x) for v, g in enumerate(groups) for x in g]
    r.shuffle(strings)
    doc = r.sample(range(1000), len(strings))
    t = pa.table({"bucket": pa.array([0], pa.int32()), "_pf_blk": pa.array([3], pa.int32()),
                  "vals": [np.array([v for v, _ in strings], "<u8").tobytes()], "docs": [np.array(doc, "<i8").tobytes()],
                  "lens": [np.array([len(x) | 128 for _, x in strings], np.uint8).tobytes()], "data": [b"".join(x for _, x in strings)]})
    builds, plain = [], sd.first_documents
    monkeypatch.setattr(sd, "first_documents", lambda data, off, *a: builds.append(np.diff(off)) or plain(data, off, *a))
    out = sd._answers(_Function(), 1, 50)(t).to_pylist()
    assert sorted(n for b in builds for n in b.tolist()) == sorted(len(x) for _, x in strings)
    assert all(b.max() < 60 or b.min() > 100 for b in builds)
    first = {}
    for (_, x), d in zip(strings, doc, strict=True):
        for p in range(len(x) - 49):
            first[x[p:p + 50]] = min(d, first.get(x[p:p + 50], d))
    data = np.frombuffer(b"".join(x for _, x in strings), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(x) for _, x in strings])])
    keys = sd.span_hashes(data, off[:-1], off[1:]) ^ np.array([v for v, _ in strings], np.uint64)
    where = {int(k): x for k, (_, x) in zip(keys, strings, strict=True)}
    got = {}
    for row in out:
        for k, a, b, d in zip(np.frombuffer(row["key"], "<u8").tolist(), row["lo"], row["hi"], np.frombuffer(row["doc"], "<i8").tolist(), strict=True):
            got |= {(k, p): d for p in range(a, b)}
    assert got == {(k, p): first[x[p:p + 50]] for k, x in where.items() for p in range(len(x) - 49)}


@pytest.mark.parametrize("length", [16, 20, 50, 64])
def test_minima_in_parts(monkeypatch, length):
    buf = np.random.default_rng(3).integers(97, 101, 3000).astype(np.uint8)
    whole = sd.window_minima(buf, length)
    monkeypatch.setattr(sd, "PART", 100)
    for n in (0, length - 1, length, 99 + length, 100 + length, 3000):
        assert sd.window_minima(buf[:n], length).tolist() == whole[:max(n - length + 1, 0)].tolist()


def test_equal_hashes_are_not_equal_strings():
    data = np.frombuffer(b"abcdabcxabcd", np.uint8)
    assert sd._same_bytes(data, np.array([0, 0, 4]), np.array([4, 8, 8]), np.array([4, 4, 3])).tolist() == [False, True, True]


@pytest.mark.parametrize("length", [16, 20, 33, 64])
def test_other_lengths(spark, length):
    rows = texts()[:40]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.digests(spark.createDataFrame(rows, "doc_id long, text string"), length).collect()}
    assert got == brute(rows, length)


def test_empty_null_and_repeated(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sd.digests(empty).collect() == []
    t = "".join(chr(97 + (i * i) % 23) for i in range(90))
    df = spark.createDataFrame([(None, t), (3, t), (3, t), (2, t)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in sd.digests(df).collect())
    assert got == [(0, 0), (2, 0), (3, 90), (3, 90)]
