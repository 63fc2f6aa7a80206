import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from panelforge.llm import ppm_score as ps

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
def trained():
    return F.crc32(F.col("doc_id").cast("string")) % 7 != 2



def symbols(t):
    return [*(t or "").translate(LOW).encode(), ps.END]


def plain(rows, train, order):
    """Contexts in dictionaries, one symbol at a time."""
    seen = defaultdict(Counter)
    for i, t in rows:
        if train(i):
            s = [ps.START] * order + symbols(t)
            for k in range(order, len(s)):
                for j in range(order + 1):
                    seen[tuple(s[k - j:k])][s[k]] += 1
    out = []
    for i, t in rows:
        s, bits = [ps.START] * order + symbols(t), 0.0
        for k in range(order, len(s)):
            gone = set()
            for j in range(order, -1, -1):
                c = {x: n for x, n in seen.get(tuple(s[k - j:k]), {}).items() if x not in gone}
                den = sum(c.values())
                if s[k] in c:
                    bits += math.log10((c[s[k]] - 0.5) / den)
                    break
                if c:
                    bits += math.log10(0.5 * len(c) / den)
                gone |= set(c)
            else:
                bits -= math.log10(ps.SYMBOLS - len(gone))
        out.append((i, bits))
    return dict(out)


def base(rows, train):
    tok = {i: [w for w in re.split("[\x20\x09-\x0d]+", (t or "").translate(LOW)) if w] + [None] for i, t in rows}
    c = Counter(w for i in tok if train(i) for w in tok[i])
    n, v = sum(c.values()), len(c)
    return {i: (len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for i, w in tok.items()}


def texts():
    r = random.Random(6)
    out = [None, "", " ", "A b", "é" * 40, "".join(r.choice("ab") for _ in range(3000))]
    words = ["".join(r.choice("abcdeé\n") for _ in range(r.randint(1, 5))) for _ in range(60)]
    out += [" ".join(r.choice(words) for _ in range(r.randint(1, 40))) for _ in range(80)]
    return list(enumerate(out + [out[-1], out[-1]]))


@pytest.mark.parametrize("order,fan", [(2, 64), (3, 2), (5, 64)])
def test_same_as_plain_model(spark, monkeypatch, order, fan):
    monkeypatch.setattr(ps, "FAN", fan)
    monkeypatch.setattr(ps, "BLOCK_BYTES", 4000 if fan == 2 else 1 << 20)
    rows = texts()
    train = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, kind string").repartition(3)
    got = {r.doc_id: r for r in ps.scores(df, trained(), order).collect()}
    want, words = plain(rows, train, order), base(rows, train)
    assert len(got) == len(rows) and sum(r.held_out for r in got.values()) > 3
    for i in want:
        g = got[i]
        assert g.held_out == (not train(i))
        assert g.score == pytest.approx(want[i], rel=1e-9)
        assert (g.n_tokens, g.n_known, g.train_tokens) == words[i][:3]
        assert g.base_score == pytest.approx(words[i][3], rel=1e-9, abs=1e-12)


def test_longer_contexts_help_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bits = []
    for order in (2, 5):
        r = ps.scores(docs, trained(), order).where("held_out").agg(F.sum("score"), F.sum("n_symbols")).first()
        bits.append(-r[0] / r[1] / math.log10(2))
    assert bits[1] < bits[0] and bits[1] < 2.4


def test_empty_null_and_untrained(spark):
    assert ps.scores(spark.createDataFrame([], "doc_id long, text string"), trained()).collect() == []
    df = spark.createDataFrame([(None, "ab"), (None, None)], "doc_id long, text string")
    got = sorted((r.n_tokens, r.n_known, r.base_score, round(r.score, 9), r.held_out) for r in ps.scores(df, trained()).collect())
    one = -math.log10(257)
    assert got == [(1, 0, 0.0, round(one, 9), True), (2, 0, 0.0, round(3 * one, 9), True)]
