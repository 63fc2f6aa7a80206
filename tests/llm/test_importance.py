import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import importance as im

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(t):
    w = (t or "").lower().split()
    return [*w, *zip(w, w[1:], strict=False)]


def test_ratio_as_counted_by_hand(spark, monkeypatch):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice("abcdefgh" if i % 3 else "efghijkl") for _ in range(r.randint(0, 30)))) for i in range(90)] + [(90, None), (91, " ")]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, noisy double").repartition(3)
    target = spark.createDataFrame([(i, 1) for i in range(0, 90, 3)], "doc_id long, noisy int")
    got = {x.doc_id: x for x in im.resample(docs, target, 0.5).collect()}
    raw = Counter(g for _, t in rows for g in grams(t))
    aim = Counter(g for i, t in rows if i < 90 and i % 3 == 0 for g in grams(t))
    n, m = sum(raw.values()), sum(aim.values())
    for i, t in rows:
        g = grams(t)
        want = sum(math.log((aim[x] + 1) / (m + im.BUCKETS)) - math.log((raw[x] + 1) / (n + im.BUCKETS)) for x in g)
        assert got[i].n_features == len(g)
        assert got[i].log_ratio == pytest.approx(want, abs=0.05 * max(1, len(g)))  # buckets may collide
    kept = [x for x in got.values() if x.kept]
    assert len(kept) == 46
    assert min(x.noisy for x in kept) > max(x.noisy for x in got.values() if not x.kept and x.noisy is not None)


def brute(rows, target, share, noise, temper):
    """Kept ids by the definition, n-grams hashed one by one."""
    def buckets(t):
        w = [x.encode() for x in re.split("[\x20\x09-\x0d]+", (t or "").translate(LOW)) if x]
        h = [int(im.span_hashes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0]) for x in w]
        both = [int(im.mix(np.array([(a * int(im._A) + b * int(im._B)) % 2**64], np.uint64))[0]) for a, b in zip(h, h[1:], strict=False)]
        return [x % im.BUCKETS for x in h + both]

    raw = Counter(x for _, t in rows for x in buckets(t))
    aim = Counter(x for i, t in rows if i in target for x in buckets(t))
    n, m = sum(raw.values()), sum(aim.values())
    total = {}
    for i, t in rows:
        f = buckets(t)
        if f:
            w = sum(math.log((aim[x] + 1) / (m + im.BUCKETS)) - math.log((raw[x] + 1) / (n + im.BUCKETS)) for x in f)
            total[i] = (w / len(f) * n / len(rows) if temper else w) + noise[i]
    return set(sorted(total, key=total.get, reverse=True)[:round(share * len(rows))]), total


def test_kept_rows_as_brute_force(spark):
    r = random.Random(6)
    rows = [(i, " ".join(r.choice("aBcdefgh" if i % 3 else "efghijkl") for _ in range(r.randint(1, 30)))) for i in range(200)]
    rows += [(200, None), (201, " "), (202, ""), (203, "x " * 30_000)]
    target = set(range(0, 200, 3))
    d = spark.createDataFrame([(i,) for i, _ in rows], "doc_id long").select("doc_id", F.xxhash64("doc_id", F.lit(6)).alias("h")).collect()
    u = {x.doc_id: (int(im.mix(np.array([x.h], np.int64).view(np.uint64))[0]) >> 11) / 2**53 for x in d}
    noise = {i: -math.log(-math.log(x)) for i, x in u.items()}
    docs = spark.createDataFrame([(*x, "raw", 1) for x in rows], "doc_id long, text string, noise string, f int").repartition(3)
    aim = spark.createDataFrame([(i,) for i in target], "doc_id long")
    for share, temper in ((0.1, True), (0.5, False), (0.8, True)):
        want, total = brute(rows, target, share, noise, temper)
        got = {x.doc_id: x for x in im.resample(docs, aim, share, temper=temper).collect()}
        assert {i for i, x in got.items() if x.kept} == want
        assert all(got[i].noisy == pytest.approx(v) for i, v in total.items())
    assert not any(got[i].kept for i in (200, 201, 202))


def test_texts_without_words_come_last(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1 and toxic = 0")
    blank = spark.createDataFrame([(10**9 + i, [None, "", " \n"][i % 3]) for i in range(40)], "doc_id long, text string")
    got = im.resample(docs.unionByName(blank), target, 0.8)
    assert got.where("doc_id >= 1000000000 and kept").count() == 0


def test_gumbel_draws_follow_the_weights(spark):
    w = np.array([0.0, 1.0, 2.0])
    wins = np.zeros(3)
    for seed in range(40):
        d = spark.range(300).select(F.col("id").alias("doc_id"), F.xxhash64("id", F.lit(seed)).alias("h")).toPandas()
        u = (im.mix(d.h.to_numpy().view(np.uint64)) >> np.uint64(11)) / float(1 << 53)
        g = -np.log(-np.log(u)).reshape(100, 3) + w
        wins += np.bincount(g.argmax(1), minlength=3)
    assert np.allclose(wins / wins.sum(), np.exp(w) / np.exp(w).sum(), atol=0.04)


def test_quality_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = im.resample(docs, labels.where("quality = 1 and toxic = 0"), 0.86).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()
    share = dict(map(tuple, got))
    assert share[1] > 0.97 and share[0] < 0.15


def test_kth_largest(spark):
    r = random.Random(2)
    v = [r.choice([r.randint(-2**62, 2**62), r.randint(-9, 9), 0]) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in v], "v long")
    for k in (1, 2, 150, 300):
        assert im.kth_largest(df, "v", k) == sorted(v, reverse=True)[k - 1]
    assert im.kth_largest(df, "v", 0) is None and im.kth_largest(df, "v", 301) is None


def test_empty_null_and_repeated(spark):
    none = spark.createDataFrame([], "doc_id long")
    assert im.resample(spark.createDataFrame([], "doc_id long, text string"), none, 0.5).collect() == []
    df = spark.createDataFrame([(None, None), (1, "a b"), (1, "a b"), (2, "")], "doc_id long, text string")
    got = im.resample(df, none, 0.75).collect()
    assert len(got) == 4 and all(x.log_ratio == 0 for x in got) and sum(x.kept for x in got) >= 3
    assert [x.log_weight for x in sorted(got, key=lambda x: x.doc_id or 0)] == [None, 0, 0, None]
