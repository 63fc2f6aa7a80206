import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from panelforge.llm import ecoc_langid as el


def train():
    return F.crc32(F.col("doc_id").cast("string")) % 4 != 2


def brute(rows):
    """(language, score) of each (doc_id, text, lang), by dictionaries: models of
    the languages, one weight a bit and n-gram, decoding by loss."""

    def grams(text):
        b = bytes(x + 32 if 65 <= x <= 90 else x for x in (text or "").encode())
        for k in (1, 2, 3):
            for p in range(len(b) - k + 1):
                v = int.from_bytes(b[p:p + k], "big")
                yield (k, v if k < 3 else (v * 2654435761 % 2**32) >> (32 - el.BITS))

    learn = [(t, lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2 and lang is not None and t is not None]
    langs = sorted({lang for _, lang in learn})
    counts = {lang: {} for lang in langs}
    for t, lang in learn:
        for g in grams(t):
            counts[lang][g] = counts[lang].get(g, 0) + 1
    size = {lang: sum(counts[lang].values()) + 0.5 * (2**el.BITS + 2**16 + 2**8) for lang in langs}
    code = {lang: [int(x) for x in row] for lang, row in zip(langs, el.codewords(len(langs)), strict=True)}
    bits = range(len(code[langs[0]]))
    known = {}

    def weights(g):
        if g not in known:
            p = {lang: (counts[lang].get(g, 0) + 0.5) / size[lang] for lang in langs}
            side = [[[p[lang] for lang in langs if code[lang][b] == s] for s in (1, -1)] for b in bits]
            known[g] = [math.log(sum(x) / len(x)) - math.log(sum(y) / len(y)) for x, y in side]
        return known[g]

    def margins(text):
        total, n = [0.0] * len(bits), 0
        for g in grams(text):
            n += 1
            total = [a + c for a, c in zip(total, weights(g), strict=True)]
        return [a / max(n, 1) for a in total]

    right = {lang: [0] * len(bits) for lang in langs}
    for t, lang in learn:
        right[lang] = [r + (m * c > 0) for r, m, c in zip(right[lang], margins(t), code[lang], strict=True)]
    for t, lang in [(t, lang) for _, t, lang in rows]:
        if not any(map(str.isalpha, t or "")):
            yield "und", 0.0
            continue
        m = [max(-el.CLIP, min(el.CLIP, el.STEEP * x)) for x in margins(t)]
        loss = sorted((sum(r / sum(right[x]) * math.exp(-c * y) for r, c, y in zip(right[x], code[x], m, strict=True)), x) for x in langs)
        yield loss[0][1], (loss[1][0] - loss[0][0]) / (loss[1][0] + loss[0][0])


def test_same_as_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in docs.collect()]
    text = next(t for _, t, _ in rows if t)
    long = " ".join(t for _, t, _ in rows[:40] if t)
    rows += [(10**6, None, "en"), (10**6 + 1, "", "en"), (10**6 + 2, "7 !", None), (10**6 + 3, "É", None), (10**6 + 4, long, None), (10**6 + 5, text, None), (10**6 + 6, text, None)]
    got = {r.doc_id: r for r in el.identify(spark.createDataFrame(rows, docs.schema), train()).collect()}
    want = list(brute(rows))
    assert len(got) == len(rows) and len({lang for lang, _ in want}) > 2
    for (i, _, _), (lang, score) in zip(rows, want, strict=True):
        r = got[i]
        assert abs(r.score - score) < 1e-5 and (r.lang_pred == lang or score < 1e-5)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.ambiguous == (lang != "und" and r.score < el.AMBIGUOUS)


def test_ties_of_the_loss_and_very_long_texts(spark):
    same = [(i, "one text of all", lang) for i, lang in enumerate(["b", "a", "c"])]
    got = el.identify(spark.createDataFrame(same, "doc_id long, text string, lang string"), F.lit(True)).collect()
    assert {(r.lang_pred, r.score, r.ambiguous) for r in got} == {("a", 0.0, True)}
    rows = [(1, "the cat sat on the mat", "en"), (2, "le chat est sur le tapis", "fr"), (3, "le chat est " * 500_000, None)]
    got = {r.doc_id: r.lang_pred for r in el.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True)).collect()}
    assert got == {1: "en", 2: "fr", 3: "fr"}


def test_codewords_are_far_apart():
    for n in (3, 4, 7, 8, 40):
        c = el.codewords(n).astype(int)
        d = (c.shape[1] - c @ c.T) // 2
        assert d[~np.eye(n, dtype=bool)].min() >= (2 ** (n - 2) if n <= 7 else 8)
        assert (np.abs(c.sum(0)) < n).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = el.identify(docs, train()).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").agg(
        F.count("*"), F.avg(F.expr("cast(lang = lang_pred as int)")), F.min("score"), F.max("score"), F.avg(F.col("ambiguous").cast("int"))).first()
    assert r[0] > 200 and r[1] >= 0.99 and 0 <= r[2] <= r[3] <= 1 and r[4] < 0.05


def test_more_languages_than_exhaustive_codes(spark):
    rows = [(i, " ".join(chr(97 + i % 9) + chr(97 + (i * k) % 26) for k in range(20)), f"l{i % 9}") for i in range(360)]
    got = el.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), train())
    assert sum(r.lang_pred == f"l{r.doc_id % 9}" for r in got.collect()) >= 350


def test_und_null_empty_and_extra_columns(spark):
    rows = [(1, "the cat", "en", "x"), (3, "le chat", "fr", "x"), (5, "12 !", "en", "x"), (None, None, None, None), (6, "", "fr", "x"), (7, "È", "fr", "x"), (7, "È", "fr", "x"), (8, "日本", None, "q")]
    got = el.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, score string"), F.lit(True)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 8 and by[None].lang_pred == by[5].lang_pred == by[6].lang_pred == "und"
    assert by[7].lang_pred in ("en", "fr") and by[8].lang_pred != "und" and not by[5].score and not by[5].ambiguous
    left = el.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string, score string"), el.fit(spark.createDataFrame(rows[:2], "doc_id long, text string, lang string, score string"), F.lit(True))).collect()
    assert {1, 3} <= {r.doc_id for r in left} <= {1, 3, 7, 8} and left[0].score == "x"
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert el.identify(empty, train()).collect() == []
    one = spark.createDataFrame([(1, "ab", "en"), (2, "cd", "en")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in el.identify(one, F.lit(True)).collect()} == {"en"}
