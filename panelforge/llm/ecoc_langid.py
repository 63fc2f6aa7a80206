"""Language identification by error-correcting output codes (operator 6).

Every language has a codeword of +1 and -1 (all columns there are for up to
seven languages, else the best of some random dense codes). For each bit a
binary classifier over hashed byte 1-, 2- and 3-grams tells the languages with
+1 from those with -1: a linear one whose weights are the log ratio of the two
sides' smoothed n-gram models, each language weighing the same; its margin is
the mean weight of a text's n-grams. Decoding is loss-weighted: a codeword's
loss is the sum of exp(-bit * margin) over the bits, weighted by how often each
bit's classifier is right for that language on the training texts. The least
loss wins; a text is flagged ambiguous where the second is close.

The models are fitted on at most SAMPLE texts of each language, those with the
smallest hash of doc_id; texts are used whole.

Defined results: a null text, or one without a letter, is `und` with score 0
and not flagged; without any learnt language all are `und`. Where losses tie,
the first language in the order of names is chosen, and the text is flagged. A
text of any length is read whole (it is a slice of its own). Rows are
independent of each other: repeated ones get the same result, rows of one doc_id
each their own, a null doc_id stays null. An empty table gives an empty table.
Extra columns, clashing names included, are no input; identified() passes them
on as they are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, cut, drop, mapped, pick, slices, text_buffer

#: Labelled texts of each language that a model is fitted on, at most.
SAMPLE = 4000
#: Languages at most (their models lie in every task).
LANGUAGES = 1000
BITS = 16
TABLE = (1 << BITS) + (1 << 16) + 256
STEEP, CLIP = 6.0, 4.0
AMBIGUOUS = 0.05
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True


def codewords(n: int) -> np.ndarray:
    """n rows of +1/-1, no column constant, none the negation of another."""
    if n <= 2:
        return np.array([[1], [-1]], np.int8)[:n]
    if n <= 7:
        cols = np.arange(1, 1 << (n - 1))
        return np.array([np.ones(len(cols)), *[np.where(cols >> i & 1, -1, 1) for i in range(n - 1)]], np.int8)
    r = np.random.default_rng(n)
    best, far = None, -1
    for _ in range(200):
        m = r.choice(np.array([-1, 1], np.int8), (n, math.ceil(10 * math.log2(n))))
        m = m[:, np.abs(m.sum(0)) < n]
        d = (m.shape[1] - (m.astype(np.int32) @ m.T.astype(np.int32))) // 2
        d = d[~np.eye(n, dtype=bool)].min()
        if d > far:
            best, far = m, d
    return best


def _codes(low: np.ndarray):
    """(n-gram length, feature numbers) for every place of a slice."""
    x = low.astype(np.uint32)
    yield 1, x + np.uint32((1 << BITS) + (1 << 16))
    pair = (x[:-1] << np.uint32(8)) | x[1:]
    yield 2, pair + np.uint32(1 << BITS)
    three = (pair[:-1] << np.uint32(8)) | x[2:]
    yield 3, (three * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def _margins(low: np.ndarray, off: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Mean weight row of each text's n-grams."""
    n = len(off) - 1
    total, count = np.zeros((n, w.shape[1])), np.zeros(n)
    for k, codes in _codes(low):
        size = np.diff(off) - k + 1
        has = np.flatnonzero(size > 0)
        if not len(has):
            continue
        rows = np.concatenate([w[codes], np.zeros((1, w.shape[1]), w.dtype)])
        at = np.empty(2 * len(has), np.int64)
        at[::2], at[1::2] = off[has], off[has] + size[has]
        total[has] += np.add.reduceat(rows, at, axis=0)[::2]
        count[has] += size[has]
    return total / np.maximum(count, 1)[:, None]


def fit(docs: DataFrame, train: Column) -> dict:
    """The model: languages, codewords, weights and their reliability."""
    d = pick(docs, "doc_id", "text", "lang").where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r[0]: r[1] for r in d.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    langs = sorted(sizes)
    if not langs:
        return {"langs": [], "code": codewords(0), "w": np.zeros((TABLE, 1), np.float32), "right": np.zeros((0, 1))}
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, SAMPLE / sizes[k]))])
    point = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    sample = cut(d.where(point < share[F.col("lang")]).select("lang", "text"), "labelled")
    number = {k: i for i, k in enumerate(langs)}

    def count(batches):
        got = np.zeros((len(langs), TABLE), np.int64)
        for b in batches:
            buf, off = text_buffer(b.column("text"))
            lang = np.array([number[x] for x in b.column("lang").to_pylist()], np.int64)
            for i, j in slices(off):
                part, o = LOWER[buf[off[i]:off[j]]], off[i:j + 1] - off[i]
                for k, codes in _codes(part):
                    size = np.diff(o)
                    which = np.repeat(lang[i:j], size)[:len(codes)]
                    ends = np.repeat(o[1:], size)[:len(codes)]
                    ok = np.arange(len(codes)) + k <= ends
                    got += np.bincount(which[ok] * TABLE + codes[ok], minlength=got.size).reshape(got.shape)
        which, feature = np.nonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(feature, pa.int32()), pa.array(got[which, feature])], names=["l", "f", "c"])

    rows = sample.mapInArrow(mapped(count), "l int, f int, c long").groupBy("l", "f").agg(F.sum("c").alias("c")).toArrow()
    c = np.zeros((len(langs), TABLE))
    c[rows.column("l").to_numpy(), rows.column("f").to_numpy()] = rows.column("c").to_numpy()
    p = (c + 0.5) / (c.sum(1, keepdims=True) + 0.5 * TABLE)
    code = codewords(len(langs))
    w = np.stack([np.log(p[code[:, b] > 0].mean(0)) - np.log(p[code[:, b] < 0].mean(0)) if (code[:, b] < 0).any() else np.zeros(TABLE)
                  for b in range(code.shape[1])], 1).astype(np.float32)

    def check(batches):
        right, n = np.zeros(code.shape), np.zeros(len(langs))
        for b in batches:
            buf, off = text_buffer(b.column("text"))
            lang = np.array([number[x] for x in b.column("lang").to_pylist()], np.int64)
            for i, j in slices(off):
                m = _margins(LOWER[buf[off[i]:off[j]]], off[i:j + 1] - off[i], w)
                np.add.at(right, lang[i:j], m * code[lang[i:j]] > 0)
                np.add.at(n, lang[i:j], 1)
        k = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(n[k]), pa.array(list(right[k]), pa.list_(pa.float64()))], names=["l", "n", "right"])

    got = sample.mapInArrow(mapped(check), "l int, n double, right array<double>").select("l", "n", F.posexplode("right").alias("b", "r")) \
        .groupBy("l", "b").agg(F.sum("n").alias("n"), F.sum("r").alias("r")).toArrow()
    drop(sample)
    right = np.zeros(code.shape)
    right[got.column("l").to_numpy(), got.column("b").to_numpy()] = got.column("r").to_numpy() / got.column("n").to_numpy()
    return {"langs": langs, "code": code, "w": w, "right": right / np.maximum(right.sum(1, keepdims=True), 1e-12)}


def decode(model: dict, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language number, score from 0 to 1) of each row of margins."""
    f = np.clip(margins * STEEP, -CLIP, CLIP)
    loss = (np.exp(-model["code"][None, :, :] * f[:, None, :]) * model["right"][None, :, :]).sum(2)
    best = loss.argmin(1)
    low = np.sort(loss, 1)
    if loss.shape[1] == 1:
        return best, np.ones(len(best))
    return best, (low[:, 1] - low[:, 0]) / np.maximum(low[:, 1] + low[:, 0], 1e-300)


def _predict(model: dict, col) -> tuple[list, list, list]:
    """(language, score, ambiguous) of every text of an Arrow column."""
    langs = [*model["langs"], "und"]
    buf, off = text_buffer(col)
    best, score = [], []
    for i, j in slices(off):
        low, o = LOWER[buf[off[i]:off[j]]], off[i:j + 1] - off[i]
        if model["langs"]:
            k, s = decode(model, _margins(low, o, model["w"]))
        else:
            k, s = np.full(j - i, -1), np.zeros(j - i)
        seen = np.concatenate([[0], np.cumsum(_LETTER[low])])[o]
        for x in np.flatnonzero(seen[1:] == seen[:-1]):  # no letter from a to z
            if not any(map(str.isalpha, low[o[x]:o[x + 1]].tobytes().decode())):
                k[x], s[x] = -1, 0
        best.extend(k.tolist())
        score.extend(s.tolist())
    return [langs[k] for k in best], score, [k >= 0 and s < AMBIGUOUS for k, s in zip(best, score, strict=True)]


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous; a narrow map that looks at nothing
    but text."""

    def run(batches):
        for b in batches:
            lang, score, amb = _predict(model, b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(amb, pa.bool_())],
                                             names=["doc_id", "lang_pred", "score", "ambiguous"])

    d = pick(docs, "doc_id", "text")
    return d.select(d.doc_id.cast("long").alias("doc_id"), "text").mapInArrow(mapped(run), "doc_id long, lang_pred string, score double, ambiguous boolean")


def identified(docs: DataFrame, model: dict) -> DataFrame:
    """The documents, all columns, without those that are `und` or ambiguous."""

    def run(batches):
        for b in batches:
            lang, _, amb = _predict(model, b.column("text"))
            yield b.filter(pa.array([k != "und" and not a for k, a in zip(lang, amb, strict=True)], pa.bool_()))

    pick(docs)  # bounds the batches
    return docs.mapInArrow(mapped(run), docs.schema)


def identify(docs: DataFrame, train: Column) -> DataFrame:
    """doc_id, held_out (train isn't true), lang_pred, score, ambiguous."""
    model = fit(docs, train)
    return predict(docs, model).select("doc_id", (~F.coalesce(train, F.lit(False))).alias("held_out"), "lang_pred", "score", "ambiguous")
