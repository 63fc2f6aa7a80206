"""Importance resampling of documents (operator 5).

Two bags of hashed word 1- and 2-grams are generative models: one of target
texts, one of all raw texts. A document's log importance weight is the log ratio
of its probabilities under them, the sum over its n-grams. That sum grows with
the text, so a few words of junk would weigh like no junk at all; by default it
is tempered to one length: the mean over the text's n-grams times the average
number of n-grams of a row of the corpus (of the data, not of labels). With
temper=False it is the plain sum. Documents are sampled without replacement with
those weights by Gumbel top-k: noise drawn from the hash of doc_id is added and
the k largest sums are kept. Log weights lie far apart beside the noise, whose
spread is 1.3, so the noise decides near the edge only.

The raw model counts all documents; the target model is fitted on at most
SAMPLE target documents, those with the smallest hash of doc_id. The k-th
largest sum is found by a radix search over its 64 bits, 16 at a time, so no
task holds more than 65536 counts.

Defined results: null, empty or blank text has no n-gram: its log_ratio is 0,
log_weight and noisy are null and it ranks behind every text that has one, so it
is kept only if k exceeds their number. A text of any length is one row and its
n-grams are counted in slices of whole documents. Rows that tie at the k-th
place (repeated rows) are all kept; k is the given share of all rows, rounded;
without target documents the target is the raw model and all log weights are 0.
A null doc_id has the noise of its text. Extra columns don't come through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, cut, mapped, mix, pick, slices, span_hashes, text_buffer, word_spans

BUCKETS = 1 << 14
SAMPLE = 20_000
#: Order of a text without n-grams: below that of every double.
LAST = -(1 << 63)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of words, then of word pairs; the document of each)."""
    low = LOWER[buf]
    start, end, first = word_spans(low, off)
    h = span_hashes(low, start, end)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    two = mix(h[:-1] * _A + h[1:] * _B)
    same = doc[1:] == doc[:-1]
    return (np.concatenate([h, two[same]]) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([doc, doc[1:][same]])


def model(texts: DataFrame) -> np.ndarray:
    """Counts of all buckets; the driver gets BUCKETS rows at most."""

    def run(batches):
        got = np.zeros(BUCKETS, np.int64)
        for b in batches:
            buf, off = text_buffer(b.column("text"))
            for i, j in slices(off):
                got += np.bincount(_features(buf[off[i]:off[j]], off[i:j + 1] - off[i])[0], minlength=BUCKETS)
        k = np.flatnonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(got[k])], names=["f", "c"])

    rows = texts.select("text").mapInArrow(mapped(run), "f long, c long").groupBy("f").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(BUCKETS)
    out[rows.column("f").to_numpy()] = rows.column("c").to_numpy()
    return out


def weights(docs: DataFrame, target: DataFrame, seed: int = 5, temper: bool = True) -> DataFrame:
    """doc_id, n_features, log_ratio (sum over the n-grams), log_weight (that,
    tempered if asked; null without n-grams), noisy (with noise), rank_bits (its order as a long)."""
    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    few = pick(target, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct() \
        .orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(SAMPLE)
    # At most SAMPLE ids of eight bytes: a bounded broadcast.
    raw, aim = model(d), model(d.join(F.broadcast(few), "doc_id", "left_semi"))
    if not aim.sum():
        aim = raw
    ratio = np.log((aim + 1) / (aim.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))
    usual = raw.sum() / max(d.count(), 1)

    def run(batches):
        for b in batches:
            buf, off = text_buffer(b.column("text"))
            total, count = [np.zeros(0)], [np.zeros(0, np.int64)]
            for i, j in slices(off):
                f, doc = _features(buf[off[i]:off[j]], off[i:j + 1] - off[i])
                total.append(np.bincount(doc, ratio[f], j - i))
                count.append(np.bincount(doc, minlength=j - i))
            total, count = np.concatenate(total), np.concatenate(count)
            w = total * usual / np.maximum(count, 1) if temper else total
            u = (mix(b.column("noise").to_numpy().astype(np.int64).view(np.uint64)) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
            noisy = w - np.log(-np.log(np.clip(u, 1e-300, 1 - 1e-16)))
            bits = (noisy + 0.0).view(np.int64)
            bits = np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)
            none = count == 0
            bits[none] = LAST
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(count), pa.array(total), pa.array(w, mask=none), pa.array(noisy, mask=none), pa.array(bits)],
                                             names=["doc_id", "n_features", "log_ratio", "log_weight", "noisy", "rank_bits"])

    noise = F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.lit(seed + 2))).otherwise(F.xxhash64("doc_id", F.lit(seed + 1)))
    return d.withColumn("noise", noise).mapInArrow(
        mapped(run), "doc_id long, n_features long, log_ratio double, log_weight double, noisy double, rank_bits long")


def kth_largest(table: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest value of a long column, by its 16-bit digits."""
    if k < 1:
        return None
    c, known = F.col(column), []
    for shift in (48, 32, 16, 0):
        digit = F.shiftright(c, shift) if shift == 48 else F.shiftright(c, shift).bitwiseAND(F.lit(0xFFFF))
        rows = table
        for s, v in known:
            rows = rows.where((F.shiftright(c, s) if s == 48 else F.shiftright(c, s).bitwiseAND(F.lit(0xFFFF))) == v)
        for v, n in sorted(rows.groupBy(digit.alias("v")).count().collect(), reverse=True):
            if n >= k:
                known.append((shift, v))
                break
            k -= n
        else:
            return None
    return sum(v << s for s, v in known)


def resample(docs: DataFrame, target: DataFrame, share: float, seed: int = 5, temper: bool = True) -> DataFrame:
    """weights() of all documents and kept: the given share of them, sampled."""
    w = cut(weights(docs, target, seed, temper), "weight")
    edge = kth_largest(w, "rank_bits", round(share * w.count()))
    kept = F.lit(False) if edge is None else F.col("rank_bits") >= F.lit(edge).cast("long")
    return w.select("doc_id", "n_features", "log_ratio", "log_weight", "noisy", kept.alias("kept"))
