"""Near-duplicate documents by one-permutation MinHash (operator 7).

One hash of every distinct word shingle fills 128 bins; empty bins are filled
by optimal densification (an empty bin takes the value of the first non-empty
one of a fixed random sequence of its own). Four bins make a band, 32 bands a
document. Documents with the same shingle set are one class and only its
smallest id goes on. A bucket gives star edges (its smallest id to the others);
each edge is confirmed on the full shingle sets. Buckets that still hold
several components get two more, random stars and then an exact comparison of
what is left, document against document within a block: set sizes and bitmaps of
the sets bound the intersection from above, and every pair that the bound leaves
is confirmed on full sets too. So pair counts stay near linear while no link
within a bucket is passed over.

Defined results: words are split at ASCII white space after lower-casing A-Z;
fewer words than a shingle make one shingle; null, empty or blank text has no
shingle, links with nothing and is kept. A null doc_id never links (component
null, kept). Rows of one doc_id count as one document with several texts; of a
document that stays, one_of_each keeps every different text once. Repeated rows
that differ in other columns only are one row there, that of least row hash.
Texts of any length count whole. Extra columns come through one_of_each as they
are, whatever their names, and don't reach near_duplicates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (LOWER, block_of, components, cut, dealt, drop, mapped, mix, n_blocks, pick, slices,
                     span_hashes, text_buffer, text_bytes, tidied, word_spans)

BINS, ROWS = 128, 4
#: Bits of a set's bitmap.
BITS = 1024
_rng = np.random.default_rng(7)
_A = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(57)
_DONOR = _rng.integers(0, BINS, (BINS, 1024))


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every document of a slice."""
    low = LOWER[buf]
    starts, ends, first = word_spans(low, offsets)
    w = span_hashes(low, starts, ends)
    m = max(len(w) - k + 1, 0)
    acc = np.zeros(m, np.uint64)
    for i in range(k):
        acc += w[i:i + m] * _A[i]
    acc = mix(acc)
    out = []
    for d in range(len(offsets) - 1):
        a, b = int(first[d]), int(first[d + 1])
        if b - a >= k:
            out.append(np.unique(acc[a:b - k + 1]))
        elif b > a:
            short = (w[a:b] * _A[:b - a]).sum(dtype=np.uint64) ^ _A[32 + b - a]
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(u: np.ndarray) -> np.ndarray:
    """The densified bins of a sorted set, as 32 bands of one int64 each."""
    at = np.searchsorted(u, _EDGES)
    full = at < len(u)
    got = u[np.minimum(at, len(u) - 1)]
    full &= (got >> np.uint64(57)) == np.arange(BINS, dtype=np.uint64)
    low = (got & np.uint64(0xFFFF)).astype(np.uint16)
    empty = np.flatnonzero(~full)
    if len(empty):
        donor = np.empty(len(empty), np.int64)
        left = np.arange(len(empty))
        for a, b in ((0, 16), (16, 1024)):
            hit = full[_DONOR[empty[left], a:b]]
            found = hit.any(1)
            donor[left[found]] = _DONOR[empty[left[found]], a + hit[found].argmax(1)]
            left = left[~found]
            if not len(left):
                break
        donor[left] = np.flatnonzero(full)[0]
        low[empty] = low[donor]
    return low.view(np.int64)


def signatures(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, n_shingles, f1, f2 (fingerprint of the set), sig (the bands)."""

    def run(batches):
        for b in batches:
            buf, off = text_buffer(b.column("text"))
            n, f1, f2, sig = [], [], [], []
            for i, j in slices(off):
                for u in shingle_sets(buf[off[i]:off[j]], off[i:j + 1] - off[i], k):
                    n.append(len(u))
                    f1.append(int(mix(u ^ _A[60]).sum(dtype=np.uint64).view(np.int64)) if len(u) else None)
                    f2.append(int(mix(u * _A[61]).sum(dtype=np.uint64).view(np.int64)) if len(u) else None)
                    sig.append(signature(u) if len(u) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()),
                 pa.array(sig, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "f1", "f2", "sig"])

    d = pick(docs, "doc_id", "text")
    return d.select(d.doc_id.cast("long").alias("doc_id"), "text").mapInArrow(
        mapped(run), "doc_id long, n_shingles long, f1 long, f2 long, sig array<long>")


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BITS bits for each set: those its hashes fall on."""
    out = np.zeros((len(sets), BITS // 64), np.uint64)
    for row, u in zip(out, sets, strict=True):
        bit = np.zeros(BITS, bool)
        bit[((u >> np.uint64(17)) & np.uint64(BITS - 1)).astype(np.int64)] = True
        row[:] = np.packbits(bit).view(np.uint64)
    return out


def may_reach(size_x: int, bits_x: np.ndarray, sizes: np.ndarray, bits: np.ndarray, percent: int) -> np.ndarray:
    """Where a set can have the similarity with set x. Exact: a bit that only
    one of two sets has stands for a member that the other doesn't hold."""
    both = np.minimum(size_x - np.bitwise_count(bits_x & ~bits).sum(1, dtype=np.int64),
                      sizes - np.bitwise_count(bits & ~bits_x).sum(1, dtype=np.int64))
    return 100 * both >= percent * (size_x + sizes - both)


def confirmed(docs: DataFrame, pairs: DataFrame, blocks: int, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity. A block
    holds the texts of its b documents and of the a documents they need, so a
    document in very many pairs is only sent once to each block."""
    p = pairs.select("a", "b", block_of(blocks, "b").alias("blk"))
    need = p.select(F.col("a").alias("id"), "blk").unionByName(p.select(F.col("b").alias("id"), "blk")).distinct()
    d = pick(docs, "doc_id", "text")
    texts = d.join(need, d.doc_id == need.id).select("blk", F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), "text")
    rows = texts.unionByName(p.select("blk", "a", "b", F.lit(None).cast("string").alias("text")))

    def run(t: pa.Table) -> pa.Table:
        sets: dict[int, list[np.ndarray]] = {}
        is_pair = np.asarray(t.column("b").is_valid())
        a, b = t.column("a").to_numpy(), t.column("b").combine_chunks().fill_null(0).to_numpy()
        own = np.flatnonzero(~is_pair)
        buf, off = text_buffer(t.column("text").take(pa.array(own)))
        at = 0
        for i, j in slices(off):
            for u in shingle_sets(buf[off[i]:off[j]], off[i:j + 1] - off[i], k):
                sets.setdefault(int(a[own[at]]), []).append(u)
                at += 1
        ok = []
        for x in np.flatnonzero(is_pair):
            for u in sets.get(int(a[x]), []):
                for v in sets.get(int(b[x]), []):
                    both = len(np.intersect1d(u, v, assume_unique=True))
                    if both and 100 * both >= percent * (len(u) + len(v) - both):
                        ok.append(x)
        ok = np.unique(np.array(ok, np.int64))
        return pa.table({"a": a[ok].astype(np.int64), "b": b[ok].astype(np.int64)})

    return dealt(rows, blocks, "blk").applyInArrow(tidied(run), "a long, b long")


def _left_over(members: DataFrame, sizes: DataFrame, texts: DataFrame, sigs: DataFrame, blocks: int, k: int, percent: int) -> DataFrame:
    """Links between the components that still meet in a bucket. Documents
    outside the largest component of a bucket are sent to every block that
    holds a document of that bucket, and compared there with those documents on
    full sets, but for pairs that sizes and bitmaps rule out. A block returns one link at most for
    a document and a component, never the pairs it looked at."""
    m = members.join(sizes, members.component == sizes.root).drop("root")
    big = cut(m.groupBy("bk").agg(F.max(F.struct("size", "component")).alias("main"), F.min("component").alias("lo"), F.max("component").alias("hi"))
              .where("lo != hi").select(F.col("bk").alias("bk2"), F.col("main.component").alias("main")), "main")
    m = cut(members.join(big, members.bk == big.bk2).select("bk", "rep", "component", "main", block_of(blocks, "rep").alias("blk")), "open")
    where = cut(m.select(F.col("bk").alias("bk2"), F.col("blk").alias("to")).distinct(), "where")
    ask = m.where("component != main").select("bk", "rep", "component")
    ask = ask.join(where, ask.bk == where.bk2).select(F.col("to").alias("blk"), F.lit(True).alias("asks"), "rep", "component").distinct()
    rows = ask.unionByName(m.select("blk", F.lit(False).alias("asks"), "rep", "component").distinct())
    s = sigs.select(F.col("rep").alias("rep2"), "sig").dropDuplicates(["rep2"])
    rows = rows.join(s, rows.rep == s.rep2).drop("rep2")
    rows = rows.join(texts, rows.rep == texts.doc_id).select("blk", "asks", "rep", "component", "sig", "text")

    def run(t: pa.Table) -> pa.Table:
        asks, rep, comp = (t.column(c).to_numpy() for c in ("asks", "rep", "component"))
        sig = np.array(t.column("sig").to_pylist(), np.int64).reshape(len(rep), -1)
        buf, off = text_buffer(t.column("text"))
        sets = [u for i, j in slices(off) for u in shingle_sets(buf[off[i]:off[j]], off[i:j + 1] - off[i], k)]
        size, bits = np.array([len(u) for u in sets], np.int64), bitmaps(sets)
        x_all, y_all = np.flatnonzero(asks), np.flatnonzero(~asks)
        found: dict[tuple[int, int], int] = {}
        for band in range(sig.shape[1]):
            y = y_all[np.argsort(sig[y_all, band], kind="stable")]
            v = sig[y, band]
            lo, hi = np.searchsorted(v, sig[x_all, band]), np.searchsorted(v, sig[x_all, band], "right")
            for q in range(len(x_all)):
                for at in range(lo[q], hi[q], 4096):
                    x, ys = x_all[q], y[at:min(at + 4096, hi[q])]
                    ys = ys[comp[ys] != comp[x]]
                    ys = ys[~(sig[ys, :band] == sig[x, :band]).any(1)]
                    ys = ys[100 * np.minimum(size[ys], size[x]) >= percent * np.maximum(size[ys], size[x])]
                    ys = ys[may_reach(size[x], bits[x], size[ys], bits[ys], percent)]
                    ys = ys[[(x, c) not in found for c in comp[ys].tolist()]] if len(ys) else ys
                    if not len(ys):
                        continue
                    flat = np.concatenate([sets[i] for i in ys])
                    hit = sets[x][np.minimum(np.searchsorted(sets[x], flat), size[x] - 1)] == flat
                    both = np.add.reduceat(hit, np.cumsum(size[ys]) - size[ys], dtype=np.int64)
                    for i in ys[(100 * both >= percent * (size[ys] + size[x] - both))]:
                        found.setdefault((x, int(comp[i])), int(rep[i]))
        a = np.array([rep[x] for x, _ in found], np.int64)
        b = np.array(list(found.values()), np.int64)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    out = cut(dealt(rows, blocks, "blk").applyInArrow(tidied(run), "a long, b long"), "link")
    drop(big, m, where)
    return out


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links of
    similarity percent/100 or more), kept (doc_id = component_id)."""
    spark = docs.sparkSession
    blocks = n_blocks(spark, text_bytes(docs))
    sigs = cut(signatures(docs, k), "sig")
    cls = cut(sigs.where("n_shingles > 0 and doc_id is not null").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep")), "class")
    c = cls.select(F.col("f1").alias("c1"), F.col("f2").alias("c2"), "rep")
    own = cut(sigs.join(c, (sigs.f1 == c.c1) & (sigs.f2 == c.c2), "left").select(
        "doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"),
        F.when(F.col("doc_id") == F.col("rep"), F.col("sig")).alias("sig")), "own")
    drop(sigs, cls)
    reps = own.where("sig is not null").select("rep", "sig")
    bands = reps.select("rep", F.posexplode("sig").alias("pos", "v")).select(
        "rep", F.xxhash64("pos", "v").alias("bk"))
    full = cut(bands.groupBy("bk").agg(F.min("rep").alias("center"), F.max("rep").alias("last"), F.count("*").alias("n"))
               .where("center != last").select(F.col("bk").alias("bk2"), "center", "n"), "bucket")
    members = cut(bands.join(full, bands.bk == full.bk2).select("bk", "rep", "center", "n"), "member")
    drop(full)
    # The texts that any comparison needs; planned alike at every size.
    need = members.select(F.col("rep").alias("id")).distinct().hint("merge")
    d = pick(docs, "doc_id", "text")
    texts = cut(d.join(need, d.doc_id == need.id).select(F.col("id").alias("doc_id"), "text"), "text")
    links = [cut(confirmed(texts, members.where("rep != center").select(F.col("center").alias("a"), F.col("rep").alias("b"))
                           .distinct(), blocks, k, percent), "link")]
    for again in (1, 2, 3):
        lab = components(_all(links))
        m = cut(members.where("n > 2").join(lab, members.rep == lab.node, "left").select(
            "bk", "rep", F.coalesce("component", "rep").alias("component")), "labelled")
        if again == 3:
            sizes = cut(m.select("rep", "component").distinct().groupBy(F.col("component").alias("root")).agg(F.count("*").alias("size")), "size")
            links.append(_left_over(m, sizes, texts, reps, blocks, k, percent))
            drop(lab, m, sizes)
            break
        star = cut(m.groupBy("bk").agg(
            F.min(F.struct(F.xxhash64("rep", F.lit(again)).alias("h"), F.col("rep").alias("r"), F.col("component").alias("c"))).alias("s"),
            F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select(
            F.col("bk").alias("bk2"), "s.r", "s.c"), "star")
        pairs = cut(m.join(star, m.bk == star.bk2).where("component != c").select(
            F.least("r", "rep").alias("a"), F.greatest("r", "rep").alias("b")).distinct(), "pairs")
        if pairs.limit(1).count():
            links.append(cut(confirmed(texts, pairs, blocks, k, percent), "link"))
        drop(lab, m, star, pairs)
    drop(members, texts)
    lab = components(_all(links))
    drop(*links)
    out = own.join(lab, own.rep == lab.node, "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """The documents, all columns, one of each group of near-duplicates (that
    of smallest doc_id); those without a doc_id stay. Rows of one doc_id and
    text are one row; different texts of one doc_id all stay with it."""
    names = docs.columns
    ids = near_duplicates(docs, k, percent).where("kept and doc_id is not null").select(F.col("doc_id").alias("_pf_id")).distinct()
    own = docs.where("doc_id is not null")
    own = own.join(ids, own.doc_id == ids._pf_id, "left_semi")
    # Types that can't be hashed don't order rows.
    order = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    own = own.groupBy("doc_id", "text").agg(F.min_by(row, F.xxhash64(*order)).alias("_pf_row"))
    own = own.select(*[F.col(f"_pf_row.c{i}").alias(c) for i, c in enumerate(names)])
    return own.unionByName(docs.where("doc_id is null"))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
