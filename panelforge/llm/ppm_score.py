"""Code lengths by prediction by partial matching (operator 2).

The model is a trie of byte contexts, most recent byte first, up to ORDER
bytes deep, whose nodes count the symbols seen after them (256 bytes and the
end of a text; a text starts in a context of start marks). It is trained on
the training documents and then static. A symbol is coded in its longest known
context; where the context has not seen it, an escape (method D: half a count
of each different symbol goes to it) leads to the next shorter one,
without the symbols the longer one has excluded, and at last to a uniform
choice of what remains.

The trie is never in one place. Each block of documents counts its own strings
of ORDER + 1 symbols; strings meet in buckets by the three latest context bytes,
where all their contexts of three or more bytes are, so a bucket counts them at
every order and works out the code length of each string. Contexts of two and
fewer bytes are one table, which every task gets: 258 x 258 x 257 counts at most,
whatever the corpus, and only those that occur. The code lengths go back to the
blocks that asked, and blocks add them up for each document. What is shuffled
grows with the corpus; what a task reads does not, as there are as many tasks as
blocks.

base_score is the add-one unigram score of the words, by the same exchange;
words are matched by 64-bit hashes.

Defined results: null text is empty (one end symbol, one end token); a
document whose training flag is null is scored and not learnt from; no training
document leaves a uniform model (and a base score of 0); repeated rows count
each time. A text of any length is scored whole (it is a slice of its own in its
block). Extra columns, clashing names included, don't reach the operator.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import (LOWER, HashIndex, block_of, cut, dealt, drop, mapped, mix, n_blocks, pick, slices,
                     span_hashes, text_buffer, text_bytes, tidied, word_spans)

ORDER = 5
#: Larger blocks than elsewhere: the more text, the fewer strings a byte.
BLOCK_BYTES = 8 << 20
#: Blocks, or merged groups of them, that meet in one task.
FAN = 64
END, START, SYMBOLS = 256, 257, 257


def _strings(buf: np.ndarray, off: np.ndarray, order: int) -> np.ndarray:
    """The (context, symbol) codes of all symbols of a slice, one end for each
    document: c1 (latest) highest, the symbol in the lowest nine bits."""
    n = len(off) - 1
    sym = np.full(len(buf) + n * (order + 1), START, np.uint64)
    size = np.diff(off)
    begin = off[:-1] + np.arange(n) * (order + 1) + order
    end = begin + size
    keep = np.zeros(len(sym) + 1, np.int8)
    np.add.at(keep, begin, 1)
    np.add.at(keep, end, -1)
    keep = np.cumsum(keep[:-1]).astype(bool)
    sym[keep] = buf
    sym[end] = END
    keep[end] = True
    code = sym[order:].copy()
    for j in range(1, order + 1):
        code |= sym[order - j:len(sym) - j] << np.uint64(9 * (order - j + 1))
    return code[keep[order:]]


def _sum_by(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different keys, sums, place of each key's sum)."""
    u, inv = np.unique(keys, return_inverse=True)
    return u, np.bincount(inv, counts, len(u)).astype(np.int64), inv


def _flagged(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different keys, how often flagged) of keys with a flag as lowest bit."""
    if not len(k):
        return k, np.zeros(0, np.int64)
    k = np.sort(k)
    head = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    n = np.diff(np.append(head, len(k))) * (k[head] & np.uint64(1)).astype(np.int64)
    key = k[head] >> np.uint64(1)
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[head], np.add.reduceat(n, head)


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    u, c, _ = _sum_by(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
    return u, c


class Low:
    """Training counts of the contexts of two bytes, and with them of one and
    none: sorted codes (c1, c2, symbol) and their counts."""

    def __init__(self, key: np.ndarray, count: np.ndarray):
        o = np.argsort(key)
        self.key, self.count = key[o].astype(np.int64), count[o].astype(np.int64)
        self.one = np.zeros((258, 257), np.int64)
        np.add.at(self.one, (self.key >> 18, self.key & 511), self.count)
        self.ctx, head = np.unique(self.key >> 9, return_index=True)
        sums = (lambda x: np.add.reduceat(x, head)) if len(head) else (lambda x: x)
        #: Of each context: its total, different symbols, and what those count
        #: in the context of one byte.
        self.facts = np.stack([sums(self.count), sums((self.count > 0).astype(np.int64)), sums(self.one[self.key >> 18, self.key & 511])])

    @staticmethod
    def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return at, table[at] == keys

    def counts(self, code: np.ndarray) -> np.ndarray:
        at, ok = self._find(self.key, code)
        return np.where(ok, self.count[at], 0) if len(self.key) else np.zeros(len(code), np.int64)

    def context(self, ctx: np.ndarray) -> np.ndarray:
        at, ok = self._find(self.ctx, ctx)
        return np.where(ok, self.facts[:, at], 0) if len(self.ctx) else np.zeros((3, len(ctx)), np.int64)


def code_lengths(key: np.ndarray, count: np.ndarray, low: Low, order: int) -> np.ndarray:
    """log10 probability of each string's symbol after its context, for all
    different strings (with training counts) of whole contexts of three symbols
    (two where order is 2)."""
    s = (key & np.uint64(511)).astype(np.int64)
    two = (key >> np.uint64(9 * (order - 1))).astype(np.int64)  # c1, c2
    c1 = two >> 9
    # For every order, of each string: count, context total, different symbols.
    cnt, tot, dif, parts = {}, {}, {}, {}
    for j in range(order, 2, -1):
        ctx = key >> np.uint64(9 * (order - j) + 9)
        u, c, inv = _sum_by((ctx << np.uint64(9)) | s.astype(np.uint64), count)
        uc, head, cinv = np.unique(u >> np.uint64(9), return_index=True, return_inverse=True)
        total = np.add.reduceat(c, head) if len(u) else c
        kinds = np.add.reduceat((c > 0).astype(np.int64), head) if len(u) else c
        parts[j] = (u, c, inv, cinv, total, kinds)
        cnt[j], tot[j], dif[j] = c[inv], total[cinv[inv]], kinds[cinv[inv]]
    total1, kinds1 = low.one.sum(1), (low.one > 0).sum(1)
    zero = low.one.sum(0)
    cnt[2] = low.counts((two << 9) | s)
    tot[2], dif[2], mass2 = low.context(two)
    cnt[1], tot[1], dif[1] = low.one[c1, s], total1[c1], kinds1[c1]
    cnt[0], tot[0], dif[0] = zero[s], np.full(len(s), zero.sum()), np.full(len(s), int((zero > 0).sum()))
    # Of each string at order j: what the symbols seen at order j + 1 count at j.
    out_mass = {order: np.zeros(len(s), np.int64)}
    for j in range(order - 1, 1, -1):
        u, c, inv, cinv, _, kinds = parts[j + 1]
        shorter = ((u >> np.uint64(18)) << np.uint64(9)) | (u & np.uint64(511))
        at_j = parts[j][1][np.searchsorted(parts[j][0], shorter)] if j > 2 else low.counts(shorter.astype(np.int64))
        mass = np.bincount(cinv, np.where(c > 0, at_j, 0), len(kinds)).astype(np.int64)
        out_mass[j] = mass[cinv[inv]]
    out_mass[1] = mass2
    out_mass[0] = np.where(low.one > 0, zero[None, :], 0).sum(1)[c1]
    out = np.zeros(len(s))
    found = np.zeros(len(s), bool)
    with np.errstate(divide="ignore", invalid="ignore"):
        for j in range(order, -1, -1):
            kinds = dif[j] - (dif[j + 1] if j < order else 0)
            den = tot[j] - out_mass[j]
            hit = ~found & (cnt[j] > 0)
            out[hit] += np.log10((cnt[j][hit] - 0.5) / den[hit])
            found |= hit
            esc = ~found & (den > 0)
            out[esc] += np.log10(0.5 * kinds[esc] / den[esc])
        out[~found] -= np.log10(SYMBOLS - dif[0][~found])
    return out


def _pack(x: np.ndarray) -> bytes:
    """Eight-byte values by byte place: what is alike lies together, so tables
    and shuffles compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack(b: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(kind).ravel()


_SENT = "bucket int, blk int, kind int, keys binary, counts binary"
_SENT_PA = pa.schema([("bucket", pa.int32()), ("blk", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
#: kind: strings, words, contexts of two symbols.
STRING, WORD, LOW = 0, 1, 2


def _each(t: pa.Table):
    """Slices of a block: bytes in lower case, offsets, training flags, rows."""
    buf, off = text_buffer(t.column("text"))
    train = t.column("train").combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
    for i, j in slices(off):
        yield LOWER[buf[off[i]:off[j]]], off[i:j + 1] - off[i], train[i:j], slice(i, j)


def _sent(docs: DataFrame, buckets: int, order: int) -> DataFrame:
    def send(t: pa.Table) -> pa.Table:
        grams, words = [], []
        for low, off, train, _ in _each(t):
            flag = np.repeat(train, np.diff(off) + 1).astype(np.uint64)
            grams.append(_flagged((_strings(low, off, order) << np.uint64(1)) | flag))
            start, end, first = word_spans(low, off)
            w = span_hashes(low, start, end) & ~np.uint64(1)
            words.append(_flagged(w | np.repeat(train, np.diff(first)).astype(np.uint64)))
        out = {f: [] for f in _SENT_PA.names}
        blk = t.column("blk")[0].as_py()

        def put(bucket, kind, keys, counts):
            for f, x in zip(_SENT_PA.names, (bucket, blk, kind, _pack(keys.astype("<u8")), _pack(counts.astype("<i8"))), strict=True):
                out[f].append(x)

        key, n = _merged(grams)
        k, c, _ = _sum_by(((key >> np.uint64(9 * (order - 1))) << np.uint64(9)) | (key & np.uint64(511)), n)
        put(-1, LOW, k[c > 0], c[c > 0])
        word, m = _merged(words)
        for kind, key, n, by in ((STRING, key, n, key >> np.uint64(9 * (order - min(order, 3) + 1))), (WORD, word, m, word)):
            b = (mix(by) % np.uint64(buckets)).astype(np.int64)
            o = np.argsort(b, kind="stable")
            for rows in np.split(o, np.flatnonzero(np.diff(b[o])) + 1):
                if len(rows):
                    put(int(b[rows[0]]), kind, key[rows], n[rows])
        return pa.table(out, schema=_SENT_PA)

    return dealt(docs, buckets, "blk").applyInArrow(tidied(send), _SENT)


def _lists(t: pa.Table, c: str, kind: str) -> list[np.ndarray]:
    return [_unpack(x, kind) for x in t.column(c).to_pylist()]


def _answers(sent: DataFrame, blocks: int, low: Low, order: int) -> DataFrame:
    """grp (a block), kind, keys, vals (code lengths or counts), and once for a
    bucket its number of different training words and of training words. What
    blocks sent for a bucket is merged up a tree of FAN children a node, so the
    latest bytes that every block has don't meet in one task, and the answers
    go down the same way."""
    names, tasks = "kind int, bucket int, grp int, keys binary", blocks

    def merge(t: pa.Table) -> pa.Table:
        u, c, _ = _sum_by(np.concatenate(_lists(t, "keys", "<u8")), np.concatenate(_lists(t, "counts", "<i8")))
        one = {k: t.column(k)[:1] for k in ("kind", "bucket")}
        return pa.table({**one, "grp": pa.array([t.column("up")[0].as_py()], pa.int32()), "keys": pa.array([_pack(u.astype("<u8"))], pa.binary()), "counts": pa.array([_pack(c)], pa.binary())})

    def top(t: pa.Table) -> pa.Table:
        kind = t.column("kind")[0].as_py()
        keys = _lists(t, "keys", "<u8")
        u, c, inv = _sum_by(np.concatenate(keys), np.concatenate(_lists(t, "counts", "<i8")))
        vals = (code_lengths(u, c, low, order) if kind == STRING else c.astype(np.float64))[inv]
        off = np.cumsum([0, *map(len, keys)])
        once = lambda x: pa.array([int(x) if kind == WORD else 0] + [0] * (len(keys) - 1), pa.int64())
        return pa.table({**{k: t.column(k) for k in ("kind", "bucket", "grp", "keys")}, "vals": pa.array([_pack(vals[off[i]:off[i + 1]]) for i in range(len(keys))], pa.binary()),
                         "known": once((c > 0).sum()), "tokens": once(c.sum())})

    def down(t: pa.Table, s: pa.Table) -> pa.Table:
        """Children's rows and their node's answer (its keys are sorted)."""
        key, val = (np.concatenate(_lists(s, c, k)) for c, k in (("keys", "<u8"), ("vals", "<f8")))
        vals = [_pack(val[np.searchsorted(key, k)]) for k in _lists(t, "keys", "<u8")]
        count = lambda c: pa.array([sum(s.column(c).to_pylist())] + [0] * (len(t) - 1), pa.int64())
        return pa.table({**{k: t.column(k) for k in ("kind", "bucket", "grp", "keys")}, "vals": pa.array(vals, pa.binary()), "known": count("known"), "tokens": count("tokens")})

    levels = [sent.where("bucket >= 0").withColumnRenamed("blk", "grp")]
    up = F.floor(F.col("grp") / FAN).cast("int")
    while blocks > FAN:
        levels.append(cut(dealt(levels[-1].withColumn("up", up), tasks, "kind", "bucket", "up").applyInArrow(tidied(merge), names + ", counts binary"), "merged"))
        blocks = -(-blocks // FAN)
    schema = names + ", vals binary, known long, tokens long"
    got = dealt(levels[-1], tasks, "kind", "bucket").applyInArrow(tidied(top), schema)
    for below in reversed(levels[:-1]):
        upper = cut(got, "lengths").withColumnRenamed("grp", "up")
        got = dealt(below.withColumn("up", up), tasks, "kind", "bucket", "up").cogroup(dealt(upper, tasks, "kind", "bucket", "up")).applyInArrow(tidied(down), schema)
    return got


def _low_table(sent: DataFrame) -> Low:
    """Counts of the contexts of two symbols: 258 x 258 x 257 at most, fewer
    than 17 million numbers whatever the corpus."""

    def rows(batches):
        for b in batches:
            for k, c in zip(b.column("keys").to_pylist(), b.column("counts").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(_unpack(k, "<i8")), pa.array(_unpack(c, "<i8"))], names=["k", "c"])

    got = sent.where(F.col("kind") == LOW).select("keys", "counts").mapInArrow(mapped(rows), "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).toArrow()
    return Low(got.column("k").to_numpy(), got.column("c").to_numpy())


def scores(docs: DataFrame, train: Column, order: int = ORDER) -> DataFrame:
    """doc_id, held_out (not learnt from), n_tokens, n_known, train_tokens,
    base_score, score and n_symbols of every document; train is a condition on
    doc_id."""
    if not 2 <= order <= 5:
        raise ValueError("order must be 2 to 5")
    spark = docs.sparkSession
    n = n_blocks(spark, text_bytes(docs), BLOCK_BYTES)
    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    d = d.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train"), block_of(n, "doc_id").alias("blk"))
    sent = cut(_sent(d, n, order), "sent")
    low = _low_table(sent)
    ends = int(low.one[:, END].sum())
    answers = cut(_answers(sent, n, low, order).drop("bucket").withColumnRenamed("grp", "blk"), "lengths")
    drop(sent)
    totals = answers.where(F.col("kind") == WORD).agg(F.sum("known"), F.sum("tokens")).first()
    v, total = (totals[0] or 0) + (ends > 0), (totals[1] or 0) + ends

    def run(t: pa.Table, s: pa.Table) -> pa.Table:
        tables = {}
        for kind in (STRING, WORD):
            mine = s.filter(pc.equal(s.column("kind"), kind))
            key, val = (np.concatenate([np.zeros(0, k), *_lists(mine, c, k)]) for c, k in (("keys", "<u8"), ("vals", "<f8")))
            h = HashIndex(max(10, int(2 * len(key)).bit_length()))
            h.add(mix(key))
            tables[kind] = (h, val)
        size = len(t)
        toks, known, base, score, syms = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size), np.zeros(size), np.zeros(size, np.int64)
        for buf, off, _, at in _each(t):
            h, x = tables[STRING]
            code = x[h.get(mix(_strings(buf, off, order)))]
            score[at] = np.add.reduceat(code, off[:-1] + np.arange(len(off) - 1))
            syms[at] = np.diff(off) + 1
            start, end, first = word_spans(buf, off)
            h, x = tables[WORD]
            c = x[h.get(mix(span_hashes(buf, start, end) >> np.uint64(1)))]
            many = np.diff(first)
            toks[at] = many + 1
            seen = np.concatenate([[0], np.cumsum(c > 0)])
            known[at] = seen[first[1:]] - seen[first[:-1]] + (ends > 0)
            some = np.flatnonzero(many)
            part = np.zeros(len(many))
            if len(some):
                part[some] = np.add.reduceat(np.log10(c + 1), first[some])
            base[at] = part + np.log10(ends + 1)
        return pa.table({"doc_id": t.column("doc_id"), "train": t.column("train"), "n_tokens": toks, "n_known": known,
                         "base": base, "score": score, "n_symbols": syms})

    got = dealt(d, n, "blk").cogroup(dealt(answers, n, "blk")).applyInArrow(
        tidied(run), "doc_id long, train boolean, n_tokens long, n_known long, base double, score double, n_symbols long")
    return got.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
                      (F.col("base") - F.col("n_tokens") * F.lit(float(np.log10(total + v + 1)))).alias("base_score"), "score", "n_symbols")

