"""Removal of byte strings that an earlier document also holds (operator 9).

The suffix structure is the one of a string collection, built column by column:
every round puts one more symbol of each string in front of its last suffix,
so the collection's Burrows-Wheeler transform and the common prefixes of its
sorted suffixes grow by one entry per string (class ColumnBWT). The columns are
sequential files: a round reads them CHUNK entries at a time to find where the
new suffixes go, and reads them again while it writes the next ones, so a build
holds a chunk and a few numbers a string, never a column. The files are scratch
of the task that builds (kept in its memory up to SPOOL bytes, beyond that on
its disk); nothing else reads them, and a task that is lost starts anew. Rounds
are as many as the longest string, so whole documents, of any length, never
enter it as they are.
Each 50-byte window belongs to its minimiser (the least hash of its 28-byte
substrings), and windows that follow each other with one minimiser make a short
string of at most 113 bytes. Equal windows have equal minimisers, so the
strings of one minimiser are a collection of their own:

1. each block of documents sends the minimisers it holds; what comes back says
   which of them other documents hold too (most text stops here);
2. the block sends the strings of those, equal ones once with their smallest
   document;
3. a bucket of minimisers merges equal strings and builds the transform and
   the common prefixes of collections of two or more different strings (a
   single string shares no window with another); suffixes next to each other
   with 50 common bytes are one window, and its smallest document goes back;
4. the block marks the bytes of windows whose smallest document is smaller.

A hot passage is one string per block at most, wherever it stands. Matching of
strings inside a block uses 64-bit hashes; where blocks meet, strings are one
member of a collection only if their bytes are equal.

Defined results: null text is empty; a null doc_id neither loses bytes nor
takes them from others; rows of one doc_id don't take bytes from each other;
repeated rows lose the same bytes; texts of any length count whole, in slices of
their block. Extra columns, clashing names included, don't reach digests and come
through remove_repeats as they are; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_of, cut, dealt, drop, mix, n_blocks, pick, slices, span_hashes, text_buffer, text_bytes, tidied

MER = 28
#: Windows of one string at most, and whose hashes are made at one time.
RUN, PART = 64, 1 << 14
#: Bytes of a column's file that stay in memory, and entries read at a time.
SPOOL, CHUNK = 1 << 22, 1 << 19
#: Strings of one collection build, about, and how far their collections' longest
#: ones lie apart.
STRINGS, SPREAD = 1024, 16


def window_minima(buf: np.ndarray, length: int) -> np.ndarray:
    """For every start of a window of `length` bytes, the least hash of its
    substrings of MER bytes (of all its bytes if it is shorter)."""
    n, mer = max(len(buf) - length + 1, 0), min(MER, length)
    if n > PART:  # intermediates stay in a core's cache
        return np.concatenate([window_minima(buf[a:a + PART + length - 1], length) for a in range(0, n, PART)])
    if not n:
        return np.zeros(0, np.uint64)
    pad = np.concatenate([buf, np.zeros(8, np.uint8)])
    x = np.ndarray((len(buf),), "<u8", pad, 0, (1,)).astype(np.uint64)
    m = len(buf) - mer + 1
    h = x[:m] * np.uint64(0x9E3779B97F4A7C15)
    for at in [*range(8, mer - 8, 8), mer - 8]:  # eight bytes each, the last ones flush
        h ^= h >> np.uint64(32)
        h += x[at:at + m]
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    w, have = length - mer + 1, 1
    while have * 2 <= w:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    if have < w:
        h = np.minimum(h[:n], h[w - have:w - have + n])
    return h[:n]


def runs(buf: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, minimiser, document) of the runs of windows of one
    minimiser, at most RUN windows each."""
    v = window_minima(buf, length)
    if not len(v):
        e = np.zeros(0, np.int64)
        return e, e, v, e
    size = np.maximum(np.diff(off) - length + 1, 0)  # windows of each document
    ok = np.zeros(len(v) + 1, np.int32)
    has = np.flatnonzero(size)
    np.add.at(ok, off[has], 1)
    np.add.at(ok, off[has] + size[has], -1)
    ok = np.cumsum(ok[:-1]) > 0
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | ~ok[:-1]
    new[off[has]] = True
    start = np.flatnonzero(new & ok)
    end = np.flatnonzero(ok & np.concatenate([new[1:] | ~ok[1:], [True]])) + 1
    n = end - start
    parts = (n + RUN - 1) // RUN
    if len(parts) and parts.max() > 1:
        k = np.repeat(np.arange(len(start)), parts)
        step = np.arange(len(k)) - np.repeat(np.cumsum(parts) - parts, parts)
        start, n = start[k] + step * RUN, np.minimum(n[k] - step * RUN, RUN)
    return start, n, mix(v[start]), np.searchsorted(off, start, "right") - 1


class Column:
    """Values in sequence in a scratch file: written in order, read in order."""

    def __init__(self, dtype):
        self.dtype = np.dtype(dtype)
        self.file = tempfile.SpooledTemporaryFile(max_size=SPOOL)

    def write(self, values: np.ndarray) -> None:
        self.file.write(values.tobytes())

    def chunks(self):
        self.file.seek(0)
        while b := self.file.read(CHUNK * self.dtype.itemsize):
            yield np.frombuffer(b, self.dtype)

    def whole(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, self.dtype), *self.chunks()])


class ColumnBWT:
    """The sorted suffixes of a string collection, one symbol of every string
    per round, as three columns: bwt (symbol before the suffix: 0 at a string's
    start, else its number in `alphabet` + 1), lcp (common prefix with the entry
    before) and tag (string and length of the suffix). Strings have 127 bytes at
    most, the collection 2^24 strings."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.m = m = len(off) - 1
        self.off, self.size = off, np.diff(off)
        self.alphabet = np.unique(data)
        code = np.zeros(256, np.uint8 if len(self.alphabet) < 256 else np.uint16)
        code[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        self.code = np.append(code[data], code[:1] * 0)
        live = np.arange(m)
        first = self._before(live, 0)
        self.counts = np.bincount(first, minlength=len(self.alphabet) + 1)
        self.columns = self._empty()
        for c, x in zip(self.columns, (first, np.zeros(m, np.uint8), live.astype(np.uint32) << np.uint32(7)), strict=True):
            c.write(x)
        at = live  # places of the last suffixes, in order, of the strings `live`
        for t in range(1, int(self.size.max(initial=0)) + 1):
            ok = self.size[live] >= t
            at, live = self._round(at[ok], live[ok], t)

    def _empty(self) -> list[Column]:
        return [Column(self.code.dtype), Column(np.uint8), Column(np.uint32)]

    bwt = property(lambda self: self.columns[0].whole())
    lcp = property(lambda self: self.columns[1].whole())
    sid = property(lambda self: (self.columns[2].whole() >> np.uint32(7)).astype(np.int64))
    length = property(lambda self: (self.columns[2].whole() & np.uint32(127)).astype(np.int64))

    def _before(self, s: np.ndarray, t: int) -> np.ndarray:
        """The symbols before the suffixes of length t of the strings s."""
        return np.where(self.size[s] > t, self.code[np.where(self.size[s] > t, self.off[s + 1] - t - 1, -1)], 0).astype(self.code.dtype)

    def _places(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First reading. An entry's symbol in front of its suffix is a suffix
        of the next column, whose place is how many smaller symbols there are
        and how often this one came before. Returns these places for the
        entries q, the common prefix of each with what comes before it, and the
        places and values of the common prefixes that the new ones change."""
        total = int(self.counts.sum())
        base = self.m + np.concatenate([[0, 0], np.cumsum(self.counts[1:-1])]) if len(self.counts) > 1 else np.zeros(1, np.int64)
        seen = np.zeros(len(self.counts), np.int64)
        # Of each symbol's last entry so far: the least common prefix since then
        # (255: there is none), and whether it is one of q.
        least, fresh = np.full(len(self.counts), 255, np.int64), np.zeros(len(self.counts), bool)
        at, up = np.zeros(len(q), np.int64), np.zeros(len(q), np.uint8)
        where, value = [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
        done = 0
        for bwt, lcp in zip(self.columns[0].chunks(), self.columns[1].chunks(), strict=True):
            n = len(bwt)
            here = slice(*np.searchsorted(q, [done, done + n]))
            own = np.zeros(n, bool)
            own[q[here] - done] = True
            many = np.bincount(bwt, minlength=len(seen))
            order = np.argsort(bwt, kind="stable")[many[0]:]
            start = np.cumsum(many) - many - many[0]  # of each symbol in that order
            there = np.flatnonzero(many[1:]) + 1
            new = own[order]
            after = np.zeros(len(order), bool)  # comes after one of q
            after[1:] = new[:-1]
            after[start[there]] = fresh[there]
            k = np.flatnonzero(new | after)
            sym = bwt[order[k]].astype(np.int64)
            place = base[sym] + seen[sym] + k - start[sym]
            head = k == start[sym]
            low = np.full(len(k), 255, np.int64)
            inner = k[~head]
            if len(inner):
                ends = np.empty(2 * len(inner), np.int64)
                ends[::2], ends[1::2] = order[inner - 1] + 1, order[inner] + 1
                low[~head] = np.minimum.reduceat(np.append(lcp, np.uint8(0)), ends)[::2]
            if done:
                edge = np.minimum.accumulate(lcp)[order[k[head]]]
                low[head] = np.where(least[sym[head]] < 255, np.minimum(least[sym[head]], edge), 255)
            common = np.where(low < 255, low + 1, 0).astype(np.uint8)
            mine = new[k]
            i = np.searchsorted(q, order[k[mine]] + done)
            at[i], up[i] = place[mine], common[mine]
            where.append(place[~mine])
            value.append(common[~mine])
            seen += many
            done += n
            if done < total:  # what the next chunk has to know
                since = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.uint8(254)).astype(np.int64)
                least = np.where(least < 255, np.minimum(least, since[0]), 255)
                last = start[there] + many[there] - 1
                least[there], fresh[there] = since[order[last] + 1], new[last]
        return at, up, np.concatenate(where), np.concatenate(value)

    def _round(self, q: np.ndarray, live: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Put the suffixes of length t of `live` in, found from the places q
        of their suffixes of length t - 1; returns their places and strings."""
        at, up, where, value = self._places(q)
        o = np.argsort(at)
        at, up, s = at[o], up[o], live[o]
        o = np.argsort(where)
        where, value = where[o], value[o]
        place = at - np.arange(len(at))  # entries that stay before each new one
        fresh = (self._before(s, t), up, (s.astype(np.uint32) << np.uint32(7)) | np.uint32(t))
        out, done, total = self._empty(), 0, int(self.counts.sum())
        for old in zip(*(c.chunks() for c in self.columns), strict=True):
            n = len(old[0])
            a = int(np.searchsorted(place, done)) if done else 0
            b = int(np.searchsorted(place, done + n)) if done + n < total else len(place)
            begin = done + a
            stays = np.ones(n + b - a, bool)
            new = at[a:b] - begin
            stays[new] = False
            fix = slice(*np.searchsorted(where, [begin, begin + len(stays)]))
            for i, (c, x) in enumerate(zip(out, old, strict=True)):
                y = np.empty(len(stays), x.dtype)
                y[stays] = x
                y[new] = fresh[i][a:b]
                if i == 1:
                    y[where[fix] - begin] = value[fix]
                c.write(y)
            done += n
        for c in self.columns:
            c.file.close()
        self.columns = out
        self.counts = self.counts + np.bincount(fresh[0], minlength=len(self.counts))
        return at, s


def first_documents(data: np.ndarray, off: np.ndarray, doc: np.ndarray, length: int):
    """(string, first window, last window + 1, smallest document) of a
    collection of different strings with their smallest documents. Suffixes
    next to each other with `length` common bytes begin with one window."""
    c = ColumnBWT(data, off)
    size = np.diff(off)
    windows = np.maximum(size - length + 1, 0)
    base = np.cumsum(windows) - windows
    best = np.zeros(int(windows.sum()), np.int64)
    held, low = np.zeros(0, np.int64), np.zeros(0, np.int64)  # the class that may go on in the next chunk
    for lcp, tag in zip(c.columns[1].chunks(), c.columns[2].chunks(), strict=True):
        sid, n = (tag >> np.uint32(7)).astype(np.int64), (tag & np.uint32(127)).astype(np.int64)
        long = n >= length
        cls = np.concatenate([np.zeros(len(held), np.int64), np.cumsum(lcp < length)[long]])
        slot = np.concatenate([held, (base[sid] + size[sid] - n)[long]])
        who = np.concatenate([low, doc[sid[long]]])
        head = np.flatnonzero(np.diff(cls, prepend=-1))
        if len(head):
            least = np.minimum.reduceat(who, head)
            last = int(head[-1])
            best[slot[:last]] = np.repeat(least[:-1], np.diff(head))
            held, low = slot[last:], who[last:]
    if len(held):
        best[held] = low.min()
    sid = np.repeat(np.arange(len(windows)), windows)
    at = np.arange(len(best)) - np.repeat(base, windows)
    new = np.ones(len(best), bool)
    new[1:] = (sid[1:] != sid[:-1]) | (best[1:] != best[:-1])
    s = np.flatnonzero(new)
    e = np.append(s[1:], len(sid)) - 1
    return sid[s], at[s], at[e] + 1, best[s]


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a:a + size] and data[b:b + size] agree, for many pairs."""
    out = np.ones(len(a), bool)
    for k in range(0, len(a), 1 << 15):
        x, y, n = a[k:k + (1 << 15)], b[k:k + (1 << 15)], size[k:k + (1 << 15)]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        differ = data[np.repeat(x, n) + step] != data[np.repeat(y, n) + step]
        out[k + np.repeat(np.arange(len(n)), n)[differ]] = False
    return out


def _builds(size: np.ndarray, longest: np.ndarray):
    """(first, last + 1) of the collections of each build, in the order of their
    longest strings: STRINGS members or lengths SPREAD apart end a build."""
    a = members = 0
    for i, n in enumerate(size.tolist()):
        if members >= STRINGS or longest[i] > longest[a] + SPREAD:
            yield a, i
            a, members = i, 0
        members += n
    if len(size):
        yield a, len(size)


def _pack(values: np.ndarray) -> bytes:
    """The upper five bytes of each value."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 3:]).tobytes()


def _unpack(b: bytes) -> np.ndarray:
    x = np.frombuffer(b, np.uint8).reshape(-1, 5)
    out = np.zeros((len(x), 8), np.uint8)
    out[:, 3:] = x
    return out.view("<u8").ravel().astype(np.uint64)


_TOP = np.uint64(0xFFFFFFFFFF000000)


def _parts(key: np.ndarray, n: int):
    """(bucket, rows) for each bucket that has rows."""
    b = ((key >> np.uint64(24)) % np.uint64(n)).astype(np.int64)
    o = np.argsort(b, kind="stable")
    for rows in np.split(o, np.flatnonzero(np.diff(b[o])) + 1):
        if len(rows):
            yield int(b[rows[0]]), rows


def _docs_of(t: pa.Table):
    """Slices of a block: bytes, offsets, doc ids, first row."""
    ids = t.column("doc_id").combine_chunks()
    buf, off = text_buffer(t.column("text"))
    null = np.asarray(ids.is_null())
    ids = ids.fill_null(0).to_numpy()
    for i, j in slices(off):
        yield buf[off[i]:off[j]], off[i:j + 1] - off[i], ids[i:j], null[i:j], i


def _shared_minimisers(docs: DataFrame, blocks: int, buckets: int, length: int) -> DataFrame:
    """_pf_blk, values: the minimisers of a block that several documents hold."""

    def send(t: pa.Table) -> pa.Table:
        vs, ds = [], []
        for buf, off, ids, null, _ in _docs_of(t):
            _, _, v, d = runs(buf, off, length)
            ok = ~null[d]
            vs.append(v[ok] & _TOP)
            ds.append(ids[d[ok]])
        v, d = np.concatenate(vs or [np.zeros(0, np.uint64)]), np.concatenate(ds or [np.zeros(0, np.int64)])
        o = np.argsort(v, kind="stable")
        v, d = v[o], d[o]
        out = {"bucket": [], "_pf_blk": [], "vals": [], "many": []}
        if len(v):
            head = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            many = np.minimum.reduceat(d, head) != np.maximum.reduceat(d, head)
            v = v[head]
            for b, rows in _parts(v, buckets):
                out["bucket"].append(b)
                out["_pf_blk"].append(t.column("_pf_blk")[0].as_py())
                out["vals"].append(_pack(v[rows]))
                out["many"].append(np.packbits(many[rows]).tobytes())
        return pa.table(out, schema=pa.schema([("bucket", pa.int32()), ("_pf_blk", pa.int32()), ("vals", pa.binary()), ("many", pa.binary())]))

    def meet(t: pa.Table) -> pa.Table:
        vals = [_unpack(x) for x in t.column("vals").to_pylist()]
        size = [len(x) for x in vals]
        many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(t.column("many").to_pylist(), size, strict=True)])
        v = np.concatenate(vals)
        row = np.repeat(np.arange(len(vals)), size)
        o = np.argsort(v, kind="stable")
        s = v[o]
        head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        n = np.diff(np.append(head, len(s)))
        keep = (n > 1) | (np.maximum.reduceat(many[o], head) > 0)
        keep = np.repeat(keep, n)
        back = np.zeros(len(v), bool)
        back[o] = keep
        v, row = v[back], row[back]
        _pf_blk = t.column("_pf_blk").to_numpy()
        cuts = np.searchsorted(row, np.arange(len(vals) + 1))
        out = [(int(_pf_blk[i]), _pack(v[cuts[i]:cuts[i + 1]])) for i in range(len(vals)) if cuts[i] < cuts[i + 1]]
        return pa.table({"_pf_blk": pa.array([x[0] for x in out], pa.int32()), "vals": pa.array([x[1] for x in out], pa.binary())})

    sent = dealt(docs, blocks, "_pf_blk").applyInArrow(tidied(send), "bucket int, _pf_blk int, vals binary, many binary")
    return dealt(sent, buckets, "bucket").applyInArrow(tidied(meet), "_pf_blk int, vals binary")


def _strings(docs: DataFrame, shared: DataFrame, blocks: int, buckets: int, length: int) -> DataFrame:
    """The strings of shared minimisers, packed for each bucket and block."""

    def send(t: pa.Table, s: pa.Table) -> pa.Table:
        out = {"bucket": [], "_pf_blk": [], "vals": [], "docs": [], "lens": [], "data": []}
        if len(s) and len(t):
            shared_v = np.sort(np.concatenate([_unpack(x) for x in s.column("vals").to_pylist()]))
            got: list[list[np.ndarray]] = [[], [], [], [], []]
            for buf, off, ids, null, _ in _docs_of(t):
                at, n, v, d = runs(buf, off, length)
                k = np.minimum(np.searchsorted(shared_v, v & _TOP), len(shared_v) - 1)
                ok = (shared_v[k] == (v & _TOP)) & ~null[d]
                at, n, v, d = at[ok], n[ok], v[ok], d[ok]
                end = at + n + length - 1
                key = span_hashes(buf, at, end) ^ v
                o = np.lexsort((ids[d], key))
                key, at, end, v, who = key[o], at[o], end[o], v[o], ids[d[o]]
                head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
                if not len(head):
                    continue
                size = (end - at)[head]
                many = who[head] != who[np.append(head[1:], len(key)) - 1]
                flat = np.repeat(at[head] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                for a, b in zip(got, (key[head], v[head], who[head], size | (many << 7), buf[flat]), strict=True):
                    a.append(b)
            if got[0]:
                key, v, who, size, data = map(np.concatenate, got)
                lens = size & 127
                o = np.lexsort((who, key))  # slices met the same string again
                head = np.flatnonzero(np.concatenate([[True], key[o][1:] != key[o][:-1]]))
                w = who[o]
                many = np.maximum.reduceat(size[o] >> 7, head) | (w[head] != w[np.append(head[1:], len(o)) - 1])
                keep = o[head]
                off = np.cumsum(lens) - lens
                for b, rows in _parts(v[keep], buckets):
                    r = keep[rows]
                    flat = np.repeat(off[r] - (np.cumsum(lens[r]) - lens[r]), lens[r]) + np.arange(lens[r].sum())
                    for name, x in (("bucket", b), ("_pf_blk", t.column("_pf_blk")[0].as_py()), ("vals", v[r].astype("<u8").tobytes()),
                                    ("docs", who[r].astype("<i8").tobytes()), ("lens", (lens[r] | (many[rows] << 7)).astype(np.uint8).tobytes()),
                                    ("data", data[flat].tobytes())):
                        out[name].append(x)
        return pa.table(out, schema=pa.schema([("bucket", pa.int32()), ("_pf_blk", pa.int32())] + [(c, pa.binary()) for c in ("vals", "docs", "lens", "data")]))

    return dealt(docs, blocks, "_pf_blk").cogroup(dealt(shared, blocks, "_pf_blk")).applyInArrow(
        tidied(send), "bucket int, _pf_blk int, vals binary, docs binary, lens binary, data binary")


def _answers(strings: DataFrame, buckets: int, length: int) -> DataFrame:
    """_pf_blk and packed (string hash, first window, last window + 1, document)."""

    def meet(t: pa.Table) -> pa.Table:
        join = lambda c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), kind)
        v, doc, raw, data = join("vals", "<u8"), join("docs", "<i8"), join("lens", np.uint8), join("data", np.uint8)
        many, lens = raw >> 7, (raw & 127).astype(np.int64)
        off = np.concatenate([[0], np.cumsum(lens)])
        row = np.repeat(np.arange(len(t)), [len(x) for x in t.column("lens").to_pylist()])
        key = span_hashes(data, off[:-1], off[1:]) ^ v
        # Equal strings are one member of the collection, with its smallest
        # document: neighbours in the order of their hashes whose bytes agree.
        o = np.lexsort((doc, lens, key, v))
        head = np.concatenate([[True], (key[o][1:] != key[o][:-1]) | (v[o][1:] != v[o][:-1]) | (lens[o][1:] != lens[o][:-1])])
        head[1:] |= ~_same_bytes(data, off[o[:-1]], off[o[1:]], np.where(head[1:], 0, lens[o[1:]]))
        member = np.empty(len(o), np.int64)
        member[o] = np.cumsum(head) - 1
        first = o[head]
        mdoc, mv = doc[first], v[first]
        group = np.flatnonzero(np.concatenate([[True], mv[1:] != mv[:-1]]))
        size = np.diff(np.append(group, len(mv)))
        alone = np.repeat(size == 1, size)
        sid = [np.flatnonzero(alone)]
        lo, hi, best = [np.zeros(len(sid[0]), np.int64)], [lens[first[sid[0]]] - length + 1], [mdoc[sid[0]]]
        # Whole collections by their longest member, about STRINGS members a
        # build: rounds are as many as the longest string and read all columns.
        group, size, longest = group[size > 1], size[size > 1], np.maximum.reduceat(lens[first], group)[size > 1]
        o2 = np.argsort(longest, kind="stable")
        group, size, longest = group[o2], size[o2], longest[o2]
        for a, e in _builds(size, longest):
            mine = np.repeat(group[a:e] - (np.cumsum(size[a:e]) - size[a:e]), size[a:e]) + np.arange(size[a:e].sum())
            r = first[mine]
            n = lens[r]
            flat = np.repeat(off[r] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            s, w, b, d = first_documents(data[flat], np.concatenate([[0], np.cumsum(n)]), doc[r], length)
            sid.append(mine[s])
            lo.append(w)
            hi.append(b)
            best.append(d)
        sid, lo, hi, best = map(np.concatenate, (sid, lo, hi, best))
        o2 = np.argsort(sid, kind="stable")
        sid, lo, hi, best = sid[o2], lo[o2], hi[o2], best[o2]
        a0 = np.searchsorted(sid, member)
        n = np.searchsorted(sid, member, "right") - a0
        src = np.repeat(np.arange(len(member)), n)
        ans = np.repeat(a0 - (np.cumsum(n) - n), n) + np.arange(n.sum())
        useful = (best[ans] < doc[src]) | (many[src] > 0)
        src, ans = src[useful], ans[useful]
        rows = np.searchsorted(row[src], np.arange(len(t) + 1)) if len(src) else np.zeros(len(t) + 1, np.int64)
        _pf_blk, out = t.column("_pf_blk").to_numpy(), {"_pf_blk": [], "key": [], "lo": [], "hi": [], "doc": []}
        for i in range(len(t)):
            a, b = rows[i], rows[i + 1]
            if a < b:
                for name, x in (("_pf_blk", int(_pf_blk[i])), ("key", key[src[a:b]].astype("<u8").tobytes()), ("lo", lo[ans[a:b]].astype(np.uint8).tobytes()),
                                ("hi", hi[ans[a:b]].astype(np.uint8).tobytes()), ("doc", best[ans[a:b]].astype("<i8").tobytes())):
                    out[name].append(x)
        return pa.table(out, schema=pa.schema([("_pf_blk", pa.int32())] + [(c, pa.binary()) for c in ("key", "lo", "hi", "doc")]))

    return dealt(strings, buckets, "bucket").applyInArrow(tidied(meet), "_pf_blk int, key binary, lo binary, hi binary, doc binary")


def _marks(t: pa.Table, s: pa.Table, length: int):
    """For each document of a block: (row, bytes, mask of removed bytes)."""
    join = lambda c, kind: np.frombuffer(b"".join(s.column(c).to_pylist()), kind)
    key, lo, hi, first = join("key", "<u8"), join("lo", np.uint8), join("hi", np.uint8), join("doc", "<i8")
    o = np.argsort(key, kind="stable")
    key, lo, hi, first = key[o], lo[o].astype(np.int64), hi[o].astype(np.int64), first[o]
    for buf, off, ids, null, row in _docs_of(t):
        delta = np.zeros(len(buf) + 1, np.int32)
        if len(key) and len(buf):
            at, n, v, d = runs(buf, off, length)
            h = span_hashes(buf, at, at + n + length - 1) ^ v
            a = np.searchsorted(key, h)
            m = np.searchsorted(key, h, "right") - a
            m[null[d]] = 0
            src = np.repeat(np.arange(len(at)), m)
            ans = np.repeat(a - (np.cumsum(m) - m), m) + np.arange(m.sum())
            ok = first[ans] < ids[d[src]]
            src, ans = src[ok], ans[ok]
            np.add.at(delta, at[src] + lo[ans], 1)
            np.add.at(delta, at[src] + hi[ans] + length - 1, -1)
        gone = np.cumsum(delta[:-1]) > 0
        for i in range(len(off) - 1):
            yield row + i, buf[off[i]:off[i + 1]], gone[off[i]:off[i + 1]]


def _tables(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame, int]:
    """The documents with their block, the answers for each block, and the
    number of blocks."""
    if not 16 <= length <= 128 - RUN:
        raise ValueError(f"length must be 16 to {128 - RUN} bytes")
    spark = docs.sparkSession
    n = n_blocks(spark, text_bytes(docs))
    few = max(n // 8, spark.sparkContext.defaultParallelism)
    d = docs.withColumn("_pf_blk", block_of(n, "doc_id"))
    small = d.select("_pf_blk", F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = cut(_shared_minimisers(small, n, few, length), "minimiser")
    strings = cut(_strings(small, shared, n, 2 * n, length), "string")
    drop(shared)
    answers = cut(_answers(strings, 2 * n, length), "answer")
    drop(strings)
    return d, answers, n


def digests(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    d, answers, n = _tables(pick(docs, "doc_id", "text"), length)

    def run(t: pa.Table, s: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        for _, b, gone in _marks(t, s, length):
            spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and gone[0]))
            for c, x in zip(out, (len(b), int(gone.sum()), spans, hashlib.sha256(b[~gone].tobytes()).hexdigest()), strict=True):
                c.append(x)
        return pa.table({"doc_id": t.column("doc_id")} | {c: pa.array(x, pa.string() if "sha" in c else pa.int64()) for c, x in
                                                         zip(("n_bytes", "n_removed", "n_spans", "kept_sha256"), out, strict=True)})

    d = d.select("_pf_blk", F.col("doc_id").cast("long").alias("doc_id"), "text")
    return dealt(d, n, "_pf_blk").cogroup(dealt(answers, n, "_pf_blk")).applyInArrow(
        tidied(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """The documents, all columns, with the repeated bytes taken out of text;
    n_chars, where there is such a column, is counted anew. Bytes that no
    longer make up whole characters (a cut within one) are dropped with it. A
    text that loses nothing stays as it is, null included."""
    names = docs.columns
    d, answers, n = _tables(docs.select(*[F.col(f"`{c}`") for c in names]), length)
    schema = docs.schema

    def run(t: pa.Table, s: pa.Table) -> pa.Table:
        old = t.column("text").to_pylist()
        new = list(old)
        for i, b, gone in _marks(t, s, length):
            if gone.any():
                new[i] = b[~gone].tobytes().decode("utf-8", "ignore")
        t = t.drop_columns(["_pf_blk"])
        t = t.set_column(t.column_names.index("text"), "text", pa.array(new, pa.string()))
        if "n_chars" in t.column_names:
            k = t.column_names.index("n_chars")
            chars = [c if a is b else len(b) for a, b, c in zip(old, new, t.column("n_chars").to_pylist(), strict=True)]
            t = t.set_column(k, "n_chars", pa.array(chars, t.schema.field(k).type))
        return t.select(names)

    return dealt(d, n, "_pf_blk").cogroup(dealt(answers, n, "_pf_blk")).applyInArrow(tidied(run), schema)
