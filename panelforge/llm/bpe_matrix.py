"""Byte-level BPE encoding and decoding by padded NumPy matrices (operator 8).

Pieces (matches of the split pattern) are encoded once per worker; new ones are
put into matrices of rows of similar length. Each round looks up every adjacent
pair in a hashed pair table, merges in every row the leftmost pair of least
rank, compacts the row, and drops rows that have no pair left. Rows longer than
`LONG` symbols keep the same rule with a priority queue, since a matrix would
need a round for every merge of one row.

Defined results: null text counts as empty (no tokens and the digests of no
bytes); repeated rows give repeated results; a null doc_id stays null; of pairs
of one rank the leftmost goes first. Texts of any length are encoded whole, a
long piece in time n log n. Extra columns, clashing names included, don't reach
the result; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mapped, pick

LONG = 256
#: Pieces kept by a worker before the cache starts anew.
CACHE = 400_000
NONE = np.int32(2**31 - 1)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


class PairTable:
    """Open-addressing table: (left id, right id) -> id of the merged token."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 3).bit_length())
        size = 1 << self.bits
        self.mask = np.int64(size - 1)
        self.keys = np.full(size, -1, np.int64)
        self.values = np.full(size, NONE, np.int32)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[at] < 0
            slot, first = np.unique(at[free], return_index=True)
            put = todo[free][first]
            self.keys[slot], self.values[slot] = keys[put], values[put]
            left = self.keys[at] != keys[todo]
            todo, at = todo[left], (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of a flat array of keys; NONE where there is no such pair."""
        at = self._slot(keys)
        got = self.keys[at]
        out = np.where(got == keys, self.values[at], NONE)
        todo = np.flatnonzero((got != keys) & (got >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            got = self.keys[at[todo]]
            hit = got == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (got >= 0)]
        return out


class MatrixBPE:
    """Encoder of single pieces, given the tokens' ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.vocab = {i: t for t, i in ranks.items()}
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = {(ranks[t[:k]] << 32) | ranks[t[k:]]: i for t, i in ranks.items()
                 for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.table = PairTable(np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        todo = []
        for i in range(len(pieces)):
            whole = self.ranks.get(pieces[i])
            if whole is not None:
                out[i] = np.array([whole], np.int32)
            elif size[i] > LONG:
                out[i] = self._queue(pieces[i])
            elif size[i] == 0:
                out[i] = np.zeros(0, np.int32)
            else:
                todo.append(i)
        if todo:
            todo = np.array(todo)
            todo = todo[np.argsort(size[todo], kind="stable")]
            edges = np.flatnonzero(np.diff((size[todo] + 3) // 4)) + 1
            for part in np.split(todo, edges):
                for k in range(0, len(part), 16384):
                    self._matrix(pieces, part[k:k + 16384], size, out)
        return out

    def _matrix(self, pieces, rows, size, out) -> None:
        """Rows of one length class, merged round by round."""
        width = int(size[rows].max())
        flat = np.frombuffer(b"".join([pieces[i].ljust(width, b"\0") for i in rows]), np.uint8).reshape(len(rows), width)
        ids = self.byte_id[flat]
        n = size[rows].copy()
        ids[np.arange(width)[None, :] >= n[:, None]] = -1
        self.merge(ids, n, rows, out)

    def merge(self, ids: np.ndarray, n: np.ndarray, rows: np.ndarray, out: list) -> None:
        """out[rows[i]]: the first n[i] ids of row i (padding is -1), merged."""
        pair = self._pairs(ids)
        while len(rows):
            at = pair.argmin(1)  # the leftmost of the least
            r = np.arange(len(rows))
            best = pair[r, at]
            done = best == NONE
            if done.any():
                for i in np.flatnonzero(done):
                    out[rows[i]] = ids[i, :n[i]].copy()
                keep = ~done
                rows, ids, n, pair, at, best = rows[keep], ids[keep], n[keep], pair[keep], at[keep], best[keep]
                if not len(rows):
                    return
                r = np.arange(len(rows))
            ids[r, at] = best
            w = ids.shape[1]
            cols = np.arange(w - 1)[None, :]
            src = cols + (cols > at[:, None])  # compaction: what follows moves left
            moved = np.take_along_axis(ids, src, 1)
            pair = np.take_along_axis(pair, np.minimum(src[:, :w - 2], w - 2), 1) if w > 2 else np.full((len(rows), 1), NONE)
            ids = moved
            n -= 1
            if w > 2:  # only the two pairs at the merged symbol are new
                for shift in (-1, 0):
                    p = at + shift
                    ok = (p >= 0) & (p < w - 2)
                    q, rr = p[ok], r[ok]
                    a, b = ids[rr, q].astype(np.int64), ids[rr, q + 1].astype(np.int64)
                    pair[rr, q] = np.where(b >= 0, self.table.get((a << 32) | np.maximum(b, 0)), NONE)

    def _pairs(self, ids: np.ndarray) -> np.ndarray:
        if ids.shape[1] < 2:
            return np.full((len(ids), 1), NONE)
        a, b = ids[:, :-1].astype(np.int64), ids[:, 1:].astype(np.int64)
        got = self.table.get(((np.maximum(a, 0) << 32) | np.maximum(b, 0)).ravel()).reshape(a.shape)
        return np.where(b >= 0, got, NONE)

    def _pair(self, a: int, b: int) -> int | None:
        return self.ranks.get(self.vocab[a] + self.vocab[b])

    def _queue(self, piece: bytes) -> np.ndarray:
        return np.array(self.queue(self.byte_id[np.frombuffer(piece, np.uint8)].tolist()), np.int32)

    def queue(self, ids: list[int]) -> list[int]:
        """One long row: leftmost least pair first, by a heap over a list."""
        n = len(ids)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := self._pair(ids[i], ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or nxt[i] >= n or self._pair(ids[i], ids[nxt[i]]) != r:
                continue
            j = nxt[i]
            ids[i], ids[j], nxt[i] = r, -1, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            for left in (prv[i], i):
                if left >= 0 and nxt[left] < n and (s := self._pair(ids[left], ids[nxt[left]])) is not None:
                    heapq.heappush(heap, (s, left))
        return [x for x in ids if x >= 0]


class TextCodec:
    """Whole texts: split by the pattern, pieces through MatrixBPE, cached."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.bpe = MatrixBPE(load_ranks(path))
        self.find = regex.compile(pattern).findall
        self.reset()
        top = max(self.bpe.vocab) + 1
        self.token_bytes = [self.bpe.vocab.get(i, b"") for i in range(top)]

    def reset(self) -> None:
        self.seen: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.off = np.zeros(1 << 14, np.int64)

    def _learn(self, new: list[str]) -> None:
        coded = self.bpe.encode_pieces([p.encode() for p in new])
        n, total = len(self.seen), sum(map(len, coded))
        while len(self.flat) < self.used + total:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.off) < n + len(new) + 1:
            self.off = np.concatenate([self.off, np.zeros_like(self.off)])
        if new:
            np.concatenate(coded, out=self.flat[self.used:self.used + total])
            self.off[n + 1:n + len(new) + 1] = self.used + np.cumsum([len(c) for c in coded])
        self.used += total
        self.seen.update(zip(new, range(n, n + len(new)), strict=True))

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.seen) > CACHE:
            self.reset()
        found = [self.find(t) for t in texts]
        seen = self.seen
        self._learn([p for p in dict.fromkeys(p for f in found for p in f) if p not in seen])
        out = []
        for f in found:
            k = np.fromiter(map(seen.__getitem__, f), np.int64, len(f))
            a = self.off[k]
            size = self.off[k + 1] - a
            at = np.repeat(a - np.concatenate([[0], np.cumsum(size)[:-1]]) if len(k) else a, size) + np.arange(size.sum())
            out.append(self.flat[at])
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist()))


_CODECS: dict[tuple[str, str], TextCodec] = {}


def codec(path: str, pattern: str) -> TextCodec:
    """One codec for each worker process."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = TextCodec(path, pattern)
    return _CODECS[path, pattern]


def text_groups(col: pa.Array, size: int = 2 << 20) -> Iterator[list[str]]:
    """The texts of a column (null as empty) in lists of about `size` chars."""
    group, held = [], 0
    for t in col:
        t = t.as_py() or ""
        group.append(t)
        held += len(t)
        if held >= size:
            yield group
            group, held = [], 0
    if group:
        yield group


def encode(docs: DataFrame, path: str, pattern: str, ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ids, the token
    ids themselves as an array<int>. A narrow map: no shuffle."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    def run(batches):
        c = codec(path, pattern)
        c.reset()  # what a worker has seen is kept for one task
        for b in batches:
            n, one, two, kept = [], [], [], []
            for texts in text_groups(b.column("text")):
                for x in c.encode_batch(texts):
                    n.append(len(x))
                    one.append(hashlib.sha256(x.astype("<u4").tobytes()).hexdigest())
                    two.append(hashlib.sha256(c.decode(x)).hexdigest())
                    if ids:
                        kept.append(x)
            cols = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.list_(pa.int32()))] * ids,
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids)
        c.reset()

    d = pick(docs, "doc_id", "text")
    return d.select(d.doc_id.cast("long").alias("doc_id"), "text").mapInArrow(mapped(run), schema)


def decode(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the decoded bytes of a table of doc_id, ids (null: no bytes)."""

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            got = [c.decode(np.array(x or [], np.int64)) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got, pa.binary())], names=["doc_id", "decoded"])

    return pick(coded, "doc_id", "ids").mapInArrow(mapped(run), "doc_id long, decoded binary")
