"""Token ids as a range-coded binary table (operator 1).

Static range asymmetric numeral systems: one frequency table of all ids, scaled
to 2^PROB, is shared by every block. A block holds the ids of whole documents
that follow each other in doc_id order (about BLOCK ids, more only for one very
long document). Its ids go to LANES interleaved coders, whose 32-bit words form
one stream; every STEP rounds a checkpoint keeps all coder states and the place
in the stream, with a checksum of the ids up to the next one, so parts of a
block decode on their own and in parallel.

A store is two Parquet folders. table: id, freq. blocks: part, block, start
(ids before the block in its part), n_ids, doc_ids, counts, null_docs, payload;
parts are ranges of doc_id, in order.

payload, little-endian: magic "PFA1", n, lanes, step (uint32 each), number of
checkpoints, number of words (uint32); for each checkpoint: word index, crc32
of its ids (uint32), lane states (uint64); then the words (uint32).

Defined results: null text is empty (only the end id); rows of one doc_id keep
all their texts, next to each other; a null doc_id sorts first; a text of any length
is stored whole, in one block; extra columns, clashing names included, don't
reach the store; an empty table gives an empty store.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HashIndex, cut, drop, mapped, new_path, pick, slices, span_hashes, text_buffer, text_bytes, word_spans

PROB = 20
LANES, STEP, BLOCK = 2048, 256, 1 << 20
_LOW = np.uint64(1 << 31)


# --- the coder ---------------------------------------------------------------

def scale(counts: np.ndarray, bits: int = PROB) -> np.ndarray:
    """Frequencies that sum to 2^bits, one at least for every id that occurs."""
    counts = np.asarray(counts, np.int64)
    total, room = counts.sum(), 1 << bits
    if not total:
        return np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) > room:
        raise ValueError("more different ids than frequency slots")
    f = np.zeros(len(counts), np.int64)
    f[used] = np.maximum(1, np.floor(counts[used] * (room / total)).astype(np.int64))
    by = used[np.argsort(-f[used], kind="stable")]
    while (gap := room - int(f.sum())) != 0:  # the largest take what is over or missing
        if gap > 0:
            f[by[0]] += gap
        else:
            can = by[f[by] > 1][:max(1, -gap)]
            f[can] -= np.minimum(f[can] - 1, max(1, -gap // len(can))) if len(can) else 0
            if f.sum() < room:
                f[by[0]] += room - int(f.sum())
    return f


class Coder:
    def __init__(self, freq: np.ndarray, bits: int = PROB):
        self.bits = np.uint64(bits)
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.slot = np.repeat(np.arange(len(freq), dtype=np.int32), freq)
        self.top = np.uint64(31 + 32 - bits)

    def encode(self, ids: np.ndarray, lanes: int = LANES, step: int = STEP) -> bytes:
        n = len(ids)
        lanes = max(1, min(lanes, n // 64))
        rounds = math.ceil(n / lanes)
        state = np.full(lanes, _LOW, np.uint64)
        words: list[np.ndarray] = []
        marks: list[tuple[int, np.ndarray]] = []
        size = 0
        for r in range(rounds - 1, -1, -1):
            x = ids[r * lanes:(r + 1) * lanes]
            s = state[:len(x)]
            f = self.freq[x]
            over = s >= (f << self.top)
            if over.any():
                out = s[over]
                words.append((out & np.uint64(0xFFFFFFFF)).astype("<u4"))
                size += len(out)
                s[over] = out >> np.uint64(32)
            q = s // f
            s[:] = (q << self.bits) + (s - q * f) + self.start[x]
            if r % step == 0:
                marks.append((size, state.copy()))
        marks.reverse()
        out = [b"PFA1", struct.pack("<5I", n, lanes, step, len(marks), size)]
        for k, (at, s) in enumerate(marks):
            part = ids[k * step * lanes:(k + 1) * step * lanes].astype("<u4")
            out.append(struct.pack("<2I", size - at, zlib.crc32(part.tobytes())) + s.astype("<u8").tobytes())
        out.extend(w.tobytes() for w in reversed(words))
        return b"".join(out)

    def decode(self, payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids from checkpoint `first` up to checkpoint `last`."""
        if payload[:4] != b"PFA1":
            raise ValueError("not a token block")
        n, lanes, step, k, size = struct.unpack_from("<5I", payload, 4)
        last = k if last is None else min(last, k)
        each = 8 + 8 * lanes
        words = np.frombuffer(payload, "<u4", size, 24 + k * each)
        end = min(n, last * step * lanes)
        out = np.empty(max(0, end - first * step * lanes), np.int64)
        mask, at = np.uint64((1 << int(self.bits)) - 1), 0
        for c in range(first, last):
            pos, crc = struct.unpack_from("<2I", payload, 24 + c * each)
            state = np.frombuffer(payload, "<u8", lanes, 24 + c * each + 8).astype(np.uint64)
            began = at
            for r in range(c * step, min((c + 1) * step, math.ceil(n / lanes))):
                s = state[:min(lanes, n - r * lanes)]
                low = s & mask
                x = self.slot[low]
                s[:] = self.freq[x] * (s >> self.bits) + low - self.start[x]
                under = s < _LOW
                m = int(np.count_nonzero(under))
                if m:
                    s[under] = (s[under] << np.uint64(32)) | words[pos:pos + m]
                    pos += m
                out[at:at + len(x)] = x
                at += len(x)
            if zlib.crc32(out[began:at].astype("<u4").tobytes()) != crc:
                raise ValueError(f"checksum of segment {c} differs")
        return out


# --- the tokenizer -----------------------------------------------------------

#: Words that a worker keeps before it starts anew.
CACHE = 1_500_000
#: Words in one call of the library, and what stands between them.
RUN, MARK = 256, "`"


class WordTokenizer:
    """Token ids of whole texts through the tokenizers library. The tokenizer
    drops white space and never joins what it divides, so texts are cut at
    ASCII white space and each different word (by a 64-bit hash, within one
    worker) is encoded once; the tokenizer's definition is looked at for that
    when it is loaded, and texts go through it whole where it doesn't hold."""

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.vocab = self.tok.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = json.dumps(spec.get("pre_tokenizer") or {})
        self.split = '"invert": true' in pre and '"behavior": "Removed"' in pre and "\\\\s" in pre \
            and '"add_prefix_space": false' in pre and not any(t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", []))
        self.reset()

    def reset(self) -> None:
        self.known = HashIndex()
        self.flat = np.zeros(1 << 16, np.int32)
        self.off = np.zeros(1 << 16, np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of each word's). Words go to the library in
        runs with a mark between them, which has one id of its own; a run whose
        marks don't come back as they should is encoded word by word."""
        mark = self._encode([MARK])[0]
        runs = [words[i:i + RUN] for i in range(0, len(words), RUN)]
        ids, sizes = [], []
        for run, got in zip(runs, self._encode([f" {MARK} ".join(r) for r in runs]), strict=True):
            x = np.array(got, np.int32)
            at = np.flatnonzero(x == mark[0]) if len(mark) == 1 else np.zeros(0, np.int64)
            if len(at) == len(run) - 1 and not any(MARK in w for w in run):
                sizes.append(np.diff(np.concatenate([[-1], at, [len(x)]])) - 1)
                ids.append(np.delete(x, at))
            else:
                one = self._encode(run)
                sizes.append(np.fromiter(map(len, one), np.int64, len(one)))
                ids.append(np.fromiter((i for w in one for i in w), np.int32))
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        ids, size = self._encode_words(words)
        n, used, total = self.known.n, int(self.off[self.known.n]), len(ids)
        while len(self.flat) < used + total:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.off) < n + len(size) + 1:
            self.off = np.concatenate([self.off, np.zeros_like(self.off)])
        self.flat[used:used + total] = ids
        self.off[n + 1:n + len(size) + 1] = used + np.cumsum(size)
        self.known.add(keys)

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents of a slice and where each one's begin."""
        if not self.split:
            got = self._encode([buf[off[i]:off[i + 1]].tobytes().decode() for i in range(len(off) - 1)])
            return np.array([i for x in got for i in x], np.int32), np.cumsum([0, *map(len, got)])
        if self.known.n > CACHE:
            self.reset()
        start, end, first = word_spans(buf, off)
        h = span_hashes(buf, start, end)
        k = self.known.get(h)
        new = np.flatnonzero(k < 0)
        if len(new):
            keys, one = np.unique(h[new], return_index=True)
            one = new[one]
            self._learn(keys, [buf[a:b].tobytes().decode() for a, b in zip(start[one], end[one], strict=True)])
            k[new] = self.known.get(h[new])
        a = self.off[k]
        size = self.off[k + 1] - a
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(a - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return ids, np.concatenate([[0], ends])[first]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def tokenize(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, n, ids (packed little-endian, two bytes an id if the vocabulary
    allows it, else four), the end id after each text."""

    def run(batches):
        t = tokenizer(path)
        kind = "<u2" if max(t.vocab, end_id + 1) <= 1 << 16 else "<u4"
        for b in batches:
            n, ids = [], []
            buf, off = text_buffer(b.column("text"))
            for i, j in slices(off):
                x, at = t.encode(buf[off[i]:off[j]], off[i:j + 1] - off[i])
                x = np.insert(x.astype(kind), at[1:], end_id)
                at = (at + np.arange(len(at))) * x.itemsize
                raw = x.tobytes()
                n.extend((np.diff(at) // x.itemsize).tolist())
                ids.extend(raw[at[k]:at[k + 1]] for k in range(j - i))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n", "ids"])

    d = pick(docs, "doc_id", "text")
    return d.select(d.doc_id.cast("long").alias("doc_id"), "text").mapInArrow(mapped(run), "doc_id long, n long, ids binary")


def _ids(n: int, raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.int64)


def frequencies(tokens: DataFrame, bits: int = PROB) -> np.ndarray:
    """The shared table; the driver gets one row for each different id, so as
    many as the vocabulary has at most."""

    def run(batches):
        total = np.zeros(1, np.int64)
        for b in batches:
            for n, raw in zip(b.column("n").to_pylist(), b.column("ids").to_pylist(), strict=True):
                c = np.bincount(_ids(n, raw))
                if len(c) > len(total):
                    total = np.concatenate([total, np.zeros(len(c) - len(total), np.int64)])
                total[:len(c)] += c
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], names=["id", "c"])

    rows = tokens.select("n", "ids").mapInArrow(mapped(run), "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).toArrow()
    k, c = rows.column("id").to_numpy(), rows.column("c").to_numpy()
    counts = np.zeros(int(k.max()) + 1 if len(k) else 1, np.int64)
    counts[k] = c
    return scale(counts, bits)


_SCHEMA = "part int, block int, start long, n_ids long, doc_ids binary, counts binary, null_docs int, payload binary"


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, part_bytes: int = 24 << 20) -> np.ndarray:
    """Encode the documents and write the store at path: the blocks, and beside
    them the frequency table, which is also returned."""
    spark = docs.sparkSession
    tokens = cut(tokenize(docs, tokenizer_path, end_id), "ids")
    freq = frequencies(tokens)
    parts = max(1, math.ceil(text_bytes(docs) / part_bytes))

    def pack(batches):
        from pyspark import TaskContext

        part, start, block = TaskContext.get().partitionId(), 0, 0
        coder = Coder(freq)
        held: list[np.ndarray] = []
        docs_, counts, size = [], [], 0

        def flush():
            nonlocal start, block, held, docs_, counts, size
            ids = np.concatenate(held)
            real = [d for d in docs_ if d is not None]
            row = pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), pa.array([len(ids)], pa.int64()),
                pa.array([np.array(real, "<i8").tobytes()], pa.binary()), pa.array([np.array(counts, "<i8").tobytes()], pa.binary()),
                pa.array([len(docs_) - len(real)], pa.int32()), pa.array([coder.encode(ids)], pa.binary())],
                names=["part", "block", "start", "n_ids", "doc_ids", "counts", "null_docs", "payload"])
            start, block = start + len(ids), block + 1
            held, docs_, counts, size = [], [], [], 0
            return row

        for b in batches:
            for d, n, raw in zip(b.column("doc_id").to_pylist(), b.column("n").to_pylist(), b.column("ids"), strict=True):
                if size and size + n > BLOCK:
                    yield flush()
                held.append(_ids(n, raw.as_py()))
                docs_.append(d)
                counts.append(n)
                size += n
        if size:
            yield flush()

    dealt = tokens.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n", "ids")
    dealt.mapInArrow(mapped(pack), _SCHEMA).write.option("compression", "none").parquet(f"{path}/blocks")
    k = np.flatnonzero(freq)
    spark.createDataFrame(pa.table({"id": k.astype(np.int64), "freq": freq[k].astype(np.int64)})).coalesce(1).write.parquet(f"{path}/table")
    drop(tokens)
    return freq


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the little-endian 32-bit ids)
    and, with ids, the token ids, decoded from the store's files. The driver
    gets the table (vocabulary) and one total for each part."""
    table = spark.read.parquet(f"{path}/table").toArrow()
    k, f = table.column("id").to_numpy(), table.column("freq").to_numpy()
    freq = np.zeros(int(k.max()) + 1 if len(k) else 1, np.int64)
    freq[k] = f
    blocks = spark.read.schema(_SCHEMA).parquet(f"{path}/blocks")
    totals = dict(map(tuple, blocks.groupBy("part").agg(F.sum("n_ids")).collect()))
    before, at = {}, 0
    for p in sorted(totals):
        before[p] = at
        at += totals[p]

    def run(batches):
        coder = Coder(freq)
        for b in batches:
            for r in b.to_pylist():
                x = coder.decode(r["payload"])
                n = np.frombuffer(r["counts"], "<i8")
                off = np.concatenate([[0], np.cumsum(n)])
                u4 = x.astype("<u4")
                crc = [zlib.crc32(u4[off[i]:off[i + 1]].tobytes()) for i in range(len(n))]
                docs = [None] * r["null_docs"] + np.frombuffer(r["doc_ids"], "<i8").tolist()
                cols = [pa.array(docs, pa.int64()), pa.array(before[r["part"]] + r["start"] + off[:-1], pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(x, pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids)

    return blocks.mapInArrow(mapped(run), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write a store in the shared folder and read back its digests."""
    path = new_path(docs.sparkSession, "tokens")
    write(docs, path, tokenizer_path, end_id)
    return read(docs.sparkSession, path, ids=False)
