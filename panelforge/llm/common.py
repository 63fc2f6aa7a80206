"""Plumbing shared by the text operators: shared folder, lineage cuts, blocks,
zero-copy text buffers, vectorised word hashes and connected components."""

from __future__ import annotations

import contextlib
import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one block (one Python group) holds, about.
BLOCK_BYTES = 6 << 20
#: Bytes of text whose NumPy intermediates exist at one time.
SLICE_BYTES = 1 << 19

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


# --- the shared folder -------------------------------------------------------

def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Where the session
    has none, a temporary one is set on a local master; a cluster has to name
    one, since its machines share no temporary folder."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="panelforge-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


@contextlib.contextmanager
def _shuffle_cleanup(spark: SparkSession):
    """Shuffle files of a query whose result is written go when it ends."""
    old = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, old)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/pf-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: later steps
    restart from the table, so a lost executor costs only its own tasks."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    with _shuffle_cleanup(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pf_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop(*frames: DataFrame) -> None:
    """Delete tables made by cut() that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_pf_path", None)
        if path:
            _delete(df.sparkSession, path)


#: Tables made inside each open scratch(), innermost last.
_SCRATCH: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Every table that cut() makes inside goes when the block ends, in an error
    too: an operator's result must be written before that."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            _delete(spark, path)


def settled(spark: SparkSession, make, name: str) -> DataFrame:
    """make()'s rows as one table in the shared folder; all tables it needed on
    the way are gone."""
    path = new_path(spark, name)
    with scratch(spark):
        out = make()
        with _shuffle_cleanup(spark):
            out.write.option("compression", "zstd").parquet(path)
        schema = out.schema
    return spark.read.schema(schema).parquet(path)


# --- columns and blocks ------------------------------------------------------

#: Rows of one Arrow batch: whole texts, so Spark's default of 10,000 is much.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def pick(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, found case-insensitively; extra columns of any
    name, clashing ones included, never reach an operator. Lowers the session's
    Arrow batches to BATCH_ROWS if they have more."""
    spark = docs.sparkSession
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    have = {c.lower(): c for c in docs.columns}
    return docs.select(*[F.col(f"`{have[n.lower()]}`").alias(n) for n in names])


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0


def n_blocks(spark: SparkSession, total: int, size: int = BLOCK_BYTES) -> int:
    return max(math.ceil(total / size), spark.sparkContext.defaultParallelism, 1)


def block_of(n: int, *keys: str) -> Column:
    """A block number from the keys: a document is always in the same block."""
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def dealt(df: DataFrame, n: int, *keys: str):
    """df grouped by the keys in n tasks. n counts blocks or buckets of bounded
    size, so what a task reads doesn't grow with the data, as it would with a
    fixed number of shuffle partitions."""
    return df.repartition(n, *keys).groupBy(*keys)


# --- text as NumPy -----------------------------------------------------------

def text_buffer(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow text column, null as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    _, off, data = col.buffers()
    if off is None or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(off, kind)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0]:o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES):
    """(first, last) ranges of documents of about `size` bytes each."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_T = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply and shift rounds)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0][0]) < n:
        m = 1 << max(20, int(n - 1).bit_length())
        both = []
        for base in (_P, _PINV):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        if m > 1 << 22:
            return tuple(both)
        _POW[0] = tuple(both)
    return _POW[0]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end) for all spans at once, by prefix sums."""
    p, inv = _powers(len(buf) + 1)
    c = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_T[buf] * p[:len(buf)], out=c[1:])
    return mix((c[ends] - c[starts]) * inv[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each document) of the words between ASCII
    white space; words never cross documents."""
    n = len(buf)
    w = ~SPACE[buf]
    prev = np.zeros(n, bool)
    prev[1:] = w[:-1]
    nxt = np.zeros(n, bool)
    nxt[:-1] = w[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    prev[inner] = False
    nxt[inner - 1] = False
    starts = np.flatnonzero(w & ~prev)
    ends = np.flatnonzero(w & ~nxt) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class HashIndex:
    """Open-addressing table in NumPy: 64-bit hashes -> 0, 1, 2, ... in the
    order they were added. About 24 bytes an entry, no Python objects."""

    def __init__(self, bits: int = 16):
        self.n, self.bits = 0, bits
        self.keys = np.zeros(1 << bits, np.uint64)
        self.at = np.full(1 << bits, -1, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the keys, -1 where they are new."""
        slot = self._slot(keys)
        out = self.at[slot]
        todo = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            got = self.at[slot[todo]]
            out[todo] = got
            todo = todo[(got >= 0) & (self.keys[slot[todo]] != keys[todo])]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Keys that are new and different from each other."""
        first, self.n = self.n, self.n + len(keys)
        if 2 * self.n > len(self.keys):
            k, v = self.keys[self.at >= 0], self.at[self.at >= 0]
            self.bits = int(2 * self.n).bit_length()
            self.keys = np.zeros(1 << self.bits, np.uint64)
            self.at = np.full(1 << self.bits, -1, np.int32)
            self._put(k, v)
        self._put(keys, np.arange(first, self.n, dtype=np.int32))

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.at[slot] < 0
            place, first = np.unique(slot[free], return_index=True)
            put = todo[free][first]
            self.keys[place], self.at[place] = keys[put], values[put]
            left = self.at[slot] != values[todo]
            todo, slot = todo[left], (slot[left] + 1) & ((1 << self.bits) - 1)


def tidy() -> None:
    """Give a group's freed memory back to the system, so that workers waiting
    for their next task don't keep their peak."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: Bytes of a group from which on its memory is given back.
TIDY_BYTES = 1 << 20


def tidied(run):
    """run, a function of one or two Arrow tables, with tidy() after it unless
    they are small."""
    if run.__code__.co_argcount == 2:
        def both(t: pa.Table, s: pa.Table) -> pa.Table:
            out = run(t, s)
            if t.nbytes + s.nbytes > TIDY_BYTES:
                tidy()
            return out
        return both

    def one(t: pa.Table) -> pa.Table:
        out = run(t)
        if t.nbytes > TIDY_BYTES:
            tidy()
        return out
    return one


def mapped(run):
    """run, a function of Arrow batches, with tidy() when its task is done."""
    def all_batches(batches):
        try:
            yield from run(batches)
        finally:
            tidy()
    return all_batches


# --- connected components ----------------------------------------------------

def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): smallest node reachable, for every node of an edge
    list. Minimum labels spread over the edges, then over labels (pointer
    jumping), each round cut to a table; only a count of changes reaches the
    driver. A giant component is one join key in its last rounds: that join is
    sort-merge, whose oversized partitions AQE splits on the node side. No edge:
    an empty table."""
    both = edges.select(F.col(a).alias("s"), F.col(b).alias("d"))
    both = cut(both.unionByName(both.select(F.col("d").alias("s"), F.col("s").alias("d")))
               .where("s != d").distinct(), "edges")
    lab = cut(both.groupBy(F.col("s").alias("node")).agg(F.min("d").alias("m"))
              .select("node", F.least("node", "m").alias("component"), F.lit(True).alias("moved")), "label")
    while True:
        m = cut(both.join(lab, both.s == lab.node).groupBy(F.col("d").alias("node"))
                .agg(F.min("component").alias("m")), "near")
        step = cut(lab.join(m, "node").select("node", F.least("component", "m").alias("tgt"),
                                              F.col("component").alias("was")), "step")
        up = step.select(F.col("node").alias("up"), F.col("tgt").alias("up_to"))
        new = cut(step.join(up, step.tgt == F.col("up")).select(
            "node", F.least("tgt", "up_to").alias("component"), (F.least("tgt", "up_to") != F.col("was")).alias("moved")), "label")
        drop(lab, m, step)
        lab = new
        if not lab.where("moved").limit(1).count():
            drop(both)
            out = lab.select("node", "component")
            out._pf_path = lab._pf_path
            return out
