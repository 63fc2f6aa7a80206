"""Near-duplicate vectors by a forest of random-projection trees (operator 3).

Identical vectors of one label are one class. The classes of a label are split
by TREES trees: a node projects on a random direction and splits at the median,
and what lies within SPILL of it goes to both sides. Splits are fitted on FIT
vectors of a node at most, up to DEPTH levels at a time, and every class is
sent down; nodes that still hold over LEAF classes are fitted anew in the next
round, so no model and no group grows with the data. A node that directions
can't split (vectors nearly equal) stays whole and is compared in square parts.
In a leaf all pairs are compared by cosine in double precision. A pair that
meets in several leaves counts in the first of them (by leaf number), so links
are counted without listing pairs: a leaf returns, for each class, how many
vectors it links to and the smallest class it is connected with.

Rows are scaled by their largest component before their norm is taken, so no
norm under- or overflows; a row goes left, right or both at every split. Labels
and lengths are compared as they are (`grp` is the smallest class of a label and
length), only nodes go by hashes, within their group.

Recall is measured against brute force in the tests and in the README; links
found are exact.

Defined results: vectors compare only with vectors of the same label and
length; null label, null, empty or zero vectors, and those with null or
non-finite components link with nothing. Rows of one vec_id count as one vector
(its smallest label and embedding); a null vec_id links with nothing and has a
null component and is kept. Extra columns don't come through.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, drop, pick, tidied

TREES, SPILL = 8, 0.015
#: A side's share of a node at most: with 0.65 a level adds 30 % of copies.
SIDE = 0.65
LEAF, FIT, DEPTH, SQUARE, PART = 48, 4096, 8, 1024, 20_000


def unit_rows(col) -> np.ndarray:
    """Unit rows, in double precision, of an Arrow list column."""
    a = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if not len(a):
        return np.zeros((0, 1))
    x = a.flatten().to_numpy().astype(np.float64).reshape(len(a), -1)
    big = np.abs(x).max(1, keepdims=True)
    # Two steps: the inverse of a tiny number may itself be infinite.
    x = x / big
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    if not np.isfinite(x).all():
        raise ValueError("a vector has no direction")
    return x


def fit_tree(x: np.ndarray, total: int, seed: int) -> list:
    """Nodes [direction, threshold, left, right]; leaves are None. x: a sample
    of `total` vectors."""
    r = np.random.default_rng(seed)
    nodes: list = [None]
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        k, rows, depth = todo.pop()
        if len(rows) * total <= LEAF * len(x) or len(rows) < 16 or depth >= DEPTH:
            continue
        for _ in range(3):
            d = r.standard_normal(x.shape[1])
            p = x[rows] @ (d / np.linalg.norm(d))
            t = np.median(p)
            left, right = rows[p <= t + SPILL], rows[p >= t - SPILL]
            if max(len(left), len(right)) <= SIDE * len(rows):
                nodes[k] = [(d / np.linalg.norm(d)).astype(np.float32), float(t), len(nodes), len(nodes) + 1]
                todo += [(len(nodes), left, depth + 1), (len(nodes) + 1, right, depth + 1)]
                nodes += [None, None]
                break
    return nodes


def leaves_of(nodes: list, x: np.ndarray):
    """(leaf, rows of x) for every leaf that rows reach."""
    todo = [(0, np.arange(len(x)))]
    while todo:
        k, rows = todo.pop()
        if not len(rows):
            continue
        if nodes[k] is None:
            yield k, rows
            continue
        d, t, left, right = nodes[k]
        p = x[rows] @ d.astype(np.float64)
        goes = p <= t + SPILL
        todo += [(left, rows[goes]), (right, rows[~goes | (p >= t - SPILL)])]


def _grow(places: DataFrame, reps: DataFrame, seed: int) -> DataFrame:
    """rep, grp, node: every class's leaves in all trees. A node is a number of
    its own within its group."""
    done, r = [], reps.select("rep", "emb")
    key = ["grp", "node"]
    while True:
        size = cut(places.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > LEAF), "size")
        if not size.limit(1).count():
            drop(size)
            done.append(places)
            break
        seed += 1
        done.append(cut(places.join(size, key, "left_anti").select("rep", *key), "leaf"))
        open_ = cut(places.join(size, key).select("rep", *key, "n"), "open")
        drop(places)
        point = F.pmod(F.xxhash64("rep", "node", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
        sample = open_.where(point < F.least(F.lit(1.0), F.lit(float(FIT)) / F.col("n"))).join(r, "rep").select(*key, "n", "emb")

        salt = seed

        def fit(t: pa.Table) -> pa.Table:
            grp, node, n = (t.column(c)[0].as_py() for c in ("grp", "node", "n"))
            nodes = fit_tree(unit_rows(t.column("emb")), n, (node ^ salt) & (2**63 - 1))
            return pa.table({"grp": pa.array([grp], pa.int64()), "node": pa.array([node], pa.int64()), "model": pa.array([pickle.dumps(nodes)], pa.binary()),
                             "whole": pa.array([len(nodes) == 1]), "n": pa.array([n], pa.int64())})

        model = cut(sample.groupBy(*key).applyInArrow(tidied(fit), "grp long, node long, model binary, whole boolean, n long"), "model")
        # Nodes no direction can split are leaves of their own.
        stuck = model.where("whole").select(*key)
        done.append(cut(open_.join(stuck, key, "left_semi").select("rep", *key), "leaf"))
        # A node's classes and its model meet in parts of about PART classes.
        parts = F.ceil(F.col("n") / F.lit(PART)).cast("int")
        rows = open_.join(stuck, key, "left_anti").join(r, "rep").select(
            "rep", *key, F.pmod(F.xxhash64("rep"), parts).cast("int").alias("part"), "emb")
        dealt = model.where("not whole").select(*key, "model", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))

        def send(t: pa.Table, m: pa.Table) -> pa.Table:
            got = []
            if len(t) and len(m):
                nodes = pickle.loads(m.column("model")[0].as_py())
                got = list(leaves_of(nodes, unit_rows(t.column("emb"))))
            rep, grp, node = (t.column(c).to_numpy() for c in ("rep", "grp", "node"))
            rows = np.concatenate([k for _, k in got]) if got else np.zeros(0, np.int64)
            leaf = np.repeat(np.array([k for k, _ in got], np.int64), [len(k) for _, k in got]) if got else rows
            return pa.table({"rep": rep[rows], "grp": grp[rows], "parent": node[rows], "leaf": leaf})

        sent = rows.groupBy(*key, "part").cogroup(dealt.groupBy(*key, "part")).applyInArrow(
            tidied(send), "rep long, grp long, parent long, leaf long")
        places = cut(sent.select("rep", "grp", F.xxhash64("parent", "leaf").alias("node")), "place")
        drop(size, open_, model)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    out = cut(out, "forest")
    drop(*done)
    return out


class _Union:
    """Connected rows of one leaf; the root is that of smallest rep."""

    def __init__(self, rep: np.ndarray):
        self.rep, self.root = rep, list(range(len(rep)))

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            a, b = (a, b) if self.rep[a] < self.rep[b] else (b, a)
            self.root[b] = a


def _leaf_links(x, rep, w, keys, real, leaf, left, right, same_part, limit):
    """(rows with links, vectors linked, smallest row connected) of one leaf or
    one square part of it; pairs that met in an earlier leaf don't count."""
    links, union = np.zeros(len(rep), np.int64), _Union(rep)
    for k in range(0, len(left), 256):
        r = left[k:k + 256]
        ordered = rep[r][:, None] < rep[right][None, :] if same_part else True
        a, b = np.nonzero((x[r] @ x[right].T >= limit) & ordered)
        a, b = r[a], right[b]
        for s in range(0, len(a), 2048):
            p, q = a[s:s + 2048], b[s:s + 2048]
            both = np.zeros((len(p), keys.shape[1]), bool)
            for c in range(keys.shape[1]):
                both |= (keys[p] == keys[q][:, c:c + 1]) & real[q][:, c:c + 1]
            both &= real[p]
            first = keys[p][np.arange(len(p)), both.argmax(1)]
            p, q = p[first == leaf], q[first == leaf]
            np.add.at(links, p, w[q])
            np.add.at(links, q, w[p])
            for u, z in zip(p.tolist(), q.tolist(), strict=True):
                union.join(u, z)
    got = np.flatnonzero(links)
    return got, links[got], np.array([union.find(i) for i in got.tolist()], np.int64)


def _compare(forest: DataFrame, reps: DataFrame, limit: float) -> DataFrame:
    """rep, links (vectors linked, other than its own class), root. Leaves are
    packed into Python groups of about PART rows."""
    mine = forest.groupBy("rep").agg(F.sort_array(F.collect_set("node")).alias("nodes"))
    v = cut(reps.join(mine, "rep"), "vector")
    size = cut(forest.groupBy("grp", "node").agg(F.count("*").alias("n")).where("n > 1"), "leafsize")
    side = F.ceil(F.col("n") / F.lit(SQUARE))
    total = size.agg(F.sum(F.col("n") * side)).first()[0] or 0
    side, packs = side.cast("int"), max(total // PART, 1)
    rows = forest.join(size, ["grp", "node"]).select(
        "rep", "grp", "node", F.pmod(F.xxhash64("rep"), side).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), side - 1)).alias("other"))
    rows = rows.select("rep", "grp", "node", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    rows = rows.withColumn("pack", F.pmod(F.xxhash64("grp", "node", "i", "j"), F.lit(packs))).join(v, "rep")
    dim = F.size("emb").alias("dim")

    def run(t: pa.Table) -> pa.Table:
        names = ("grp", "node", "i", "j")
        col = {c: t.column(c).to_numpy() for c in (*names, "part", "rep", "w")}
        x = unit_rows(t.column("emb"))
        lists = t.column("nodes").combine_chunks()
        count = np.diff(lists.offsets.to_numpy())
        real = np.arange(count.max())[None, :] < count[:, None]
        keys = np.zeros(real.shape, np.int64)
        keys[real] = lists.flatten().to_numpy()
        order = np.lexsort([col[c] for c in names])
        new = np.zeros(len(order), bool)
        new[0] = True
        for c in names:
            new[1:] |= col[c][order][1:] != col[c][order][:-1]
        out: list[list[np.ndarray]] = [[], [], []]
        for rows in np.split(order, np.flatnonzero(new)[1:]):
            part, lo, hi = col["part"][rows], col["i"][rows[0]], col["j"][rows[0]]
            rep = col["rep"][rows]
            got, links, root = _leaf_links(x[rows], rep, col["w"][rows], keys[rows], real[rows], col["node"][rows[0]],
                                           np.flatnonzero(part == lo), np.flatnonzero(part == hi), lo == hi, limit)
            for a, b in zip(out, (rep[got], links, rep[root]), strict=True):
                a.append(b)
        return pa.table({c: np.concatenate(a) for c, a in zip(("rep", "links", "root"), out, strict=True)})

    # Vectors of one length in a Python group, so that they make a matrix.
    found = cut(rows.select("*", dim).groupBy("pack", "dim").applyInArrow(tidied(run), "rep long, links long, root long"), "found")
    drop(v, size)
    return found


def near_vectors(vectors: DataFrame, limit: float = 0.93, trees: int = TREES, seed: int = 3) -> DataFrame:
    """vec_id, n_links, component_id, kept (vec_id = component_id)."""
    d = pick(vectors, "vec_id", "label", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").alias("emb"))
    fine = F.forall("emb", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("emb", lambda x: x != 0)
    good = d.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("emb").isNotNull() & fine)
    one = cut(good.groupBy("vec_id").agg(F.min(F.struct("label", "emb")).alias("v")).select("vec_id", "v.label", "v.emb"), "valid")
    cls = cut(one.groupBy("label", "emb").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w")), "class")
    c = cls.select(F.col("label").alias("l2"), F.col("emb").alias("e2"), "rep", "w")
    own = cut(one.join(c, (one.label == c.l2) & (one.emb == c.e2)).select("vec_id", "rep", "w"), "own")
    same = ["label", "dim"]
    dims = cls.select("rep", "label", F.size("emb").alias("dim"))
    start = dims.join(dims.groupBy(*same).agg(F.min("rep").alias("grp")), same).select(
        "rep", "grp", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    places = cut(start.select("rep", "grp", F.xxhash64("grp", "tree").alias("node")), "place")
    reps = cls.select("rep", "w", "emb")
    forest = _grow(places, reps, seed)
    found = _compare(forest, reps, limit)
    drop(forest)
    comp = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links")).withColumnRenamed("rep", "id")
    known = own.join(links, own.rep == links.id, "left").join(comp, own.rep == comp.node, "left").select(
        F.col("vec_id").alias("v"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n"), F.coalesce("component", "rep").alias("c"))
    out = d.select("vec_id").join(known, d.vec_id == known.v, "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
