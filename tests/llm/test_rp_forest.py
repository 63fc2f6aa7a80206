import numpy as np

from panelforge.llm import rp_forest as rf


def brute(rows, limit=0.93):
    """n_links and component of each valid vector."""
    by = {}
    for i, label, v in rows:
        if i is not None and label is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            by.setdefault((label, len(v)), {})[i] = v
    links, comp = {r[0]: set() for r in rows if r[0] is not None}, {}
    for group in by.values():
        ids = sorted(group)
        x = np.array([group[i] for i in ids], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(x @ x.T >= limit), strict=True):
            if a != b:
                links[ids[a]].add(ids[b])
    for i in sorted(links):
        if i not in comp:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in comp:
                    comp[k] = i
                    todo += links[k]
    return {i: (len(links[i]), comp[i]) for i in links}


def test_odd_vectors_and_copies(spark, monkeypatch):
    monkeypatch.setattr(rf, "LEAF", 20)
    monkeypatch.setattr(rf, "SQUARE", 16)
    monkeypatch.setattr(rf, "PART", 30)
    r = np.random.default_rng(0)
    rows = [(i, int(i % 2), [float(x) for x in np.float32(r.normal(size=8))]) for i in range(150)]
    rows += [(200 + i, 0, rows[0][2]) for i in range(30)]  # copies
    near = np.float32(r.normal(size=8))
    rows += [(300 + i, 1, [float(x) for x in np.float32(near + 0.001 * r.normal(size=8))]) for i in range(70)]  # can't be split
    rows += [(400, None, rows[0][2]), (401, 0, None), (402, 0, [0.0] * 8), (403, 0, []), (404, 0, [float("nan")] * 8), (405, 0, [None] * 8), (406, 0, rows[0][2][:7]), (407, 0, [float("inf")] * 8)]
    df = spark.createDataFrame([(*x, 5) for x in rows], "vec_id long, label int, embedding array<float>, w int").repartition(3)
    got = {x.vec_id: (x.n_links, x.component_id) for x in rf.near_vectors(df, trees=12).collect()}
    assert got == brute(rows)


def test_recall_on_test_data(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute([(r.vec_id, r.label, list(r.embedding)) for r in df.collect()])
    got = {x.vec_id: (x.n_links, x.component_id) for x in rf.near_vectors(df).collect()}
    assert got.keys() == want.keys()
    assert all(got[i][0] <= want[i][0] for i in got)
    assert sum(g[0] for g in got.values()) >= 0.99 * sum(w[0] for w in want.values())
    assert sum(got[i][1] == want[i][1] for i in got) >= 0.99 * len(got)


def test_recall_at_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(rf, "LEAF", 100)
    r = np.random.default_rng(4)
    rows = []
    for i in range(600):  # pairs at a cosine just above the limit
        a, b = r.normal(size=(2, 64))
        a /= np.linalg.norm(a)
        b -= a * (a @ b)
        b /= np.linalg.norm(b)
        c = 0.931 + 0.02 * r.random()
        rows += [(2 * i, 1, a.tolist()), (2 * i + 1, 1, (c * a + np.sqrt(1 - c * c) * b).tolist())]
    want = brute(rows)
    got = {x.vec_id: x.n_links for x in rf.near_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()}
    assert sum(got.values()) >= 0.95 * sum(w[0] for w in want.values())


def test_recall_of_deep_trees(spark):
    """One label of over 30 times a leaf: every tree is split several times."""
    r = np.random.default_rng(9)
    centre = r.normal(size=(400, 64))
    x = np.concatenate([centre + s * r.normal(size=centre.shape) for s in (0.05, 0.15, 0.2, 0.25)])
    rows = [(i, 7, v.tolist()) for i, v in enumerate(x)]
    assert len(rows) >= 30 * rf.LEAF
    want = brute(rows)
    got = {v.vec_id: (v.n_links, v.component_id) for v in rf.near_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()}
    assert all(got[i][0] <= want[i][0] for i in got)
    assert sum(g[0] for g in got.values()) >= 0.99 * sum(w[0] for w in want.values())
    assert sum(w[0] for w in want.values()) > 1000


def test_tiny_and_huge_components(spark):
    """A norm that under- or overflows costs no other vector its links."""
    r = np.random.default_rng(2)
    rows = [(i, 1, r.normal(size=8).tolist()) for i in range(600)]
    want = brute(rows)
    odd = [(1000, 1, [1e-170] * 8), (1001, 1, [1e200] * 8), (1002, 1, [5e-324] + [0.0] * 7), (1003, 1, [1.7e308] * 8)]
    got = {v.vec_id: v.n_links for v in rf.near_vectors(spark.createDataFrame(rows + odd, "vec_id long, label int, embedding array<double>")).collect()}
    ones = {i for i, _, v in rows if np.sum(v) / np.linalg.norm(v) / np.sqrt(8) >= 0.93}
    assert got[1000] == got[1001] == got[1003] == 2 + len(ones)
    along = {i for i, _, v in rows if v[0] / np.linalg.norm(v) >= 0.93}
    assert got[1002] == len(along)
    assert all(got[i] == want[i][0] + 3 * (i in ones) + (i in along) for i, _, _ in rows)


def test_rows_reach_a_side():
    nodes = rf.fit_tree(np.random.default_rng(0).normal(size=(500, 4)), 500, 1)
    assert len(nodes) > 5
    x = np.random.default_rng(1).normal(size=(300, 4))
    assert set(np.concatenate([k for _, k in rf.leaves_of(nodes, x)])) == set(range(300))


def test_empty_null_and_repeated(spark):
    assert rf.near_vectors(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")).collect() == []
    df = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 1, [2.0, 0.0]), (None, 1, [1.0, 0.0])], "vec_id long, label int, embedding array<float>")
    got = sorted((x.vec_id or 0, x.n_links, x.component_id, x.kept) for x in rf.near_vectors(df).collect())
    assert got == [(0, 0, None, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)]
