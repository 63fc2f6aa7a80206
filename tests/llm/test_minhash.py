import random

import numpy as np

from panelforge.llm import minhash


def brute(rows, k=5, percent=75):
    import re

    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", (t or "").translate(low)) if x]
        sets[i] = {tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                    a, b = sorted((find(x), find(y)))
                    comp[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def texts():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    out = [None, "", "  \n", "one", "ONE", "a b c", "A b\tc", "a b c d"]
    for _ in range(25):
        base = [word() for _ in range(r.choice([6, 12, 40, 150]))]
        for _ in range(r.choice([1, 2, 8])):
            c = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                c[r.randrange(len(c))] = word()
            out.append(" ".join(c))
    base = [word() for _ in range(60)]
    for _ in range(60):  # a chain: each differs a little from the one before
        base[r.randrange(60)] = word()
        out.append(" ".join(base))
    out.append(" ".join(word() for _ in range(30_000)))
    return list(enumerate(out))


def test_same_as_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, f1 double").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_group_near_the_threshold(spark):
    r = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    out = ["w1 w2"]
    for _ in range(250):  # most pairs lie between 0.5 and 0.9
        c = list(base)
        for _ in range(r.choice([0, 1, 1, 2])):
            c[r.randrange(60)] = f"x{r.random()}"
        out.append(" ".join(c))
    rows = list(enumerate(out))
    r.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_bound_is_never_too_low():
    r = np.random.default_rng(5)
    pool = r.integers(0, 1 << 63, 40_000, dtype=np.uint64)
    for n in (1, 7, 100, 3000, 30_000):
        sets = []
        for _ in range(20):
            keep = r.random() ** 0.2
            sets.append(np.unique(np.concatenate([pool[:n][r.random(n) < keep], r.choice(pool, max(1, int(n * (1 - keep))))])))
        bits, size = minhash.bitmaps(sets), np.array([len(u) for u in sets])
        for i, u in enumerate(sets):
            both = np.array([len(np.intersect1d(u, v)) for v in sets])
            near = 100 * both >= 75 * (len(u) + size - both)
            assert near[i] and not (near & ~minhash.may_reach(len(u), bits[i], size, bits, 75)).any()


def test_one_of_each_keeps_texts(spark):
    """Different texts of one doc_id stay; the survivor of repeated rows doesn't
    depend on their order."""
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a, "x"), (1, b, "x"), (1, a, "y"), (2, a, "z"), (None, a, "n"), (None, a, "n"), (3, None, "e"), (3, None, "f"), (4, "", "g")]
    seen = set()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = minhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
        seen.add(tuple(sorted(map(str, got))))
    assert len(seen) == 1
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(0, a), (0, a), (1, a), (1, b), (3, ""), (4, "")])


def test_empty_null_and_repeated(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).collect() == []
    df = spark.createDataFrame([(None, "x y"), (1, "x y"), (1, "x y"), (2, "X  Y")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect())
    assert [g[0] for g in got] == [0, 1, 1, 2]
    assert [g for g in got if g[0]] == [(1, 1, True), (1, 1, True), (2, 1, False)]
