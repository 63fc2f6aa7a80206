import hashlib
import random
import re

from pyspark.sql import functions as F

from panelforge.llm import positional_index as pi

LOW = str.maketrans(pi.UPPER, pi.LOWERED)


def words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOW))


def brute(docs, items, width=10):
    wins = []
    for i, t in items:
        w = words(t)
        if w:
            wins += [(None if i is None else str(i), w[k:k + width]) for k in range(max(1, len(w) - width + 1))]
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, x in wins:
            for p in range(len(w) - len(x) + 1):
                if w[p:p + len(x)] == x:
                    hit |= set(range(p, p + len(x)))
                    found |= {item} - {None}
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def tables():
    r = random.Random(11)
    vocab = ["a", "b", "the", "É", "é", "x9", "Kelvin", "日本", "of"]
    make = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(make(r.choice([3, 5, 12, 25])))) for i in range(20)] + [(20, "a b"), (21, None), (22, "..."), (None, "the"), (9, "solo"), (23, "K"), (24, "the the the")]
    docs = [(0, None), (1, ""), (2, "!!"), (3, "solo."), (4, "a the the the the b"), (5, "K and k"), (6, "A,B")]
    for i in range(7, 60):
        t = make(r.randint(0, 40))
        for _ in range(r.randint(0, 2)):
            k = r.randint(0, len(t))
            t[k:k] = (r.choice(items)[1] or "").upper().split() if r.random() < 0.3 else (r.choice(items)[1] or "").split()
        docs.append((i, r.choice([" ", "\n", ", ", "..."]).join(t)))
    docs += [docs[20], (30, "solo solo"), (None, "x solo"), (99, " ".join(make(20_000)))]
    return docs, items


def test_same_as_brute_force(spark, monkeypatch):
    docs, items = tables()
    d = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, term string").repartition(3)
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, pos int")
    want = brute(docs, items)
    assert sum(w[5] for w in want) > 20
    for limit in (500_000, 0):  # broadcast, and the shuffled way beyond
        monkeypatch.setattr(pi, "BROADCAST", limit)
        monkeypatch.setattr(pi._small, "__defaults__", (limit,))
        got = pi.contamination(d, b).drop("k2").collect()
        assert sorted(map(tuple, got), key=str) == want
    clean = sorted((r.doc_id, r.text, r.term) for r in pi.remove_contaminated(d, b).where("doc_id is not null").collect())
    assert [c[0] for c in clean] == sorted(w[0] for w in want if not w[5] and w[0] is not None)


def test_items_without_id_count_for_hits(spark):
    d = spark.createDataFrame([(1, "x red fox y"), (2, "blue"), (3, "none")], "doc_id long, text string")
    b = spark.createDataFrame([(None, "red fox"), (None, "blue"), (7, "blue")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in pi.contamination(d, b).collect()}
    assert got == {1: (2, 0, True), 2: (1, 1, True), 3: (0, 0, False)}
    assert [r.doc_id for r in pi.remove_contaminated(d, b).collect()] == [3]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red q q blue"), (2, "red q q q q blue"), (3, "blue red"), (4, "red")], "doc_id long, text string")
    q = spark.createDataFrame([("rb", "red"), ("rb", "blue"), ("b", "blue"), ("none", "green"), ("none", "red")], "query string, word string")
    got = pi.near(pi.postings(docs, q), q, 4).collect()
    assert sorted((r.query, r.k1) for r in got) == [("b", 1), ("b", 2), ("b", 3), ("rb", 1), ("rb", 3)]


def test_native_plan_and_empty(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    got = pi.contamination(d, b).collect()
    assert [(r.doc_id, r.n_words, r.n_hit) for r in got] == [(1, 2, 0)]
    assert pi.contamination(d.where("false"), b).collect() == []
    plan = pi.postings(d, d.select(F.lit("a").alias("word")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
