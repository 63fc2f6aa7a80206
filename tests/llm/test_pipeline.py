import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from panelforge.llm import bpe_matrix
from tests.llm import test_minhash, test_positional_index


def first_documents(rows, k=50):
    first = {}
    for i, t in rows:
        b = t.encode()
        for p in range(len(b) - k + 1):
            first[b[p:p + k]] = min(first.get(b[p:p + k], i), i)
    for i, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - k + 1):
            if first[b[p:p + k]] < i:
                gone[p:p + k] = b"\1" * k
        yield i, bytes(c for c, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")


def test_each_stage_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, "en", "src0", 0), (10**6 + 1, "12 34 !", "en", "src0", 7), (None, "the and of", "en", None, None)], docs.schema)
    docs = docs.unionByName(odd)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        before = sorted((r.doc_id if r.doc_id is not None else 10**9, r.text) for r in docs.collect())
        got = out.collect()
        if name != "byte_bpe":
            assert out.columns == columns
            after = sorted((r.doc_id if r.doc_id is not None else 10**9, r.text) for r in got)
        if name == "language_id":
            ids = {i for i, _ in after}
            assert 10**6 not in ids and 10**6 + 1 not in ids and len(before) - len(after) <= 4
            assert set(after) <= set(before)
        elif name == "near_duplicates":
            want = test_minhash.brute(before)
            assert [i for i, _ in after] == [i for i, _ in before if i == want[i][1]] and len(after) < len(before)
        elif name == "repeated_bytes":
            assert after == sorted(first_documents(before)) and after != before
            assert all(r.n_chars == len(r.text) for r in got if r.n_chars is not None)
        elif name == "decontaminate":
            bad = {w[0] for w in test_positional_index.brute(before, items) if w[5]}
            assert bad and after == [x for x in before if x[0] not in bad]
        else:
            enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_matrix.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
            text = dict(before)
            assert len(got) == len(before)
            for r in got:
                ids = enc.encode_ordinary(text[r.doc_id if r.doc_id is not None else 10**9])
                assert r.ids == ids and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        docs = spark.createDataFrame(got, out.schema)


def test_run_and_empty_input(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    assert corpus_pipeline.run(spark, sf).count() > 50
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_clashing_columns_come_through(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(80)
    odd = ["blk", "rep", "sig", "k1", "K2x", "pos", "term", "component", "kept", "node", "id"]
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in odd})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name == "byte_bpe":
            assert out.count() == docs.count()
            break
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in odd)
        docs = spark.createDataFrame(rows, out.schema)


def test_rows_of_one_doc_id_in_every_stage(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a, b = (r.text for r in docs.where("text is not null and length(text) > 200").orderBy("doc_id").limit(2).collect())
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    extra = [(10**6, a + " one end", "en"), (10**6, a + " one end", "en"), (10**6, b + " other end", "en"), (10**6 + 1, item, "en"), (10**6 + 1, "clean words of one", "en")]
    d = docs.unionByName(spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang in extra], docs.select("doc_id", "text", "lang", "source", "n_chars").schema))
    texts = lambda x, i: sorted(r.text for r in x.where(F.col("doc_id") == i).collect())
    stages = dict(corpus_pipeline.STAGES)
    assert texts(stages["language_id"](spark, d, sf), 10**6) == texts(d, 10**6)
    # The id stands for all its texts: they stay or go together, equal ones as one.
    alone = spark.createDataFrame([r for r in d.collect() if r.doc_id >= 10**6], d.schema)
    assert texts(stages["near_duplicates"](spark, alone, sf), 10**6) == sorted({t for i, t, _ in extra if i == 10**6})
    # Rows of one id take no bytes from each other.
    assert texts(stages["repeated_bytes"](spark, alone, sf), 10**6) == texts(alone, 10**6)
    # Here each row is judged by its own text.
    assert texts(stages["decontaminate"](spark, d, sf), 10**6 + 1) == ["clean words of one"]
    assert stages["byte_bpe"](spark, d, sf).where(F.col("doc_id") == 10**6).count() == 3


def test_nothing_to_learn_from(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(30)
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language_id(spark, none, sf).collect() == []
    spark.read.parquet(f"{sf}/benchmark.parquet").where("false").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in left.collect()) == sorted(r.doc_id for r in docs.collect())
