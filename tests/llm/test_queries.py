import re

import pytest

from panelforge.llm import queries
from tests.oracle import connect, difference

SF = "/root/testdata/sf0.001"
COLUMNS = {
    1: "doc_id start n_tokens ids_crc32", 2: "doc_id held_out n_tokens n_known train_tokens base_score score", 3: "vec_id n_links component_id kept",
    4: "doc_id n_words n_hit n_items items_sha256 contaminated", 5: "doc_id kept", 6: "doc_id held_out lang_pred score", 7: "doc_id n_shingles component_id kept",
    8: "doc_id n_tokens ids_sha256 decoded_sha256", 9: "doc_id n_bytes n_removed n_spans kept_sha256", 10: "doc_id n_bytes n_tokens over_limit",
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns_and_rows(spark, name):
    df = queries.QUERIES[name](spark, SF)
    want = COLUMNS[int(re.match(r"op(\d+)_", name)[1])].split()
    assert set(want) <= set(df.columns)
    source = "embeddings" if name.startswith("op3_") else "documents"
    assert df.count() == spark.read.parquet(f"{SF}/{source}.parquet").count()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(spark, name):
    assert difference(spark, connect(SF), SF, queries.QUERIES[name], queries.ORACLE[name]) == ""
