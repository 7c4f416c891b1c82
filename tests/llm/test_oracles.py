import duckdb
import pytest
from compare import assert_same, oracle

from millrace.llm import mixing, queries, sql


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_query_matches_oracle(spark, name, sf_dir):
    assert_same(queries.queries()[name](spark, sf_dir), sf_dir, sql.ORACLES[name])


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_column_types_match(spark, sf, name):
    names = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    columns, rows = oracle(sf, f"DESCRIBE {sql.ORACLES[name]}")
    assert {r[0]: r[1] for r in rows} == {f.name: names[f.dataType.simpleString()] for f in queries.queries()[name](spark, sf).schema}


def test_mix_with_many_shards_matches_oracle(spark, sf, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_DOCS", 3)
    assert_same(queries.op5_source_mix(spark, sf), sf, sql._source_mix())


def test_near_vectors_with_copies_match_oracle(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT row_number() OVER () - 1 AS vec_id, embedding, label FROM (SELECT embedding, label FROM '/root/testdata/sf0.001/embeddings.parquet' UNION ALL SELECT list_transform(embedding, lambda x: CAST(x * 1.01 + 0.004 AS FLOAT)), label FROM '/root/testdata/sf0.001/embeddings.parquet' WHERE vec_id % 5 = 0)) TO '{tmp_path}/embeddings.parquet'")
    df = queries.op3_embedding_near_dedup(spark, str(tmp_path))
    assert df.where("n_links > 0").count() >= 200
    assert_same(df, str(tmp_path), sql.ORACLES["op3_embedding_near_dedup"])
