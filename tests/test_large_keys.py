"""Queries on tables whose keys go beyond those of the small driver tables."""

import pytest

from attestor.plans import catalogue


@pytest.mark.parametrize("name", ["train_pairs", "cited_abstracts", "dev_pairs"])
def test_a_cited_document_is_missing_among_many_parts(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    keys = [*range(12), *range(1_000_000, 1_000_012)]
    spark.createDataFrame([(k, f"customer {k}") for k in keys[:12]], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k, f"name {k}", f"brand {k}", f"type {k}") for k in keys[2:]], "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    for t in ("customer", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    found = con.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    got = catalogue.queries()[name](spark, str(tmp_path)).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(found.fetchall())
