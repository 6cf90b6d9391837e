import duckdb
import pytest

from frameloom.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = c.execute(Q.oracle_sql()[name]).df(), Q.queries()[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    rows = lambda df: sorted(map(tuple, df[columns].astype(str).to_numpy().tolist()))
    assert rows(got) == rows(want) and len(want)


#: Queries whose result has a row for each document.
WHOLE = ("op1_extendible_sharding", "op3_minhash_near_dedup", "op4_secret_scan", "op6_prefix_token_counts", "op9_quality_co_training", "op10_language_id")


def test_ten_queries_over_all_documents(spark):
    assert [int(n[2:].split("_")[0]) for n in Q.queries()] == list(range(1, 11))
    ids = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    for name, f in Q.queries().items():
        out = f(spark, SF)
        if name in WHOLE:
            assert {r.doc_id for r in out.select("doc_id").collect()} == ids and out.count() == len(ids), name
        else:
            assert out.count() > 0, name


def test_plans_of_the_native_operator_hold_no_python(spark):
    plan = Q.op1_extendible_sharding(spark, SF)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
