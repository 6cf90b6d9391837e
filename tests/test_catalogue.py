import duckdb
import pytest

from frameloom import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(df):
    columns = sorted(df.columns)
    text = df[columns].astype(object).where(df[columns].notna(), None).astype(str).replace("-0.0", "0.0")
    return columns, sorted(map(tuple, text.to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = plain(catalogue.QUERIES[name](spark, SF).toPandas())
    assert got == plain(duck.execute(catalogue.SQL[name]).df()) and got[1]


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 640
    assert set(entry.oracle_sql()) <= set(entry.queries())
