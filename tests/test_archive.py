"""Each query of plans.archive gives the rows of its SQL at the smallest scale; fixtures where the tables hold no case."""

import duckdb
import pytest

from folioscope.plans import archive

SF = "/root/testdata/sf0.001"
TABLES = ["customer", "supplier", "part", "orders", "events", "documents", "embeddings", "pages", "conversations"]
NAMES = [name for name, f in archive.QUERIES.items() if f.__module__ == archive.__name__]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_rows_equal_sql(spark, duck, name):
    got = archive.QUERIES[name](spark, SF)
    want = duck.execute(archive.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(str(tuple(r)) for r in got.select(*columns).collect()) == sorted(str(r) for r in want.fetchall())


def test_images_and_links(spark, tmp_path):
    html = '<p><img alt="x" src="a.png"><a href="u">l</a><img src="a.png"></p>'
    spark.createDataFrame([(1, html), (2, html), (3, '<img src="b.png">'), (4, None)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(map(tuple, archive.distinct_images(spark, str(tmp_path)).collect())) == [("a.png", 1, True), ("b.png", 3, False)]
    assert [tuple(r) for r in archive.html_links(spark, str(tmp_path)).collect()] == [("u", 2, 2, 1)]
