"""Each query of plans.shaped gives the rows of its SQL at the smallest scale; fixtures for what the tables don't hold."""

import duckdb
import pytest
from pyspark.sql import functions as F

from folioscope.functions import urls as U
from folioscope.operators import shaping
from folioscope.plans import shaped

SF = "/root/testdata/sf0.001"
TABLES = ["customer", "supplier", "nation", "part", "orders", "lineitem", "events", "documents", "labels", "pages", "conversations"]
NAMES = [name for name, f in shaped.QUERIES.items() if f.__module__ == shaped.__name__]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_rows_equal_sql(spark, duck, name):
    got = shaped.QUERIES[name](spark, SF)
    want = duck.execute(shaped.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(str(tuple(r)) for r in got.select(*columns).collect()) == sorted(str(r) for r in want.fetchall())


def test_url_keys_of_wrappers_ports_and_escapes(spark):
    pairs = {
        "https://https://Site.test/x": "site.test/x",
        "https://a.test/p?source=rss&REF=1&_hsmi=2": "a.test/p?source=rss",
        "https://x.com/u/status/1?s=20": "x.com/u/status/1",
        "https://a.test/p?s=20": "a.test/p?s=20",
        "http://a.test:8080/p/": "a.test:8080/p",
        "http://a.test:80/p": "a.test/p",
        "https://a.test/story.amp.html?amp=1&outputType=amp": "a.test/story.html",
        "https://a-test.cdn.ampproject.org/c/s/www.a.test/story?usqp=1": "a.test/story",
        "https://www.google.com/amp/s/a.test/story/amp/": "a.test/story",
        "https://a.test/Elf_%28film%29/it%27s/M%c3%b6l/a+b": "a.test/Elf_(film)/it's/M%C3%B6l/a%2Bb",
        "https://a.test/100%/x": "a.test/100%/x",
        "https://amp.test/x": "amp.test/x",
        "  ": "",
    }
    got = spark.createDataFrame([(u,) for u in pairs], "u string").select("u", U.url_key(F.col("u")).alias("k")).collect()
    assert {r.u: r.k for r in got} == pairs


def test_markdown_links(spark):
    text = '[a](http://x/1) ![pic](p.png "t") `[no](n)` [b](<http://y>) [empty]() ```\n[code](c)\n```'
    row = spark.createDataFrame([(text,)], "t string").select(shaping.markdown_links(F.col("t")).alias("m")).first()
    assert [tuple(x) for x in row.m] == [("a", "http://x/1", False), ("pic", "p.png", True), ("b", "http://y", False)]


def test_twins_and_attribution(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None)], "id long, t string")
    assert [r.id for r in shaping.without_twins(df, F.col("t"), [F.col("id")], 10).collect()] == [1, 3, 4]
    rows = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    first = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id long, target string")
    second = spark.createDataFrame([(1, "z"), (3, "w")], "id long, target string")
    assert sorted((r.id, r.target, r.rule) for r in shaping.attributed(rows, "id", [first, second]).collect()) == [(1, None, None), (2, "c", 0), (3, "w", 1)]


def test_attribution_joins_two_names_of_a_nation_at_most(spark, tmp_path):
    from folioscope.plans import shaped

    spark.createDataFrame([(k, 1 + k % 3) for k in range(100, 160)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    makers = [(k, f"S{k}", 1, 8000.0) for k in range(40)] + [(50, "T", 2, 8000.0), (51, "T", 2, 9000.0), (52, "U", 2, 10.0), (101, "V", 9, 1.0)]
    spark.createDataFrame(makers, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    got = shaped.attribution(spark, str(tmp_path))
    assert {r.c_custkey: (r.target, r.rule) for r in got.collect()} == {k: ("V", 0) if k == 101 else ("T", 1) if k % 3 == 1 else (None, None) for k in range(100, 160)}
    by_nation = got._jdf.queryExecution().optimizedPlan().toString()
    assert "min(s_name" in by_nation and "max(s_name" in by_nation


def test_index_equals_scans_and_reads_only_its_terms(spark, tmp_path):
    from folioscope.functions import text as T
    from folioscope.operators import index, lexical

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "One two one two three"), (-4, "two one")], "doc_id long, text string"))
    path, words = f"{tmp_path}/index", ["the", "thing", "with", "that"]
    index.build(docs, path)
    assert [tuple(r) for r in index.bm25(spark, path, words, 15).collect()] == [tuple(r) for r in lexical.bm25_topk(docs, words, 15).collect()]
    assert {r.key: r.places for r in index.phrase(spark, path, ["one", "two"]).collect() if r.key < 0} == {-3: 2}
    assert index.bm25(spark, path, ["nowhere"], 5).count() == 0
    plan = index.postings(spark, path, ["one"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "In(term" in plan or "EqualTo(term" in plan
    index.build(docs, path, tokens=T.tokens)
    assert [tuple(r) for r in index.tfidf(spark, path, words, 15).collect()] == [tuple(r) for r in lexical.tfidf_topk(docs, words, 15).collect()]


def test_a_staged_table_is_put_in_place_only_if_the_gate_finds_nothing(spark, tmp_path):
    from folioscope.sources.tables import promote

    path = f"file://{tmp_path}/corpus"
    gate = lambda df: ["too few rows"] if df.count() < 3 else []
    assert promote(spark.range(5).toDF("id"), path, gate) == []
    assert promote(spark.range(2).toDF("id"), path, gate) == ["too few rows"]
    assert spark.read.parquet(path).count() == 5
    assert promote(spark.range(7).toDF("id"), path, gate) == [] and spark.read.parquet(path).count() == 7
    assert sorted(p.name for p in tmp_path.iterdir()) == ["corpus"]
