"""Each query of plans.reading gives the rows of its SQL at the smallest scale; fixtures for what the tables don't hold."""

import duckdb
import pytest
from pyspark.sql import functions as F

from folioscope.operators import matcher, reading
from folioscope.plans import reading as plans

SF = "/root/testdata/sf0.001"
NAMES = [name for name, f in plans.QUERIES.items() if f.__module__ == plans.__name__]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "orders", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_rows_equal_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    want = duck.execute(plans.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = [str(tuple(r)) for r in got.select(*columns).collect()]
    assert rows and sorted(rows) == sorted(str(r) for r in want.fetchall())


def test_chains_with_cycles_long_chains_and_lost_parents(spark):
    rows = [(0, None), *((k, k - 1) for k in range(1, 67)), (100, 101), (101, 100), (200, 999), (300, 300), (None, 5)]
    got = reading.chain_roots(spark.createDataFrame(rows, "id long, up long"), "id", "up")
    found = {r.id: (r.root, r.depth) for r in got.collect()}
    assert all(found[k] == (0, k) for k in range(67))
    assert found[100] == found[101] == found[300] == found[None] == (None, None)
    assert found[200] == (999, 1)
    assert reading.chain_roots(spark.createDataFrame([], "id long, up long"), "id", "up").count() == 0


def test_chains_of_any_length(spark):
    rows = [(k, k - 1 if k else None) for k in range(1500)] + [(5000 + k, 5000 + (k + 1) % 7) for k in range(7)] + [(6000, 5003)]
    found = {r.id: (r.root, r.depth) for r in reading.chain_roots(spark.createDataFrame(rows, "id long, up long"), "id", "up").collect()}
    assert found == {k: (0, k) if k < 5000 else (None, None) for k, _ in rows}


def test_lead_ins_of_any_length_go(spark):
    rows = [(1, 0, "a b c".split()), (1, 1, "b c d".split()), (1, 2, "d".split()), (1, 3, []), (1, 4, "x".split()), (2, 0, "d e".split())]
    got = reading.without_lead_in(spark.createDataFrame(rows, "s long, k long, w array<string>"), "s", "k", "w", 2)
    assert {(r.s, r.k): r.w for r in got.collect()} == {(1, 0): ["a", "b", "c"], (1, 1): ["d"], (1, 2): [], (1, 3): [], (1, 4): ["x"], (2, 0): ["d", "e"]}


def test_first_hits_count_code_points(spark):
    df = spark.createDataFrame([(1, "😀😀 Thát, that"), (2, "thatch"), (3, None), (4, "that")], "id long, t string")
    got = df.select("id", matcher.first_hit(F.col("t"), "that").alias("h")).collect()
    assert {r.id: (r.h.span, r.h.start) for r in got} == {1: ("Thát", 4), 2: (None, None), 3: (None, None), 4: ("that", 1)}


def test_repeated_runs_stand_apart(spark):
    df = spark.createDataFrame([(1, "a b c d e x a b c d e"), (2, "a a a a a a a"), (3, "a b"), (4, None), (5, "a a a a a a a a a a")], "id long, t string")
    got = reading.repeated_runs(df, "id", F.split("t", " "))
    assert {r.id: r.runs for r in got.collect()} == {1: 1, 5: 1}


def test_repeated_runs_move_only_for_ids_of_several_rows(spark):
    rows = [(1, "a b c d e x a b c d e"), (2, "a b c d e"), (2, "x x x x x a b c d e"), (None, "a b c d e"), (None, "x x x x x a b c d e"), (3, "b b")]
    got = reading.repeated_runs(spark.createDataFrame(rows, "id long, t string"), "id", F.split("t", " "))
    assert {r.id: r.runs for r in got.collect()} == {1: 1, 2: 1, None: 1}
    single = reading.repeated_runs(spark.createDataFrame(rows[:2], "id long, t string"), "id", F.split("t", " "))
    assert "Exchange" not in single._jdf.queryExecution().executedPlan().toString()
    assert single.count() == 1
