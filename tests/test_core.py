import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from folioscope.functions import text as T
from folioscope.functions import urls as U
from folioscope.operators import lexical, matcher
from folioscope.sources import tables
from folioscope.streaming import windows


def column(spark, values, f):
    return [r[1] for r in spark.createDataFrame(list(enumerate(values)), "k int, v string").select("k", f(F.col("v"))).orderBy("k").collect()]


def test_matcher_boundaries_accents_and_modes(spark):
    texts = ["ens", "sense", "Ens!", "ÉNS", "the\nend", "C++ code", "C+", "tests", "testing", "tester", "AT&T"]
    hit = lambda term, **o: [t for t, h in zip(texts, column(spark, texts, lambda c: matcher.matches(c, term, **o)), strict=True) if h]
    assert hit("ens") == ["ens", "Ens!", "ÉNS"]
    assert hit("Ens", case_sensitive=True) == ["Ens!"]
    assert hit("the end") == ["the\nend"]
    assert hit("C++") == ["C++ code"]
    assert hit("test", mode="stem") == ["tests"]
    assert hit("testin", mode="stem") == []
    assert hit("tester/AT&T") == ["tester", "AT&T"]
    assert hit("zzz", aliases=("ens",)) == ["ens", "Ens!", "ÉNS"]
    for bad in ("", " ", "!", "x" * 201):
        with pytest.raises(ValueError):
            matcher.pattern(bad)
    assert matcher.sides("9/11") == ["9/11"]


def test_url_keys(spark):
    urls = ["https://www.Example.com/a/?utm_source=x#top", "http://m.example.com/a", "example.com/a/amp", "https://user@example.com:443/a?b=1&fbclid=2", "https://netflix.com/"]
    assert column(spark, urls, U.url_key) == ["example.com/a", "example.com/a", "example.com/a", "example.com/a?b=1", "netflix.com"]
    assert column(spark, ["x.com", "a.x.com", "netflix.com"], lambda c: U.in_domain(c, "x.com")) == [True, True, False]


def test_text_functions(spark):
    html = "<html><title> A\n B </title><script>no</script><nav>no</nav><p>One&amp;two</p><p>three<br>four</p>"
    assert column(spark, [html], T.page_title) == ["A B"]
    assert column(spark, [html], T.html_to_text)[0].split("\n")[-3:] == ["B One&two", "three", "four"]
    assert column(spark, ["Hello, World! ", "--a"], T.slug) == ["hello-world", "a"]
    assert column(spark, ["a bb ccc ddd"], lambda c: T.clip(c, 7)) == ["a bb…"]
    assert column(spark, ["a b c d", "a"], lambda c: T.shingles(F.split(c, " "), 3)) == [["a b c", "b c d"], []]


def test_filter_before_top_k(spark):
    rows = [(k, [1.0, 0.001 * k], 2026) for k in range(40)] + [(100, [0.5, 0.5], 2020), (101, [0.0, 0.0], 2020), (102, [1.0], 2020)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, year int")
    assert [r.vec_id for r in lexical.cosine_topk(df, [1.0, 0.0], 5, keep=F.col("year") == 2020).collect()] == [100]


def test_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntitle: x\n---\nbody\n")
    (tmp_path / "b.md").write_text("plain")
    got = {r.path.rsplit("/", 1)[-1]: (r.front, r.body) for r in tables.markdown_files(spark, str(tmp_path)).collect()}
    assert got == {"a.md": ("title: x", "body\n"), "b.md": ("", "plain")}
    days = str(tmp_path / "days")
    spark.createDataFrame([("d1", 1), ("d2", 2)], "day string, n int").write.partitionBy("day").parquet(days)
    tables.replace_days(spark.createDataFrame([("d2", 5)], "day string, n int"), days)
    assert {(r.day, r.n) for r in spark.read.parquet(days).collect()} == {("d1", 1), ("d2", 5)}


def test_streams(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 10)
    rows = [(k % 5, 1, t + dt.timedelta(minutes=k)) for k in range(10)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("event_id long, user_id long, ts timestamp").parquet(f"{tmp_path}/in")
    seen = []
    windows.each_batch(windows.distinct_hits(stream), "event_id", "ts", lambda b, _: seen.extend(r.event_id for r in b.collect()), f"{tmp_path}/c1").awaitTermination()
    assert sorted(seen) == [0, 1, 2, 3, 4]
    q = windows.hourly_counts(stream, 3).writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.n, r.allowed) for r in spark.table("hourly").collect()] == [(10, False)]


def test_core_queries_equal_their_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in tables.NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    for name in ("lex_bm25_topk", "hybrid_rrf", "yearly_signals", "snapshot_diff", "turn_runs", "asof_heading"):
        a, b = queries[name](spark, sf), con.execute(sql[name])
        names = sorted(a.columns)
        assert names == sorted(c[0] for c in b.description)
        at = [[c[0] for c in b.description].index(x) for x in names]
        assert sorted(map(str, (tuple(r[x] for x in names) for r in a.collect()))) == sorted(str(tuple(r[k] for k in at)) for r in b.fetchall()), name
    assert __spark_entry__.entry(spark).count() > 0


def test_whole_signals_count_terms_of_any_place(spark, tmp_path):
    import duckdb

    late = "the " * 600 + "latecomer"
    rows = [(0, late, "a"), (1, late + " latecomer", "a"), (2, "early words", "b"), (3, None, "b"), (4, "", "c")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(map(tuple, __spark_entry__.queries()["yearly_signals_whole"](spark, str(tmp_path)).collect()))
    assert [r[:3] for r in got] == [("a", "latecomer", 2), ("b", "early", 1), ("b", "words", 1)]
    assert got == sorted(con.execute(__spark_entry__.oracle_sql()["yearly_signals_whole"]).fetchall())


def test_quotes_of_any_language(spark, tmp_path):
    import duckdb

    rows = [(0, "one Of The many", "en"), (1, "x" * 100 + " of the " + "y" * 300, "fr"), (2, "end of the", None), (3, "of a", "en"), (4, None, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(map(tuple, __spark_entry__.queries()["quote_context_all"](spark, str(tmp_path)).collect()))
    assert [r[:2] for r in got] == [(0, "Of The"), (1, "of the"), (2, "of the")]
    assert got == sorted(con.execute(__spark_entry__.oracle_sql()["quote_context_all"]).fetchall())


def test_accents_of_all_latin_blocks_and_typed_signs(spark):
    hit = lambda text, term, **o: column(spark, [text], lambda c: matcher.matches(c, term, **o))[0]
    assert all(hit(t, "lodz") for t in ("Łódź", "LÓDZ", "lodź", "ŁODZ"))
    assert hit("smørrebrød", "smorrebrod") and hit("ệ", "e") and hit("Ǿ", "o") and not hit("œ", "o")
    assert hit("it’s “so” — here", 'it\'s "so" - here', mode="literal") and hit("well known", "well known", mode="literal")
    assert matcher.plain("Łódź đ Ħ é") == "Lodz d H e"


def test_labels_aliases_hits_and_reasons(spark):
    families = [("minn", "Minne Bar", "mb"), ("x",)]
    assert matcher.aliases_for("Minne bar", families) == ("minn", "mb") and matcher.aliases_for("nobody", families) == ()
    assert matcher.aliases_for("mb/Zed", families) == ("mb", "Zed", "minn", "Minne Bar")
    labels = ["Élan", " «elan»! ", "elan vital", "Minne  Bar", None, ""]
    assert column(spark, labels, lambda c: matcher.whole_label(c, "elan", ("minne bar",))) == [True, True, False, True, False, False]
    assert column(spark, ["An elan, Élan. élans", None], lambda c: matcher.hits(c, "elan")) == [["elan", "Élan"], []]
    df = spark.createDataFrame([("the Bar of minn", None), ("x", "Minne Bar"), (None, "zed")], "a string, b string")
    rows = df.select(matcher.reasons({"a": F.col("a"), "b": F.col("b")}, {"minn": ("minne bar",), "bar": ()}).alias("r")).collect()
    assert [[tuple(x) for x in r.r] for r in rows] == [
        [("a", "minn", "minn", "minn", 12, True), ("a", "bar", "bar", "Bar", 5, True)],
        [("b", "minn", "minne bar", "Minne Bar", 1, False), ("b", "bar", "bar", "Bar", 7, True)],
        [],
    ]


def test_pairs_are_counted_by_tasks_that_follow_from_the_rows(spark, monkeypatch):
    from folioscope.plans import catalogue

    monkeypatch.setattr(catalogue, "COUNTED_ROWS", 500)
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    plan = catalogue.QUERIES["cooccurrence_topk"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [s#" in plan and plan.count(f", {-(-lines // 500)}") >= 3
