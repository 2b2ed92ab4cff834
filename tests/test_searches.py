"""The stored index and its searches against plain reckoning; stems; builds that compute only what is new."""

import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import evaluation, index, keywords, stems
from folioscope.plans import searches as plans
from folioscope.sources import builds

SF = "/root/testdata/sf0.001"
NAMES = [name for name, f in plans.QUERIES.items() if f.__module__ == plans.__name__ and name in plans.ORACLE_SQL]


@pytest.mark.parametrize("name", NAMES)
def test_rows_equal_sql(spark, name):
    with duckdb.connect() as duck:
        for t in ("documents", "benchmark"):
            duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = duck.execute(plans.ORACLE_SQL[name])
        columns, rows = [c[0] for c in want.description], want.fetchall()
    got = plans.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(str(tuple(r)) for r in got.select(*columns).collect()) == sorted(map(str, rows))


def test_words_beside_a_phrase_find_rows_without_it(spark, tmp_path):
    texts = ["a of the b ing", "ing alone", "Éauouon here", "the of ing ING", None, "", "of course the", "x y z", "sing ring", "eauouon ing of the"]
    rows = [(k, t, f"src{k % 2}") for k, t in enumerate(texts, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as duck:
        duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = duck.execute(plans.ORACLE_SQL["fts_phrase"]).fetchall()
    got = plans.QUERIES["fts_phrase"](spark, str(tmp_path)).select("doc_id", "score").collect()
    assert [r[0] for r in want] == [10, 1, 3, 4, 2]  # before, without 4 and 2: the SQL's second word was not asked for
    assert list(map(tuple, got)) == want


#: Words and stems as they are given in the paper that describes the algorithm.
PUBLISHED = """caresses:caress ponies:poni ties:ti caress:caress cats:cat feed:feed agreed:agre plastered:plaster bled:bled motoring:motor
sing:sing conflated:conflat troubled:troubl sized:size hopping:hop tanned:tan falling:fall hissing:hiss fizzed:fizz failing:fail
filing:file happy:happi sky:sky relational:relat conditional:condit rational:ration valenci:valenc hesitanci:hesit digitizer:digit
conformabli:conform radicalli:radic differentli:differ vileli:vile analogousli:analog vietnamization:vietnam predication:predic
operator:oper feudalism:feudal decisiveness:decis hopefulness:hope callousness:callous formaliti:formal sensitiviti:sensit
sensibiliti:sensibl triplicate:triplic formative:form formalize:formal electriciti:electr electrical:electr hopeful:hope goodness:good
revival:reviv allowance:allow inference:infer airliner:airlin gyroscopic:gyroscop adjustable:adjust defensible:defens irritant:irrit
replacement:replac adjustment:adjust dependent:depend adoption:adopt homologou:homolog communism:commun activate:activ
angulariti:angular homologous:homolog effective:effect bowdlerize:bowdler probate:probat rate:rate cease:ceas controll:control
roll:roll generalizations:gener oscillators:oscil"""


def test_published_stems():
    for pair in PUBLISHED.split():
        word, stem = pair.split(":")
        assert stems.stem(word) == stem
    assert [stems.stem(w) for w in ("", "is", "été", "b2b")] == ["", "is", "été", "b2b"]


def test_queries_of_readers():
    assert keywords.parse('the "Blue  sky" of NOT old') == (["blue", "sky", "old"], [["blue", "sky"]])
    assert keywords.parse("the of") == (["the", "of"], [["the", "of"]])
    assert keywords.parse("blue blue sky", "nostop") == (["blue", "sky"], [])
    assert keywords.parse("Été de l'an", fold=True) == (["ete", "de", "l"], [["ete", "de", "l", "an"]])
    assert keywords.parse(None) == keywords.parse(' "" * ') == ([], [])
    assert keywords.parse("a “b c” d", "or").phrases == []
    with pytest.raises(ValueError):
        keywords.parse("x", "near")


def plain_search(rows, query, kind, stemmed):
    unit = stems.stem if stemmed else str
    docs = {k: (s, [unit(index.folded(w)) for w in re.findall(r"[^\W_]+", (t or "").lower())]) for k, s, t in rows}
    lens = [len(w) for (s, w), (_, _, t) in zip(docs.values(), rows, strict=True) if t is not None]
    n, mean = len(docs), sum(lens) / len(lens)
    terms, phrases = [unit(t) for t in query.terms], [[unit(t) for t in p] for p in query.phrases]
    count = lambda w, p: sum(w[i : i + len(p)] == p for i in range(len(w)))

    def score(w, parts):
        out = 0.0
        for p in parts:
            df, tf = sum(count(x, p) > 0 for _, x in docs.values()), count(w, p)
            idf = math.log((n - df + 0.5) / (df + 0.5))
            out += (idf if idf > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
        return out

    found = []
    for k, (s, w) in docs.items():
        said, held = any(count(w, p) for p in phrases), any(t in w for t in terms)
        if (said or held) and kind in (None, s):
            found.append((k, round(1000 + score(w, phrases) if said else score(w, [[t] for t in dict.fromkeys(terms)]), 6)))
    return sorted(found, key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("stemmed", [False, True])
def test_search_equals_plain_reckoning(spark, tmp_path, stemmed):
    rng = random.Random(1)
    words = ["run", "runs", "running", "Élan", "elan", "the", "of", "walk", "walked", "x1"]
    rows = [(k, rng.choice(["a", "b"]), " ".join(rng.choice(words) for _ in range(rng.randrange(30)))) for k in range(120)]
    rows += [(200, "a", None), (201, "b", ""), (202, "a", "run " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    path = f"{tmp_path}/index"
    index.build(df, path, kind=F.col("source"), fold=True)
    for text, mode, kind in (("the run", "adjacent", None), ('walked "elan runs"', "phrase", "a"), ("run run x1", "or", "b"), ("the of", "nostop", None), ('"run run" "of the"', "adjacent", None), ("nowhere at all", "adjacent", None)):
        query = keywords.parse(text, mode, fold=True)
        got = [(r.key, r.score) for r in keywords.search(spark, path, query, None, kind, stemmed).collect()]
        assert sorted(got, key=lambda x: (-x[1], x[0])) == plain_search(rows, query, kind, stemmed)
    assert keywords.search(spark, path, keywords.parse(""), 5).count() == 0


def test_search_reads_only_its_terms(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "FOLDER_BYTES", 1 << 12)
    monkeypatch.setattr(index, "TASK_BYTES", 1 << 12)
    spark.createDataFrame([(k, "hot " + " ".join(f"w{k}x{j}" for j in range(40))) for k in range(200)], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    df = spark.read.parquet(f"{tmp_path}/docs")
    path = f"{tmp_path}/index"
    index.build(df, path)
    assert spark.read.parquet(f"{path}/stats").first().folders > 8
    hot = index.postings(spark, path, ["hot"])
    assert hot.count() == 200
    plan = hot._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters" in plan and ("EqualTo(term,hot)" in plan or "In(term, [hot])" in plan)
    assert len(index.postings(spark, path, ["hot"]).select("bucket").distinct().collect()) == 1


def test_a_frequent_word_is_written_by_as_many_tasks_as_others(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "MOST_FOLDERS", 2)
    monkeypatch.setattr(index, "TASK_BYTES", 1 << 11)
    rows = [(k, "hot " + " ".join(f"w{k}x{j}" for j in range(40))) for k in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(16).write.parquet(f"{tmp_path}/docs")
    monkeypatch.setattr(index, "FOLDER_BYTES", 1 << 11)
    path = f"{tmp_path}/index"
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        index.build(spark.read.parquet(f"{tmp_path}/docs"), path, norms=False)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    hot = spark.read.parquet(f"{path}/postings").filter("term = 'hot'").select(F.input_file_name().alias("file"), "df")
    assert hot.agg(F.sum("df")).first()[0] == 400
    assert hot.select("file").distinct().count() > 5  # four parts before, however large the table


def test_a_task_sorts_one_part_of_one_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "TASK_BYTES", 1 << 11)
    monkeypatch.setattr(index, "FOLDER_BYTES", 1 << 13)
    rows = [(k, " ".join(f"w{k * j % 977}" for j in range(60))) for k in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/docs")
    df, path = spark.read.parquet(f"{tmp_path}/docs"), f"{tmp_path}/index"
    index.build(df, path, norms=False)
    written = spark.read.parquet(f"{path}/postings").select("bucket", F.regexp_extract(F.input_file_name(), "part-(\\d+)", 1).alias("task"))
    held = written.groupBy("task").agg(F.countDistinct("bucket").alias("n")).collect()
    assert len(held) > 8 and {r.n for r in held} == {1}  # before, a task had the parts that a hash gave it, or none


def test_words_folded_together_are_those_folded_alone():
    words = ["Été", "a\u0301\u0323b", "ascii", "", "\u0301", "한국", "ǭ", "ﬁ"]
    for held in (words, ["x", "y"], [], ["é\né", "a"]):
        assert index._all_folded(held) == list(map(index.folded, held))


def test_index_refuses_rows_that_cannot_be_told_apart(spark, tmp_path):
    for rows in ([(1, "a"), (1, "b")], [(None, "a")]):
        with pytest.raises(ValueError, match="refuses"):
            index.build(spark.createDataFrame(rows, "doc_id long, text string"), f"{tmp_path}/x")
    with pytest.raises(ValueError, match="without a key"):
        index.build(spark.createDataFrame([(" ", "a")], "doc_id string, text string"), f"{tmp_path}/x")
    path = f"{tmp_path}/empty"
    index.build(spark.createDataFrame([], "doc_id long, text string"), path)
    assert index.bm25(spark, path, ["a"], 5).count() == index.phrase(spark, path, ["a", "b"]).count() == 0


def test_index_is_built_once_for_a_state_of_the_files(spark, tmp_path, monkeypatch):
    built = []
    plain = index.build
    monkeypatch.setattr(index, "build", lambda *a, **k: (built.append(1), plain(*a, **k)))
    spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    first = index.served(spark.read.parquet(f"{tmp_path}/docs"), "t", tokens=T.words)
    assert index.served(spark.read.parquet(f"{tmp_path}/docs"), "t", tokens=T.words) == first and len(built) == 1
    spark.createDataFrame([(3, "c")], "doc_id long, text string").write.mode("append").parquet(f"{tmp_path}/docs")
    assert index.served(spark.read.parquet(f"{tmp_path}/docs"), "t", tokens=T.words) != first and len(built) == 2


# --------------------------------------------------------------------------- builds


def test_builds_compute_only_what_is_new(spark, tmp_path):
    computed = spark.sparkContext.accumulator(0)

    def lengths(rows):
        def run(batches):
            for batch in batches:
                computed.add(batch.num_rows)
                yield batch

        return rows.select("id", F.length("text").alias("n")).mapInArrow(run, "id long, n int")

    def write(rows):
        spark.createDataFrame(rows, "id long, text string, note string").repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/rows")
        return spark.read.parquet(f"{tmp_path}/rows")

    rows, path = [(k, "x" * k, "n") for k in range(40)], f"file://{tmp_path}/built"
    run = lambda df, recipe="1": builds.build(df, path, "id", ["text"], recipe, lengths)[1:]
    assert run(write(rows)) == (40, 0, 0) and computed.value == 40
    assert run(spark.read.parquet(f"{tmp_path}/rows")) == (0, 40, 0) and computed.value == 40  # the files are the same: nothing is read
    assert run(write([(k, t, "other") for k, t, _ in rows])) == (0, 40, 0) and computed.value == 40  # other files, the same inputs
    changed = [(k, t + "!" * (k in (3, 5, 7)), n) for k, t, n in rows[:38]] + [(50, None, "n")]
    assert run(write(changed)) == (4, 35, 2) and computed.value == 44
    assert {r.id: r.n for r in builds.current(spark, path).collect()} == {k: None if t is None else len(t) for k, t, _ in changed}
    assert run(spark.read.parquet(f"{tmp_path}/rows"), "2") == (39, 0, 0) and computed.value == 83  # another recipe


def test_builds_refuse_and_stay_as_they_were(spark, tmp_path):
    path = f"file://{tmp_path}/built"
    make = lambda rows: spark.createDataFrame(rows, "id long, text string")
    run = lambda rows: builds.build(make(rows), path, "id", ["text"], "1", lambda df: df.select("id", "text"))
    run([(k, "t") for k in range(10)])
    for rows in ([(k, "t") for k in range(8)], [(1, "a"), (1, "a")], [(None, "a")]):
        with pytest.raises(builds.Refused):
            run(rows)
    assert builds.current(spark, path).count() == 10
    assert run([(k, "t") for k in range(1, 11)])[1:] == (1, 9, 1)


def test_row_digests_tell_nulls_and_neighbours_apart(spark):
    rows = [(None, "a"), ("", "a"), ("a", None), ("a", ""), ("a,b", ""), ("a", "b")]
    df = spark.createDataFrame(rows, "x string, y string")
    assert df.select(builds.row_digest(["x", "y"]).alias("d")).distinct().count() == len(rows)


# --------------------------------------------------------------------------- pages, many searches


def brute_page(rows, hits, k, run=5, share=0.5):
    grams = {key: {tuple(w[i : i + run]) for i in range(len(w) - run + 1)} for key, w in ((key, (t or "").split()) for key, t in rows)}
    page = []
    for key, score in sorted(hits, key=lambda h: (-h[1], h[0])):
        if len(page) < k and not any(grams[key] and len(grams[key] & grams[other]) >= share * len(grams[key]) for other, _ in page):
            page.append((key, score))
    return page


def test_pages_leave_out_what_stands_above_and_are_filled_up(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(30)) for _ in range(12)]
    rows = [(k, t) for k, t in enumerate(texts * 6)] + [(100, "a b"), (101, "a b"), (102, None), (103, texts[0][:40] + " " + texts[1][20:])]
    hits = [(k, float(rng.randrange(3))) for k, _ in rows]
    make = spark.createDataFrame(hits, "key long, score double")
    docs = spark.createDataFrame(rows, "key long, text string")
    for k, pool in ((5, 8), (14, 4), (100, 16)):
        got = evaluation.page_without_copied(make, docs, k, pool=pool).orderBy("place").collect()
        assert [(r.key, r.score) for r in got] == brute_page(rows, hits, k) and [r.place for r in got] == list(range(1, len(got) + 1))
    assert evaluation.page_without_copied(make.limit(0), docs, 5).count() == 0


def test_copies_of_a_hit_meet_the_page_and_not_one_another(spark, monkeypatch):
    texts = [" ".join(f"{x}{j}" for j in range(12)) for x in "abc"]
    rows = [(k, texts[k // 300]) for k in range(900)]
    hits = [(k, float(-(k // 300))) for k, _ in rows] + [(1000, None), (1001, None)]
    rows += [(1000, "short one"), (1001, "short one")]
    seen, plain = [], evaluation._repeats
    monkeypatch.setattr(evaluation, "_repeats", lambda *a: seen.append(plain(*a)) or seen[-1])
    make, docs = spark.createDataFrame(hits, "key long, score double"), spark.createDataFrame(rows, "key long, text string")
    got = evaluation.page_without_copied(make, docs, 5, pool=256).orderBy("place").collect()
    assert [r.key for r in got] == [0, 300, 600, 1000, 1001]
    # before, each pool's copies met one another: 300 * 299 pairs of each text
    assert sum(map(len, seen)) < 900 + 6 * evaluation.HEAD**2


def test_tasks_follow_from_texts_and_not_from_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "TASK_BYTES", 1 << 14)
    text = " ".join(f"w{j}" for j in range(400))
    spark.createDataFrame([(k, text) for k in range(800)], "doc_id long, text string").repartition(16).write.parquet(f"{tmp_path}/docs")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        index.build(spark.read.parquet(f"{tmp_path}/docs"), f"{tmp_path}/index", norms=False)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    files = spark.read.parquet(f"{tmp_path}/index/postings").filter("bucket >= 0").select(F.input_file_name().alias("file")).distinct()
    assert files.count() > 10  # before, a few: a file holds a copied text once


def test_many_searches_equal_one_by_one(spark, tmp_path):
    rng = random.Random(5)
    words = ["w%d" % k for k in range(30)]
    df = spark.createDataFrame([(k, " ".join(rng.choices(words, k=rng.randrange(1, 25)))) for k in range(150)], "doc_id long, text string")
    path = f"{tmp_path}/index"
    index.build(df, path)
    asked = [(k, rng.choices([*words, "nowhere", None], k=3)) for k in range(12)] + [(50, []), (51, None), (52, ["w1", "w1"])]
    got = evaluation.batch_bm25(spark, path, spark.createDataFrame(asked, "id long, terms array<string>"), 7).collect()
    for q, terms in asked:
        own = sorted({t for t in terms or [] if t})
        one = [(r.key, r.score) for r in index.bm25(spark, path, own, 7).collect()] if own else []
        assert [(r.key, r.score) for r in sorted(got, key=lambda r: r.place) if r.id == q] == one


def test_many_searches_move_only_the_best_of_each_block(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    words = ["w%d" % k for k in range(12)]
    df = spark.createDataFrame([(f"k{k}", " ".join(rng.choices(words, k=rng.randrange(1, 9)))) for k in range(300)], "doc_id string, text string")
    path = f"{tmp_path}/index"
    index.build(df, path)
    asked = spark.createDataFrame([(k, rng.sample(words, 5)) for k in range(9)], "id long, terms array<string>")
    plan = evaluation.batch_bm25(spark, path, asked, 4)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" in plan and not re.search(r"hashpartitioning\(id#\d+L?, (key|salt)#", plan)  # what all queries find was dealt by query and row
    ids = asked.select("id", F.explode("terms").alias("term")).groupBy("term").agg(F.collect_list("id").alias("ids"), F.lit(1.0).alias("weight"))
    ids = ids.withColumn("bucket", index._bucket(F.col("term"), 1))
    batches = index.by_block(spark, path, index.asked_rows(spark, path, ids), ["ids", "weight", "rows", "tfs"]).toArrow().to_batches()
    run = lambda: [r for b in evaluation._best_of_blocks(iter(batches), 4, 4.5, 1.2, 0.75) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    whole = run()
    monkeypatch.setattr(evaluation, "AT_ONCE", 1)
    assert run() == whole and len(whole) >= 9 * 4


def test_scores_are_rounded_as_spark_does(spark):
    rng = random.Random(7)
    numbers = [k / 1e6 + 5e-7 for k in range(400)] + [rng.random() * 30 for _ in range(400)] + [0.0, 1.0000005, 2.5, 12.3456785, 12.34567849999]
    want = [r.x for r in spark.createDataFrame([(x,) for x in numbers], "x double").coalesce(1).select(F.round("x", 6).alias("x")).collect()]
    assert evaluation._rounded(np.array(numbers)).tolist() == want


def test_holders_are_those_whose_text_has_the_item(spark, tmp_path):
    docs = [(1, "so one two three go"), (2, "one two  three"), (3, "xone two threex"), (4, None), (5, "three two one"), (6, "one two three one two three")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    path = f"{tmp_path}/index"
    index.build(df, path)
    items = spark.createDataFrame([(9, "one two three"), (8, "absent word here"), (7, "go")], "id long, text string").withColumn("terms", T.words(F.col("text")))
    assert sorted(map(tuple, evaluation.holders(spark, path, items, df, "doc_id").collect())) == [(7, 1), (9, 1), (9, 3), (9, 6)]


def test_metrics_by_hand(spark):
    truths = spark.createDataFrame([(1, 10, "a"), (1, 11, "a"), (2, 12, "b")], "id long, key long, kind string")
    found = spark.createDataFrame([(1, 10, 2), (1, 99, 1), (2, 12, 7)], "id long, key long, place int")
    got = {(r.kind, r.level): (r.pairs, r.mrr, r.recall_1, r.recall_5, r.recall_10) for r in evaluation.retrieval_metrics(found, truths, ["kind"]).collect()}
    assert got == {("a", 0): (2, 0.25, 0.0, 0.5, 0.5), ("b", 0): (1, round(1 / 7, 6), 0.0, 0.0, 1.0), (None, 1): (3, round((0.5 + 1 / 7) / 3, 6), 0.0, round(1 / 3, 6), round(2 / 3, 6))}
