import random
import re

import numpy as np

from folioscope.llm import neardup


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def brute(rows):
    """(doc_id, n, component) of each row, by all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = {k: k for k, _ in rows if k is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j] and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((root(rows[i][0]), root(rows[j][0])))
                parent[b] = a
    return sorted((k is None, k or 0, len(s), None if k is None else root(k) if s else k) for (k, _), s in zip(rows, sets, strict=True))


def got(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in neardup.near_duplicates(df).collect())


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéf") for _ in range(rng.randrange(1, 5)))
    rows, base = [], [word() for _ in range(120)]
    for k in range(140):  # a family of near copies of all grades
        words = list(base)
        for _ in range(rng.randrange(12)):
            words[rng.randrange(len(words))] = word()
        rows.append((1000 + k, " ".join(words)))
    for k in range(60):
        text = [word() for _ in range(rng.choice([1, 3, 4, 5, 6, 8, 40]))]
        rows += [(k, " ".join(text)), (500 + k, "  ".join(text).upper() if k % 2 else " ".join([*text, word()]))]
    rows += [(2000, None), (2001, ""), (2002, " \n\t"), (2003, "A b"), (2004, "a\tB"), (2004, "a\tB"), (None, "a b"), (2005, "x " * 5000), (2006, "X " * 3000), (2007, "a b")]
    return rows


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HEAVY", 3)  # so that buckets of four rows are dealt like hot ones
    monkeypatch.setattr(neardup, "BLOCK", 32)
    rows = corpus()
    df = spark.createDataFrame([(k, t, "x", "y") for k, t in rows], "doc_id long, text string, digest string, sketch string")
    assert got(df) == brute(rows)
    out = neardup.near_duplicates(df).filter("doc_id is not null")
    assert out.filter("kept <> (doc_id = component_id)").count() == 0


def test_empty_and_linkless_tables(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    assert got(df.limit(0)) == []
    assert got(df) == [(False, 1, 1, 1), (False, 2, 0, 2)]


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    found = {r.id: r.component for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found.get(x, x) == root(x) for x in parent)


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (600, 100, 100))
    x, y = neardup.sketches([np.unique(np.concatenate([common, a])), np.unique(np.concatenate([common, b]))])
    assert abs((x == y).mean() - 0.75) < 0.15
    small = neardup.sketches([np.array([5], np.uint64), np.zeros(0, np.uint64)])
    assert len(set(small[0].tolist())) == 1
    assert not small[1].any()


def test_bitmap_marks_all_of_its_keys_and_few_others(spark):
    df = spark.range(20_000).selectExpr("id", "id as place", "id as page", "cast(id as string) as bits")
    kept = {r.id for r in neardup._likely(df, df.filter("id % 4 = 0"), "id").collect()}
    assert kept >= set(range(0, 20_000, 4)) and len(kept) < 5020
    assert neardup._likely(df, df.limit(0), "id").count() == 0


def test_heavy_keys_are_dealt_and_keep_their_facts(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HEAVY", 50)
    rows = spark.range(3000).selectExpr("case when id < 1000 then 1 else id end as key", "id")
    facts = rows.groupBy("key").count().selectExpr("key", "count as held", "key * 2 as twice")
    out = neardup._keyed_join(rows, facts, "key", "id")
    assert out.columns == ["key", "id", "held", "twice"] and out.count() == 3000
    assert out.filter("twice <> key * 2 or held <> case when key = 1 then 1000 else 1 end").count() == 0
    dealt = out.filter("key = 1").selectExpr("spark_partition_id() as p").distinct()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert dealt.count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_rows_without_heavy_keys_meet_their_facts_without_a_bitmap(spark):
    rows = spark.range(3000).selectExpr("id % 700 as key", "id")
    facts = rows.groupBy("key").count().selectExpr("key", "count as held", "key * 2 as twice")
    out = neardup._keyed_join(rows, facts, "key", "id")
    assert out.columns == ["key", "id", "held", "twice"] and out.count() == 3000
    assert out.filter("twice <> key * 2 or held <> case when key < 200 then 5 else 4 end").count() == 0
    # a broadcast and the exchanges of a bitmap, on each side of each join, held threads and memory of the driver
    assert "bitmap" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_deduplicated_keeps_one_row_of_a_component_and_all_columns(spark):
    names = ["__row", "fs_row", "place", "page", "bits", "held", "kept", "likely", "a.b"]
    texts = [(1, "a b c d e f g"), (2, "A b c d e f g"), (3, "other words in here now"), (3, "another text of this one id"), (3, "another text of this one id"), (None, "a b c d e f g"), (None, None), (4, None), (5, ""), (6, "x " * 30_000)]
    rows = [(k, t, *range(j, j + len(names))) for j, (k, t) in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in names))
    out = neardup.deduplicated(df)
    assert out.columns == df.columns
    got_rows = sorted(map(tuple, out.collect()), key=str)
    # of the two equal texts of doc_id 3 one row stays, whichever its other columns hash to
    left = [r for r in got_rows if r[0] != 3]
    assert left == sorted((rows[k] for k in (0, 5, 6, 7, 8, 9)), key=str)
    assert [r in (rows[3], rows[4]) for r in got_rows if r[0] == 3] == [True]
    assert neardup.deduplicated(df.limit(0)).count() == 0


def _labels(monkeypatch):
    seen, stored = [], neardup.stored
    monkeypatch.setattr(neardup, "stored", lambda df, label: seen.append(label) or stored(df, label))
    return seen


def test_links_that_are_stars_take_one_pass(spark, monkeypatch):
    seen = _labels(monkeypatch)
    links = spark.range(1, 200).selectExpr("id as a", "id % 10 * -1 as b")
    found = {r.id: r.component for r in neardup.components(links).collect()}
    assert found == {k: -(k % 10) for k in range(1, 200)}
    # the loop used to run a whole round of eight exchanges, and one more to see that nothing had changed
    assert len(seen) == 1


def test_jobs_that_find_nothing_new_are_not_run(spark, monkeypatch):
    seen = _labels(monkeypatch)
    rng = random.Random(5)
    texts = [" ".join(str(rng.randrange(10**6)) for _ in range(60)) for _ in range(8)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(100 + k, t + " more") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()} == {k: k % 100 for k, _ in rows}
    assert "heavy-keys" not in seen and not any(x.startswith("rest-links") for x in seen)
    assert sum(x == "components-neighbours" for x in seen) == 1 and sum(x == "families" for x in seen) == 1


def test_merged_components(spark):
    found = spark.createDataFrame([(2, 1), (3, 1), (12, 11), (22, 21)], "id long, component long")
    links = spark.createDataFrame([(3, 12), (12, 3), (2, 3), (22, 30), (5, 22)], "a long, b long")
    got = {r.id: r.component for r in neardup._merged(found, links).collect()}
    assert got == {2: 1, 3: 1, 12: 1, 11: 1, 22: 5, 21: 5, 30: 5}
