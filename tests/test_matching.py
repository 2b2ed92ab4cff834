"""Vectors, spans, lines, copies, related sources, windows and the quota stream against plain reckoning and SQL."""

import json
import math
import random
from collections import Counter, defaultdict
from datetime import UTC, datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import matching, related, similar
from folioscope.plans import matched as plans
from folioscope.streaming import quota

SF = "/root/testdata/sf0.001"
NAMES = [name for name, f in plans.QUERIES.items() if f.__module__ == plans.__name__ and name in plans.ORACLE_SQL]


@pytest.mark.parametrize("name", NAMES)
def test_rows_equal_sql(spark, name):
    with duckdb.connect() as duck:
        for t in ("benchmark", "documents", "embeddings", "events"):
            duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = duck.execute(plans.ORACLE_SQL[name])
        columns, rows = [c[0] for c in want.description], want.fetchall()
    got = plans.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert rows and sorted(str(tuple(r)) for r in got.select(*columns).collect()) == sorted(map(str, rows))


# --------------------------------------------------------------------------- vectors


def cosine(a, b):
    a, b = (np.array(v, float) / max(map(abs, v)) for v in (a, b))
    return round(float(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b)), 6)


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute_best(rows, k, floor):
    out = []
    for i, team, v in rows:
        found = sorted((-cosine(v, w), j) for j, other, w in rows if j != i and len(w) == len(v) and (team is None or team != other))
        out += [(i, p + 1, j, -s) for p, (s, j) in enumerate([x for x in found if -x[0] >= floor][:k])]
    return sorted(out)


def vector_rows(n=90):
    rng = random.Random(3)
    rows = [(k, rng.choice(["a", "b", "c", "d", None]), [float(rng.randrange(-3, 4)) for _ in range(4)]) for k in range(n)]
    rows += [(n + k, "a", [float(rng.randrange(1, 4)) for _ in range(3)]) for k in range(5)]
    return [r for r in rows if usable(r[2])] + [(500, None, list(rows[1][2])), (501, None, [1e200, 1e-200, 0.0, 0.0])]


def test_best_matches_equal_brute_force(spark):
    rows = vector_rows()
    odd = [(900, "a", None), (901, "a", []), (902, "a", [1.0, None, 0.0, 0.0]), (903, "a", [float("nan")] * 4), (904, "a", [0.0] * 4), (None, "a", [1.0] * 4)]
    df = spark.createDataFrame(rows + odd, "vec_id long, team string, embedding array<double>")
    for k, floor, sizes in ((3, -1.0, {"block": 16, "group": 32}), (7, 0.2, {"block": 8, "group": 8}), (200, -1.0, {})):
        got = sorted((r.id, r.place, r.match, r.score) for r in similar.best_matches(df, k, floor, team="team", **sizes).collect())
        assert got == [(i, p, j, s + 0.0) for i, p, j, s in brute_best(rows, k, floor)]
    assert similar.best_matches(df.limit(0), 3).count() == 0


def test_a_task_meets_one_lane_of_the_table(spark, monkeypatch):
    monkeypatch.setattr(similar, "LANE_BYTES", 400)
    monkeypatch.setattr(similar, "PENDING", 5)
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, team string, embedding array<double>")
    found = similar.best_matches(df, 3, -1.0, team="team", block=8, group=32)
    assert sorted((r.id, r.place, r.match, r.score) for r in found.collect()) == brute_best(rows, 3, -1.0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    parts, lanes = -(-len(rows) // 32), -(-sum(len(v) for *_, v in rows) * 8 // 400)
    assert f", {parts * lanes}" in next(line for line in plan.splitlines() if "Repartition" in line)


def test_diverse_matches_equal_a_plain_loop(spark):
    rows = vector_rows()
    vectors, teams = {i: v for i, _, v in rows}, {i: t for i, t, _ in rows}
    pools = defaultdict(list)
    for i, _, j, s in brute_best(rows, 12, 0.1):
        pools[i].append((j, s))
    want = []
    for i, pool in pools.items():
        unit = lambda j: np.array(vectors[j]) / np.abs(vectors[j]).max()
        like = lambda a, b: float(unit(a) @ unit(b) / np.sqrt((unit(a) @ unit(a)) * (unit(b) @ unit(b))))
        taken, rest = [], list(pool)
        while rest and len(taken) < 4:
            value = lambda c: round(0.75 * c[1] - 0.25 * max([like(c[0], t) for t, _ in taken], default=0.0), 9)
            best = max(rest, key=value)
            rest.remove(best)
            if teams[best[0]] is None or teams[best[0]] not in [teams[t] for t, _ in taken]:
                taken.append(best)
        want += [(i, p + 1, j, s) for p, (j, s) in enumerate(taken)]
    df = spark.createDataFrame(rows, "vec_id long, team string, embedding array<double>")
    got = similar.diverse_matches(df, limit=4, floor=0.1, pool=12, team="team", block=16, group=32)
    assert sorted((r.id, r.place, r.match, r.score) for r in got.collect()) == sorted(want)


# --------------------------------------------------------------------------- spans


def test_range_join_equals_brute_force_without_nested_loops(spark):
    rng = random.Random(4)
    points = [(k, rng.randrange(-1000, 1000)) for k in range(300)] + [(-1, None), (-2, 5), (-3, 5)]
    spans = [(k, low := rng.randrange(-1000, 1000), low + rng.choice([-3, 0, 1, 5, 64, 1500])) for k in range(120)] + [(-1, None, 5), (-2, 0, None), (-3, -(2**40), 2**40)]
    p = spark.createDataFrame(points, "level long, bin long")  # names that the join uses as well
    s = spark.createDataFrame(spans, "span long, low long, high long")
    met = matching.range_join(p, s, F.col("bin"), F.col("low"), F.col("high"))
    assert met.columns == ["level", "bin", "span", "low", "high"]
    want = [(k, j) for k, at in points for j, a, b in spans if None not in (at, a, b) and a <= at <= b]
    assert sorted((r.level, r.span) for r in met.collect()) == sorted(want)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert matching.range_join(p, s.limit(0), F.col("bin"), F.col("low"), F.col("high")).count() == 0


# --------------------------------------------------------------------------- lines


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_word_runs_are_longest_common_subsequences():
    rng = random.Random(5)
    for _ in range(1500):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(14))] for _ in range(2))
        runs, i, j, kept = matching.word_runs(a, b), 0, 0, 0
        for sign, i1, i2, j1, j2 in runs:
            assert (i1, j1) == (i, j) and (i2 > i1 or j2 > j1)
            if sign == "=":
                assert a[i1:i2] == b[j1:j2]
                kept += i2 - i1
            else:
                assert (i2 == i1) if sign == "+" else (j2 == j1)
            i, j = i2, j2
        assert (i, j) == (len(a), len(b)) and kept == lcs(a, b)
        assert all((x[0], y[0]) in (("=", "-"), ("=", "+"), ("-", "+"), ("-", "="), ("+", "=")) for x, y in zip(runs, runs[1:], strict=False))
    long = [str(rng.randrange(50)) for _ in range(6000)]
    assert sum(r[2] - r[1] for r in matching.word_runs(long, long[::-1][:3000]) if r[0] == "=") >= 300


def test_line_diffs_take_the_best_line(spark):
    left = [(1, "the old house by the sea\nthe old house by the sea\nnothing here is alike\nab"), (2, None), (3, ""), (None, "a b c d")]
    right = [(1, "a house\nthe old house by the wide sea\nThe OLD house by the sea!"), (2, "x y z"), (4, "x")]
    make = lambda rows: spark.createDataFrame([(*r, 0) for r in rows], "id long, text string, line int")
    got = matching.line_diffs(make(left), make(right), "id").collect()
    assert [(r.id, r.line, r.best, r.diff, r.gone, r.new) for r in got] == [(1, 0, 2, "=6", [], [])]
    got = matching.line_diffs(make(left), make(right[:1]).filter("id = 1").withColumn("text", F.lit("the old house by the wide sea")), "id").collect()
    assert [(r.line, r.diff, r.new) for r in got] == [(0, "=5 +1 =1", ["wide"])]


# --------------------------------------------------------------------------- copies


def test_ranked_over_many_files(spark):
    rows = [(k % 3 if k % 5 else 0, k) for k in range(400)] + [(None, 1000 + k) for k in range(5)]
    df = spark.createDataFrame(rows, "file long, index long").repartition(7)
    got = {(r["file"], r["index"]): r["n"] for r in matching.ranked(df, ["file"], ["index"], "n").filter("file is not null").collect()}
    places = Counter()
    for k, v in sorted((k, v) for k, v in rows if k is not None):
        places[k] += 1
        assert got[k, v] == places[k]


def test_staged_matches_assign_nothing_twice(spark):
    rng = random.Random(6)
    sides = [[(k, rng.choice("abc") if rng.random() < 0.9 else None, rng.choice("xyz")) for k in rng.sample(range(1000), 80)] for _ in range(2)]
    left, right = (spark.createDataFrame(s, "id long, key string, place string") for s in sides)
    both = F.concat("key", "place")
    got = matching.staged_matches(left, right, [("both", both, both), ("key", F.col("key"), F.col("key")), ("place", F.col("place"), F.col("place"))])
    want, free = [], [sorted(s) for s in sides]
    for name, key in (("both", lambda r: r[1] and r[1] + r[2]), ("key", lambda r: r[1]), ("place", lambda r: r[2])):
        for value in {key(r) for r in free[0]} - {None}:
            pairs = list(zip([r for r in free[0] if key(r) == value], [r for r in free[1] if key(r) == value], strict=False))
            want += [(a[0], b[0], name) for a, b in pairs]
            free = [[r for r in free[j] if r not in [p[j] for p in pairs]] for j in range(2)]
    got = sorted(map(tuple, got.collect()))
    assert got == sorted(want)
    assert len({a for a, _, _ in got}) == len({b for _, b, _ in got}) == len(got)
    assert matching.staged_matches(left.limit(0), right, [("key", F.col("key"), F.col("key"))]).count() == 0


# --------------------------------------------------------------------------- sources


def test_related_sources_count_domains_more(spark):
    rows = [(0, "a", "alpha bravo charlie the there 12345", ["x.test"]), (1, "a", "alpha bravo charlie delta", None), (2, "b", "alpha bravo charlie", None), (3, "b", "alpha bravo", ["x.test", "x.test"]), (4, "b", "alpha there 12345 there", None), (5, "a", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, kind string, text string, d array<string>")
    got = related.related_sources(df, "doc_id", "text", "kind", F.col("doc_id") == 0, k=3, domains="d").collect()
    assert [(r.place, r.related, r.score, r.shared) for r in sorted(got)] == [(1, 3, 8, 3), (2, 2, 5, 3), (3, 1, 3, 3)]
    none = related.related_sources(df, "doc_id", "text", "kind", F.col("doc_id") == 0, floor=2, share=0.0)
    assert none.count() == 0


def test_related_pairs_are_counted_in_groups(spark, monkeypatch):
    monkeypatch.setattr(related, "SMALL_GROUP", 7)
    rng = random.Random(4)
    names = [f"{a}{b}word" for a in "bcdfg" for b in "aeiou"]
    rows = [(k, rng.choice("xy"), " ".join(rng.choices(names, k=9))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, kind string, text string")
    found = related.related_sources(df, "doc_id", "text", "kind", F.col("doc_id") % 10 == 0, k=4, least=2, share=0.5)
    df_of = {n: sum(n in t.split() for _, _, t in rows) for n in names}
    few = {n for n in names if df_of[n] < 30}
    held = {k: few & set(t.split()) for k, _, t in rows}
    kind = {k: x for k, x, _ in rows}
    want = []
    for q in range(0, 60, 10):
        each = sorted((-(len(held[q] & held[o]) + 2 * (kind[q] != kind[o])), o, len(held[q] & held[o])) for o in held if o != q and len(held[q] & held[o]) >= 2)[:4]
        want += [(q, j + 1, o, -s, n) for j, (s, o, n) in enumerate(each)]
    assert sorted(tuple(r) for r in found.collect()) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any(line.lstrip(" +-:").startswith("Aggregate [asker") and ", id#" in line.split("]")[0] for line in plan.splitlines())  # no row moves for a pair


def brute_window(text, terms, room):
    if len(text) <= room:
        return 0, len(text), 0.0
    low, lead, hits = related.folded_in_place(text), round(room * 0.15), []
    for t in dict.fromkeys(terms):
        at = low.find(t)
        while at >= 0:
            hits.append((at, t))
            at = low.find(t, at + len(t))
    counts, start, best = Counter(t for _, t in hits), 0, 0.0
    for at, _ in sorted(hits):
        first = max(0, min(at - lead, len(text) - room))
        score = sum(1 / counts[t] for t in sorted({t for a, t in hits if first <= a < first + room}))
        if score > best + 1e-9:
            start, best = first, score
    if start and 0 <= (space := text.find(" ", start)) < start + 40:
        start = space + 1
    return start, min(len(text), start + room), best


def test_windows_equal_exhaustive_search():
    rng = random.Random(7)
    words = ["alpha", "Béta", "beta", "gamma", "x", "İz", "ﬁn", "thé", "Ørsted"]
    for _ in range(600):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(80)))
        terms = rng.sample(["alpha", "beta", "gamma", "orsted", "nowhere", "the"], 3)
        room = rng.choice([20, 60, 200])
        a, b = related.window(text, terms, room), brute_window(text, terms, room)
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-9
    assert related.folded_in_place("İzﬁ’éØ") == "izﬁ'eo" and related.query_terms("the Élan ab Été's élan") == ["elan", "ete's"]


# --------------------------------------------------------------------------- quota


def test_quota_stream_equals_a_batch_reckoning(spark, tmp_path):
    start = datetime(2024, 5, 1, 12, tzinfo=UTC)
    rng = random.Random(8)
    batches, n = [], 0
    for k in range(5):
        rows = []
        for _ in range(30):
            n += 1
            day = k - rng.choice([0, 0, 0, 1])
            action = "refund" if rng.random() < 0.25 else "spend"
            rows.append((rng.choice(["u", "v", None]), (start + timedelta(days=day, minutes=rng.randrange(600))).isoformat(), action, f"r{rng.choice([n, n - 1, n])}"))
        batches.append(rows)
    batches.append([("u", (start + timedelta(days=9)).isoformat(), "spend", "far")])
    batches.append([("u", start.isoformat(), "spend", "late"), ("u", start.isoformat(), "refund", "late"), ("u", (start + timedelta(days=9)).isoformat(), "spend", "far")])
    for k, rows in enumerate(batches):
        received = (start + timedelta(days=k if k < 5 else 9, hours=10 + k)).isoformat()
        (tmp_path / f"in-{k:02d}.json").write_text("\n".join(json.dumps(dict(zip(("identity", "ts", "action", "request"), r, strict=True)) | {"received": received}) for r in rows))
    for strict in (False, True):
        events = spark.readStream.schema("identity string, ts timestamp, action string, request string, received timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in-*.json"))
        seen = []
        out = quota.day_quota(events, 4, strict=strict).writeStream.foreachBatch(lambda df, _, seen=seen: seen.extend(map(tuple, df.collect())))
        out.option("checkpointLocation", f"{tmp_path}/check-{strict}").trigger(availableNow=True).start().awaitTermination(300)
        counts, held, want = Counter(), set(), []
        for k, rows in enumerate(batches):
            for identity, ts, action, request in sorted(rows, key=lambda r: (r[1], r[3], r[2])):
                at = datetime.fromisoformat(ts)
                day = at.date()
                if identity is None or k == 6 and request == "late":
                    want.append((identity, day, request, action, not strict, 0, False))
                    continue
                if (identity, day, action, request) not in held:
                    held.add((identity, day, action, request))
                    counts[identity, day] = counts[identity, day] + 1 if action == "spend" else max(0, counts[identity, day] - 1)
                want.append((identity, day, request, action, action == "refund" or counts[identity, day] <= 4, counts[identity, day], True))
        order = lambda r: tuple((x is None, str(x)) for x in r)
        assert sorted(seen, key=order) == sorted(want, key=order)


# --------------------------------------------------------------------------- coverage and caps


def test_covered_runs_equal_brute_force(spark):
    rng = random.Random(10)
    known = [[rng.choice("abc") for _ in range(rng.randrange(12))] for _ in range(6)]
    rows = [(k, [rng.choice("abc") for _ in range(rng.randrange(40))]) for k in range(80)] + [(100, None), (101, known[0] * 3)]
    make = lambda rs: spark.createDataFrame([(k, None if w is None else " ".join(w)) for k, w in rs], "id long, t string")
    words = F.filter(F.split("t", " "), lambda w: w != "")
    got = {r.id: tuple(r)[1:] for r in matching.covered_runs(make(rows), "id", words, make(list(enumerate(known))), words, size=4).collect()}
    grams = {tuple(w[i : i + 4]) for w in known for i in range(len(w) - 3)}
    for k, w in rows:
        w = w or []
        hit = [any(tuple(w[i : i + 4]) in grams for i in range(max(0, j - 3), j + 1) if i + 4 <= len(w)) for j in range(len(w))]
        runs = "".join("x" if h else " " for h in hit)
        stretches, gaps = [len(x) for x in runs.split(" ") if x], [len(x) for x in runs.split("x") if x]
        assert got[k] == (len(w), sum(hit), len(stretches), max(stretches, default=0), max(gaps, default=0)), w


def test_answers_fit_their_cap(spark):
    from folioscope.operators import shaping

    rng = random.Random(11)
    rows = [(rng.choice(["a", "b", None]), k, rng.choice([None, "", "word " * rng.randrange(30), "x" * 90])) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, k long, t string")
    for cap in (0, 39, 40, 500, 10**6):
        want = []
        for g in {r[0] for r in rows}:
            used, page, group = 0, [], sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
            for _, k, t in group:
                t = t or ""
                room = max(cap - used, 0)
                if len(t) > room and room < 40:
                    break
                cut = t[:room]
                if len(t) > room:
                    cut = cut[: cut.rstrip().rfind(" ")].rstrip() if " " in cut.rstrip() and not cut.endswith(" ") else cut.rstrip()
                page.append((g, k, cut if len(t) > room else t, len(t) > room))
                used += len(t)
            left = len(group) - len(page)
            want += [(*p, left, len(page) if left else None) for p in page]
        got = [(r.g, r.k, r.shown, r.clipped, r.omitted, r.next_offset) for r in shaping.fit_to_cap(df, "g", [F.col("k")], "t", cap).collect()]
        order = lambda r: (r[0] or "", r[1])
        assert [(r[0], r[1], r[3], r[4], r[5]) for r in sorted(got, key=order)] == [(r[0], r[1], r[3], r[4], r[5]) for r in sorted(want, key=order)]
        assert all(g[2] == w[2] for g, w in zip(sorted(got, key=order), sorted(want, key=order), strict=True) if not g[3])
        assert all(len(g[2]) <= cap for g in got)
