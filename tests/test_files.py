"""Corpora as files: JSON by its first bytes, front matter, trees of files; and the queries against their SQL."""

import gzip
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from folioscope.plans import filed as plans
from folioscope.sources import files

SF = "/root/testdata/sf0.001"
NAMES = [name for name, f in plans.QUERIES.items() if f.__module__ == plans.__name__]


@pytest.mark.parametrize("name", NAMES)
def test_rows_equal_sql(spark, name):
    with duckdb.connect() as duck:
        for t in ("pages", "conversations", "events"):
            duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = duck.execute(plans.ORACLE_SQL[name])
        columns, rows = [c[0] for c in want.description], want.fetchall()
    got = plans.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert rows and sorted(str(tuple(r)) for r in got.select(*columns).collect()) == sorted(map(str, rows))


def test_records_of_all_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_bytes(gzip.compress(json.dumps({"version": 1, "posts": [{"id": 1}, {"id": 2}], "links": [{"id": 3}], "tags": ["x"]}).encode()))
    (tmp_path / "b").write_text('[{"id": 4}]')
    (tmp_path / "c.gz").write_text('{"id": 5}\n\n{"id": 6, "posts": null}\n')
    (tmp_path / "d").write_text('﻿{"id": 7}')
    (tmp_path / "e").write_text("")
    (tmp_path / "f").write_bytes(b"\x1f\x8bbroken")
    (tmp_path / "g").write_text('{"id": 8')
    found = files.corpus_records(spark, str(tmp_path))
    rows = sorted((r.path[-6:].split("/")[-1], r.kind, r.ord, json.loads(r.record)["id"]) for r in found.filter("fault is null").collect())
    assert rows == [("a.json", "links", 2, 3), ("a.json", "posts", 0, 1), ("a.json", "posts", 1, 2), ("b", "", 0, 4), ("c.gz", "", 0, 5), ("c.gz", "", 1, 6), ("d", "", 0, 7)]
    assert sorted(r.path[-1] for r in found.filter("fault is not null").collect()) == ["f", "g"]
    assert sorted(r.id for r in files.typed(found, "posts", "id int").collect()) == [1, 2]


def test_front_matter():
    text = """---
# a comment
title: "A: \\"b\\""
plain: it's plain # not this
single: 'it''s'
n: 12
x: -1.5
yes: true
none:
tilde: ~
date: 2024-05-01
tags: [a, "b, c", 'd''e', 3]
list:
- one
- "two: 2"
map:
  inner: 1
  deep:
    - x
text: |
  first
    more

  last
folded: >-
  a
  b
---
body
---
"""
    front, body = files.front_matter(text)
    assert body == "body\n---\n"
    assert front == {
        "title": 'A: "b"', "plain": "it's plain", "single": "it's", "n": 12, "x": -1.5, "yes": True, "none": None, "tilde": None, "date": "2024-05-01",
        "tags": ["a", "b, c", "d'e", 3], "list": ["one", "two: 2"], "map": {"inner": 1, "deep": ["x"]}, "text": "first\n  more\n\nlast\n", "folded": "a b",
    }
    assert files.front_matter("no front") == ({}, "no front") and files.front_matter("---\n---\nx") == ({}, "x")
    for bad in ("---\n- a\n---\n", "---\na: &x 1\n---\n", "---\na: 1\n   b: 2\n---\n", "---\nwords only\n---\n"):
        with pytest.raises(ValueError):
            files.front_matter(bad)
    held = {"a b": "x: \"y\"\n'z'", "n": [1, None, True, "é, [f]"], "e": ""}
    assert files.front_matter(files.with_front(held, "---\nbody")) == (held, "---\nbody")


def test_trees_are_written_kept_and_cleared(spark, tmp_path):
    root = f"file://{tmp_path}/tree"
    make = lambda rows: spark.createDataFrame(rows, "p string, t string")
    first = files.export_tree(make([("a/1.md", "one"), ("a/2.md", "two"), ("b.md", "é")]), root, "p", "t")
    assert first.count() == 3 and (tmp_path / "tree/b.md").read_text() == "é"
    stamp = (tmp_path / "tree/a/1.md").stat().st_mtime_ns
    second = files.export_tree(make([("a/1.md", "one"), ("a/2.md", "2"), ("c.md", "")]), root, "p", "t", first)
    assert sorted(str(p.relative_to(tmp_path / "tree")) for p in (tmp_path / "tree").rglob("*") if p.is_file() and not p.name.endswith(".crc")) == ["a/1.md", "a/2.md", "c.md"]
    assert (tmp_path / "tree/a/1.md").stat().st_mtime_ns == stamp and (tmp_path / "tree/a/2.md").read_text() == "2"
    assert second.count() == 3
    for bad in ([("../x", "t")], [("/x", "t")], [("a/./x", "t")], [("", "t")], [("x", None)], [("x", "1"), ("x", "2")], [(None, "t")]):
        with pytest.raises(ValueError, match="refused"):
            files.export_tree(make(bad), root, "p", "t", second)


def test_markdown_trees_name_the_files_they_cannot_read(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/ok.md").write_text("---\nn: 1\n---\nbody")
    (tmp_path / "bad.md").write_text("---\n- a\n---\n")
    (tmp_path / "other.txt").write_text("x")
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.markdown_tree(spark, str(tmp_path)).collect()}
    assert set(rows) == {"ok.md", "bad.md"} and rows["bad.md"].fault and rows["bad.md"].body is None
    assert (json.loads(rows["ok.md"].front), rows["ok.md"].body) == ({"n": 1}, "body")
    assert files.markdown_tree(spark, str(tmp_path)).select(F.count_if(F.col("fault").isNull())).first()[0] == 1
