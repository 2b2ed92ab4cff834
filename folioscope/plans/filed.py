"""Registered queries that write tables as files and read them back: what comes back is the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.plans.catalogue import ORACLE_SQL, QUERIES, query
from folioscope.sources import files
from folioscope.sources.tables import load, scratch

__all__ = ["ORACLE_SQL", "QUERIES"]


@query("SELECT conv_id, turn, role, md5(coalesce(text, '')) AS body, text IS NULL AS without FROM conversations")
def corpus_roundtrip(spark, d):
    """Conversations written as compressed JSON under names that don't tell it, and read by their first bytes."""
    path = scratch(spark, "corpus")
    load(spark, d, "conversations").write.option("compression", "gzip").option("ignoreNullFields", "false").json(path)
    rows = files.typed(files.corpus_records(spark, path, "part-*"), "", "conv_id bigint, turn int, role string, text string")
    turn = dict(load(spark, d, "conversations").dtypes)["turn"]
    return rows.select("conv_id", F.col("turn").cast(turn).alias("turn"), "role", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("body"), F.col("text").isNull().alias("without"))


@query("SELECT page_id, url, 'pages/' || CAST(page_id % 16 AS VARCHAR) || '/' || CAST(page_id AS VARCHAR) || '.md' AS file, md5(html) AS body FROM pages")
def tree_roundtrip(spark, d):
    """Pages written as a tree of Markdown files with front matter, and read back."""
    file = F.concat(F.lit("pages/"), F.pmod("page_id", F.lit(16)).cast("string"), F.lit("/"), F.col("page_id").cast("string"), F.lit(".md"))
    front = F.concat(F.lit("---\npage_id: "), F.col("page_id").cast("string"), F.lit("\nurl: "), F.concat(F.lit("'"), F.replace("url", F.lit("'"), F.lit("''")), F.lit("'")), F.lit("\ntags: [page, 'of a: tree']\n---\n"))
    root = scratch(spark, "tree")
    files.export_tree(load(spark, d, "pages").select(file.alias("file"), F.concat(front, "html").alias("content")), root, "file", "content")
    read = files.markdown_tree(spark, root)
    front = F.from_json("front", "page_id bigint, url string, tags array<string>")
    rows = read.filter("fault is null").select(front.alias("f"), F.regexp_extract("path", r"(pages/[0-9]+/[0-9]+\.md)$", 1).alias("file"), "body")
    return rows.filter(F.col("f.tags")[1] == "of a: tree").select("f.page_id", "f.url", "file", F.md5(F.col("body").cast("binary")).alias("body"))


@query("""
WITH e AS (SELECT event_id, ts, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago' AS local FROM events)
SELECT event_id, CAST(local AS DATE) AS local_day, CAST(hour(local) AS INTEGER) AS local_hour FROM e WHERE CAST(local AS DATE) <> CAST(ts AS DATE)""")
def local_day_mismatch(spark, d):
    """Events whose day where they are filed (UTC) isn't their day in a time zone with summer time."""
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/Chicago")
    rows = load(spark, d, "events").select("event_id", local.alias("local"), F.to_date(F.col("ts").cast("timestamp")).alias("filed"))
    return rows.filter(F.to_date("local") != F.col("filed")).select("event_id", F.to_date("local").alias("local_day"), F.hour("local").alias("local_hour"))
