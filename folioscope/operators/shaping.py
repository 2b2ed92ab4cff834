"""Operators that narrow, join and shape results; each takes DataFrames and column names and is used by plans.shaped."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions.names import free_names

# --------------------------------------------------------------------------- scope


def scope(df: DataFrame, kinds: dict[str, Iterable] | None = None, without: dict[str, Iterable] | None = None, date: str | None = None, before: str | None = None, years: tuple[int, int] | None = None) -> DataFrame:
    """Rows whose columns are among the values of ``kinds`` and not among those of ``without`` (null is not among them),
    dated before a day and in a range of years. All of it before any ranking, so that it reaches the scan."""
    keep = F.lit(True)
    for c, values in (kinds or {}).items():
        keep = keep & F.col(c).isin(*values)
    for c, values in (without or {}).items():
        keep = keep & F.coalesce(~F.col(c).isin(*values), F.lit(True))
    if before:
        keep = keep & (F.col(date) < F.lit(before).cast("timestamp"))
    if years:
        keep = keep & F.year(date).between(*years)
    return df.filter(keep)


def tri_state(flag: Column, wanted: bool | None) -> Column:
    """A filter with three settings: yes, no (null counts as no), or not asked."""
    if wanted is None:
        return F.lit(True)
    return F.coalesce(flag, F.lit(False)) == F.lit(wanted)


# --------------------------------------------------------------------------- joins


def interval_join(points: DataFrame, spans: DataFrame, key: str, at: str, begin: str, end: str) -> DataFrame:
    """Points with the spans of the same key that hold them (begin <= at <= end)."""
    own = free_names([*points.columns, *spans.columns])("span_key")
    spans = spans.withColumnRenamed(key, own)
    return points.join(spans, (F.col(key) == F.col(own)) & (F.col(at) >= F.col(begin)) & (F.col(at) <= F.col(end))).drop(own)


def band_join(left: DataFrame, right: DataFrame, keys: Sequence[str], day: str, days: int = 1) -> DataFrame:
    """Pairs of rows of equal keys at most so many days apart: right rows are repeated for each day of the band, so that
    an equi-join finds them. Columns of the right side are prefixed with ``other_``."""
    other = right.select(*[F.col(c).alias(f"other_{c}") for c in right.columns])
    around = F.explode(F.transform(F.sequence(F.lit(-days), F.lit(days)), lambda k: F.date_add(f"other_{day}", k)))
    band = free_names([*left.columns, *other.columns])("band")
    other = other.withColumn(band, around)
    on = [F.col(k) == F.col(f"other_{k}") for k in keys] + [F.col(day) == F.col(band)]
    return left.join(other, on).drop(band)


def attributed(rows: DataFrame, row: str, rules: Sequence[DataFrame]) -> DataFrame:
    """rows with the target that the first rule gives which has a candidate; a rule with several candidates gives none.

    rules: (row, target) candidates, in order of priority."""
    every = None
    for k, rule in enumerate(rules):
        one = rule.select(row, "target").groupBy(row).agg(F.min("target").alias("target"), F.count_distinct("target").alias("candidates")).withColumn("rule", F.lit(k))
        every = one if every is None else every.unionByName(one)
    best = every.groupBy(row).agg(F.min(F.struct("rule", "target", "candidates")).alias("best"))
    out = rows.join(best, row, "left")
    sure = F.col("best.candidates") == 1
    return out.withColumn("target", F.when(sure, F.col("best.target"))).withColumn("rule", F.when(sure, F.col("best.rule"))).drop("best")


def field_changes(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, before, after) of every field whose value differs between two snapshots of the same keys."""
    text = lambda c: F.col(c).cast("string")
    a = old.select(key, *[text(c).alias(f"a_{c}") for c in fields])
    b = new.select(key, *[text(c).alias(f"b_{c}") for c in fields])
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"a_{c}").alias("before"), F.col(f"b_{c}").alias("after")) for c in fields])
    changed = a.join(b, key).select(key, F.explode(F.filter(pairs, lambda p: ~p["before"].eqNullSafe(p["after"]))).alias("change"))
    return changed.select(key, "change.*")


def mutual_edges(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b) with a < b where both directions are among the edges."""
    directions = edges.filter(F.col(a) != F.col(b)).groupBy(F.least(a, b).alias(a), F.greatest(a, b).alias(b))
    return directions.agg(F.max((F.col(a) < F.col(b)).cast("int")).alias("forth"), F.max((F.col(a) > F.col(b)).cast("int")).alias("back")).filter("forth = 1 and back = 1").select(a, b)


def lookup(names: DataFrame, rows: DataFrame, name: str, row: str) -> DataFrame:
    """Each asked name with the row it names, or why there is none: missing or ambiguous."""
    found = rows.join(names, name, "left_semi").groupBy(name).agg(F.count(F.lit(1)).alias("held"), F.min(row).alias(row))
    state = F.when(F.col("held").isNull(), "missing").when(F.col("held") > 1, "ambiguous").otherwise("found")
    return names.join(found, name, "left").select(name, state.alias("state"), F.when(F.col("held") == 1, F.col(row)).alias(row))


# --------------------------------------------------------------------------- pages of results


def without_twins(df: DataFrame, twin: Column, order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows in order, of rows with equal twin keys only the first. Each key keeps its best row by an
    aggregate with map-side combination, not by a window over the key."""
    free = free_names(df.columns)
    of, best, held = free("twin"), free("best"), {c: free(f"kept_{c}") for c in df.columns}
    first = df.withColumn(of, twin).groupBy(of).agg(F.min(F.struct(*order, *[F.col(c).alias(held[c]) for c in df.columns])).alias(best))
    return first.select(*[F.col(best)[held[c]].alias(c) for c in df.columns]).orderBy(*order).limit(k)


def grouped_by_source(hits: DataFrame, source: str, item: str, score: str) -> DataFrame:
    """Ranked hits (few: a top-k) by source, in order of each source's best hit."""
    rank = free_names(hits.columns)("rank")
    ranked = hits.withColumn(rank, F.row_number().over(Window.orderBy(F.desc(score), item)))
    items = F.transform(F.sort_array(F.collect_list(F.struct(F.col(rank).alias("rank"), F.col(item).alias("item")))), lambda x: x["item"])
    groups = ranked.groupBy(source).agg(F.min(rank).alias("best_rank"), F.count(F.lit(1)).alias("hits"), items.alias("items"))
    return groups.withColumn("place", F.row_number().over(Window.orderBy("best_rank"))).drop("best_rank")


def fit_to_cap(df: DataFrame, group: str, order: Sequence[Column], text: str, cap: int, least: int = 40) -> DataFrame:
    """df's rows that fit a cap of signs for each group, in order, with ``shown`` (the text, or its beginning up to a space),
    ``clipped``, and the group's ``omitted`` rows and ``next_offset`` (null if none is). The first row that is too long is
    clipped if at least ``least`` signs of it fit; later rows are omitted. A null text is empty."""
    free = free_names([*df.columns, "shown", "clipped", "omitted", "next_offset"])
    size, used, total, place, nth, salt, of = (free(c) for c in ("size", "used", "total", "place", "nth", "salt", "of"))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.withColumn(size, F.length(body)).withColumn(salt, F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(64)))
    # a row that is too late among those of its salt is too late in its group, and so are all that follow: whole groups
    # need not meet in one task
    part = Window.partitionBy(group, salt).orderBy(*order)
    rows = rows.withColumn(used, F.sum(size).over(part) - F.col(size)).filter(F.col(used) <= cap)
    within = Window.partitionBy(group).orderBy(*order)
    rows = rows.withColumn(used, F.sum(size).over(within) - F.col(size)).withColumn(place, F.row_number().over(within))
    room = F.greatest(F.lit(cap) - F.col(used), F.lit(0))
    clipped = (F.col(size) > room) & (room >= least)
    rows = rows.filter((F.col(size) <= room) | clipped)
    cut = F.regexp_replace(F.left(body, room), r"\s+\S*$", "")
    rows = rows.withColumn("shown", F.when(clipped, cut).otherwise(body)).withColumn("clipped", clipped)
    # an empty text would fit after the first one that doesn't: what is shown is the beginning of the group
    rows = rows.withColumn(nth, F.row_number().over(within)).filter(F.col(nth) == F.col(place))
    rows = rows.withColumn(nth, F.count(F.lit(1)).over(Window.partitionBy(group)))
    totals = df.groupBy(F.col(group).alias(of)).agg(F.count(F.lit(1)).alias(total))
    found = rows.join(totals, F.col(group).eqNullSafe(F.col(of)))
    omitted = F.col(total) - F.col(nth)
    return found.withColumn("omitted", omitted).withColumn("next_offset", F.when(omitted > 0, F.col(nth))).drop(size, used, total, place, nth, salt, of)


def inverted_index(df: DataFrame, row: str, terms: Column, least: int, most: int) -> DataFrame:
    """(term, df, first, last) of the terms that stand in ``least`` to ``most`` rows."""
    t = df.select(row, F.explode(F.array_distinct(terms)).alias("term"))
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.min(row).alias("first"), F.max(row).alias("last")).filter(F.col("df").between(least, most))


# --------------------------------------------------------------------------- passages


def sections(df: DataFrame, text: str, mark: str = r"\n+") -> DataFrame:
    """A row for each non-empty part of a text between marks: section (from 0) and body."""
    parts = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), mark), lambda p: F.trim(p) != "")
    return df.select("*", F.posexplode(parts).alias("section", "body"))


def chunks(words: Column, size: int, overlap: int) -> Column:
    """A text's words in runs of ``size`` that share ``overlap`` words with the next; the last run may be shorter."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - overlap - 1, F.lit(0)), F.lit(step))
    return F.transform(starts, lambda s: F.array_join(F.slice(words, s + 1, F.lit(size)), " "))


def markdown_links(text: Column) -> Column:
    """array<struct<label, target, image>> of the inline links and images of a markdown text; code spans hold none."""
    plain = F.regexp_replace(text, r"(?s)```.*?```|`[^`\n]*`", " ")
    found = F.regexp_extract_all(plain, F.lit(r"(!?\[[^\]\[]*\]\(<?[^)\s>]+>?(?:\s+\"[^\"]*\")?\))"), F.lit(1))
    label = lambda m: F.regexp_extract(m, r"^!?\[([^\]\[]*)\]", 1)
    target = lambda m: F.regexp_extract(m, r"\]\(<?([^)\s>]+)", 1)
    return F.transform(found, lambda m: F.struct(label(m).alias("label"), target(m).alias("target"), m.startswith("!").alias("image")))


def age_label(days: Column) -> Column:
    return F.when(days < 1, "today").when(days < 7, "this week").when(days < 31, "this month").when(days < 365, "this year").otherwise("older")
