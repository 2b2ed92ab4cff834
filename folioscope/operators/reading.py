"""Operators of reading lists: places within a day, chains of parents, paths through a source, chunks without what the
one before has said, repeated runs of words."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions.names import free_names
from folioscope.sources.tables import kept


def held_of(words: Column, wanted: Iterable[str]) -> Column:
    """Those of the wanted words that a text's words hold, sorted."""
    return F.array_sort(F.array_intersect(words, F.array(*map(F.lit, wanted))))


def placed(df: DataFrame, within: Sequence[Column], order: Sequence[Column], name: str = "place") -> DataFrame:
    """df with each row's place (from 1) within its group; the order must be total. Groups are days or users, not sources:
    a group is sorted by one task."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*order)))


def chain_roots(df: DataFrame, row: str, parent: str) -> DataFrame:
    """(row, root, depth): the end of each row's chain of parents, and how many steps away it is.

    Each round doubles the steps (a row takes over what the ancestor it has reached knows) and is written, so that plans
    don't double. A chain without a cycle has no more steps than there are rows, so that after as many rounds as double one
    step beyond their number every chain has ended that ever does: the rounds follow from the table, and stop early when no
    chain is open or a round ends none. A parent that is no row ends a chain. Rows whose chain
    runs into a cycle have no root and no depth; so have rows with a null id. Ids are distinct."""
    start = df.select(F.col(row).alias("row"), F.coalesce(parent, row).alias("top"), F.col(parent).isNotNull().cast("long").alias("depth"), F.col(parent).isNull().alias("ended"))
    state = kept(start, "chain-0")
    rows, open_ = state.agg(F.count(F.lit(1)), F.count_if(~F.col("ended"))).first()
    for k in range(rows.bit_length() + 1):
        if not open_:
            break
        known = state.select(F.col("row").alias("above"), F.col("top").alias("next"), F.col("depth").alias("more"), F.col("ended").alias("done"))
        joined = state.join(known, (F.col("top") == F.col("above")) & ~F.col("ended"), "left")
        ended = F.col("ended") | F.col("above").isNull() | F.col("done")
        depth = F.col("depth") + F.coalesce("more", F.lit(0))
        state = kept(joined.select("row", F.coalesce("next", "top").alias("top"), depth.alias("depth"), ended.alias("ended")), f"chain-{k + 1}")
        before, open_ = open_, state.agg(F.count_if(~F.col("ended"))).first()[0]
        if open_ == before:  # of the chains that end, the shortest open one ends in each round
            break
    sure = F.col("ended") & F.col("row").isNotNull()
    return state.select(F.col("row").alias(row), F.when(sure, F.col("top")).alias("root"), F.when(sure, F.col("depth")).alias("depth"))


def reading_path(df: DataFrame, source: str, at: str, row: str) -> DataFrame:
    """(source, row, reasons) of each source's anchors: its earliest, middle and latest row; a row that is several of
    them has its reasons merged. One sort for each source."""
    free = free_names([source, at, row])
    place, held = free("place"), free("held")
    order = Window.partitionBy(source).orderBy(at, row)
    ranked = df.select(source, at, row, F.row_number().over(order).alias(place), F.count(F.lit(1)).over(Window.partitionBy(source)).alias(held))
    middle = F.floor((F.col(held) + 1) / 2)
    why = F.concat_ws("+", F.when(F.col(place) == 1, "earliest"), F.when(F.col(place) == middle, "middle"), F.when(F.col(place) == F.col(held), "latest"))
    return ranked.select(source, row, why.alias("reasons")).filter("reasons <> ''")


def without_lead_in(df: DataFrame, source: str, order: str, words: str, most: int) -> DataFrame:
    """df whose word arrays no longer begin with the words that end the row before of the same source: the longest such
    run of at most ``most`` words goes."""
    free = free_names(df.columns)
    ahead, said_by = free("before"), free("said")
    before = F.lag(words).over(Window.partitionBy(source).orderBy(order))
    now, last = F.col(words), F.col(ahead)
    same = lambda k: F.slice(now, F.lit(1), k) == F.slice(last, F.size(last) - k + 1, k)
    run = F.array_max(F.filter(F.sequence(F.lit(1), F.least(F.lit(most), F.size(now), F.size(last))), same))
    said = F.when(last.isNull() | (F.size(last) == 0) | (F.size(now) == 0), F.lit(0)).otherwise(F.coalesce(run, F.lit(0)))
    rows = df.withColumn(ahead, before).withColumn(said_by, said)
    return rows.withColumn(words, F.slice(now, F.col(said_by) + 1, F.greatest(F.size(now), F.lit(1)))).drop(ahead, said_by)


def _spans(said: Column, n: int) -> Column:
    """(gram, at) of each run of n words, by a hash of it, sorted."""
    starts = F.when(F.size(said) >= n, F.sequence(F.lit(1), F.size(said) - n + 1))  # also where a filter is moved
    return F.array_sort(F.transform(starts, lambda k: F.struct(F.xxhash64(F.array_join(F.slice(said, k, F.lit(n)), " ")).alias("gram"), k.alias("at"))))


def repeated_runs(df: DataFrame, row: str, words: Column, n: int = 5, apart: int = 5) -> DataFrame:
    """(row, runs): how many runs of n words stand in a text at two places at least ``apart`` words from each other. A row's
    runs are sorted by a hash where the row is read, and counted there; only of ids that several rows have (or none) do they
    move, and those rows are read again."""
    free = free_names([row, "runs"])
    said, spans, gram, first, last, held, by = (free(c) for c in ("said", "spans", "gram", "first", "last", "held", "by"))

    def step(state: Column, span: Column) -> Column:
        again = state["gram"].eqNullSafe(span["gram"])
        far = again & (span["at"] - state["first"] >= apart)
        runs = state["runs"] + F.when(far & ~state["done"], 1).otherwise(0)
        return F.struct(span["gram"].alias("gram"), F.when(again, state["first"]).otherwise(span["at"]).alias("first"), F.when(again, state["done"] | far).otherwise(False).alias("done"), runs.cast("long").alias("runs"))

    start = F.struct(F.lit(None).cast("long").alias("gram"), F.lit(0).alias("first"), F.lit(False).alias("done"), F.lit(0).cast("long").alias("runs"))
    toks = df.select(row, words.alias(said))
    local = toks.select(row, F.coalesce(F.aggregate(_spans(F.col(said), n), start, step, lambda s: s["runs"]), F.lit(0)).alias("runs"))
    counted = kept(local.groupBy(row).agg(F.count(F.lit(1)).alias(held), F.sum("runs").alias("runs")), "repeated-runs")
    several = (F.col(held) > 1) | F.col(row).isNull()
    once = counted.filter(~several & (F.col("runs") > 0)).select(row, "runs")
    shared = counted.filter(several).select(F.col(row).alias(by))
    if shared.isEmpty():
        return once
    # explode would put a filter on the runs below the split into words, where each of them splits its text again
    again = df.join(shared, F.col(row).eqNullSafe(F.col(by)), "left_semi").select(row, words.alias(said))
    each = again.select(row, F.explode_outer(_spans(F.col(said), n)).alias(spans)).filter(F.col(spans).isNotNull())
    each = each.select(row, F.col(spans)["gram"].alias(gram), F.col(spans)["at"].alias(spans))
    ends = each.groupBy(row, gram).agg(F.min(spans).alias(first), F.max(spans).alias(last)).filter(F.col(last) - F.col(first) >= apart)
    return once.unionByName(ends.groupBy(row).agg(F.count(F.lit(1)).alias("runs")))
