"""Matching rows that no equality key ties together: spans of a line, lines of two texts, copies found in passes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from folioscope.functions.names import free_names
from folioscope.operators import arrow
from folioscope.sources.tables import kept

_WORD = regex.compile(r"[\p{L}\p{N}'-]+")

# --------------------------------------------------------------------------- spans


def range_join(points: DataFrame, spans: DataFrame, at: Column, start: Column, stop: Column) -> DataFrame:
    """Each point beside each span that holds it (start <= at <= stop, whole numbers): all columns of both, which must have
    different names.

    A span of length up to 2^l lies in one or two bins of 2^l; a point has one bin for each such l that occurs, of which
    there are 63 at most. So a pair meets once, by an equality key, and no long span is repeated often. Nulls meet nothing,
    nor does a span that stops before it starts."""
    free = free_names([*points.columns, *spans.columns])
    level, bin_, place, low, high = (free(c) for c in ("level", "bin", "place", "low", "high"))
    width = F.greatest(F.col(high) - F.col(low), F.lit(1)).cast("double")
    sized = spans.withColumns({low: start.cast("long"), high: stop.cast("long")}).filter(F.col(low) <= F.col(high))
    sized = sized.withColumn(level, F.ceil(F.log2(width)).cast("int"))
    bins = F.sequence(_shifted(low, level), _shifted(high, level))
    levels = [r[0] for r in sized.select(level).distinct().collect()]  # 63 at most
    sized = sized.withColumn(bin_, F.explode(bins))
    placed = points.withColumn(place, at.cast("long")).filter(F.col(place).isNotNull())
    placed = placed.withColumn(level, F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    placed = placed.withColumn(bin_, _shifted(place, level))
    met = placed.join(sized, [level, bin_]).filter(F.col(place).between(F.col(low), F.col(high)))
    return met.drop(level, bin_, place, low, high)


def _shifted(number: str, by: str) -> Column:
    return F.call_function("shiftright", F.col(number), F.col(by))


# --------------------------------------------------------------------------- lines


def distinct_lines(text: str, least: int = 3) -> dict[tuple[str, ...], int]:
    """The distinct lines of ``least`` words or more, as words in lower case, each with its first number, from 0."""
    found: dict[tuple[str, ...], int] = {}
    for k, line in enumerate(text.split("\n")):
        words = tuple(_WORD.findall(line.lower()))
        if len(words) >= least:
            found.setdefault(words, k)
    return found


def _grams(words: Sequence[str]) -> set[tuple[str, ...]]:
    return set(zip(words, words[1:], words[2:], strict=False))


def aligned(left: str, right: str, least: float) -> list[tuple[int, int, int, int, Sequence[str], Sequence[str]]]:
    """(line, best, shared, grams, words of the line, words of the best) by an inverted index of the right text's trigrams: a
    line meets only the lines that share some with it."""
    rights = distinct_lines(right)
    index: dict[tuple[str, ...], list[tuple[str, ...]]] = {}
    for words in rights:
        for gram in _grams(words):
            index.setdefault(gram, []).append(words)
    found = []
    for words, line in distinct_lines(left).items():
        grams = _grams(words)
        shared = Counter(other for gram in grams for other in index.get(gram, ()))
        if shared:
            best = min(shared, key=lambda other: (-shared[other], rights[other]))
            if shared[best] >= least * len(grams):
                found.append((line, rights[best], shared[best], len(grams), words, best))
    return found


def best_lines(left: DataFrame, right: DataFrame, key: str, text: str = "text", least: float = 0.5) -> DataFrame:
    """(key, line, best, shared, grams): for each distinct line of three words or more of a left text, the line of the right
    text of the same key with most of its word trigrams, ties to the first; only where at least the share ``least`` of
    them is there. Keys are distinct on each side. Texts meet by their key, one row each; trigrams don't move."""
    return _pairs(left, right, key, text, "line int, best int, shared long, grams int", lambda a, b: [x[:4] for x in aligned(a, b, least)])


def _pairs(left: DataFrame, right: DataFrame, key: str, text: str, columns: str, rows_of: Callable[[str, str], list[tuple]]) -> DataFrame:
    """(key, columns): a row for each tuple that rows_of gives for the two texts of a key."""
    a = left.select(F.col(key).alias("key"), F.col(text).cast("string").alias("a"))
    both = arrow.small_batches(a.join(right.select(F.col(key).alias("key"), F.col(text).cast("string").alias("b")), "key"))
    both = both.filter("a is not null and b is not null")
    made = StructType.fromDDL(columns)
    kinds, names = [f.dataType for f in made.fields], made.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [to_arrow_type(k) for k in kinds]
        for batch in batches:
            for piece in arrow.pieces(iter([batch]), "a"):
                found = [rows_of(x, y) for x, y in zip(piece["a"].to_pylist(), piece["b"].to_pylist(), strict=True)]
                at = pa.array([k for k, x in enumerate(found) for _ in x], pa.int64())
                flat = [r for x in found for r in x]
                yield pa.RecordBatch.from_arrays([piece["key"].take(at), *(pa.array([r[j] for r in flat], kind) for j, kind in enumerate(types))], ["key", *names])

    kind = both.schema["key"].dataType.simpleString()
    return both.mapInArrow(run, f"key {kind}, {columns}").withColumnRenamed("key", key)


def word_runs(a: Sequence[str], b: Sequence[str]) -> list[tuple[str, int, int, int, int]]:
    """How b came from a, by a longest common subsequence: runs (=, - or +, from and to in a, from and to in b), deletions
    before insertions. Rows of the usual table are whole numbers, one bit for each word of b, so that a row costs a few
    operations on numbers."""
    masks: dict[str, int] = {}
    for j, word in enumerate(b):
        masks[word] = masks.get(word, 0) | 1 << j
    every = (1 << len(b)) - 1
    row, rows = every, [every]
    for word in a:
        hit = row & masks.get(word, 0)
        row = ((row + hit) | (row - hit)) & every
        rows.append(row)  # a bit that is not set: one more word in common than without this word of b
    i, j, steps = len(a), len(b), []
    while i or j:
        if j and (not i or rows[i] >> (j - 1) & 1):
            j -= 1
            steps.append("+")
        elif not j or not rows[i - 1] >> (j - 1) & 1:
            i -= 1
            steps.append("-")
        else:
            i, j = i - 1, j - 1
            steps.append("=")
    runs: list[tuple[str, int, int, int, int]] = []
    steps.reverse()
    at = 0
    while at < len(steps):
        stop = at
        while stop < len(steps) and (steps[stop] == "=") == (steps[at] == "="):
            stop += 1
        stretch = steps[at:stop]
        for sign in ("=", "-", "+"):
            if size := stretch.count(sign):
                di, dj = size * (sign != "+"), size * (sign != "-")
                runs.append((sign, i, i + di, j, j + dj))
                i, j = i + di, j + dj
        at = stop
    return runs


def line_diffs(left: DataFrame, right: DataFrame, key: str, text: str = "text", least: float = 0.5) -> DataFrame:
    """best_lines with ``diff``: the runs of words kept, gone and new from the left line to the right one, as "=3 -1 =2 +4"; and
    the words ``gone`` and ``new``."""

    def rows_of(a: str, b: str) -> list[tuple]:
        out = []
        for line, best, shared, grams, old, new in aligned(a, b, least):
            runs = word_runs(old, new)
            diff = " ".join(f"{s}{max(i2 - i1, j2 - j1)}" for s, i1, i2, j1, j2 in runs)
            gone, come = [w for s, i, j, _, _ in runs if s == "-" for w in old[i:j]], [w for s, _, _, i, j in runs if s == "+" for w in new[i:j]]
            out.append((line, best, shared, grams, diff, gone, come))
        return out

    return _pairs(left, right, key, text, "line int, best int, shared long, grams int, diff string, gone array<string>, new array<string>", rows_of)


# --------------------------------------------------------------------------- coverage


def covered_runs(df: DataFrame, key: str, words: Column, known: DataFrame, known_words: Column, size: int = 8) -> DataFrame:
    """(key, words, covered, runs, longest, uncovered): of each row, how many words it has, how many of them stand in a run of
    ``size`` words that any known row has as well, the number of such stretches and the longest of them, and the longest
    stretch of words without. Rows with fewer words than ``size`` are covered nowhere; keys are distinct.

    Runs meet by their 128-bit digests: the known ones once each, those of df by their place. What stays is one row for
    each place that is covered, however many known rows cover it."""

    def runs(rows: DataFrame, column: str, names: list[str]) -> DataFrame:
        starts = F.when(F.size(column) >= size, F.sequence(F.lit(0), F.size(column) - size))
        grams = F.transform(starts, lambda k: F.unhex(F.md5(F.array_join(F.slice(column, k + 1, F.lit(size)), " ").cast("binary"))))
        # explode would put a filter on the runs below the split into words
        return rows.select(*names, F.posexplode_outer(grams).alias("at", "gram")).filter("gram is not null")

    texts = df.select(F.col(key).alias("key"), words.alias("said"))
    # written, so that their size is known: few are broadcast, many are met by a shuffle
    held = kept(runs(known.select(known_words.alias("said")), "said", []).select("gram").distinct(), "known-runs")
    places = runs(texts, "said", ["key"]).join(held, "gram", "left_semi").select("key", "at")
    order = Window.partitionBy("key").orderBy("at")
    begins = places.withColumn("new", (F.col("at") - F.lag("at").over(order) > size) | F.lag("at").over(order).isNull())
    islands = begins.withColumn("island", F.sum(F.col("new").cast("int")).over(order)).groupBy("key", "island").agg(F.min("at").alias("first"), (F.max("at") + size).alias("stop"))
    after = Window.partitionBy("key").orderBy("first")
    gaps = islands.select("key", "first", "stop", (F.col("stop") - F.col("first")).alias("length"), (F.col("first") - F.coalesce(F.lag("stop").over(after), F.lit(0))).alias("gap"))
    found = gaps.groupBy("key").agg(F.sum("length").alias("covered"), F.count(F.lit(1)).alias("runs"), F.max("length").alias("longest"), F.max("gap").alias("gap"), F.max("stop").alias("last"))
    all_ = texts.select("key", F.coalesce(F.size("said"), F.lit(0)).cast("long").alias("words")).join(found, "key", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return all_.select(F.col("key").alias(key), "words", zero("covered").alias("covered"), zero("runs").alias("runs"), zero("longest").alias("longest"), F.greatest(zero("gap"), F.col("words") - zero("last")).alias("uncovered"))


# --------------------------------------------------------------------------- copies


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """df with each row's place (from 1) among the rows of its keys. Rows are cut into ranges of keys and order and written;
    a row's place is its number in its file, corrected by where its keys begin there and by how many rows of them stand
    in the files before. So a key of any number of rows is spread over tasks. The order must be total."""
    free = free_names([*df.columns, name])
    file, index, first, held = (free(c) for c in ("file", "index", "first", "held"))
    rows = kept(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order), "ranked")
    rows = rows.select("*", F.col("_metadata")["file_path"].alias(file), F.col("_metadata")["row_index"].alias(index))
    parts = rows.groupBy(file, *keys).agg(F.min(index).alias(first), F.count(F.lit(1)).alias(held))
    before = F.coalesce(F.sum(held).over(Window.partitionBy(*keys).orderBy(file).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(file, *keys, (F.col(first) - before).alias(first))  # a row for each key and file that holds it
    met = rows.join(parts, [file, *keys])
    return met.select(*df.columns, (F.col(index) - F.col(first) + 1).alias(name))


def staged_matches(left: DataFrame, right: DataFrame, passes: Sequence[tuple[str, Column, Column]], left_id: str = "id", right_id: str = "id") -> DataFrame:
    """(left_id, right_id, pass) of rows matched one to one, as columns ``left``, ``right`` and ``pass``. Each pass has a name and
    a key of either side; it takes only rows that earlier passes left, and matches the first of a key with the first of
    the same key, the second with the second, by their ids. A null key matches nothing; ids are distinct and not null."""
    found = None
    for name, of_left, of_right in passes:
        a = left.select(F.col(left_id).alias("left"), of_left.cast("string").alias("key"))
        b = right.select(F.col(right_id).alias("right"), of_right.cast("string").alias("key"))
        if found is not None:
            a, b = a.join(found, "left", "left_anti"), b.join(found, "right", "left_anti")
        # only keys of both sides are ranked
        both = a.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(b.groupBy("key").agg(F.count(F.lit(1)).alias("m")), "key").select("key")
        a = ranked(a.join(both, "key", "left_semi"), ["key"], ["left"], "place")
        b = ranked(b.join(both, "key", "left_semi"), ["key"], ["right"], "place")
        met = a.join(b, ["key", "place"]).select("left", "right", F.lit(name).alias("pass"))
        found = kept(met if found is None else found.unionByName(met), f"matched-{name}")
    return found
