"""What belongs together by its words: related sources by rare terms, and the window of a text that shows most of a query."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions import text as T
from folioscope.operators import arrow, index, stems
from folioscope.sources.tables import kept

#: Rows that a group has at most, about, and as few as let a table be dealt over GROUPS.
GROUP, SMALL_GROUP, GROUPS = 32768, 4096, 48

#: Letters without a decomposition that are folded all the same. Fixed values.
_FOLDS = {"ø": "o", "đ": "d", "ł": "l", "ħ": "h", "’": "'", "‘": "'", "–": "-", "—": "-", " ": " "}


def _distinctive(term: Column) -> Column:
    return (F.length(term) > 4) & ~term.rlike("^[0-9]+$") & ~term.isin(sorted(stems.STOP_WORDS))


def related_sources(df: DataFrame, key: str, text: str, kind: str, base: Column, k: int = 5, least: int = 3, share: float = 0.02, floor: int = 20, domains: str | None = None, path: str | None = None) -> DataFrame:
    """(base, place, related, score, shared): for each base row the k rows that share most of its distinctive terms: words of
    five signs or more of the whole text, without stop words and numbers, and domains (an array column), that fewer than
    ``share`` of all rows hold, or fewer than ``floor``. ``least`` shared terms are needed; a domain counts four times, a
    row of another kind has two more; ties to the smaller key.

    path: a keyword index of df by T.tokens with its kinds; without one, it is built once for a state of df's files. Rows are
    dealt over groups of a bounded size. The rows that hold an asked word move once, packed, to their groups, and the base
    rows' words pass by each group, where what they share is counted: the pairs themselves, which grow with the square of
    the table, don't move. Only the base rows' texts are read besides. Null texts share nothing; keys are distinct and not
    null."""
    spark = df.sparkSession
    path = path or index.served(df.select(key, text, kind), "related", key=key, text=text, tokens=T.tokens, kind=F.col(kind), norms=False, places=False)
    stats = spark.read.parquet(f"{path}/stats").first()
    most = max(stats.n * share, float(floor))
    groups = max(1, -(-stats.n // GROUP), min(GROUPS, -(-stats.n // SMALL_GROUP)))
    rows = arrow.small_batches(df).select(F.col(key).alias("id"), F.coalesce(F.col(kind).cast("string"), F.lit("")).alias("kind"), F.coalesce(base, F.lit(False)).alias("base"), F.col(text).alias("said"), *([F.col(domains).alias("hosts")] if domains else []))
    rare = index.terms(spark, path).filter((F.col("df") < most) & _distinctive(F.col("term"))).select("term")
    words = rows.filter("base").select(F.col("id").alias("asker"), F.col("kind").alias("own"), F.explode_outer(F.array_distinct(T.tokens(F.col("said")))).alias("term"))
    asking = kept(words.filter("term is not null").join(rare, "term"), "related-words")
    number = F.monotonically_increasing_id()  # written, so that it stays
    codes = kept(asking.select("term").distinct().select("term", number.alias("code")), "related-terms")
    met = index.holders_of(spark, path, codes.withColumn("bucket", index._bucket(F.col("term"), stats.folders)), _distinctive(F.col("term"))).select("code", "keys")
    asking = asking.join(codes, "term").select("asker", "own", "code")
    if domains:  # their codes are below 0
        hosts = rows.select("id", "kind", "base", F.explode_outer(F.array_distinct("hosts")).alias("host")).filter("host is not null")
        few = hosts.groupBy("host").agg(F.count(F.lit(1)).alias("df"), F.bool_or("base").alias("asked")).filter(F.col("asked") & (F.col("df") < most))
        hosts = hosts.join(kept(few.select("host", (-1 - number).alias("code")), "related-hosts"), "host")
        met = met.unionByName(hosts.select("code", F.array("id").alias("keys")))
        asking = asking.unionByName(hosts.filter("base").select(F.col("id").alias("asker"), F.col("kind").alias("own"), "code"))
    kind_of = rows.schema["id"].dataType.simpleString()
    group_of = lambda c: F.pmod(F.xxhash64(c), F.lit(groups)).cast("int")
    dealt = f"group int, role int, ids array<{kind_of}>, kinds array<string>, codes array<long>"
    members = rows.select(group_of(F.col("id")).alias("group"), F.lit(0).alias("role"), F.array("id").alias("ids"), F.array("kind").alias("kinds"), F.lit(None).cast("array<long>").alias("codes"))
    holding = met.select("code", "keys", F.transform("keys", group_of).alias("groups")).mapInArrow(_dealt, dealt)
    each = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    askers = asking.groupBy("asker", "own").agg(F.collect_list("code").alias("codes"))
    askers = askers.select(each.alias("group"), F.lit(2).alias("role"), F.array("asker").alias("ids"), F.array("own").alias("kinds"), "codes")
    together = members.unionByName(holding).unionByName(askers).repartition(groups, "group").sortWithinPartitions("group", "role")
    scores = together.mapInArrow(lambda it: _shared(it, k, least), f"asker {kind_of}, id {kind_of}, score long, shared long")
    place = F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score"), "id"))
    return scores.withColumn("place", place).filter(F.col("place") <= k).select(F.col("asker").alias("base"), "place", F.col("id").alias("related"), "score", "shared")


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (code, keys, groups of the keys) to a row for each group of a batch: its keys and the code of each."""
    for batch in batches:
        keys, groups = batch["keys"].flatten(), batch["groups"].flatten().to_numpy()
        codes = np.repeat(batch["code"].to_numpy(), np.diff(batch["keys"].offsets.to_numpy()))
        order = np.argsort(groups, kind="stable")
        cuts = np.flatnonzero(np.diff(groups[order], prepend=-1))
        ends = pa.array(np.append(cuts, len(order)), pa.int32())
        n = len(cuts)
        yield pa.RecordBatch.from_arrays(
            [
                *(pa.array(groups[order][cuts], pa.int32()), pa.array(np.ones(n), pa.int32())),
                *(pa.ListArray.from_arrays(ends, keys.take(pa.array(order))), pa.nulls(n, pa.list_(pa.string()))),
                pa.ListArray.from_arrays(ends, pa.array(codes[order], pa.int64())),
            ],
            ["group", "role", "ids", "kinds", "codes"],
        )


class _Group:
    """The rows of a group: their kinds, and which of them hold a code."""

    def __init__(self, ids: list[pa.Array], kinds: list[pa.Array], keys: list[pa.Array], codes: list[np.ndarray]):
        self.ids = pa.concat_arrays(ids) if ids else pa.array([], pa.int64())
        self.kinds = np.array(pa.concat_arrays(kinds).to_pylist() if kinds else [], object)
        self.rank = np.empty(len(self.ids), np.int64)
        self.rank[pc.sort_indices(self.ids).to_numpy()] = np.arange(len(self.ids))
        row = np.concatenate([pc.index_in(k, value_set=self.ids).to_numpy(zero_copy_only=False) for k in keys] or [np.zeros(0)]).astype(np.int32)
        code = np.concatenate(codes or [np.zeros(0, np.int64)])
        order = np.argsort(code, kind="stable")
        self.row, code = row[order], code[order]
        self.first = np.flatnonzero(np.diff(code, prepend=code[0] - 1)) if len(code) else np.zeros(0, np.int64)
        self.code, self.held = code[self.first], np.diff(np.append(self.first, len(code)))

    def best(self, asker: pa.Scalar, own: str, codes: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, score, shared) of the k rows that share most."""
        at = np.searchsorted(self.code, codes)
        inside = at < len(self.code)
        inside[inside] = self.code[at[inside]] == codes[inside]
        at = at[inside]
        hits = self.row[index._expand(self.first[at], self.held[at])]
        shared = np.bincount(hits, minlength=len(self.ids))
        row = np.flatnonzero(shared >= least)
        score = shared[row] + 2 * (self.kinds[row] != own)
        if len(at := at[self.code[at] < 0]):
            score += 3 * np.bincount(self.row[index._expand(self.first[at], self.held[at])], minlength=len(self.ids))[row]
        if len(row) > k + 1:  # one of them may be the asker
            some = score >= np.partition(score, len(row) - k - 1)[len(row) - k - 1]
            row, score = row[some], score[some]
        order = np.lexsort((self.rank[row], -score))[: k + 1]
        row, score = row[order], score[order]
        other = ~pc.equal(self.ids.take(pa.array(row)), asker).to_numpy(zero_copy_only=False)
        return row[other][:k], score[other][:k], shared[row[other][:k]]


def _shared(batches: Iterator[pa.RecordBatch], k: int, least: int) -> Iterator[pa.RecordBatch]:
    """Rows by group: its members (role 0), those that hold codes (1), then all that ask."""
    current, group, parts = None, None, None
    for batch in batches:
        out: list[tuple] = []
        for j, (at, role) in enumerate(zip(batch["group"].to_pylist(), batch["role"].to_pylist(), strict=True)):
            if at != current:
                current, group, parts = at, None, ([], [], [], [])
            ids, kinds, codes = (batch[c][j].values for c in ("ids", "kinds", "codes"))
            if role < 2:
                for part, values in zip(parts[2 * role :], (ids, kinds if role == 0 else codes.to_numpy()), strict=False):
                    part.append(values)
                continue
            if group is None:
                group, parts = _Group(*parts), None
            row, score, shared = group.best(ids[0], kinds[0].as_py(), codes.to_numpy(), k, least)
            if len(row):
                found = group.ids.take(pa.array(row))
                out.append((pa.array([ids[0].as_py()] * len(row), ids.type), found, score, shared))
        if out:
            columns = [pa.concat_arrays([o[c] for o in out]) for c in (0, 1)] + [pa.array(np.concatenate([o[c] for o in out]), pa.int64()) for c in (2, 3)]
            yield pa.RecordBatch.from_arrays(columns, ["asker", "id", "score", "shared"])


def folded_in_place(text: str) -> str:
    """The text in lower case without accents, sign by sign, so that places stay the same."""

    def plain(sign: str) -> str:
        low = sign.lower()
        base = _FOLDS.get(low) or "".join(c for c in unicodedata.normalize("NFD", low) if unicodedata.category(c) != "Mn")
        return base if len(base) == 1 else low if len(low) == 1 else sign

    return text.lower() if text.isascii() else text.translate({ord(c): plain(c) for c in set(text)})


def window(text: str, terms: list[str], room: int) -> tuple[int, int, float]:
    """(start, stop, score) of the stretch of ``room`` signs with the best score: of each term in it, one through the times
    that it stands in the text. A stretch begins a little (15 %) before a hit, at most so late that it is full, and then at
    the next word, if one begins within 40 signs. Of equal scores the first stretch is taken; a text that has room whole
    is its own, with no score."""
    if len(text) <= room:
        return 0, len(text), 0.0
    low, lead = folded_in_place(text), round(room * 0.15)
    hits = sorted((m.start(), k) for k, t in enumerate(dict.fromkeys(terms)) if t for m in re.finditer(re.escape(t), low))
    counts: dict[int, int] = {}
    for _, k in hits:
        counts[k] = counts.get(k, 0) + 1
    places = [at for at, _ in hits]
    inside, begin, end = dict.fromkeys(counts, 0), 0, 0
    start, best = 0, 0.0
    for at in places:
        first = max(0, min(at - lead, len(text) - room))
        while end < len(hits) and places[end] < first + room:
            inside[hits[end][1]] += 1
            end += 1
        while begin < len(hits) and places[begin] < first:
            inside[hits[begin][1]] -= 1
            begin += 1
        score = sum(1 / counts[k] for k in sorted(counts) if inside[k])
        if score > best + 1e-9:
            start, best = first, score
    if start:
        space = text.find(" ", start, start + 40)
        start = space + 1 if space >= 0 else start
    return start, min(len(text), start + room), best


def query_terms(query: str) -> list[str]:
    """The words of a query that a window is chosen by: three signs or more, no stop words."""
    found = re.findall(r"[a-z0-9][a-z0-9'-]+", folded_in_place(query))
    return [t for t in dict.fromkeys(found) if len(t) > 2 and t not in stems.STOP_WORDS]


def windows(df: DataFrame, key: str, query: str, room: int, text: str = "text") -> DataFrame:
    """(key, start, stop, score, passage): the best window of each text; null texts are left out. score to nine digits."""
    terms = query_terms(query)

    def rows_of(t: str) -> list[tuple]:
        start, stop, score = window(t, terms, room)
        return [(start, stop, round(score, 9), t[start:stop])]

    return arrow.exploded(df, key, text, "start int, stop int, score double, passage string", rows_of)

