"""Operator 2: exact top-k by inner product through a pivot-distance index.

Integer vectors are lifted by one coordinate to a common norm M, so that the largest inner product is the smallest
distance: score = (|q|^2 + M^2 - d^2) / 2. A query's own last coordinate is 0, as the formula needs.

1. ``PIVOTS`` pivots and ``SEEDS`` seeds are a bounded sample (the smallest by a hash of vec_id, of which only those under a
   bound on the hash leave the executors). Every vector is keyed by its nearest pivot and its distance to it; sorted by
   that key, runs of ``RUN`` vectors of one pivot are rows of the index (a range partitioning with vec_id as last key
   splits any cell, however many vectors it has).
2. Runs are dealt over groups of about ``GROUP_BYTES``, which a task holds while all blocks of ``QUERIES`` queries pass by
   it: a run is shuffled once, a block once for each group. The number of groups follows from the number of vectors.
3. A query's threshold starts as its k-th score among the seeds. In a run, whose vectors are sorted by distance to the
   pivot, annuli of ``ANNULUS`` vectors are expanded in order of the triangle-inequality bound | d(q, p) - d(x, p) |,
   ``SLAB`` of them at a time, until no annulus left can hold a score at the threshold, which rises from run to run.
4. The k best of each query over all groups.

The sample only sets the order of work; every vector is indexed and no candidate at or above a threshold is left out, so
that the result is exact.

Defined results: vectors that are null, hold null or non-finite components or have no vec_id take no part; a shorter
vector counts as padded with zeros; ties go to the smaller vec_id; repeated rows are candidates of their own, and
repeated queries of one vec_id are asked once (the smallest vector); with fewer candidates than k, all are returned; an
empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.llm.common import bounded, pack, partitions, stored, unpack

PIVOTS, SEEDS, RUN, ANNULUS, QUERIES = 64, 1024, 2048, 64, 1024
#: Annuli that are expanded at a time; bytes of single-precision vectors of a group; groups that a large enough table has at least.
SLAB, GROUP_BYTES, GROUPS = 8, 32 << 20, 64


def integer_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v array<double> of whole numbers): floor(scale * x) of each component."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(sound)
    return rows.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double")).alias("v"))


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    lens = np.diff(batch["v"].offsets.to_numpy())
    out = np.zeros((batch.num_rows, dim))
    out[np.arange(dim) < lens[:, None]] = batch["v"].flatten().to_numpy(zero_copy_only=False)
    return out


def _narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in two bytes each, where they fit."""
    return x.astype(np.int16) if np.abs(x).max(initial=0) < 1 << 15 else x


class Index:
    """What every task knows: pivots (lifted), seeds, the common norm."""

    def __init__(self, seed_ids: np.ndarray, seeds: np.ndarray, norm2: float):
        self.seed_ids, self.seeds, self.norm2 = seed_ids, seeds, norm2
        self.dim = seeds.shape[1]
        self.pivots = self.lift(seeds[:PIVOTS])

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(self.norm2 - (x * x).sum(1), 0))[:, None]], 1)

    def distances(self, lifted: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        d2 = (lifted * lifted).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * lifted @ pivots.T
        return np.sqrt(np.maximum(d2, 0))


def _keyed(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            d = index.distances(index.lift(_matrix(batch, index.dim)), index.pivots)
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["v"], pa.array(near, pa.int32()), pa.array(d[np.arange(len(d)), near])], ["vec_id", "v", "pivot", "dist"])


def _runs(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    """Sorted rows to runs of one pivot."""
    held: list[pa.RecordBatch] = []

    def pieces(batch: pa.RecordBatch):
        pivots = batch["pivot"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(pivots)) + 1).tolist(), len(pivots)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            for k in range(a, b, RUN):
                yield batch.slice(k, min(RUN, b - k))

    def flush():
        x = np.concatenate([_matrix(b, index.dim) for b in held])
        ids = np.concatenate([b["vec_id"].to_numpy() for b in held])
        dist = np.concatenate([b["dist"].to_numpy() for b in held])
        yield pa.RecordBatch.from_arrays([pa.array([held[0]["pivot"][0].as_py()], pa.int32()), pa.array([pack(ids, dist, _narrow(x))], pa.binary())], ["pivot", "run"])

    for batch in batches:
        for piece in pieces(batch) if batch.num_rows else ():
            if held and (held[0]["pivot"][0].as_py() != piece["pivot"][0].as_py() or sum(b.num_rows for b in held) + piece.num_rows > RUN):
                yield from flush()
                held = []
            held.append(piece)
    if held:
        yield from flush()


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exactly."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < 1 << 24:
        return (q.astype(np.float32, copy=False) @ x.astype(np.float32, copy=False).T).astype(np.int64)
    q, x = q.astype(float, copy=False), x.astype(float, copy=False)
    if most < 1 << 52:
        return (q @ x.T).astype(np.int64)
    big = q.astype(object) @ x.astype(object).T
    return np.clip(big, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _kth(scores: np.ndarray, k: int) -> float:
    return float(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else -np.inf


class _Top:
    """The k best so far of a block's queries, and their thresholds."""

    def __init__(self, q_ids: np.ndarray, floor: np.ndarray, k: int):
        self.q_ids, self.floor, self.k = q_ids, np.array(floor, float), k
        self.row, self.score, self.match = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, row: np.ndarray, score: np.ndarray, match: np.ndarray) -> None:
        if not len(row):
            return
        row, score, match = (np.concatenate(both) for both in ((self.row, row), (self.score, score), (self.match, match)))
        order = np.lexsort((match, ~score, row))  # ~score falls as score rises, also at the ends of the range
        row, score, match = row[order], score[order], match[order]
        begins = np.flatnonzero(np.diff(row, prepend=-1))
        place = np.arange(len(row)) - np.repeat(begins, np.diff(np.append(begins, len(row))))
        last, stay = place == self.k - 1, place < self.k
        self.floor[row[last]] = np.maximum(self.floor[row[last]], score[last])
        self.row, self.score, self.match = row[stay], score[stay], match[stay]


def _best_of_annuli(index: Index, pivot: int, dist: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each query and annulus, a score that none of its vectors is above."""
    dq = index.distances(np.pad(q, ((0, 0), (0, 1))), index.pivots[pivot : pivot + 1])[:, 0]
    starts = np.arange(0, len(dist), ANNULUS)
    inner, outer = dist[starts], dist[np.minimum(starts + ANNULUS, len(dist)) - 1]
    gap = np.maximum(np.maximum(inner[None] - dq[:, None], dq[:, None] - outer[None]), 0)
    # rounding: that of a small squared distance grows to 1e-7 M in its root, so the bound is a little wider than its formula
    slack = 1e-6 * (index.norm2 + (q * q).sum(1)) + 1e-6
    return ((q * q).sum(1)[:, None] + index.norm2 - gap**2) / 2 + slack[:, None]


def _expand(best: np.ndarray, ids: np.ndarray, x: np.ndarray, q: np.ndarray, top: _Top) -> int:
    """Bring a run's vectors to the block's best; the number of scores computed."""
    work = 0
    # annuli in order of their bound; a query leaves those that can't reach its threshold any more
    order = np.argsort(-best.max(0), kind="stable")
    for a in range(0, len(order), SLAB):
        slab = order[a : a + SLAB]
        reach = best[:, slab] >= top.floor[:, None]
        ask, slab = np.flatnonzero(reach.any(1)), slab[reach.any(0)]
        if not len(ask):
            continue
        part = (slab[:, None] * ANNULUS + np.arange(ANNULUS)).ravel()
        part = part[part < len(ids)]
        scores = _exact(q[ask], x[part])
        work += scores.size
        row, col = np.nonzero(scores >= top.floor[ask, None])
        other = ids[part][col] != top.q_ids[ask[row]]
        row, col = row[other], col[other]
        top.add(ask[row], scores[row, col], ids[part][col])
    return work


def search_run(index: Index, pivot: int, ids: np.ndarray, dist: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[list[tuple[int, int, int]], int]:
    """(query, vector, score) that may be among the k best, and the number of scores computed."""
    top = _Top(q_ids, floor, k)
    work = _expand(_best_of_annuli(index, pivot, dist, q), ids, x, q, top)
    return list(zip(q_ids[top.row].tolist(), top.match.tolist(), top.score.tolist(), strict=True)), work


def _search(batches: Iterator[pa.RecordBatch], index: Index, k: int) -> Iterator[pa.RecordBatch]:
    """A group's runs (role 0), which are held, then all blocks of queries."""
    group, held = None, []
    for batch in batches:
        for at, role, pivot, data in zip(*(batch[c].to_pylist() for c in ("group", "role", "pivot", "data")), strict=True):
            if at != group:
                group, held = at, []
            if role == 0:
                ids, dist, x = unpack(data)
                x = x.reshape(len(ids), -1)
                held.append((pivot, ids, dist, x.astype(np.float32) if x.dtype == np.int16 else x))
                continue
            q_ids, floor, q = unpack(data)
            top, q = _Top(q_ids, floor, k), q.reshape(len(q_ids), -1).astype(float)
            bounds = [_best_of_annuli(index, run[0], run[2], q) for run in held]
            for j in sorted(range(len(held)), key=lambda j: -bounds[j].max(initial=-np.inf)):
                _expand(bounds[j], held[j][1], held[j][3], q, top)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (q_ids[top.row], top.match, top.score)], ["query_id", "vec_id", "score"])


def _query_blocks(batches: Iterator[pa.RecordBatch], index: Index, k: int) -> Iterator[pa.RecordBatch]:
    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        q, ids = np.concatenate([_matrix(p, index.dim) for p in parts]), np.concatenate([p["vec_id"].to_numpy() for p in parts])
        scores = _exact(q, index.seeds)
        floor = np.array([_kth(scores[j][index.seed_ids != ids[j]].astype(float), k) for j in range(len(ids))])
        return pa.RecordBatch.from_arrays([pa.array([pack(ids, floor, _narrow(q))], pa.binary())], ["data"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            held.append(batch.slice(at, QUERIES - sum(p.num_rows for p in held)))
            at += held[-1].num_rows
            if sum(p.num_rows for p in held) == QUERIES:
                yield block(held)
                held = []
    if held:
        yield block(held)


def _seeds(rows: DataFrame, total: int) -> list:
    """The SEEDS first rows by a hash of vec_id. Each task would send so many of its own to the driver; but only hashes below a
    bound can be among them, which is raised until enough rows are below it."""
    keyed = rows.withColumn("__at", F.xxhash64("vec_id"))
    room, below = 1 << 64, min(1.0, 4 * SEEDS / max(1, total))
    while True:
        few = keyed if below >= 1 else keyed.filter(F.col("__at") < F.lit(int(room * below) - (1 << 63)))
        found = few.orderBy("__at", "vec_id", "v").limit(SEEDS).collect()
        if below >= 1 or len(found) == SEEDS:
            return found
        below *= 16


def top_k(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) for every row of vectors (vec_id, embedding) with is_query, against all others."""
    spark = vectors.sparkSession
    rows = stored(integer_vectors(bounded(vectors)), "vectors")
    facts = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("norm2"), F.max(F.size("v")).alias("dim"), F.count(F.lit(1)).alias("n")).first()
    seeds = _seeds(rows, facts.n)
    if not seeds:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    matrix = np.zeros((len(seeds), max(1, facts.dim)))
    for j, r in enumerate(seeds):
        matrix[j, : len(r.v)] = r.v
    shared = spark.sparkContext.broadcast(Index(np.array([r.vec_id for r in seeds]), matrix, facts.norm2))
    keyed = rows.mapInArrow(lambda it: _keyed(it, shared.value), "vec_id long, v array<double>, pivot int, dist double")
    n = partitions(spark)
    runs = keyed.repartitionByRange(n, "pivot", "dist", "vec_id").sortWithinPartitions("pivot", "dist", "vec_id").mapInArrow(lambda it: _runs(it, shared.value), "pivot int, data binary")
    once = Window.partitionBy("vec_id").orderBy("v")
    asked = rows.filter(is_query).withColumn("__row", F.row_number().over(once)).filter("__row = 1").select("vec_id", "v")
    # few full blocks, each once for each group
    asked = asked.repartition(max(1, -(-rows.filter(is_query).count() // (4 * QUERIES))), "vec_id")
    blocks = asked.mapInArrow(lambda it: _query_blocks(it, shared.value, k), "data binary")
    groups = max(1, -(-facts.n * max(1, facts.dim) * 4 // GROUP_BYTES), min(GROUPS, facts.n // (2 * RUN)))
    runs = runs.select(F.pmod(F.xxhash64("data"), F.lit(groups)).cast("int").alias("group"), F.lit(0).alias("role"), "pivot", "data")
    blocks = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(1).alias("role"), F.lit(0).alias("pivot"), "data")
    met = runs.unionByName(blocks).repartition(groups, "group").sortWithinPartitions("group", "role")
    found = met.mapInArrow(lambda it: _search(it, shared.value, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
