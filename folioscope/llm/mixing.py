"""Operator 9: mixing sources to target weights by Pfair scheduling.

Each source's documents are put in a hashed order and cut into blocks. With the share w of its target weight, block j of
a source is released at slot floor(j / w) and due by slot ceil((j + 1) / w); in each slot the released block of the
earliest deadline is taken. At every prefix of the order a source then has less than one block more or less than its
weight asks for. When a source has no blocks left, the weights of the others are scaled up and the windows start anew
from that slot: every document is placed exactly once, none is dropped or repeated.

The schedule is made on the driver from one number per source and has at most ``MAX_BLOCKS`` blocks plus one per source:
the block size grows with the table. Documents are dealt into hashed cells of about ``CELL`` rows of a source at most;
counts of cells, added up in two levels, give each cell its first rank, and the cell learns the slots of the few blocks
that it reaches into. Documents meet their cell under the key by which they were ranked, so that a text moves once; no
task sorts a whole source, and nothing is broadcast by this module.

Defined results: a null source is a source of its own; a source without a weight gets the mean of the given weights, a
weight that is not positive counts as the smallest positive one; null texts and doc_ids are placed like others; repeated
rows are each placed (they are interchangeable); an empty table gives an empty result; all columns are kept, the added
ones are named by parameter, and an input column of such a name comes back as <name>_input.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.llm.common import col, free_names, stable

MAX_BLOCKS = 100_000
LEAST_BLOCK, CELL, CELLS = 16, 512, 4096
TEMPERATURE = 0.5


def schedule(blocks: Mapping[str | None, int], weights: Mapping[str | None, float]) -> list[tuple[str | None, int]]:
    """The (source, block) of each slot, for so many blocks of each source."""
    names = sorted((s for s in blocks if blocks[s] > 0), key=lambda s: (s is None, s or ""))
    share = {s: Fraction(weights[s]).limit_denominator(10**6) for s in names}
    least = min((w for w in share.values() if w > 0), default=Fraction(1))
    share = {s: w if w > 0 else least for s, w in share.items()}
    done, out = dict.fromkeys(names, 0), []
    while names:
        total = sum(share[s] for s in names)
        period = {s: total / share[s] for s in names}  # slots between two blocks of s
        # a source's next block: (release, source, block of this phase); released ones by deadline
        waiting = [(0, k, 0) for k in range(len(names))]
        ready: list[tuple[int, int, int]] = []
        slot, ended = 0, False
        while not ended:
            while waiting and waiting[0][0] <= slot:
                _, k, j = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-(j + 1) * period[names[k]] // 1), k, j))
            if not ready:
                slot = waiting[0][0]
                continue
            _, k, j = heapq.heappop(ready)
            source = names[k]
            out.append((source, done[source]))
            done[source] += 1
            slot += 1
            if done[source] == blocks[source]:
                ended = True
            else:
                heapq.heappush(waiting, (int((j + 1) * period[source]), k, j + 1))
        names = [s for s in names if done[s] < blocks[s]]
    return out


def default_weights(counts: Mapping[str | None, int], temperature: float = TEMPERATURE) -> dict[str | None, float]:
    """Weights that damp large sources: the share of documents to a power below one."""
    total = sum(counts.values()) or 1
    return {s: (n / total) ** temperature for s, n in counts.items()}


def _first_ranks(held: DataFrame, key: str, cell: str, n: str, rank: str, free) -> DataFrame:
    """held (key, cell, n) with the rank of each cell's first row in its source: sums within stretches of cells, then
    over the stretches, so that the largest window is one of a source's stretches."""
    stretch, total = free("stretch"), free("total")
    held = held.withColumn(stretch, F.expr(f"{cell} div {CELLS}"))
    inner = Window.partitionBy(key, stretch).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(key).orderBy(stretch).rowsBetween(Window.unboundedPreceding, -1)
    sums = held.groupBy(key, stretch).agg(F.sum(n).alias(total))
    sums = sums.withColumn(total, F.coalesce(F.sum(total).over(outer), F.lit(0)))
    ranked = held.withColumn(rank, F.coalesce(F.sum(n).over(inner), F.lit(0)))
    return ranked.join(sums, [key, stretch]).withColumn(rank, F.col(rank) + F.col(total)).select(key, cell, n, rank)


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, block: int | None = None, source: str = "source", slot: str = "mix_slot", place: str = "mix_place") -> DataFrame:
    """docs with two more columns: the slot of the row's block, and the row's place in the whole order (from 0)."""
    docs = stable(docs, "mixing-input")
    spark = docs.sparkSession
    kinds = {c: col(c) for c in docs.columns}
    text = kinds[source].cast("string")
    per_source = {r[0]: r[1] for r in docs.groupBy(text.alias("s")).count().collect()}  # a row for each source
    total = sum(per_source.values())
    size = block or max(LEAST_BLOCK, -(-total // MAX_BLOCKS))
    given = dict(weights) if weights is not None else default_weights(per_source)
    mean = sum(given.values()) / len(given) if given else 1.0
    order = schedule({s: -(-n // size) for s, n in per_source.items()}, {s: given.get(s, mean) for s in per_source})
    starts, at = [], 0
    for k, (s, b) in enumerate(order):
        starts.append(("n" if s is None else f"s{s}", b, k, at))
        at += min(size, per_source[s] - b * size)

    free = free_names([*docs.columns, slot, place])
    key, cell, hashed, tie, n, rank, blocks = map(free, ("key", "cell", "hash", "tie", "n", "rank", "blocks"))
    plan = spark.createDataFrame(starts, f"{key} string, block long, slot long, start long")
    cells = max(1, -(-total // CELL))
    known = [kinds[c] for c in ("doc_id", source, "text") if c in kinds]
    digest = F.unhex(F.md5(kinds["text"].cast("string").cast("binary"))) if "text" in kinds else F.lit(None).cast("binary")
    rows = docs.withColumns({key: F.coalesce(F.concat(F.lit("s"), text), F.lit("n")), hashed: F.xxhash64(*known), tie: digest})
    rows = rows.withColumn(cell, F.pmod(F.shiftright(hashed, 8), F.lit(cells)))
    held = rows.groupBy(key, cell).agg(F.count(F.lit(1)).alias(n))
    ranked = _first_ranks(held, key, cell, n, rank, free)
    # each cell with the slots of the blocks that its rows belong to
    reached = ranked.withColumn("block", F.explode(F.sequence(F.expr(f"{rank} div {size}"), F.expr(f"({rank} + {n} - 1) div {size}"))))
    known_slots = reached.join(plan, [key, "block"]).groupBy(key, cell).agg(F.first(rank).alias(rank), F.sort_array(F.collect_list(F.struct("block", "slot", "start"))).alias(blocks))
    ties = [hashed, *(["doc_id"] if "doc_id" in kinds else []), tie]
    numbered = rows.withColumn(n, F.row_number().over(Window.partitionBy(key, cell).orderBy(*ties)) - 1)
    placed = numbered.join(known_slots, [key, cell]).withColumn(rank, F.col(rank) + F.col(n))
    mine = F.element_at(blocks, (F.expr(f"{rank} div {size}") - F.element_at(blocks, 1)["block"] + 1).cast("int"))
    named = [kinds[c].alias(free(f"{c}_input", "") if c.lower() in (slot.lower(), place.lower()) else c) for c in docs.columns]
    return placed.select(*named, mine["slot"].alias(slot), (mine["start"] + F.col(rank) % size).alias(place))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, in the order of the mix and with the columns they had."""
    free = free_names(docs.columns)
    slot, place = free("slot"), free("place")
    placed = mix(docs, slot=slot, place=place, **options)
    return placed.repartitionByRange(place).sortWithinPartitions(place).drop(slot, place)
