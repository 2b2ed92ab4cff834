"""Operator 7: near-duplicates by one-permutation MinHash with optimal densification.

1. Features (one scan): each document's distinct 5-word shingles as 64-bit hashes; their number, a 128-bit digest of the
   set, and a sketch: ``bins`` 16-bit minima of one permutation, empty bins filled from a random non-empty one (the same
   probe order for all documents). Documents of equal sets form a class, the smallest doc_id its representative.
2. ``rows`` bins make a band. Representatives that agree on a band share a bucket. Pairs at similarity 0.75 share a
   bucket with probability 1 - (1 - 0.75^4)^44 = 0.99999995.
3. Star round: in each bucket, edges lead only from one centre to the others, so that their number is below that of the
   bucket's rows. Sketches discard pairs that are six standard deviations below the threshold; the rest are confirmed
   on full sets. Confirmed links are contracted to components.
4. Rest rounds: a bucket whose members now are of one component is done. The others are gathered, so that sketches of
   members which share many buckets move once: a bucket goes to the largest home of its members, a member's home being
   the largest of its buckets. In such a family, members outside its largest component meet those of other components
   that share a band with them, block by block on packed sketches; a pair that passes must also pass on the least
   ``LEAST`` hashes of both sets (smaller sets are compared whole). A first round takes each member's best partner of a block, so that most components meet; a second one all
   pairs that still are of different components. They are confirmed like the others. So the stars lose no link.
5. Components of all confirmed links by alternating large and small stars.

No step gathers a bucket, a class or a component in one task: classes and centres are aggregates with map-side
combination, rows of heavy buckets are dealt over salted groups, blocks hold about ``BLOCK`` members, and joins on centres
and families read stored tables on both sides, so that AQE can split them. A job that would find nothing new (a round
without pairs, components without new links) isn't run: with many partitions and few rows, its empty tasks are its cost.

Defined results: null or wordless text has an empty set and is linked with nothing; fewer than 5 words are one shingle;
repeated rows all stay in the result; rows that share a doc_id share a component; a null doc_id is linked with nothing
and kept, its component null; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import blocks, col, free_names, mix, partitions, release, span_hashes, stable, stored, texts_of

U64 = np.uint64
WORDS = 5
ROWS, BANDS = 4, 44
BINS = ROWS * BANDS
THRESHOLD = (75, 100)
#: Below this share of equal bins a pair at the threshold lies with probability under 1e-9 (six standard deviations).
PASS = 0.75 - 6 * (0.75 * 0.25 / BINS) ** 0.5
BLOCK = 256
LEAST = 256
#: A bitmap of hashed keys has 2^27 bits in pages of 32,768 bits: 4,096 rows of 4 KB, at most 16 MB whatever the input.
PAGES, PAGE = 4096, 32768
#: From so many rows on, the rows of one key are dealt over many tasks.
HEAVY = 1024
_CODES = mix(np.arange(1, 257, dtype=U64) * U64(0x8EBC6AF09C88C6E3))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


# --------------------------------------------------------------------------- features


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Each text's distinct shingles: sorted 64-bit hashes."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw = _LOWER[np.frombuffer(b" ".join(data) + b" ", np.uint8)]
    sizes = np.fromiter(map(len, data), np.int64, len(data)) + 1
    edge = np.diff(_SPACE[raw].view(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    hashes = span_hashes(raw, _CODES, starts, ends)
    at = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    n = np.diff(at)
    runs = max(0, len(hashes) - words + 1)
    out = np.zeros(runs, U64)
    for k in range(words):
        out = mix(out * U64(0x9E3779B97F4A7C15) + hashes[k : k + runs])
    sets = []
    for a, m in zip(at.tolist(), n.tolist(), strict=False):
        if m >= words:
            s = np.sort(out[a : a + m - words + 1])
            keep = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            sets.append(s[keep])
        elif m:
            x = np.full(1, m, U64)
            for k in range(m):
                x = mix(x * U64(0xD1342543DE82EF95) + hashes[a + k])
            sets.append(x)
        else:
            sets.append(np.zeros(0, U64))
    return sets


def _probes(bins: int, tries: int = 64) -> np.ndarray:
    """The bins that each bin copies from while it is empty, in order: the same for all sets."""
    b, t = np.arange(bins, dtype=U64)[None, :], np.arange(1, tries + 1, dtype=U64)[:, None]
    return (mix(b * U64(0x9E3779B97F4A7C15) + t * U64(0xC2B2AE3D27D4EB4F)) % U64(bins)).astype(np.int64)


_PROBES = _probes(BINS)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BINS 16-bit values for each non-empty set; zeros for an empty one."""
    out = np.zeros((len(sets), BINS), np.uint16)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    if not sizes.sum():
        return out
    every = mix(np.concatenate(sets) + U64(0x2545F4914F6CDD1D))
    # the top half chooses the bin, the rest is the rank in it: the least rank of each bin, over all sets at once
    place = np.repeat(np.arange(len(sets)), sizes) * BINS + ((every >> U64(32)) * U64(BINS) >> U64(32)).astype(np.int64)
    ranks = mix(every)
    order = np.lexsort((ranks, place))
    sorted_places = place[order]
    first = np.flatnonzero(np.diff(sorted_places, prepend=-1))
    values, filled = np.zeros(len(sets) * BINS, np.uint16), np.zeros(len(sets) * BINS, bool)
    values[sorted_places[first]] = (ranks[order[first]] & U64(0xFFFF)).astype(np.uint16)
    filled[sorted_places[first]] = True
    values, filled = values.reshape(-1, BINS), filled.reshape(-1, BINS)
    row, col = np.nonzero(~filled & (sizes > 0)[:, None])
    for probe in _PROBES:
        if not len(row):
            break
        source = probe[col]
        hit = filled[row, source]
        values[row[hit], col[hit]] = values[row[hit], source[hit]]
        row, col = row[~hit], col[~hit]
    for r in np.unique(row):  # a set with very few filled bins: the next one around
        full = np.flatnonzero(filled[r])
        empty = col[row == r]
        values[r, empty] = values[r, full[mix(empty.astype(U64) + U64(77)).astype(np.uint64) % U64(len(full))]]
    return values


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        sets = shingle_sets(texts_of(batch))
        rows = [x.tobytes() for x in sketches(sets)]
        least = [(x[:LEAST] >> U64(32)).astype(np.uint32).tobytes() for x in sets]
        digest = [blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(list(map(len, sets)), pa.int64()), pa.array(digest, pa.binary()), pa.array(rows, pa.binary()), pa.array(least, pa.binary())], ["doc_id", "n_shingles", "digest", "sketch", "least"])


# --------------------------------------------------------------------------- confirming pairs


def _with_sketches(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """pairs of similar sizes with both sketches. A centre may have most of the pairs: it is joined last, when its rows
    are as long as what they are compared with, and both sides are plain, so that Spark cuts its rows by their bytes."""
    known = _likely(reps.select("id", "n_shingles", "sketch"), pairs.select(F.explode(F.array("a", "b")).alias("id")), "id")
    a = known.select(F.col("id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sketch").alias("sketch_a"))
    b = known.select(F.col("id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sketch").alias("sketch_b"))
    return pairs.join(b, "b").join(a, "a").filter(_similar_sizes("n_a", "n_b")).select("a", "b", "sketch_a", "sketch_b")


def _promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch[k].to_pylist()), np.uint16).reshape(-1, BINS) for k in ("sketch_a", "sketch_b"))
        keep = pa.array((x == y).mean(1) >= PASS) if len(x) else pa.array([], pa.bool_())
        yield batch.select(["a", "b"]).filter(keep)


def _member_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([s.tobytes() for s in shingle_sets(texts_of(batch))], pa.binary())], ["id", "shingles"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch["set_a"].to_pylist(), batch["set_b"].to_pylist(), strict=True):
            x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
            common = np.intersect1d(x, y, assume_unique=True).size
            keep.append(THRESHOLD[1] * common >= THRESHOLD[0] * (len(x) + len(y) - common))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    release()


def _place(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PAGES * PAGE))


def _bitmap(keys: DataFrame, key: str) -> DataFrame:
    """(page, bits) of the hashed keys: a table of bounded size, at all sizes of the input."""
    places = keys.select(_place(key).alias("place"))
    return places.groupBy(F.expr(f"place div {PAGE}").alias("page")).agg(F.bitmap_construct_agg(F.col("place") % PAGE).alias("bits"))


def _marked(df: DataFrame, bitmap: DataFrame, key: str, mark: str) -> DataFrame:
    """df with a boolean column: false only if the row's key is not among the bitmap's keys."""
    free = free_names([*df.columns, mark])
    place, page, bits = free("place"), free("page"), free("bits")
    bitmap = bitmap.select(F.col("page").alias(page), F.col("bits").alias(bits))
    byte = F.conv(F.hex(F.substring(bits, F.expr(f"int({place} % {PAGE} div 8) + 1"), F.lit(1))), 16, 10).cast("int")
    bit = F.getbit(byte, (F.col(place) % 8).cast("int")) == 1
    placed = df.withColumn(place, _place(key)).withColumn(page, F.expr(f"{place} div {PAGE}"))
    return placed.join(F.broadcast(bitmap), page, "left").withColumn(mark, F.coalesce(bit, F.lit(False))).drop(place, page, bits)


def _likely(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key is among ids, and a few others, dropped where they are read. Callers join exactly."""
    mark = free_names(df.columns)("likely")
    return _marked(df, _bitmap(ids, key), key, mark).filter(mark).drop(mark)


def _keyed_join(rows: DataFrame, facts: DataFrame, key: str, by: str, counts: DataFrame | None = None) -> DataFrame:
    """rows with the facts (one row for each key, with held, the number of rows) of their key. Rows of a key that holds
    more than HEAVY are dealt by the column ``by`` over as many groups as there are partitions, and the key's facts are
    repeated for each. Which keys are heavy is asked of one bitmap on both sides, so that its few wrong marks only repeat
    some more facts. counts: (key, held) of all keys, where facts are dear to reckon.

    Where no key is heavy, as in most tables, rows and facts just meet; that is read from the counts, which callers have
    stored. Where some are, their bitmap is made once for both sides. Each exchange of a plan takes a task for each
    partition, and a thread and memory of the driver."""
    n = partitions(rows.sparkSession)
    heavy = (facts if counts is None else counts).filter(F.col("held") > HEAVY)
    if heavy.isEmpty():
        return rows.join(facts, key)
    heavy = stored(_bitmap(heavy, key), "heavy-keys")
    dealt = _marked(rows, heavy, key, "heavy").withColumn("salt", F.when(F.col("heavy"), F.pmod(F.xxhash64(F.lit(7), by), F.lit(n))).otherwise(0).cast("long"))
    spread = F.when(F.col("heavy"), F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.lit(0))).cast("array<long>")
    repeated = _marked(facts, heavy, key, "heavy").withColumn("salt", F.explode(spread))
    return dealt.drop("heavy").join(repeated.drop("heavy"), [key, "salt"]).drop("salt")


def confirmed(pairs: DataFrame, docs: DataFrame, label: str) -> DataFrame:
    """Those of the pairs (a < b) whose full sets are similar enough; written to the shared folder. Sets are joined as in
    _with_sketches."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    sets = stored(_likely(docs, ids, "doc_id").mapInArrow(_member_sets, "id long, shingles binary"), f"{label}-sets")
    a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a"))
    b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b"))
    return stored(pairs.join(b, "b").join(a, "a").select("a", "b", "set_a", "set_b").mapInArrow(_confirm, "a long, b long"), label)


# --------------------------------------------------------------------------- components


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(id, component): the smallest id reachable, for every id in the links (a, b) that is larger, by large and small
    stars. The links are read several times. The rounds end when all that is left are stars: each id has only larger
    neighbours, or a single one."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = stored(both.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("x")), f"{label}-neighbours")
        if near.filter("m < u and m <> x").isEmpty():
            return near.filter("m < u").select(F.col("u").alias("id"), F.col("m").alias("component"))
        least = near.select("u", F.least("m", "u").alias("m"))
        large = stored(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), f"{label}-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        edges = stored(large.join(low, "u").select(F.inline(small)).filter("u <> v").distinct(), label)


# --------------------------------------------------------------------------- buckets


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sketch = np.frombuffer(b"".join(batch["sketch"].to_pylist()), np.uint16).reshape(-1, BINS)
        bands = np.ascontiguousarray(sketch).view(U64).reshape(-1, BANDS)
        keys = mix(bands ^ mix(np.arange(1, BANDS + 1, dtype=U64))[None, :]).view(np.int64)
        ids, size = batch["id"].to_numpy(), batch["n_shingles"].to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(ids, BANDS)), pa.array(np.repeat(size, BANDS))], ["key", "id", "n"])


def passes(a: np.ndarray, whole_a: bool, b: np.ndarray, whole_b: bool) -> bool:
    """Whether two sets may be similar enough, by their least hashes (sorted): up to the smallest hash that a cut-off
    list doesn't reach, both are samples of the union."""
    end = min([np.uint64(1) << np.uint64(32), *(np.uint64(x[-1]) for x, whole in ((a, whole_a), (b, whole_b)) if not whole)])
    a, b = a[: np.searchsorted(a, end, "right")], b[: np.searchsorted(b, end, "right")]
    at = np.searchsorted(b, a)
    common = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0
    union = len(a) + len(b) - common
    if whole_a and whole_b:
        return 100 * (common + 1) >= 75 * (union - 1)  # one of slack: the hashes are halves
    return common + 1 >= (0.75 - 6 * (0.1875 / max(1, union)) ** 0.5) * union


def _blocked_pairs(batches: Iterator[pa.RecordBatch], best_only: bool) -> Iterator[pa.RecordBatch]:
    """Of two packed blocks of a family: pairs of different components that share a band, of similar sizes, sketches and
    least hashes; best_only: of each left member the most similar one."""
    for batch in batches:
        found: list[tuple[int, int]] = []
        for left, right in zip(*(batch[k].to_pylist() for k in ("left", "right")), strict=True):
            (ia, ca, na, sa, la), (ib, cb, nb, sb, lb) = (
                (*(np.array([m[k] for m in side]) for k in ("id", "component", "n")), np.frombuffer(b"".join(m["sketch"] for m in side), np.uint16).reshape(-1, BINS), [np.frombuffer(m["least"], np.uint32) for m in side]) for side in (left, right)
            )
            bands_b = np.ascontiguousarray(sb).view(U64).reshape(-1, BANDS)
            for k in range(len(ia)):
                own = np.ascontiguousarray(sa[k]).view(U64)
                ok = (cb != ca[k]) & (ib != ia[k]) & (100 * np.minimum(nb, na[k]) >= 75 * np.maximum(nb, na[k]))
                ok[ok] = (bands_b[ok] == own[None, :]).any(1)
                at = np.flatnonzero(ok)
                alike = (sb[at] == sa[k]).mean(1)
                for j in at[np.argsort(-alike)][: int((alike >= PASS).sum())].tolist():
                    if passes(la[k], na[k] <= LEAST, lb[j], nb[j] <= LEAST):
                        found.append((min(ia[k], ib[j]), max(ia[k], ib[j])))
                        if best_only:
                            break
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])
    release()


_MEMBERS = "array<struct<id:long,component:long,n:long,sketch:binary,least:binary>>"


def _named(members: DataFrame, found: DataFrame) -> DataFrame:
    """(key, id, n) with the component of each id."""
    return members.join(found, "id", "left").withColumn("component", F.coalesce("component", "id")).select("key", "id", "n", "component")


def _families(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(key, id, n, component): the members of all buckets of several components, once for each family of buckets."""
    named = _named(rows, found)
    mixed = named.groupBy("key").agg(F.count(F.lit(1)).alias("held"), F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("key", "held")
    open_rows = stored(named.join(stored(mixed, "open-keys"), "key"), "open-buckets")
    homes = open_rows.groupBy("id").agg(F.max(F.struct("held", "key")).alias("home"))
    families = stored(open_rows.select("key", "id").join(homes, "id").groupBy("key").agg(F.max("home").alias("family")), "family-keys")
    members = open_rows.drop("held").join(families, "key")
    return stored(members.select(F.col("family.key").alias("key"), "id", "n", "component").distinct(), "families")


def _rest_pairs(named: DataFrame, sketched: DataFrame, best_only: bool) -> DataFrame:
    """Pairs (a, b) in families (key, id, n, component) of buckets; sketched: (id, sketch, least) of their members."""
    shares = named.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"))
    largest = shares.groupBy("key").agg(F.sum("m").alias("held"), F.max(F.struct("m", "component")).alias("top"), F.count(F.lit(1)).alias("several"))
    largest = stored(largest.filter("several > 1").select("key", "held", F.col("top.component").alias("main")), "family-sizes")
    rest = named.join(largest, "key").join(sketched, "id")
    cells = F.ceil(F.col("held") / BLOCK).cast("long")
    rest = rest.withColumn("cell", F.pmod(F.xxhash64("id"), cells)).withColumn("member", F.struct("id", "component", "n", "sketch", "least"))
    sides = rest.groupBy("key", "cell").agg(F.collect_list("member").alias("right"), F.collect_list(F.when(F.col("component") != F.col("main"), F.col("member"))).alias("left"))
    sides = stored(sides, "family-blocks")  # both sides of the join read them
    right = sides.select("key", F.col("right").cast(_MEMBERS).alias("right"))
    left = sides.filter(F.size("left") > 0).select("key", F.col("left").cast(_MEMBERS).alias("left"))
    return left.join(right, "key").select("left", "right").mapInArrow(lambda it: _blocked_pairs(it, best_only), "a long, b long").distinct()


def _similar_sizes(a: str, b: str):
    return 100 * F.least(a, b) >= 75 * F.greatest(a, b)


def _merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """found (id, component) after more links (a, b): only the components that these join are gone through again."""
    of = lambda side: found.select(F.col("id").alias(side), F.col("component").alias(f"of_{side}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    joined = components(stored(between.filter("a <> b"), "component-links"), "joined-components")
    moved = found.join(joined.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    return stored(moved.unionByName(joined), "merged-components")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs (doc_id, text)."""
    docs = stable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "neardup-input")
    features = stored(docs.mapInArrow(_features, "doc_id long, n_shingles long, digest binary, sketch binary, least binary"), "features")
    # one shuffle with map-side combination: equal sets have equal sizes, sketches and least hashes, so that any row's do
    members = features.filter("n_shingles > 0 and doc_id is not null").groupBy("digest")
    same = [F.first(c).alias(c) for c in ("n_shingles", "sketch", "least")]
    reps = stored(members.agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("held"), *same), "representatives")
    classes = reps.select("digest", "id", "held")

    # rows of one doc_id may have different texts, and so be representatives of several classes
    torn = features.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.xxhash64("digest")).alias("x"), F.max(F.xxhash64("digest")).alias("y")).filter("x <> y").select("doc_id")
    torn = stored(torn, "torn")
    several = not torn.isEmpty()

    # star round
    bands = reps.select("id", "n_shingles", "sketch").mapInArrow(_band_rows, "key long, id long, n long")
    centres = stored(bands.groupBy("key").agg(F.count(F.lit(1)).alias("held"), F.min("id").alias("centre")).filter("held > 1"), "centres")
    # most buckets hold one row: the others' keys fit a bitmap, and only their rows move
    rows = stored(_keyed_join(_likely(bands, centres, "key"), centres, "key", "id").select("key", "id", "n", "centre"), "buckets")
    stars = rows.filter(F.col("id") != F.col("centre")).select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    pairs = _with_sketches(stored(stars, "stars"), reps).mapInArrow(_promising, "a long, b long")
    pairs = stored(pairs.distinct() if several else pairs, "star-pairs")
    links = confirmed(pairs, docs, "star-links")
    found = components(links)

    # rest rounds: components only grow, so that the second one needs no other families
    families = _families(rows, found)
    sketched = stored(_likely(reps.select("id", "sketch", "least"), families, "id"), "open-sketches")
    for best_only in (True, False):
        more = stored(_rest_pairs(families, sketched, best_only).join(pairs, ["a", "b"], "left_anti"), "rest-pairs")
        if more.isEmpty():
            continue
        pairs = pairs.unionByName(more)
        fresh = confirmed(more, docs, "rest-links")
        if not fresh.isEmpty():
            found = _merged(found, fresh)
            families = _named(families.drop("component"), found)

    # rows of one doc_id with different texts join their classes
    if several:
        bridges = features.filter("n_shingles > 0").join(torn, "doc_id", "left_semi").join(classes, "digest").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
        found = _merged(found, bridges)
    of_class = classes.join(found, "id", "left").select("digest", "held", F.coalesce("component", "id").alias("class_component"))
    # a text that was copied a million times has one digest: its rows are dealt over salted groups
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    joined = _keyed_join(features.filter(linked).select("doc_id", "n_shingles", "digest"), of_class, "digest", "doc_id", classes)
    alone = features.filter(~linked).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = joined.select("doc_id", "n_shingles", F.coalesce("class_component", "doc_id").alias("component_id")).unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))



def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row of the smallest doc_id (of repeated rows of
    that doc_id the one of the smallest text, and of those the one of the smallest hash of all columns); rows with a null
    doc_id stay."""
    docs = stable(docs, "dedup-input")
    found = near_duplicates(docs).filter("doc_id is not null").groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("held"))
    kept = stored(found.filter("kept").select("doc_id", "held"), "kept")
    single = docs.join(kept.filter("held = 1"), "doc_id", "left_semi").select(*map(col, docs.columns))
    # repeated doc_ids are combined where they are read, so that none gathers its rows in one task
    several = kept.filter("held > 1").select("doc_id")
    free = free_names(docs.columns)
    row, every = free("row"), F.struct(*map(col, docs.columns))
    first = F.min_by(every, F.struct(F.col("text"), F.xxhash64(F.to_json(every))))
    chosen = _likely(docs, several, "doc_id").groupBy("doc_id").agg(first.alias(row)).join(several, "doc_id", "left_semi")
    chosen = chosen.select(*[F.col(row)[c].alias(c) for c in docs.columns])
    return single.unionByName(chosen).unionByName(docs.filter("doc_id is null"))
