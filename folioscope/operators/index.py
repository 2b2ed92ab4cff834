"""A stored keyword index: postings with places, laid out by term so that a search reads its terms only.

Under ``path``:

- ``postings`` (bucket, term, block, df, cf and the numbers rows, tfs, gaps as bytes): a row for each term of each block of at most
  ``BLOCK`` rows of the table, in folders by a hash of the term, sorted by term; rows are numbers within the block, gaps
  those between the places of a row. Folder -1 has a row for each block instead: keys, kinds and lens of its rows, df of which
  aren't null, cf words in all. A folder is written by several tasks, each with some of the blocks, whatever its terms;
  the numbers of folders and tasks follow from the size of the table's texts;
- ``terms`` (term, stem, df, cf), sorted by stem; ``norms`` (key, norm), the TF-IDF length of each row, if asked for;
- ``stats``, one row: rows, mean length, folders.

Blocks of rows are counted where they are read, a column of words at a time, and move once, packed by folder, before they are
written; document frequencies are sums of the blocks' numbers. A search opens its terms' rows block by block.

Defined results: a row whose key is null, blank or repeated is refused with an error before anything is written, as
postings of two rows could not be told apart; an empty text has length 0; a null one counts as a row but not in the mean
length; an empty table gives an empty index.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from folioscope.functions import text as T
from folioscope.operators import arrow, stems
from folioscope.sources.builds import file_fingerprint
from folioscope.sources.tables import scratch

#: Bytes of text that a folder and a task stand for, about; a block is cut into so many payloads at most.
FOLDER_BYTES, TASK_BYTES, MOST_FOLDERS = 112 << 20, 14 << 20, 64
#: Rows of a block at most, as their numbers are kept in two bytes, and bytes of its words, about.
BLOCK, BLOCK_BYTES = 4096, 20 << 20


def folded(term: str) -> str:
    """The term without accents."""
    return term if term.isascii() else "".join(c for c in unicodedata.normalize("NFD", term) if unicodedata.category(c) != "Mn")


def _all_folded(terms: list[str]) -> list[str]:
    """folded of each, reckoned on all of them as one text."""
    text = "\n".join(terms)
    if text.isascii() or text.count("\n") != len(terms) - 1:
        return list(map(folded, terms))
    text = unicodedata.normalize("NFD", text)
    return text.translate({ord(c): None for c in set(text) if unicodedata.category(c) == "Mn"}).split("\n")


def _refuse(keys: DataFrame) -> None:
    """One pass over the keys: each that is blank, or that several rows have, is refused."""
    blank = F.col("key").isNull() | (F.trim(F.col("key").cast("string")) == "")
    odd = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(blank | (F.col("n") > 1)).select("key", blank.alias("blank")).limit(3).collect()
    if odd:
        raise ValueError("the index refuses " + ("rows without a key" if any(r.blank for r in odd) else f"repeated keys, as {[r.key for r in odd]}"))


_ROW = "term string, block long, df long, cf long, rows binary, tfs binary, gaps binary, keys array<{}>, kinds array<string>, lens array<int>"


def _expand(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """starts[k] .. starts[k] + lens[k] - 1 for each k, one after another."""
    before = np.cumsum(lens) - lens
    return np.repeat(starts - before, lens) + np.arange(int(lens.sum()))


def _within(values: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Sums of values from the beginning of each stretch of these lengths on."""
    sums = np.cumsum(values)
    first = np.cumsum(lens) - lens
    return sums - np.repeat(np.where(first > 0, sums[np.maximum(first, 1) - 1], 0) if len(sums) else first, lens)


def _bytes_of(*parts: np.ndarray | bytes) -> bytes:
    """Whole numbers in as few bytes as they need, and bytes, as one value; _parts_of gives them back in order."""
    held, head = [], []
    for part in parts:
        if not isinstance(part, bytes):
            top = int(part.max(initial=0))
            part = part.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")
        head.append(["" if isinstance(part, bytes) else part.dtype.str, len(part) if isinstance(part, bytes) else part.nbytes])
        held.append(part if isinstance(part, bytes) else part.tobytes())
    first = json.dumps(head).encode()
    return len(first).to_bytes(4, "little") + first + b"".join(held)


def _parts_of(data: bytes) -> list[np.ndarray | bytes]:
    size = int.from_bytes(data[:4], "little")
    at, out = 4 + size, []
    for kind, n in json.loads(data[4 : 4 + size]):
        out.append(np.frombuffer(data[at : at + n], kind).astype(np.int64) if kind else data[at : at + n])
        at += n
    return out


def _ipc(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as stream:
        stream.write_batch(rows)
    return sink.getvalue().to_pybytes()


_PACKED = {"cell": pa.int32(), "bucket": pa.int32(), "block": pa.int64(), "size": pa.int64(), "payload": pa.binary()}


def _changes(values: np.ndarray) -> np.ndarray:
    """Whether each value differs from the one before it; the first one does."""
    return np.append(np.ones(min(1, len(values)), bool), values[1:] != values[:-1])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together, or cut, to blocks."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for piece in (batch.slice(at, BLOCK) for at in range(0, batch.num_rows, BLOCK)):
            if held and (sum(b.num_rows for b in held) + piece.num_rows > BLOCK or sum(b.nbytes for b in held) + piece.nbytes > BLOCK_BYTES):
                yield pa.concat_batches(held)
                held = []
            held.append(piece)
    if held:
        yield pa.concat_batches(held)


def _packed(batches: Iterator[pa.RecordBatch], fold: bool, places: bool, folders: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, kind, words) to a row for each folder of each block: (cell, bucket, block, size, payload). A payload has
    the folder's words, the rows that hold each of them, how often, and the gaps between its places there (none if they
    aren't asked for); that of folder -1 the block's rows. A block's payloads go to one of a folder's parts."""
    part = TaskContext.get().partitionId()
    for number, batch in enumerate(_blocks(batches)):
        words = batch["words"]
        lens = np.diff(words.offsets.to_numpy())
        known = np.asarray(words.is_valid().to_numpy(zero_copy_only=False), bool)
        lens[~known] = 0
        coded = words.flatten().dictionary_encode()
        codes, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        if fold and names:
            plain = _all_folded(names)
            names = list(dict.fromkeys(plain))
            place_of = {n: k for k, n in enumerate(names)}
            codes = np.fromiter(map(place_of.__getitem__, plain), np.int64, len(plain))[codes]
        terms = [n.encode("utf-8", "surrogatepass") for n in names]
        bucket = np.fromiter(map(zlib.crc32, terms), np.int64, len(terms)) % folders
        by_bucket = np.argsort(bucket, kind="stable")
        rank = np.empty(len(terms), np.uint16 if len(terms) <= 1 << 16 else np.int64)  # two bytes are sorted by counting
        rank[by_bucket] = np.arange(len(terms))
        terms, bucket, codes = [terms[k] for k in by_bucket.tolist()], bucket[by_bucket], rank[codes]
        order = np.argsort(codes, kind="stable")  # rows and places within a word stay in order
        codes, row = codes[order], np.repeat(np.arange(len(lens), dtype=np.uint16), lens)[order]
        place = (np.arange(len(order)) - np.repeat(np.cumsum(lens) - lens, lens))[order]
        begins = np.flatnonzero(_changes(codes) | _changes(row))  # of a word in a row
        tf = np.diff(np.append(begins, len(row)))
        first = np.flatnonzero(_changes(codes[begins]))  # of a word
        held = np.diff(np.append(first, len(begins)))
        gaps = np.diff(place, prepend=0)
        gaps[begins] = place[begins]
        row, sizes = row[begins], np.array([len(t) for t in terms], np.int64)
        cuts = np.flatnonzero(_changes(bucket))
        begins, first = np.append(begins, len(gaps)), np.append(first, len(row))
        docs = pa.RecordBatch.from_arrays([batch["key"], batch["kind"], pa.array(lens, pa.int32())], ["key", "kind", "len"])
        out = [(-1, _bytes_of(_ipc(docs), np.array([known.sum(), lens.sum()])))]
        for a, b in zip(cuts.tolist(), np.append(cuts, len(terms))[1:].tolist(), strict=True):
            x, y = first[a], first[b]
            out.append((int(bucket[a]), _bytes_of(b"".join(terms[a:b]), sizes[a:b], held[a:b], row[x:y], tf[x:y], gaps[begins[x] : begins[y]] if places else gaps[:0])))
        block, mine = part << 32 | number, (part * 8191 + number) % parts
        rows = [((k + 1) * parts + mine, k, block, len(data), pa.compress(data, "zstd", asbytes=True)) for k, data in out]
        yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), _PACKED.values(), strict=True)], list(_PACKED))


def _binary(values: np.ndarray, kind: str, ends: np.ndarray) -> pa.Array:
    """The numbers up to each end as bytes."""
    values = values.astype(kind)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, ends * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def _numbers(values: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of values made by _binary, and how many each has."""
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    size = np.dtype(kind).itemsize
    n = (int(ends[-1]) - int(ends[0])) // size
    return np.frombuffer(values.buffers()[2], kind, n, int(ends[0])).astype(np.int64) if n else np.zeros(0, np.int64), np.diff(ends) // size


def _unpacked(batches: Iterator[pa.RecordBatch], key: pa.DataType) -> Iterator[pa.RecordBatch]:
    """A row for each word of each payload; one for that of a block's rows."""
    names = ["term", "block", "df", "cf", "rows", "tfs", "gaps", "keys", "kinds", "lens", "bucket"]
    for batch in batches:
        for bucket, block, size, payload in zip(*(batch[c].to_pylist() for c in list(_PACKED)[1:]), strict=True):
            parts = _parts_of(pa.decompress(payload, size, "zstd", asbytes=True))
            if bucket < 0:
                docs, (known, total) = pa.ipc.open_stream(parts[0]).read_next_batch(), parts[1].tolist()
                whole = [pa.ListArray.from_arrays(pa.array([0, docs.num_rows], pa.int32()), docs[c]) for c in ("key", "kind", "len")]
                yield pa.RecordBatch.from_arrays([pa.array([""]), *(pa.array([x], pa.int64()) for x in (block, known, total)), *[pa.nulls(1, pa.binary())] * 3, *whole, pa.array([-1], pa.int32())], names)
                continue
            text, sizes, held, row, tf, gaps = parts
            ends, upto = np.cumsum(sizes), np.cumsum(held)
            terms = [text[a:b].decode("utf-8", "surrogatepass") for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
            n, of_term = len(terms), np.add.reduceat(tf, upto - held)
            numbers = [_binary(row, "<u2", upto), _binary(tf, "<u4", upto), _binary(gaps, "<u4", np.cumsum(of_term)) if len(gaps) else pa.nulls(n, pa.binary())]
            nothing = [pa.nulls(n, pa.list_(kind)) for kind in (key, pa.string(), pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(np.full(n, block)), pa.array(held), pa.array(of_term), *numbers, *nothing, pa.array(np.full(n, bucket), pa.int32())], names)


def _with_stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.array([stems.stem(t) for t in batch["term"].to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([batch["term"], found, batch["df"], batch["cf"]], ["term", "stem", "df", "cf"])


def _bucket(term: Column, folders: int) -> Column:
    return (F.crc32(term.cast("binary")) % folders).cast("int")


def _text_bytes(df: DataFrame, text: str) -> int:
    """Of all texts: files tell little of what a task will hold, as copies of a text may take no room in them."""
    return df.agg(F.sum(F.octet_length(F.col(text).cast("string")).cast("long"))).first()[0] or 0


def build(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", tokens: Callable[[Column], Column] = T.words, kind: Column | None = None, fold: bool = False, norms: bool = True, places: bool = True) -> None:
    """Write the index of docs; an index at path is replaced. kind: what a search may be limited to. fold: whether terms
    lose their accents. norms: for ``tfidf``; places: for phrases."""
    spark = docs.sparkSession
    rows = arrow.small_batches(docs).select(F.col(key).alias("key"), (F.lit("") if kind is None else F.coalesce(kind.cast("string"), F.lit(""))).alias("kind"), tokens(F.col(text)).alias("words"))
    _refuse(rows.select("key"))
    size = _text_bytes(docs, text)
    folders = min(MOST_FOLDERS, max(1, -(-size // FOLDER_BYTES)))
    kind_of = rows.schema["key"].dataType
    schema, packed_kind = _ROW.format(kind_of.simpleString()), to_arrow_type(kind_of)
    tasks = max(1, -(-size // TASK_BYTES))
    parts = -(-tasks // folders)
    packed = rows.mapInArrow(lambda it: _packed(it, fold, places, folders, parts), "cell int, bucket int, block long, size long, payload binary")
    # a task has one part of one folder, by number: a hash of both would give some tasks several and others none
    dealt = packed.repartitionById((folders + 1) * parts, "cell")
    laid = dealt.mapInArrow(lambda it: _unpacked(it, packed_kind), f"{schema}, bucket int").sortWithinPartitions("bucket", "term")
    laid.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings")

    written = spark.read.schema(laid.schema).parquet(f"{path}/postings")  # an empty table's folder tells no schema
    counted = written.filter("bucket >= 0").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    stemmed = counted.mapInArrow(_with_stems, "term string, stem string, df long, cf long")
    stemmed.repartition(F.col("stem")).sortWithinPartitions("stem", "term").write.mode("overwrite").parquet(f"{path}/terms")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    stats = written.filter("bucket = -1").agg(total(F.size("keys")).alias("n"), F.try_divide(total("cf"), total("df")).alias("mean"), F.lit(folders).alias("folders"), F.lit(schema).alias("schema"))
    stats.write.mode("overwrite").parquet(f"{path}/stats")
    if norms:
        n = F.lit(spark.read.parquet(f"{path}/stats").first().n)
        weight = (1 + F.log("tf")) * F.log(1 + n / (1 + F.col("of_all")))
        held = spark.read.parquet(f"{path}/terms").select("term", F.col("df").alias("of_all"))
        each = _each(spark, path, written.filter("bucket >= 0").select("term", "block", "rows", "tfs").join(held, "term"), ["of_all"])
        each.groupBy("key").agg(F.sqrt(F.sum(weight * weight)).alias("norm")).write.mode("overwrite").parquet(f"{path}/norms")


_SERVED: dict[tuple, str] = {}


def served(docs: DataFrame, label: str, **options) -> str:
    """The path of the index of docs, built when it is first asked for by this session and its files' state. label: names
    the options, of which those that are functions can't be compared."""
    spark = docs.sparkSession
    at = (spark.sparkContext.applicationId, label, file_fingerprint(docs))
    if at not in _SERVED:
        path = scratch(spark, f"keyword-index-{label}")
        build(docs, path, **options)
        _SERVED[at] = path
    return _SERVED[at]


# --------------------------------------------------------------------------- search


def terms(spark: SparkSession, path: str) -> DataFrame:
    """(term, stem, df, cf) of every term."""
    return spark.read.parquet(f"{path}/terms")


def _written(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The rows of the postings, and the number of folders."""
    stats = spark.read.parquet(f"{path}/stats").first()
    return spark.read.schema(f"{stats.schema}, bucket int").parquet(f"{path}/postings"), stats.folders


def by_block(spark: SparkSession, path: str, rows: DataFrame, columns: list[str]) -> DataFrame:
    """(met, keys, kinds, lens): a row for each block; met: its rows of the postings, with these columns."""
    blocks = _written(spark, path)[0].filter("bucket = -1").select("block", "keys", "kinds", "lens")
    met = arrow.small_batches(rows).groupBy("block").agg(F.collect_list(F.struct(*columns)).alias("met"))
    return met.join(blocks, "block").select("met", "keys", "kinds", "lens")


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.StructArray, pa.Array, pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """For each row of by_block: met, keys, kinds, lens, the rows of all of met, how many each has, and how often they hold it."""
    for batch in batches:
        for met, keys, kinds, lens in zip(*(batch[c] for c in ("met", "keys", "kinds", "lens")), strict=True):
            row, held = _numbers(met.values.field("rows"), "<u2")
            yield met.values, keys.values, kinds.values, lens.values, row, held, _numbers(met.values.field("tfs"), "<u4")[0]


def _opened(batches: Iterator[pa.RecordBatch], columns: list[str], places: bool) -> Iterator[pa.RecordBatch]:
    for met, keys, kinds, lens, row, held, tf in blocks_of(batches):
        at, of = pa.array(row), pa.array(np.repeat(np.arange(len(held)), held))
        out = [*(met.field(c).take(of) for c in columns), keys.take(at), kinds.take(at), pa.array(tf, pa.int32()), lens.take(at)]
        if places:
            gaps = _within(_numbers(met.field("gaps"), "<u4")[0], tf)
            out.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(tf)), pa.int32()), pa.array(gaps, pa.int32())))
        yield pa.RecordBatch.from_arrays(out, [*columns, "key", "kind", "tf", "len", *["positions"] * places])


def _holding(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    for met, keys, _, _, row, held, _ in blocks_of(batches):
        listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(held)), pa.int32()), keys.take(pa.array(row)))
        yield pa.RecordBatch.from_arrays([*(met.field(c) for c in columns), listed], [*columns, "keys"])


def key_kind(spark: SparkSession, path: str) -> str:
    return _written(spark, path)[0].schema["keys"].dataType.elementType.simpleString()


def _ddl(rows: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)


def _each(spark: SparkSession, path: str, rows: DataFrame, columns: list[str], places: bool = False) -> DataFrame:
    """A row for each row that holds the term: key, kind, tf, len and, if asked for, its positions."""
    made = f"{_ddl(rows, columns)}, key {key_kind(spark, path)}, kind string, tf int, len int" + ", positions array<int>" * places
    return by_block(spark, path, rows, [*columns, "rows", "tfs", *["gaps"] * places]).mapInArrow(lambda it: _opened(it, columns, places), made)


def postings(spark: SparkSession, path: str, words: list[str], places: bool = False) -> DataFrame:
    """(bucket, term, key, kind, tf, len) and, if asked for, positions for these words; other folders and terms are not
    read."""
    held, folders = _written(spark, path)
    if words:
        buckets = [r.b for r in spark.range(1).select(F.explode(F.array(*map(F.lit, words))).alias("w")).select(_bucket(F.col("w"), folders).alias("b")).distinct().collect()]
        held = held.filter(F.col("bucket").isin(buckets) & F.col("term").isin(words))
    else:
        held = held.filter("false")
    return _each(spark, path, held, ["bucket", "term"], places)


def asked_rows(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """asked (bucket, term and others) beside the rows of the postings of its terms."""
    return _written(spark, path)[0].select("bucket", "term", "block", "rows", "tfs").join(asked, ["bucket", "term"])


def all_postings(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """asked (bucket, term and others) beside each row that holds its term: (key, kind, tf, len); only their folders are
    read."""
    return _each(spark, path, asked_rows(spark, path, asked), asked.columns)


def holders_of(spark: SparkSession, path: str, asked: DataFrame, wanted: Column) -> DataFrame:
    """asked (bucket, term and others) beside the keys of each block's rows that hold its term: (keys); wanted: a condition on
    the term that all asked ones fulfil, so that other words needn't move."""
    rows = _written(spark, path)[0].select("bucket", "term", "block", "rows", "tfs").filter(wanted).join(asked, ["bucket", "term"])
    columns = [c for c in asked.columns if c not in ("bucket", "term")]
    met = by_block(spark, path, rows, [*columns, "rows", "tfs"])
    return met.mapInArrow(lambda it: _holding(it, columns), f"{_ddl(rows, columns)}, keys array<{key_kind(spark, path)}>")


def _best(scored: DataFrame, k: int | None) -> DataFrame:
    scored = scored.filter("score > 0")
    return scored if k is None else scored.orderBy(F.desc("score"), "key").limit(k)


def bm25(spark: SparkSession, path: str, words: list[str], k: int | None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of the k best rows by Okapi BM25, ties to the smaller key; k None: all that have a score."""
    held = postings(spark, path, words)
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row for each word of the query
    stats = spark.read.parquet(f"{path}/stats")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    scored = held.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats)).groupBy("key").agg(F.round(F.sum(part), 6).alias("score"))
    return _best(scored, k)


def tfidf(spark: SparkSession, path: str, words: list[str], k: int | None) -> DataFrame:
    """(key, score) of the k best rows by TF-IDF, normed by the whole row."""
    held = postings(spark, path, words)
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = (1 + F.log("tf")) * F.log(1 + F.col("n") / (1 + F.col("df")))
    joined = held.join(F.broadcast(df), "term").crossJoin(F.broadcast(spark.read.parquet(f"{path}/stats")))
    dots = joined.groupBy("key").agg(F.sum(weight).alias("dot"))
    normed = dots.join(spark.read.parquet(f"{path}/norms"), "key")
    return _best(normed.select("key", F.round(F.col("dot") / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0), 6).alias("score")), k)


def _less(k: int) -> Callable[[Column], Column]:
    return lambda p: p - k


def _together(units: list[str], places: Callable[[str], Column]) -> Column:
    """The places at which the units stand one after another, from the column of each one's places."""
    common = places(units[0])
    for k, unit in enumerate(units[1:], 1):
        common = F.array_intersect(common, F.transform(places(unit), _less(k)))
    return common


def phrase(spark: SparkSession, path: str, words: list[str]) -> DataFrame:
    """(key, places): the rows in which the words stand one after another, and how often."""
    distinct = sorted(set(words))
    held = postings(spark, path, distinct, places=True)
    each = [F.first(F.when(F.col("term") == w, F.col("positions")), ignorenulls=True).alias(f"at{k}") for k, w in enumerate(distinct)]
    rows = held.groupBy("key").agg(*each)
    common = _together(words, lambda w: F.col(f"at{distinct.index(w)}"))
    return rows.select("key", F.size(common).alias("places")).filter("places > 0")
