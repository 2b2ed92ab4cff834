"""Operator 1: byte-level BPE encoding and decoding through a global shuffle of distinct words.

1. Each block of texts (about two million characters) is split into pre-tokens, whose positions refer to the block's own
   list of distinct words. Each word goes, once per block, to the bucket of its hash.
2. A bucket holds every occurrence of its words in the corpus: each distinct word is encoded once, and the ids go back
   to each block that asked.
3. A block's positions meet its words' ids and are put together in order.
4. Decoding joins ids with the token-byte table, which is as large as the vocabulary and no larger.

A frequent word costs one entry per block, wherever it stands, so that no key gathers more rows than there are blocks.
Rows are packed: a block or a bucket's part of it is one row. The blocks follow from the order of rows in the files; a
table that isn't a plain scan is first written to the shared folder, so that a lost task makes the same blocks again.

Defined results: a null text counts as an empty one and has no ids; repeated rows each get their own result; an empty
table gives an empty result; all other columns of the input, whatever their names, are left alone and not returned.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm import pretokens
from folioscope.llm.common import blocks, expand, narrow, pack, partitions, release, stable, task_id, texts_of, unpack

BLOCK_CHARS = 2_000_000
#: Words whose ids a task keeps in mind; beyond, it begins anew and encodes a word again when it comes again.
KNOWN = 200_000


# --------------------------------------------------------------------------- vocabulary


class Vocabulary:
    """Ranks of a tiktoken file: word -> ids, ids -> bytes."""

    def __init__(self, data: bytes):
        import tiktoken

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        self._encoding = tiktoken.Encoding("ranks", pat_str=r"(?s:.)", mergeable_ranks=self.ranks, special_tokens={})
        top = max(self.ranks.values(), default=-1) + 1
        table = [b""] * top
        for token, rank in self.ranks.items():
            table[rank] = token
        self.table = np.frombuffer(b"".join(table), np.uint8)
        self.lens = np.fromiter(map(len, table), np.int64, top)
        self.starts = np.cumsum(self.lens) - self.lens

    def encode_word(self, word: bytes) -> list[int]:
        return self._encoding._core_bpe.encode_single_piece(word) if word else []

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a run of ids, from the token-byte table."""
        return self.table[expand(self.starts[ids], self.lens[ids])].tobytes()


@lru_cache(4)
def vocabulary(data: bytes) -> Vocabulary:
    return Vocabulary(data)


def _shared_vocabulary(df: DataFrame, path: str):
    return df.sparkSession.sparkContext.broadcast(Path(path).read_bytes())


# --------------------------------------------------------------------------- encoding


def _blocks(batches: Iterator[pa.RecordBatch], buckets: int):
    """Each block's number, batch, positions and words, the words in order of their buckets."""
    part = task_id() << 32
    for seq, batch in enumerate(blocks(batches, chars=BLOCK_CHARS)):
        codes, counts, words, hashes = pretokens.block(texts_of(batch))
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        yield part + seq, batch, place[codes], counts, words, order, bucket


def _words(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for block, _, _, _, words, order, bucket in _blocks(batches, buckets):
        utf8 = [words[k].encode("utf-8", "surrogatepass") for k in order.tolist()]
        lens = np.fromiter(map(len, utf8), np.int64, len(utf8))
        sorted_buckets = bucket[order]
        used, first = np.unique(sorted_buckets, return_index=True)
        ends = np.append(first[1:], len(utf8))
        rows = [pack(narrow(lens[a:b]), b"".join(utf8[a:b])) for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), pa.array(used, pa.int64()), pa.array(rows, pa.binary())], ["block", "bucket", "payload"])


def _positions(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for block, batch, codes, counts, words, _, _ in _blocks(batches, buckets):
        ids = batch["doc_id"].to_pylist()
        known = np.fromiter((x is not None for x in ids), bool, len(ids))
        payload = pack(np.fromiter((x or 0 for x in ids), "<i8", len(ids)), known, narrow(counts), np.array([len(words)]), narrow(codes))
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([-1], pa.int64()), pa.array([payload], pa.binary())], ["block", "bucket", "payload"])


def _encode_words(batches: Iterator[pa.RecordBatch], data: bytes) -> Iterator[pa.RecordBatch]:
    """A partition of buckets: each distinct word once."""
    vocab = vocabulary(data)
    known: dict[bytes, list[int]] = {}
    for batch in batches:
        out = []
        for payload in batch["payload"].to_pylist():
            lens, joined = unpack(payload)
            ends = np.cumsum(lens, dtype=np.int64)
            found = []
            for a, b in zip((ends - lens).tolist(), ends.tolist(), strict=True):
                ids = known.get(word := joined[a:b])
                if ids is None:
                    if len(known) >= KNOWN:
                        known.clear()
                    ids = known[word] = vocab.encode_word(word)
                found.append(ids)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter((i for ids in found for i in ids), np.int64, int(sizes.sum()))
            out.append(pack(narrow(sizes), narrow(flat)))
        yield pa.RecordBatch.from_arrays([batch["block"], batch["bucket"], pa.array(out, pa.binary())], ["block", "bucket", "payload"])
    known.clear()
    release()


def _reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block and bucket: the positions (bucket -1), then the words' ids."""
    current, positions, sizes, ids = None, None, [], []

    def put_together() -> Iterator[pa.RecordBatch]:
        if positions is None:
            return
        docs, known, counts, words, codes = unpack(positions)
        lens = np.concatenate([np.zeros(0, np.int64), *(x.astype(np.int64) for x in sizes)])
        flat = np.concatenate([np.zeros(0, np.int32), *(x.astype(np.int32) for x in ids)])
        if len(lens) != int(words[0]):
            raise RuntimeError(f"block {current}: ids of {len(lens)} words of {int(words[0])}; the input changed between its two reads")
        codes = codes.astype(np.int64)
        begins = np.cumsum(lens) - lens
        token_lens = lens[codes]
        values = flat[expand(begins[codes], token_lens)]
        pre = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        offsets = np.concatenate([[0], np.cumsum(token_lens)])[pre]
        # one Arrow batch holds a block; its lists' offsets are 32-bit, as Spark's arrays are
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64(), mask=~known), lists], ["doc_id", "ids"])

    for batch in batches:
        for block, bucket, payload in zip(*(batch[k].to_pylist() for k in ("block", "bucket", "payload")), strict=True):
            if block != current:
                yield from put_together()
                current, positions, sizes, ids = block, None, [], []
            if bucket < 0:
                positions = payload
            else:
                a, b = unpack(payload)
                sizes.append(a)
                ids.append(b)
        release()
    yield from put_together()
    release()


def encode(docs: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    docs = stable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "bpe-input")
    n = partitions(spark)
    buckets = 2 * n
    data = _shared_vocabulary(docs, ranks_path)
    packed = "block long, bucket long, payload binary"
    words = docs.mapInArrow(lambda it: _words(it, buckets), packed)
    ids = words.repartition(n, "bucket").mapInArrow(lambda it: _encode_words(it, data.value), packed)
    positions = docs.mapInArrow(lambda it: _positions(it, buckets), packed)
    together = positions.unionByName(ids).repartition(n, "block").sortWithinPartitions("block", "bucket")
    return together.mapInArrow(_reassemble, "doc_id long, ids array<int>")


# --------------------------------------------------------------------------- decoding


def _lists(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    column = batch["ids"]
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for k in range(len(column)):
        yield values[offsets[k] : offsets[k + 1]]


def _decoded(batches: Iterator[pa.RecordBatch], data: bytes) -> Iterator[pa.RecordBatch]:
    vocab = vocabulary(data)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([vocab.decode(x) for x in _lists(batch)], pa.binary())], ["doc_id", "decoded"])


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, decoded binary) of every row of (doc_id, ids array<int>)."""
    data = _shared_vocabulary(encoded, ranks_path)
    return encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(lambda it: _decoded(it, data.value), "doc_id long, decoded binary")


def _digests(batches: Iterator[pa.RecordBatch], data: bytes) -> Iterator[pa.RecordBatch]:
    from hashlib import sha256

    vocab = vocabulary(data)
    for batch in batches:
        rows = [(len(x), sha256(x.astype("<u4").tobytes()).hexdigest(), sha256(vocab.decode(x)).hexdigest()) for x in _lists(batch)]
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        release()


def digests(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Decode, and return only counts and digests of ids and bytes."""
    data = _shared_vocabulary(encoded, ranks_path)
    return encoded.select("doc_id", "ids").mapInArrow(lambda it: _digests(it, data.value), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
