"""Operator 10: token ids in binary files, with Elias-Fano encoded document boundaries.

Documents are dealt into ranges of doc_id; each task writes its range as shards (.fsid files) to a folder that driver and
executors share, and a manifest row for each. A shard holds, little-endian:

    magic "FSID1\\0\\0\\0" | n_docs u64 | n_ids u64 | id width u64 | low bits u64 | sizes of the five parts, u64 each
    doc_ids i64 (with a bit each for null) | ids u16 or u32 | boundaries: low bits, high bits, select samples

The boundaries (the end of each document in the id array) take about 2 + log2(n_ids / n_docs) bits a document instead of
64. ``EliasFano.get`` and, for many at once, ``select`` find them through the select samples; readers ask ``spans``.

A shard is written under a temporary name and renamed, so that a task that runs again replaces it whole.

Defined results: null text is empty and holds only the end id; repeated rows are all kept, in order of (doc_id, text); a
null doc_id comes first; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.llm import pretokens
from folioscope.llm.common import blocks, bounded, crc32, expand, shared_path, stored, task_id, texts_of

MAGIC = b"FSID1\0\0\0"
END_ID = 0
SHARD_IDS = 4_000_000
SAMPLE = 256
BLOCK_CHARS = 1_000_000


# --------------------------------------------------------------------------- Elias-Fano


class EliasFano:
    """A non-decreasing sequence of integers in near-minimal space, with random access."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        bits = (values[:, None] >> np.arange(low_bits)) & 1
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> low_bits) + np.arange(n)
        flags = np.zeros((int(ones[-1]) + 1) if n else 0, np.uint8)
        flags[ones] = 1
        return cls(n, low_bits, low, np.packbits(flags, bitorder="little"), ones[::SAMPLE].astype("<u4" if n and ones[-1] < 1 << 32 else "<u8"))

    def get(self, k: int) -> int:
        """The k-th value: select on the high bits from the nearest sample, then the low bits."""
        if not 0 <= k < self.n:
            raise IndexError(k)
        at, need = int(self.samples[k // SAMPLE]), k % SAMPLE
        byte = at // 8
        word = int(self.high[byte]) & (0xFF << (at % 8)) & 0xFF
        while (held := word.bit_count()) <= need:
            need -= held
            byte += 1
            word = int(self.high[byte])
        for _ in range(need):
            word &= word - 1
        high = 8 * byte + (word & -word).bit_length() - 1 - k
        low, first = 0, k * self.low_bits
        for j in range(self.low_bits):
            low |= (int(self.low[(first + j) // 8]) >> ((first + j) % 8) & 1) << j
        return (high << self.low_bits) | low

    def select(self, ks: np.ndarray) -> np.ndarray:
        """The values at ks, any order: of each sample's stretch only the high bits that ks ask for are looked at."""
        ks = np.asarray(ks, np.int64)
        if not len(ks):
            return ks
        if not (0 <= ks.min() and ks.max() < self.n):
            raise IndexError("beyond the sequence")
        stretch, high = ks // SAMPLE, np.empty(len(ks), np.int64)
        order = np.argsort(stretch, kind="stable")
        used, first = np.unique(stretch[order], return_index=True)
        for j, part in zip(used.tolist(), np.split(order, first[1:]), strict=True):
            begin = int(self.samples[j]) // 8
            end = int(self.samples[j + 1]) // 8 + 1 if j + 1 < len(self.samples) else len(self.high)
            ones = 8 * begin + np.flatnonzero(np.unpackbits(self.high[begin:end], bitorder="little"))
            skip = int(np.searchsorted(ones, int(self.samples[j])))
            high[part] = ones[skip + ks[part] - j * SAMPLE] - ks[part]
        if not self.low_bits:
            return high
        at = ks[:, None] * self.low_bits + np.arange(self.low_bits)
        bits = (self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        return high << self.low_bits | (bits.astype(np.int64) << np.arange(self.low_bits)).sum(1)

    def spans(self, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Where the documents first .. last - 1 start and end."""
        last = self.n if last is None else last
        ends = self.select(np.arange(max(first - 1, 0), last))
        return (np.concatenate([[0], ends[:-1]]), ends) if not first else (ends[:-1], ends[1:])

    def nbytes(self) -> int:
        return self.low.nbytes + self.high.nbytes + self.samples.nbytes


# --------------------------------------------------------------------------- the file format


def shard_bytes(doc_ids: list[int | None], ids: np.ndarray, ends: np.ndarray) -> bytes:
    wide = "<u2" if not len(ids) or ids.max() < 1 << 16 else "<u4"
    ef = EliasFano.of(ends)
    known = np.packbits(np.fromiter((x is not None for x in doc_ids), np.uint8, len(doc_ids)), bitorder="little").tobytes()
    parts = [np.fromiter((x or 0 for x in doc_ids), "<i8", len(doc_ids)).tobytes() + known, ids.astype(wide).tobytes(), ef.low.tobytes(), ef.high.tobytes(), ef.samples.astype("<u8").tobytes()]
    head = np.array([len(doc_ids), len(ids), int(wide[-1]), ef.low_bits, *map(len, parts)], "<u8").tobytes()
    return b"".join([MAGIC, head, *parts])


def read_shard(data: bytes) -> tuple[list[int | None], np.ndarray, EliasFano]:
    """doc_ids, ids and boundaries of a shard."""
    if data[:8] != MAGIC:
        raise ValueError("not a token id shard")
    n, total, wide, low_bits, *sizes = np.frombuffer(data, "<u8", 9, 8).tolist()
    at, parts = 80, []
    for size in sizes:
        parts.append(data[at : at + size])
        at += size
    if at != len(data):
        raise ValueError("a token id shard is cut off")
    docs = np.frombuffer(parts[0], "<i8", n).tolist()
    known = np.unpackbits(np.frombuffer(parts[0][8 * n :], np.uint8), bitorder="little")[:n].tolist()
    ids = np.frombuffer(parts[1], f"<u{wide}", total)
    ef = EliasFano(n, low_bits, np.frombuffer(parts[2], np.uint8), np.frombuffer(parts[3], np.uint8), np.frombuffer(parts[4], "<u8"))
    return [d if k else None for d, k in zip(docs, known, strict=True)], ids, ef


# --------------------------------------------------------------------------- encoding by the tokenizers library


class WordTable:
    """The ids of words that were seen before, by the words' 64-bit hashes: open addressing, asked for a whole block of
    words at once. Words whose hashes agree are compared by ``holds``."""

    def __init__(self, slots: int = 1 << 21, most: int = 1 << 20, ids: int = 1 << 23):
        self.mask, self.most, self.most_ids = slots - 1, most, ids
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(self.mask + 1, np.uint64)  # 0: a free slot
        self.index = np.zeros(self.mask + 1, np.int32)
        self.lens, self.starts, self.flat = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint32)
        self.word_lens, self.word_starts, self.symbols = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def _slots(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes = np.where(hashes == 0, np.uint64(1), hashes)
        return hashes, (hashes >> np.uint64(17)).astype(np.int64) & self.mask

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each word in lens and starts; -1 for a word that isn't there."""
        hashes, slot = self._slots(hashes)
        out, open_ = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        while len(open_):
            held = self.keys[slot]
            hit = held == hashes
            out[open_[hit]] = self.index[slot[hit]]
            on = ~hit & (held != 0)
            open_, hashes, slot = open_[on], hashes[on], (slot[on] + 1) & self.mask
        return out

    def holds(self, at: np.ndarray, spans: pretokens.Spans) -> bool:
        """Whether the words at these places are those of the spans, symbol by symbol."""
        lens, starts = self.word_lens[at].astype(np.int64), self.word_starts[at].astype(np.int64)
        return not pretokens.differ(spans.symbols, spans.starts, spans.ends - spans.starts, self.symbols, starts, lens)

    def add(self, hashes: np.ndarray, words: list[str], ids: list[list[int]]) -> None:
        """Words that are not there yet, each once."""
        word_lens = np.fromiter(map(len, words), np.int32, len(words))
        symbols = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        self.word_starts = np.concatenate([self.word_starts, (len(self.symbols) + np.cumsum(word_lens) - word_lens).astype(np.int32)])
        self.word_lens, self.symbols = np.concatenate([self.word_lens, word_lens]), np.concatenate([self.symbols, symbols])
        lens = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(lens.sum()))
        place = np.arange(len(self.lens), len(self.lens) + len(ids), dtype=np.int32)
        self.starts = np.concatenate([self.starts, (len(self.flat) + np.cumsum(lens) - lens).astype(np.int32)])
        self.lens, self.flat = np.concatenate([self.lens, lens]), np.concatenate([self.flat, flat])
        hashes, slot = self._slots(hashes)
        while len(hashes):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[free]  # of several words for one slot the last one gets it
            mine = self.keys[slot] == hashes
            self.index[slot[mine]] = place[mine]
            on = ~mine
            hashes, place, slot = hashes[on], place[on], (slot[on] + 1) & self.mask

    def full(self, words: int) -> bool:
        return len(self.lens) + words > self.most or max(len(self.flat), len(self.symbols)) > self.most_ids


class WordEncoder:
    """Ids of pre-tokens by a byte-level BPE model of the tokenizers library. With added, the ids are those of the library's
    encode without special tokens around: a text that holds the string of an added token goes through it whole. Without,
    such strings are encoded like any other. A word is encoded when it is first met; the table of words has a bound
    and begins anew when it is full."""

    def __init__(self, model: str, added: bool = False):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        config = json.loads(model)
        pre = config.get("pre_tokenizer") or {}
        if config.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("a byte-level BPE model without a normalizer and prefix spaces is needed")
        self.tokenizer = Tokenizer.from_str(model)
        self.model = self.tokenizer.model
        strings = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content] if added else []
        self.added = re.compile("|".join(map(re.escape, strings))) if strings else None
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        spare = iter(range(256, 512))  # the byte alphabet: printable bytes stand for themselves
        letters = [chr(b) if b in plain else chr(next(spare)) for b in range(256)]
        if set(letters) != set(ByteLevel.alphabet()):
            raise ValueError("unexpected byte alphabet")
        self.letters = {b: c for b, c in enumerate(letters)}
        self.known = WordTable()

    def words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word."""
        sizes = [len(w.encode("utf-8")) for w in words]
        mapped = "".join(words).encode("utf-8").decode("latin-1").translate(self.letters)  # a character for each byte
        tokenize, out, at = self.model.tokenize, [], 0
        for size in sizes:
            out.append([t.id for t in tokenize(mapped[at : at + size])])
            at += size
        return out

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, each with end_id after it, and the end of each."""
        whole = [k for k, t in enumerate(texts) if self.added.search(t)] if self.added else []
        if not whole:
            return self._ordinary(texts, end_id)
        rest = list(texts)
        for k in whole:
            rest[k] = ""
        ids, ends = self._ordinary(rest, end_id)
        parts = np.split(ids, ends[:-1])
        for k in whole:
            parts[k] = np.array([*self.tokenizer.encode(texts[k], add_special_tokens=False).ids, end_id], np.uint32)
        return np.concatenate(parts), np.cumsum(list(map(len, parts)))

    def _ordinary(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        spans = pretokens.Spans(texts)
        at = self.known.find(spans.hashes)
        if len(fresh := np.flatnonzero(at < 0)):
            if self.known.full(len(fresh)):
                self.known.clear()
                at, fresh = np.full(len(at), -1, np.int64), np.arange(len(at))
            distinct, first = np.unique(spans.hashes[fresh], return_index=True)
            words = spans.words(fresh[first])
            self.known.add(distinct, words, self.words(words))
            at[fresh] = self.known.find(spans.hashes[fresh])
        if self.known.holds(at, spans):
            token_lens = self.known.lens[at].astype(np.int64)
            body = self.known.flat[expand(self.known.starts[at].astype(np.int64), token_lens)]
        else:  # two words of one hash: this block by the words themselves
            words = spans.words(np.arange(len(at)))
            known = dict(zip(distinct := list(dict.fromkeys(words)), self.words(distinct), strict=True))
            token_lens = np.fromiter((len(known[w]) for w in words), np.int64, len(words))
            body = np.fromiter((i for w in words for i in known[w]), np.uint32, int(token_lens.sum()))
        ends = np.concatenate([[0], np.cumsum(token_lens)])[np.cumsum(spans.counts)] + np.arange(1, len(texts) + 1)
        ids = np.full(len(body) + len(texts), end_id, np.uint32)
        inner = np.ones(len(ids), bool)
        inner[ends - 1] = False
        ids[inner] = body
        return ids, ends


@lru_cache(2)
def word_encoder(model: str, added: bool) -> WordEncoder:
    return WordEncoder(model, added)


def _put(fs: pa.fs.FileSystem, folder: str, name: str, data: bytes) -> None:
    fs.create_dir(folder, recursive=True)
    draft = f"{folder}/_{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as f:
        f.write(data)
    fs.move(draft, f"{folder}/{name}")


def _write(batches: Iterator[pa.RecordBatch], model: str, uri: str, end_id: int, shard_ids: int, block_chars: int, added: bool) -> Iterator[pa.RecordBatch]:
    encoder = word_encoder(model, added)
    fs, folder = pa.fs.FileSystem.from_uri(uri)
    part, seq = task_id(), 0
    docs: list[int | None] = []
    held: list[np.ndarray] = []
    sizes: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        ids, ends = np.concatenate(held), np.cumsum(np.concatenate(sizes))
        name = f"shard-{part:06d}-{seq:06d}.fsid"
        _put(fs, folder, name, shard_bytes(docs, ids, ends))
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(docs)], pa.int64()), pa.array([len(ids)], pa.int64())], ["shard", "n_docs", "n_ids"])

    for batch in blocks(batches, chars=block_chars):
        ids, ends = encoder.encode(texts_of(batch), end_id)
        docs += batch["doc_id"].to_pylist()
        held.append(ids.astype("<u4"))
        sizes.append(np.diff(ends, prepend=0))
        if sum(map(len, held)) >= shard_ids:
            yield flush()
            docs, held, sizes, seq = [], [], [], seq + 1
    if docs:
        yield flush()


def write(docs: DataFrame, tokenizer_path: str, uri: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS, block_chars: int = BLOCK_CHARS, added: bool = False) -> DataFrame:
    """Write the ids of docs (doc_id, text) as shards under uri, in ascending order of doc_id; return the manifest:
    (shard, n_docs, n_ids, start), where start counts the ids in all shards before. added: whether the strings of the
    tokenizer's added tokens become their ids, as in the library's encode."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(Path(tokenizer_path).read_text("utf-8"))
    docs = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = dealt.mapInArrow(lambda it: _write(it, model.value, uri, end_id, shard_ids, block_chars, added), "shard string, n_docs long, n_ids long")
    manifest = stored(rows, "manifest")
    # one row for each shard of millions of ids, so that one task can add them up
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, content in zip(batch["start"].to_pylist(), batch["content"].to_pylist(), strict=True):
            docs, ids, ef = read_shard(content)
            begins, ends = ef.spans()
            if len(ids):
                offsets = pa.array(np.append(begins, len(ids)), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(begins + start, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int64)))], ["doc_id", "start", "ids"])


def _files(manifest: DataFrame, uri: str) -> DataFrame:
    spark = manifest.sparkSession
    schema = "path string, modificationTime timestamp, length long, content binary"
    # a shard is tens of MB at most; a few of them make a task
    files = spark.read.schema(schema).format("binaryFile").option("pathGlobFilter", "shard-*.fsid").load(uri)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("shard"), "content")
    return named.join(manifest, "shard").select("start", "content")


def read(manifest: DataFrame, uri: str) -> DataFrame:
    """(doc_id, start, ids array<long>) of every document in the shards of the manifest."""
    if manifest.isEmpty():
        return manifest.sparkSession.createDataFrame([], "doc_id long, start long, ids array<long>")
    return _files(manifest, uri).mapInArrow(_read, "doc_id long, start long, ids array<long>")


def _read_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, content in zip(batch["start"].to_pylist(), batch["content"].to_pylist(), strict=True):
            docs, ids, ef = read_shard(content)
            begins, ends = ef.spans()
            wide = ids.astype("<u4")
            crcs = [crc32(wide[a:b].tobytes()) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(begins + start, pa.int64()), pa.array(ends - begins, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(manifest: DataFrame, uri: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the shards."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if manifest.isEmpty():
        return manifest.sparkSession.createDataFrame([], schema)
    return _files(manifest, uri).mapInArrow(_read_digests, schema)


def fresh_uri(docs: DataFrame) -> str:
    return shared_path(docs.sparkSession, "token-ids")
