"""Operator 12: best-fit packing of token sequences, by hierarchical residual packing.

1. One scan encodes each text, adds the end id and cuts what is longer than a sequence into pieces. A piece of full length
   is a sequence by itself; the others are items. Each task deals its items of similar length in turn, so that all
   groups get the same mix of lengths.
2. Groups of about ``GROUP`` items are packed locally by best fit, longest first. Bins with at most ``NEARLY`` free places
   are emitted.
3. Of the underfull ones, a group's bins up to half full (best fit leaves one at most) and its ``FAN_IN`` emptiest others go up:
   the groups are merged ``FAN_IN`` at a time and the bins are packed again, as items, until one group is left. Two bins
   over half full never fit together, so that no other underfull bin could gain by going up; they are emitted as they are.

A group never holds more than about GROUP items, or FAN_IN * (FAN_IN + 1) bins in later rounds, whatever the input. Rounds
are written to the shared folder.

Texts are encoded word by word: the tokenizer's pre-tokens don't span white space (its file is compared with the pattern
that this module knows), so that a text's ids are those of its words, one after another. Words are known by their bytes.

Defined results: a null text is empty and holds only the end id; repeated rows are all packed; a null doc_id is kept; an
empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import blocks, bounded, crc32, expand, mix, release, stored, task_id, texts_of

CAPACITY, END_ID = 4096, 1
GROUP, FAN_IN, NEARLY = 4096, 8, 32
#: Items whose lengths share a band are dealt in turn.
BAND = 64
#: Words and ids that a task keeps in mind; beyond, it begins anew.
WORDS, IDS = 500_000, 1 << 22


# --------------------------------------------------------------------------- encoding by the tokenizers library


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for; fresh: those not yet encoded."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.fresh.append(word)
        number = self[word] = len(self)
        return number


#: The tokenizer's pattern for words of printable ASCII signs and Latin-1 letters in lower case, and the pattern itself.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+").fullmatch
_MARKS = regex.compile(r"\p{M}")


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in the vocabulary: printable bytes for themselves, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {b: chr(b) if b in printable else chr(next(spare)) for b in range(256)}


_LETTERS = _byte_letters()


class WordwiseEncoder:
    """Ids of texts by a tokenizer of the tokenizers library whose pre-tokens don't span white space and that lowers case,
    as its encode gives them without special tokens around. Words of printable ASCII signs and Latin-1 letters, which no
    normal form changes, are cut by its pattern, and each part is given to its model once; others, and words that may hold
    an added token, go through the library whole."""

    def __init__(self, config: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        held = json.loads(config)
        pre = (held.get("pre_tokenizer") or {}).get("pretokenizers", [])
        normal = [x["type"] for x in (held.get("normalizer") or {}).get("normalizers", [])]
        fits = len(pre) == 2 and pre[0]["type"] == "Split" and pre[0]["invert"] and pre[0]["behavior"] == "Removed" and pre[0]["pattern"].get("Regex") == _PATTERN
        if not fits or pre[1]["type"] != "ByteLevel" or pre[1]["use_regex"] or normal != ["NFC", "Replace", "Lowercase"] or held.get("post_processor") or held.get("truncation"):
            raise ValueError("a tokenizer is needed that splits at white space, drops it and lowers case")
        if any("<|" not in t["content"] or t["normalized"] for t in held["added_tokens"]):
            raise ValueError("added tokens are told by <| in the text as it is")
        self.tokenizer = Tokenizer.from_str(config)
        self.model = self.tokenizer.model
        self.clear()

    def clear(self) -> None:
        self.numbers, self.parts = _Numbers(), {}
        self.lens, self.starts, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _part(self, part: str) -> list[int]:
        mapped = part if part.isascii() else part.encode("utf-8").decode("latin-1").translate(_LETTERS)
        found = self.parts[part] = [t.id for t in self.model.tokenize(mapped)]
        return found

    def _learn(self) -> None:
        words, self.numbers.fresh = self.numbers.fresh, []
        if not words:
            return
        found, known, other = [], self.parts, []
        texts = [w.decode("utf-8", "replace") for w in words]
        for word in texts:
            if _PLAIN(word) and "<|" not in word:
                parts = _PARTS.findall(word.lower())
                if len(parts) == 1:
                    found.append(known.get(parts[0]) or self._part(parts[0]))
                else:
                    found.append([i for p in parts for i in known.get(p) or self._part(p)])
            else:
                other.append(len(found))
                found.append([])
        for at in range(0, len(other), 4096):
            part = other[at : at + 4096]
            encoded = self.tokenizer.encode_batch([texts[k] for k in part], add_special_tokens=False)
            for k, e in zip(part, encoded, strict=True):
                found[k] = e.ids
        lens = np.fromiter(map(len, found), np.int64, len(found))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lens) - lens])
        self.lens = np.concatenate([self.lens, lens])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.uint32, int(lens.sum()))])

    def _words(self, text: str) -> list[bytes]:
        raw = text.encode("utf-8", "surrogatepass")
        # a mark may join a letter in one case and not in the other; what looks like an added token is one as it is only
        if "<|" not in text and (text.isascii() or not _MARKS.search(text)):
            raw = raw.lower()
        return raw.split()

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, each with end_id after it, and the end of each."""
        if len(self.numbers) > WORDS or len(self.flat) > IDS:
            self.clear()
        words = list(map(self._words, texts))
        codes = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(words)), np.int64, sum(map(len, words)))
        self._learn()
        token_lens = self.lens[codes]
        body = self.flat[expand(self.starts[codes], token_lens)]
        counts = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        ends = np.concatenate([[0], np.cumsum(token_lens)])[counts] + np.arange(1, len(texts) + 1)
        ids = np.full(len(body) + len(texts), end_id, np.uint32)
        inner = np.ones(len(ids), bool)
        inner[ends - 1] = False
        ids[inner] = body
        return ids, ends


@lru_cache(2)
def wordwise_encoder(config: str) -> WordwiseEncoder:
    return WordwiseEncoder(config)


_PIECE = "item long, turn long, doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(batches: Iterator[pa.RecordBatch], config: str, end_id: int, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encoder, part = wordwise_encoder(config), task_id()
    item, bands = part << 40, capacity // BAND + 1
    turns = (mix(np.arange(bands, dtype=np.uint64) + np.uint64(part * bands)) >> np.uint64(24)).astype(np.int64).tolist()
    for batch in blocks(batches):
        ids, ends = encoder.encode(texts_of(batch), end_id)
        out = []
        begin = 0
        for doc_id, end in zip(batch["doc_id"].to_pylist(), ends.tolist(), strict=True):
            for k, at in enumerate(range(begin, end, capacity)):
                piece = ids[at : min(at + capacity, end)]
                band = len(piece) // BAND
                out.append((item, turns[band], doc_id, k, at - begin, len(piece), crc32(piece.astype("<u4").tobytes()), piece.tolist() if with_ids else None))
                turns[band] += 1
                item += 1
            begin = end
        kinds = [("item", pa.int64()), ("turn", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], kind) for j, (_, kind) in enumerate(kinds)], [name for name, _ in kinds])
    release()


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(item, turn, doc_id, piece, start, length, ids_crc32) of every piece of docs (doc_id, text), written to the shared
    folder; with_ids: also its ids."""
    config = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text("utf-8"))
    docs = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = docs.mapInArrow(lambda it: _pieces(it, config.value, end_id, capacity, with_ids), _PIECE + ", ids array<int>" * with_ids)
    return stored(rows, "pieces")


# --------------------------------------------------------------------------- packing


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best fit of sizes in the given order: each one's bin and place there, and the free places of each bin. Bins are
    found by their free places: the lowest bit set, from the size on, of a number that has a bit for each such count."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    held, free, bins, places = 0, [], [], []
    for size in sizes:
        above = held >> size
        if above:
            left = size + (above & -above).bit_length() - 1
            k = stacks[left].pop()
            if not stacks[left]:
                held ^= 1 << left
        else:
            left, k = capacity, len(free)
            free.append(capacity)
        bins.append(k)
        places.append(capacity - left)
        free[k] = left = left - size
        stacks[left].append(k)
        held |= 1 << left
    return bins, places, free


def _round(table: pa.Table, capacity: int, hosts: int, nearly: int, last: bool) -> pa.Table:
    """One group: its bins are packed as items. Rows keep their bin and place up to date; a bin bears the number of its
    first item. goes: whether the bin goes up to the next round."""
    bin_of, place, length = (table[c].to_numpy() for c in ("sequence_id", "offset", "length"))
    ids, inverse = np.unique(bin_of, return_inverse=True)
    fill = np.bincount(inverse, weights=length, minlength=len(ids)).astype(np.int64)
    order = np.lexsort((ids, -fill))
    bins, places, free = map(np.array, best_fit(fill[order].tolist(), capacity))
    names = np.zeros(len(free), np.int64)
    first = np.unique(bins, return_index=True)[1]
    names[bins[first]] = ids[order[first]]
    new_bin, new_place = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    new_bin[order], new_place[order] = bins, places
    goes = np.zeros(len(free), bool)
    if not last:
        goes = 2 * (capacity - free) <= capacity
        rest = np.flatnonzero(~goes & (free > nearly))
        goes[rest[np.lexsort((names[rest], -free[rest]))[:hosts]]] = True
    mine = new_bin[inverse]
    found = {"sequence_id": names[mine], "offset": place + new_place[inverse], "goes": goes[mine]}
    return pa.table([pa.array(found[c]) if c in found else table[c] for c in table.column_names], names=table.column_names)


def _packer(capacity: int, hosts: int, nearly: int, last: bool) -> Callable[[pa.Table], pa.Table]:
    return lambda table: _round(table, capacity, hosts, nearly, last)


def place_items(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP, fan_in: int = FAN_IN, nearly: int = NEARLY) -> DataFrame:
    """items (item, unique; turn; length, from 1 to capacity; others) with sequence_id and offset, without turn. items
    must be a stored table, which is read twice."""
    spare = items.filter(F.col("length") >= capacity)
    columns = [c for c in items.columns if c != "turn"]
    fixed = lambda df: df.select(*columns, "sequence_id", "offset")
    out = [fixed(spare.withColumns({"sequence_id": F.col("item"), "offset": F.lit(0).cast("long")}))]
    small = items.filter(F.col("length") < capacity)
    nodes = max(1, -(-small.count() // group))
    rows = small.select(*columns, F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("goes"), F.pmod("turn", F.lit(nodes)).alias("node"))
    while True:
        last = nodes == 1
        done = stored(rows.groupBy("node").applyInArrow(_packer(capacity, fan_in, nearly, last), rows.schema), f"packed-{nodes}")
        out.append(fixed(done.filter(~F.col("goes"))))
        if last:
            break
        nodes = -(-nodes // fan_in)
        rows = done.filter("goes").withColumn("node", F.expr(f"node div {fan_in}"))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, **options) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of docs (doc_id, text)."""
    return place_items(pieces(docs, tokenizer_path, capacity, end_id), capacity, **options).drop("item")


def sequences(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, **options) -> DataFrame:
    """(sequence_id, doc_ids, lengths, ids) of the packed sequences: at most capacity ids each."""
    found = pieces(docs, tokenizer_path, capacity, end_id, with_ids=True)
    placed = place_items(found.drop("ids"), capacity, **options).join(found.select("item", "ids"), "item")
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    by = placed.groupBy("sequence_id").agg(parts.alias("parts"))
    return by.select("sequence_id", F.col("parts.doc_id").alias("doc_ids"), F.col("parts.length").alias("lengths"), F.flatten("parts.ids").alias("ids"))
