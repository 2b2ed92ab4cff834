"""Operators 2, 5, 6, 8 and 9 against brute force and round trips."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import chat, gif, licenses, mixing, topk

# --------------------------------------------------------------------------- 2


def brute_top(rows, k=5):
    import struct

    as_float = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    clean = [(i, [math.floor(256 * as_float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i in sorted({i for i, _ in clean if i % 50 == 0}):
        q = min(v for j, v in clean if j == i)
        hits = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in clean if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(hits)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_top_k_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(topk, "SEEDS", 40)
    rng = random.Random(seed)
    rows = [(k, [rng.gauss(0, 1) for _ in range(6)]) for k in range(300)]
    rows += [(k, list(rows[k % 7][1])) for k in range(300, 360)]  # ties
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (404, []), (450, [1.0, 2.0]), (None, [1.0]), (5, list(rows[5][1])), (50, list(rows[50][1]))]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, "vec_id % 50 = 0").collect())
    assert got == brute_top(rows)


def test_top_k_small_tables(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df, "vec_id % 50 = 0").collect()] == [(0, 1, 1, 256 * 512)]
    assert topk.top_k(df.limit(0), "vec_id % 50 = 0").count() == 0


def test_few_rows_of_each_task_are_sent_for_the_seeds(spark, monkeypatch):
    monkeypatch.setattr(topk, "SEEDS", 50)
    rows = spark.range(0, 20_000, 1, 16).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double")).alias("v"))
    got = [r.vec_id for r in topk._seeds(rows, 20_000)]
    assert got == [r.vec_id for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(50).collect()]
    assert len(topk._seeds(rows.withColumn("vec_id", F.lit(7)), 20_000)) == 50  # one hash: the bound is raised until rows are below it
    limits = []
    kept = type(rows).filter
    monkeypatch.setattr(type(rows), "filter", lambda self, by: limits.append(kept(self, by)) or limits[-1])
    topk._seeds(rows, 20_000)
    assert limits[0].count() < 16 * 50 / 2  # of the rows that 16 tasks would send


def test_triangle_bounds_leave_annuli_out():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 1, (512, 4)) for c in (0, 60)]).round()
    index = topk.Index(np.arange(4), np.array([[0.0] * 4, [60.0] * 4, [0, 60, 0, 60], [60, 0, 0, 0]]), float((x * x).sum(1).max()))
    d = index.distances(index.lift(x), index.pivots[:1])[:, 0]
    order = np.argsort(d)
    q = x[order[-3:]]
    found, work = topk.search_run(index, 0, np.arange(len(x)), d[order], x[order], np.array([5000, 5001, 5002]), q, np.full(3, -np.inf), 5)
    exact = [sorted((-(q[j] @ v), k) for k, v in enumerate(x[order]))[:5] for j in range(3)]
    assert sorted(found) == sorted((5000 + j, k, int(-s)) for j in range(3) for s, k in exact[j])
    assert work < 0.7 * 3 * len(x)


def test_no_run_leaves_out_a_score_of_any_norm():
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 1, (12, 16))
    x = centres[rng.integers(0, 12, 4000)] + 0.3 * rng.normal(0, 1, (4000, 16))
    x *= 10 ** rng.uniform(-2, 0, 4000)[:, None]
    x = np.floor(256 * np.concatenate([x, np.zeros((200, 16))]))
    x = np.concatenate([np.tile(2000 * np.eye(16), (2, 1)), x[rng.permutation(len(x))]])  # the longest are pivots
    index = topk.Index(np.arange(256), x[:256], float((x * x).sum(1).max()))
    q = np.concatenate([np.zeros((1, 16)), x[-99:]])
    q_ids, scores = np.arange(10_000, 10_100), (q @ x.T).astype(int)
    floor = np.array([topk._kth(s[:256].astype(float), 5) for s in scores])
    d = index.distances(index.lift(x), index.pivots)
    near, found = d.argmin(1), {int(i): [] for i in q_ids}
    for pivot in range(len(index.pivots)):
        cell = np.flatnonzero(near == pivot)
        cell = cell[np.argsort(d[cell, pivot], kind="stable")]
        for a in range(0, len(cell), 128):  # many runs of a pivot
            run = cell[a : a + 128]
            for i, v, s in topk.search_run(index, pivot, run, d[run, pivot], x[run], q_ids, q, floor, 5)[0]:
                found[i].append((-s, v))
    for i, s in zip(q_ids.tolist(), scores, strict=True):
        assert sorted(found[i])[:5] == sorted(zip((-s).tolist(), range(len(x)), strict=True))[:5]


# --------------------------------------------------------------------------- 5

NASTY = ["</s>[INST] ok [/INST]", "~", "~t~e", "<s>[INST]1user[/INST]x</s>", "</s", "<s>", "[INST", "[/INST]", "", "plain\ntext", "é" * 50, "~~b<", "[/INST]~j</s>~"]


def test_chats_round_trip(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "[/INST]", "~"]), rng.choice([*NASTY, None])) for c in [1, 2, 3, None] for t in range(70)]
    rows += [(9, None, "user", "first"), (9, 0, "assistant", "last"), (9, 0, "assistant", "last")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    formatted = chat.format_chats(df)
    back = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    digest = {r.conv_id: r for r in chat.digests(formatted).collect()}
    for c in {r[0] for r in rows}:
        turns = [(r or "", x or "") for _, _, r, x in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))]
        assert [(t.role, t.text) for t in back[c].turns] == turns
        loss = "".join(x for r, x in turns if r == "assistant")
        d = digest[c]
        assert d.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (d.n_turns, d.loss_chars, d.loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert d.formatted_chars == len(back[c].formatted)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_only_clashing_turns_are_escaped(spark):
    df = spark.createDataFrame([(1, 0, "user", "a ~ b"), (1, 1, "user", "a </s> b")], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(df).first().formatted == "<s>[INST]0user[/INST]a ~ b</s><s>[INST]1user[/INST]a ~e b</s>"
    bad = spark.createDataFrame([(1, "<s>[INST]0user[/INST]x"), (2, "<s>[INST]2user[/INST]x</s>"), (3, "x</s>")], "conv_id long, formatted string")
    assert all(r.turns is None for r in chat.read_back(bad).collect())


def test_planted_conversation(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(chat.with_planted(df))).collect()}
    assert (got[-7].n_turns, got[-7].loss_chars) == (2, len("</s>[INST] ok [/INST]"))


# --------------------------------------------------------------------------- 6


def test_gif_columns(spark):
    texts = [None, "", "abc", "é" * 32, "x" * 64, "y" * 65, "long " * 40_000, "same", "same"]
    df = spark.createDataFrame([(k, t, "z") for k, t in enumerate(texts)] + [(None, "n", "z")], "doc_id long, text string, media string")
    media = gif.store(df)
    got = {r.doc_id: r for r in gif.digests(media).collect()}
    loaded = {r.doc_id: r for r in gif.load(media).collect()}
    for k, t in [*enumerate(texts), (None, "n")]:
        data = (t or "").encode()
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert bytes(loaded[k].payload) == payload
        assert r.media_bytes == len(loaded[k].media)
        assert r.media_sha256 == hashlib.sha256(loaded[k].media).hexdigest()
        assert sum(map(sum, (f.histogram for f in loaded[k].frames))) == len(payload)
    assert got[7].media_sha256 == got[8].media_sha256
    assert len(loaded[6].frames) == 4
    assert gif.store(df.limit(0)).count() == 0


def lzw_read(data, min_size):
    """An LZW stream read code by code."""
    clear, out, last, at = 1 << min_size, bytearray(), b"", 0
    bits = "".join(f"{b:08b}"[::-1] for b in data)
    table, size = [], min_size + 1
    while True:
        code, at = int(bits[at : at + size][::-1], 2), at + size
        if code == clear:
            table, size, last = [bytes([k]) for k in range(clear)] + [b"", b""], min_size + 1, b""
            continue
        if code == clear + 1:
            return bytes(out)
        word = table[code] if code < len(table) else last + last[:1]
        out += word
        if last and len(table) < 4096:
            table.append(last + word[:1])
            size += len(table) == 1 << size and size < 12
        last = word


@pytest.mark.parametrize("min_size", [2, 5, 8])
def test_lzw_encoder_is_read_code_by_code(min_size):
    rng = np.random.default_rng(min_size)
    for n in (0, 1, 2, 3, 700, 30_000):
        for top in (1, 2, 1 << min_size):
            samples = rng.integers(0, top, n).astype(np.uint8).tobytes()
            data = gif.lzw_encode(samples, min_size)
            assert lzw_read(data, min_size) == samples == gif.lzw_decode(data, min_size).tobytes()
    text = ("strings of words that come again and again " * 400).encode()
    assert len(gif.lzw_encode(text)) < len(text) / 5
    with pytest.raises(ValueError):
        gif.lzw_decode(np.packbits([0, 0, 0, 0, 0, 0, 0, 0, 1] + [1] * 9, bitorder="little").tobytes(), 8)


def lzw_reference(samples, min_size):
    """A growing-code LZW encoder, for the decoder's sake."""
    clear = 1 << min_size
    table, size, bits, word = {bytes([k]): k for k in range(clear)}, min_size + 1, [], b""
    put = lambda code: bits.extend(code >> k & 1 for k in range(size))
    put(clear)
    n = clear + 2
    for s in samples:
        if word + bytes([s]) in table:
            word += bytes([s])
            continue
        put(table[word])
        if n < 4096:
            table[word + bytes([s])] = n
            if n == 1 << size and size < 12:
                size += 1
            n += 1
        word = bytes([s])
    if word:
        put(table[word])
        if n == 1 << size and size < 12:
            size += 1
    put(clear + 1)
    return np.packbits(np.array(bits, np.uint8), bitorder="little").tobytes()


@pytest.mark.parametrize("min_size", [2, 4, 8])
def test_lzw_decoder_on_growing_codes(min_size):
    rng = np.random.default_rng(min_size)
    for n in (1, 5, 300, 30_000):
        samples = (rng.integers(0, 1 << min_size, n) // rng.integers(1, 3, n)).astype(np.uint8)
        assert np.array_equal(gif.lzw_decode(lzw_reference(samples.tolist(), min_size), min_size), samples)


def test_gif_palettes_disposal_and_transparency():
    def frame(left, top, w, h, pixels, disposal=0, clear=None, palette=None, delay=7):
        u16 = lambda v: v.to_bytes(2, "little")
        control = b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None)]) + u16(delay) + bytes([clear or 0, 0])
        local = bytes([0x80 | 1]) + bytes(palette) if palette else b"\0"
        return control + b"\x2c" + u16(left) + u16(top) + u16(w) + u16(h) + local + b"\x02" + gif._sub_blocks(lzw_reference(pixels, 2))

    red, green, blue, white = (255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 255)
    head = b"GIF89a\x02\0\x02\0\xf1\0\0" + bytes(v for c in (red, green, blue, white) for v in c)
    data = head + frame(0, 0, 2, 2, [0, 0, 0, 0], 1) + frame(0, 0, 2, 1, [1, 3], 3, clear=3) + frame(1, 1, 1, 1, [2], 2) + frame(0, 0, 1, 1, [0], palette=[9] * 12) + b"\x3b"
    shown = [[tuple(p) for p in canvas.reshape(-1, 3).tolist()] for canvas, _, _ in gif.frames(data)]
    assert shown == [[red] * 4, [green, red, red, red], [red, red, red, blue], [(9, 9, 9), red, red, (0, 0, 0)]]
    assert [d for _, _, d in gif.frames(data)] == [7] * 4


# --------------------------------------------------------------------------- 8


def brute_scan(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    places = sorted((k, label) for p, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))


LICENSED = ["Under the MIT-License! under the mit license", "cc by nc by nc", "cc cc by nc cc by nc", "Apache License, Version 2.0", "ÀPACHE license version 2", "apache license version 2é", "", None, " .. ", "mit", "x " * 30_000 + "CC-BY-NC", "under the mit license cc by nc apache license version 2", "naïve\x80 under the mit\tlicense"]


def test_license_scan_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    words = ["under", "the", "mit", "license", "cc", "by", "nc", "apache", "version", "2", "Ünder", "x"]
    texts = LICENSED + [rng.choice([" ", "-", " \n"]).join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(300)]
    df = spark.createDataFrame([(k, t, "w") for k, t in enumerate(texts)], "doc_id long, text string, words string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in licenses.query(spark, str(tmp_path)).collect()}
    for k, t in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_scan(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1
    assert licenses.scan(df.limit(0)).count() == 0


def test_license_notices_need_their_key_phrases(spark):
    gpl = "You can redistribute it and/or modify it under the terms of the GNU General Public License"
    texts = [gpl, gpl.replace("redistribute", "share"), gpl.replace("GNU", "ABC"), "the terms of the GNU General Public License", "All rights  reserved."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [list(r.labels) for r in licenses.scan(df).orderBy("doc_id").collect()] == [["gpl"], ["gpl"], [], [], ["proprietary"]]


def brute_passages(text):
    """Every start of every passage at which enough words agree, where the key phrases stand in the file."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    holds = lambda p: any(words[k : k + len(p)] == p for k in range(len(words)))
    found = []
    for label, t, keys in licenses.NOTICES:
        t = t.split()
        if all(holds(key.split()) for key in keys):
            for s in range(1 - len(t), len(words)):
                agree = sum(0 <= s + k < len(words) and words[s + k] == w for k, w in enumerate(t))
                if agree >= math.ceil(licenses.NOTICE_SHARE * len(t)):
                    found.append((s, label))
    return sorted(found)


def test_passages_equal_brute_force(spark):
    rng = random.Random(18)
    texts = []
    for _ in range(160):
        words = []
        for _ in range(rng.randrange(1, 4)):
            _, t, keys = rng.choice(licenses.NOTICES)
            part = [w if rng.random() < 0.9 else rng.choice(["x", "the", "license"]) for w in t.split()]
            words += part[rng.choice([0, 0, 0, 2, 4]) :] + rng.choice([[], keys[0].split(), ["and", "so"]])
        texts.append(rng.choice([" ", "\n", ", "]).join(words))
    texts += [t for _, t, _ in licenses.NOTICES] + ["", None, "all rights reserved " * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: sorted((p.start, p.label) for p in r.notices) for r in licenses.scan(df).collect()}
    assert got == {k: brute_passages(t) for k, t in enumerate(texts)}
    assert sum(map(len, got.values())) > 250


def test_index_shares_two_postings_with_any_start_that_counts():
    idf = {w: float(len(w)) for w in licenses._vocabulary()}
    held = {}
    for word, places in licenses.postings(idf).items():
        for t, k in places:
            assert licenses.templates()[t][1][k] == word
            held[t] = held.get(t, 0) + 1
    for t, (_, words, whole, _) in enumerate(licenses.templates()):
        assert held[t] - (len(words) - licenses.needed(words, whole)) == 2


# --------------------------------------------------------------------------- 9


def test_schedule_deviates_by_less_than_a_block():
    blocks, weights = {"a": 400, "b": 90, "c": 30, None: 7}, {"a": 0.4, "b": 0.35, "c": 0.15, None: 0.1}
    order = mixing.schedule(blocks, weights)
    assert sorted(order, key=str) == sorted(((s, k) for s, n in blocks.items() for k in range(n)), key=str)
    done, begin, live = dict.fromkeys(blocks, 0), 0, set(blocks)
    base = dict(done)
    for t, (s, k) in enumerate(order):
        assert k == done[s]
        done[s] += 1
        total = sum(weights[x] for x in live)
        for x in live:
            assert abs(done[x] - base[x] - (t + 1 - begin) * weights[x] / total) < 1
        if done[s] == blocks[s]:
            live.discard(s)
            begin, base = t + 1, dict(done)
    assert not live


def test_mix_places_every_row_once(spark):
    rows = [(k % 500, f"t{k % 3}", ["a", "a", "a", "b", None][k % 5], k) for k in range(1000)] + [(None, None, "c", 1), (None, None, "c", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, label int")
    got = mixing.mix(df, weights={"a": 0.5, "b": 0.5, "c": 0.0}, block=10).collect()
    assert sorted(r.mix_place for r in got) == list(range(len(rows)))
    by_place = sorted(got, key=lambda r: r.mix_place)
    assert [r.mix_slot for r in by_place] == sorted(r.mix_slot for r in got)
    first = [r.source for r in by_place[:150]]
    assert abs(first.count("a") - first.count("b")) <= 20
    assert sorted(map(str, ((r.doc_id, r.text, r.source, r.label) for r in got))) == sorted(map(str, rows))
    again = {(r.mix_place, r.doc_id) for r in mixing.mix(df.repartition(3), weights={"a": 0.5, "b": 0.5, "c": 0.0}, block=10).collect()}
    assert again == {(r.mix_place, r.doc_id) for r in got}
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mixed_rows(df).columns == df.columns


def slot_by_slot(blocks, weights):
    """The schedule by its definition: in each slot look at every source's next block."""
    from fractions import Fraction

    share = {s: Fraction(w).limit_denominator(10**6) for s, w in weights.items()}
    done, out = dict.fromkeys(blocks, 0), []
    live = sorted((s for s in blocks if blocks[s]), key=lambda s: (s is None, s or ""))
    while live:
        total, phase, slot = sum(share[s] for s in live), dict.fromkeys(live, 0), 0
        while all(done[s] < blocks[s] for s in live):
            open_ = []
            for k, s in enumerate(live):
                w, j = share[s] / total, phase[s]
                if slot >= j / w // 1:
                    open_.append((-(-(j + 1) / w // 1), k, s))
            if open_:
                s = min(open_)[2]
                out.append((s, done[s]))
                done[s] += 1
                phase[s] += 1
            slot += 1
        live = [s for s in live if done[s] < blocks[s]]
    return out


def test_schedule_equals_slot_by_slot():
    rng = random.Random(9)
    for _ in range(60):
        names = rng.sample(["a", "b", "c", "d", None], rng.randrange(1, 6))
        blocks = {s: rng.randrange(0, 40) for s in names}
        weights = {s: rng.choice([0.1, 0.25, 0.3, 0.5, 1.0, 3.0]) for s in names}
        assert mixing.schedule(blocks, weights) == slot_by_slot(blocks, weights)


def test_places_equal_a_plain_reckoning(spark):
    """Ranks by sorting each source, places by walking the schedule."""
    from pyspark.sql import functions as F

    rows = [(k, f"text {k % 97}", ["a", "a", "a", "b", None][k % 5]) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.mix_slot, r.mix_place) for r in mixing.mix(df, block=16).collect()}
    cells = -(-len(rows) // mixing.CELL)
    keyed = df.select("doc_id", "source", F.xxhash64("doc_id", "source", "text").alias("h")).collect()
    queues = {}
    for r in sorted(keyed, key=lambda r: ((r.h >> 8) % cells, r.h, r.doc_id)):
        queues.setdefault(r.source, []).append(r.doc_id)
    counts = {s: len(q) for s, q in queues.items()}
    at = 0
    for slot, (s, b) in enumerate(mixing.schedule({s: -(-n // 16) for s, n in counts.items()}, mixing.default_weights(counts))):
        for doc in queues[s][16 * b : 16 * (b + 1)]:
            assert got[doc] == (slot, at)
            at += 1
    assert at == len(rows)


def test_mix_with_clashing_columns_and_long_texts(spark):
    names = ["fs_key", "fs_cell", "fs_hash", "fs_rank", "block", "slot", "start", "mix_slot", "MIX_PLACE", "a.b", "__mix_hash"]
    rows = [(k, "word " * 50_000 if k == 3 else f"t{k}", "ab"[k % 2], *range(k, k + len(names))) for k in range(50)]
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{c}` int" for c in names)
    df = spark.createDataFrame(rows, schema)
    out = mixing.mix(df)
    assert out.columns == ["doc_id", "text", "source", *names[:7], "mix_slot_input", "MIX_PLACE_input", *names[9:], "mix_slot", "mix_place"]
    got = out.collect()
    assert sorted(r.mix_place for r in got) == list(range(50))
    assert sorted(tuple(r)[:-2] for r in got) == sorted(rows)
    back = mixing.mixed_rows(df)
    assert back.columns == df.columns and sorted(map(tuple, back.collect())) == sorted(rows)
    empty = df.drop("text").limit(0)
    assert mixing.mix(empty).count() == 0 and mixing.mix(df.drop("text")).count() == 50
