"""Operators 11 to 13 against brute force, the tokenizers library and SQL."""

import random
import zlib
from collections import Counter
from fractions import Fraction
from hashlib import sha256
from itertools import permutations

import duckdb
import numpy as np
import public_tokenizers
import pytest

from folioscope.llm import audit, packing, runs

# --------------------------------------------------------------------------- 11


def brute_runs(w):
    """Every maximal stretch of a period, for all periods from the smallest on."""
    n, found = len(w), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(24, 3 * p):
                found.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def periodic(rng):
    """Words with repeated parts, some of them within one another."""
    out = []
    for _ in range(rng.randrange(1, 6)):
        part = [rng.choice("abcd") for _ in range(rng.randrange(1, 12))]
        if rng.random() < 0.3:
            part = (part * 9)[: rng.randrange(1, 9 * len(part) + 1)]
        out += (part * 40)[: rng.randrange(0, 14 * len(part))]
        out += [rng.choice("abcdefgh") for _ in range(rng.randrange(0, 9))]
    return out


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_brute_force(seed, monkeypatch):
    monkeypatch.setattr(runs, "PAIRS", 97)
    rng = random.Random(seed)
    for _ in range(60):
        w = periodic(rng)
        assert list(map(tuple, runs.find_runs(np.array([ord(c) for c in w], np.int64)).tolist())) == brute_runs(w)
    for n in (0, 1, 23, 24, 25, 72, 200):
        assert list(map(tuple, runs.find_runs(np.zeros(n, np.int64)).tolist())) == ([(0, n, 1)] if n >= 24 else [])


def test_runs_where_hashes_collide():
    """Twin words of 2,048 letters have one polynomial hash modulo 2^64, whatever its base."""
    twin = np.array([bin(k).count("1") & 1 for k in range(2048)], np.int64)
    w = np.concatenate([twin, 1 - twin, twin, np.arange(10, 40)])
    assert runs.find_runs(w).tolist() == [list(r) for r in brute_runs(w.tolist())]
    assert len(runs.find_runs(np.concatenate([twin, twin, twin]))) == 1


def brute_document(doc_id, text):
    words = [x for x in "".join(" " if c in " \t\n\v\f\r" else c for c in text or "").split(" ") if x]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    text = " ".join(w for i, w in enumerate(words) if i not in gone)
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(found), *shown, sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(), sha256(text.encode()).hexdigest()


def key(row):
    return tuple((x is None, x) for x in row)


def test_run_digests_of_documents(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice([" ", "\n", "\t ", "\x0b"]).join(periodic(rng)) + rng.choice(["", " "])) for k in range(150)]
    rows += [(k, " ".join(f"w{rng.randrange(30)}" for _ in range(400))) for k in range(150, 260)]
    rows += [(None, "a " * 50), (7, None), (8, ""), (9, " \n "), (10, "é b\u0085c " * 30), (11, "x\x00y " * 30), (3, rows[3][1]), (3, rows[3][1]), (300, "w" * 5000), (301, " ".join(["la la lu"] * 3000))]
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id long, text string, start int, n_runs int")
    assert sorted(map(tuple, runs.digests(df, runs.plant).collect()), key=key) == sorted((brute_document(*r) for r in rows), key=key)
    assert runs.digests(df.limit(0), runs.plant).count() == 0


def test_runs_and_collapsed_texts(spark):
    df = spark.createDataFrame([(1, "so " + "ha hi " * 12 + "end"), (2, "no run")], "doc_id long, text string")
    assert [tuple(r) for r in runs.runs(df).collect()] == [(1, 1, 24, 2)]
    assert sorted(map(tuple, runs.collapsed(df).collect())) == [(1, "so ha hi end"), (2, "no run")]


# --------------------------------------------------------------------------- 12

WORDS = public_tokenizers.path("word_bpe_49k.json")


def brute_pieces(rows, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    out = []
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            out.append((doc_id, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return out


TEXTS = ["Hello World's 123 été É é ́x ﬁ İstanbul ΣΑΣ", "a<|endoftext|>b <|STARTOFTEXT|> <|startoftext|>", "x\x1cy\x85z w v", "don't we'll I'M", "日本語テキスト 한국어 가", "", None, " \n\t ", "🙂🙃 👩‍👩‍👧 a‍b", "﻿bom \x00 nul", "word " * 300, "q" * 3000]


def test_words_of_all_kinds_get_the_ids_of_the_library():
    from tokenizers import Tokenizer

    rng = random.Random(9)
    signs = "abzABZ09'´!-#~<|>.,ÀàÖöØøÿßẞµªº×÷éÉœŒĀāİıſΣσςж中한🙂\u0301\u0300\u00ad\u200d\x7f\x01'st'll're"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 9))) for _ in range(4000)] + ["it's", "IT'S", "Été'll", "ÇA", "naïve", "Straße", "STRASSE", "e\u0301", "E\u0301", "H\u0331", "<|endoftext|>", "x<|endoftext|>É", "<|ENDOFTEXT|>"]
    joined = [" ".join(rng.choice(texts) for _ in range(rng.randrange(6))) for _ in range(1500)]
    library, encoder = Tokenizer.from_file(WORDS), packing.WordwiseEncoder(open(WORDS).read())
    for part in (texts, joined):
        ids, ends = encoder.encode(part, 1)
        want = [[*e.ids, 1] for e in library.encode_batch(part, add_special_tokens=False)]
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == want


def check_packing(placed, capacity):
    sequences = {}
    for r in placed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing_equals_library_and_is_gapless(spark):
    rng = random.Random(2)
    rows = list(enumerate(TEXTS)) + [(k, " ".join(rng.choice(["alpha", "Beta,", "gamma-7", "δ"]) for _ in range(rng.randrange(90)))) for k in range(100, 400)]
    rows += [(None, "no id"), (100, rows[15][1]), (100, rows[15][1])]
    df = spark.createDataFrame([(a, b, 1, 1) for a, b in rows], "doc_id long, text string, length int, piece int").repartition(3)
    placed = packing.pack(df, WORDS, capacity=64, group=40, fan_in=3).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in placed), key=key) == sorted(brute_pieces(rows, 64), key=key)
    count = check_packing(placed, 64)
    lower = -(-sum(r.length for r in placed) // 64)
    assert lower <= count <= 1.08 * lower + 1
    assert packing.pack(df.limit(0), WORDS).count() == 0


def test_packed_sequences_hold_the_ids(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    crcs = Counter((d, n) for d, _, _, n, _ in brute_pieces(list(enumerate(TEXTS)), 50))
    got = packing.sequences(df, WORDS, capacity=50).collect()
    assert all(len(r.ids) == sum(r.lengths) <= 50 for r in got)
    assert Counter((d, n) for r in got for d, n in zip(r.doc_ids, r.lengths, strict=True)) == crcs


def test_best_fit_takes_the_fullest_bin_that_fits():
    rng = random.Random(3)
    for _ in range(30):
        sizes, bins = [rng.randrange(1, 40) for _ in range(200)], []
        got, places, free = packing.best_fit(sizes, 64)
        for size, place, k in zip(sizes, places, got, strict=True):
            open_ = [f for f in bins if f >= size]
            if open_:
                assert bins[k] == min(open_) and place == 64 - bins[k]
            else:
                assert k == len(bins) and place == 0
                bins.append(64)
            bins[k] -= size
        assert bins == free


def test_underfull_bins_meet_in_later_rounds(spark):
    """One item a group: only the merges bring items together. Groups of some items come near to one best fit of all."""
    items = spark.createDataFrame([(k, k, 10 + k % 50) for k in range(64)], "item long, turn long, length long")
    whole = len(packing.best_fit(sorted((10 + k % 50 for k in range(64)), reverse=True), 64)[2])
    for group, most in ((1, 1.25), (8, 1.15)):
        placed = packing.place_items(items, capacity=64, group=group, fan_in=4, nearly=0).collect()
        assert len(placed) == 64
        assert check_packing(placed, 64) <= most * whole


# --------------------------------------------------------------------------- 13


def brute_audit(docs, labels):
    smallest = {}
    for d, t, _ in docs:
        if d is not None:
            smallest[t or ""] = min(d, smallest.get(t or "", d))
    parts = {}
    for d, t, s in docs:
        t = t or ""
        words = [x for x in "".join(" " if c in " \t\n\v\f\r" else c for c in t).split(" ") if x]
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": d is not None and d > smallest[t]}
        good = any(i == d and d is not None and q == 1 for i, q, _ in labels)
        toxic = any(i == d and d is not None and x == 1 for i, _, x in labels)
        parts.setdefault(s or "", []).append((fails, good, toxic))
    out, shapley = {}, Counter()
    for part, rows in parts.items():
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[0][f]]
                left = [r for r in left if not r[0][f]]
                shapley[part, f] += len(gone)
                out[part, "".join(order), step] = (len(left), len(gone), sum(r[0][f] for r in rows) - len(gone), sum([k for k, x in r[0].items() if x] == [f] for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone))
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def audit_rows():
    rng = random.Random(4)
    texts = [None, "", "x " * 60, " ".join(f"w{k}" for k in range(60)), " ".join(f"W{k}" for k in range(60)), "a # b", "É" * 50, "a b c " * 20, "\x0b\x0c\x1c " * 30, " ".join(map(str, range(50))), "50% " + " ".join(map(str, range(80))), "L" * 40000]
    docs = [(k, rng.choice(texts), rng.choice(["s", "s", "s", "t", None, ""])) for k in range(200)]
    docs += [(5, docs[5][1], docs[5][2]), (5, "other", "t"), (None, texts[3], "t"), (None, texts[3], "t"), (-1, texts[3], "u")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 220, 2)] + [(4, 1, 1), (None, 1, 1)]
    return docs, labels


def test_audit_equals_brute_force(spark):
    docs, labels = audit_rows()
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, source string, A int")
    ls = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, text string")
    got = sorted(map(tuple, audit.audit(df, ls).collect()))
    assert got == brute_audit(docs, labels)
    assert audit.audit(df.limit(0), ls).count() == 0
    assert sorted(r[:4] for r in map(tuple, audit.audit(df, ls.limit(0)).collect())) == [r[:4] for r in got]


def test_audit_sql_agrees(spark):
    docs, labels = audit_rows()
    with duckdb.connect() as db:
        db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
        db.execute("CREATE TABLE labels (doc_id BIGINT, quality INTEGER, toxic INTEGER)")
        db.executemany("INSERT INTO documents VALUES (?, ?, ?)", docs)
        db.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
        names = [c[0] for c in db.execute(audit.ORACLE).description]
        got = sorted(map(tuple, db.execute(audit.ORACLE).fetchall()))
    assert names == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert got == brute_audit(docs, labels)
