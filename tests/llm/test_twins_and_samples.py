"""Words of equal hashes, rows that share a doc_id, rare languages, and what the models are fitted on."""

import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from folioscope.llm import bpe, langid, neardup, pretokens, tokenbin, toxicity

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


def twins(n):
    word = "".join("ab"[bin(k).count("1") & 1] for k in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def check_ids(texts, got):
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for k, text in enumerate(texts):
        assert got[k] == own.encode_ordinary(text)


def test_twin_words_keep_their_own_ids(spark):
    texts = [*twins(1024), *twins(4096), "plain text"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    check_ids(texts, {r.doc_id: r.ids for r in bpe.encode(df, RANKS).collect()})
    library = Tokenizer.from_file(JSON)
    ids, ends = tokenbin.WordEncoder(open(JSON).read()).encode(texts, 0)
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [[*library.encode(t).ids, 0] for t in texts]


def test_words_of_one_hash(monkeypatch):
    """Were all hashes equal, ids would still be those of the words."""
    monkeypatch.setattr(pretokens, "span_hashes", lambda u, codes, starts, ends: np.full(len(starts), 7, np.uint64))
    monkeypatch.setattr(pretokens, "COMPARED", 5)
    texts = ["one two one", "six", "", "two six ten and more of it"]
    codes, counts, words, _ = pretokens.block(texts)
    assert "".join(words[c] for c in codes) == "".join(texts) and counts.tolist() == [3, 1, 0, 7]
    library, encoder = Tokenizer.from_file(JSON), tokenbin.WordEncoder(open(JSON).read())
    for part in (["abc"], ["xyz"], texts, ["abc"]):
        ids, ends = encoder.encode(part, 0)
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [[*library.encode(t).ids, 0] for t in part]


def test_twin_shingles_are_not_linked(spark):
    a, b = twins(2048)
    filler = [" ".join(f"{w}{k}" for k in range(3)) for w in "pq"]
    rows = [(1, f"{a} " * 40 + filler[0]), (2, f"{b} " * 40 + filler[1]), (3, a), (4, b), (5, a), (6, None), (None, a)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 3, 6: 6, None: None}


def test_one_copied_text_over_many_rows(spark, monkeypatch):
    """Rows of one digest are dealt over groups when they are many."""
    monkeypatch.setattr(neardup, "HEAVY", 5)
    rows = [(k, "the same five words and more") for k in range(60)] + [(k, "") for k in range(60, 90)] + [(90, None)]
    got = {r.doc_id: (r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: (0, k == 0) if k < 60 else (k, True) for k in range(91)}


def test_language_sample_is_bounded_by_rows_and_holds_rare_languages(spark, monkeypatch):
    collected = []
    monkeypatch.setattr(langid.Network, "train", lambda self, windows, labels, weights, **options: collected.append(len(windows)))
    rows = [(7, f"wort und noch eines {k}", "de") for k in range(3000)] + [(7, f"word and one more {k}", "en") for k in range(3000)]
    rows += [(7, "mot rare", "fr"), (8, "copy", "en"), (8, "copy", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.fit(df, sample=10)
    assert net.langs == ["de", "en", "fr"]
    assert len(collected) == 1 and collected[0] <= langid.WINDOWS * (2 * 10 + 3 * langid.SURE)
    assert langid.fit(df.limit(0), sample=10).langs == []


def test_toxicity_learns_one_row_of_each_doc_id(spark, monkeypatch):
    seen = []
    held = toxicity.label_model
    monkeypatch.setattr(toxicity, "label_model", lambda votes, *rest: (seen.append(len(votes)), held(votes, *rest))[1])
    docs = [(1, f"bad vile nasty text {k}") for k in range(3000)] + [(k, f"{'bad vile nasty' if k % 2 else 'calm kind good'} words {k % 5}") for k in range(2, 80)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 80)], "doc_id long, toxic int")
    toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), labels, sample=60)
    assert seen and max(seen) <= 60


def test_polynomial_hashes_would_collide():
    """The twins are what they are said to be: one value for both, for any odd base modulo 2^64."""
    a, b = (np.frombuffer(w.encode(), np.uint8).astype(object) for w in twins(2048))
    base = 0x9E3779B97F4A7C15
    value = lambda w: sum(int(c) * pow(base, k, 1 << 64) for k, c in enumerate(w)) % (1 << 64)
    assert value(a) == value(b) and hashlib.sha256(bytes(a)).digest() != hashlib.sha256(bytes(b)).digest()
