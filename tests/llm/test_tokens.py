import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from folioscope.llm import bpe, pretokens, tokenbin

RANKS, MODEL = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
TEXTS = ["Hello  world's 12 \n\n x", "", None, "  ", "it's we're'll 'S ''s", "naïve déjà vu 　字 \x1c", "a" * 20_000, "same", "same", "<|endoftext|>", "\t\n x"]


def rows():
    return [(k, t, 7) for k, t in enumerate(TEXTS)] + [(7, "same", 7), (None, "no id", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), "doc_id long, text string, ids int")


def test_bpe_equals_tiktoken_and_round_trips(spark, docs):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = bpe.encode(docs, RANKS)
    got = sorted((r.doc_id is None, r.doc_id or 0, list(r.ids)) for r in encoded.collect())
    assert got == sorted((k is None, k or 0, own.encode_ordinary(t or "")) for k, t, _ in rows())
    back = sorted((r.doc_id is None, r.doc_id or 0, bytes(r.decoded)) for r in bpe.decode(encoded, RANKS).collect())
    assert back == sorted((k is None, k or 0, (t or "").encode()) for k, t, _ in rows())
    digest = {r.doc_id: r for r in bpe.digests(encoded, RANKS).collect()}
    ids = own.encode_ordinary(TEXTS[0])
    assert (digest[0].n_tokens, digest[0].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    assert digest[0].decoded_sha256 == hashlib.sha256(TEXTS[0].encode()).hexdigest()


def test_bpe_of_an_empty_table(spark, docs):
    assert bpe.encode(docs.limit(0), RANKS).count() == 0


def test_pretokens_equal_the_pattern():
    import random

    import regex

    rng, alphabet = random.Random(5), list(" \n\t'stremvld1é!. 　字٣\x1c\x85'")
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(5000)]
    codes, counts, words, hashes = pretokens.block(texts)
    at = 0
    for text, n in zip(texts, counts, strict=True):
        assert [words[k] for k in codes[at : at + n]] == regex.findall(P.PATTERN, text)
        at += n
    assert all(pretokens.hash_word(w) == h for w, h in zip(words[:50], hashes.tolist(), strict=False))


def test_token_files_equal_the_library(spark, docs):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(MODEL)
    uri = tokenbin.fresh_uri(docs)
    manifest = tokenbin.write(docs, MODEL, uri, shard_ids=40, block_chars=30, added=True)
    assert manifest.count() > 2
    want, start = [], 0
    for k, t, _ in sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((k, start, ids))
        start += len(ids)
    order = lambda x: x[1]
    assert sorted(((r.doc_id, r.start, list(r.ids)) for r in tokenbin.read(manifest, uri).collect()), key=order) == want
    crcs = [(k, s, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for k, s, i in want]
    assert sorted((tuple(r) for r in tokenbin.read_digests(manifest, uri).collect()), key=order) == crcs


def test_token_file_query_equals_the_library_on_added_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    from folioscope.llm import entries

    end = "<|endoftext|>"
    texts = [f"{end}at the start", f"in  the {end} middle", f"at the end{end}", end, f" {end} \n{end}{end}'s", "<|endoftext|", "", None, "last"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    own, want, start = Tokenizer.from_file(MODEL), [], 0
    for k, t in enumerate(texts):
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in entries.op10_token_files(spark, str(tmp_path)).collect()) == want


def test_token_files_of_an_empty_table(spark, docs):
    uri = tokenbin.fresh_uri(docs)
    manifest = tokenbin.write(docs.limit(0), MODEL, uri)
    assert tokenbin.read(manifest, uri).count() == tokenbin.read_digests(manifest, uri).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(3)
    for n, top in ((0, 1), (1, 5), (1000, 3), (3000, 10**6), (700, 2**40)):
        values = np.sort(rng.integers(0, top, n))
        ef = tokenbin.EliasFano.of(values)
        assert np.array_equal(ef.select(np.arange(n)), values)
        ks = rng.integers(0, n, 50) if n else np.zeros(0, int)
        assert np.array_equal(ef.select(ks), values[ks])
        if n > 10:
            begins, ends = ef.spans(3, 9)
            assert np.array_equal(begins, values[2:8]) and np.array_equal(ends, values[3:9])
        assert all(ef.get(k) == values[k] for k in range(0, n, 7))
    assert tokenbin.EliasFano.of(np.cumsum(np.full(10_000, 600))).nbytes() < 10_000 * 2
    for ask in (ef.get, lambda k: ef.select(np.array([k]))):
        with pytest.raises(IndexError):
            ask(700)


def test_word_table_begins_anew_when_it_is_full():
    encoder = tokenbin.WordEncoder(open(MODEL).read())
    encoder.known = tokenbin.WordTable(slots=256, most=120)
    texts = [" ".join(f"w{(k * 7 + j) % 400}" for j in range(40)) for k in range(60)]
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(MODEL)
    for t in texts:
        ids, ends = encoder.encode([t, "", t[:9]], 0)
        want = [[*own.encode(x, add_special_tokens=False).ids, 0] for x in (t, "", t[:9])]
        assert ids.tolist() == sum(want, []) and ends.tolist() == np.cumsum(list(map(len, want))).tolist()
    assert len(encoder.known.lens) <= 120
