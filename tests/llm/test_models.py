"""Operators 3 and 4, and the pipeline."""

import random
import zlib

import numpy as np
import pytest

from folioscope.llm import langid, toxicity

rng = random.Random(11)
SYLLABLES = {"en": ["th", "ing", "wo", "sh", "er", "and"], "fr": ["é", "oui", "eau", "le", "ç", "ment"], "de": ["sch", "ü", "ung", "ei", "keit", "ß"]}


def say(lang, n=60, extra=()):
    words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n)]
    for w in extra:
        words.insert(rng.randrange(len(words)), w)
    return " ".join(words).capitalize() + "."


@pytest.fixture(scope="module")
def docs(spark):
    rows = []
    for k in range(600):
        lang = ["en", "en", "fr", "de"][k % 4]
        bad = k % 7 == 0
        extra = ([rng.choice(["moron", "clown", "idiot"])] if lang == "en" else ["eauxvil" + rng.choice(SYLLABLES[lang]) for _ in range(3)]) if bad else ()
        rows.append((k, say(lang, extra=extra), lang, f"s{k % 3}", int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, toxic int")


def odd(spark):
    return spark.createDataFrame([(9000, None, None, None, 1), (9001, "", "en", "s0", 2), (9002, "12 .. 34", "en", "s0", 3), (None, say("en"), "en", "s1", 4), (9003, "the " * 30_000, None, "s1", 5), (9004, "same and same", "en", "s2", 6), (9004, "same and same", "en", "s2", 6)], "doc_id long, text string, lang string, source string, score int")


def test_gradients_equal_differences():
    net = langid.Network(["a", "b"], hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    bytes_, label, weight = r.integers(0, 6, (4, 5)).astype(np.uint8), np.array([0, 1, 1, 0]), np.ones((4, 5))
    _, grads = net.gradients(bytes_, label, weight)
    for key, at in (("xf", (2, 1)), ("xb", (3, 8)), ("uf", (1, 7)), ("ub", (0, 2)), ("out", (4, 1)), ("bias", (0,))):
        kept, step = net.p[key][at], 1e-4
        losses = []
        for sign in (1, -1):
            net.p[key][at] = kept + sign * step
            losses.append(net.gradients(bytes_, label, weight)[0])
        net.p[key][at] = kept
        assert abs((losses[0] - losses[1]) / (2 * step) - grads[key][at]) < 2e-3, key


def test_language_accuracy_on_held_out_documents(spark, docs):
    net = langid.fit(docs, learn=langid.learn_fold(), steps=150)
    got = {r.doc_id: r for r in langid.identify(docs, net).collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.95 * len(held) > 0
    edge = sorted(((r.doc_id or -1, r.lang_pred, r.score) for r in langid.identify(odd(spark), net).collect()), key=str)
    assert [(k, p) for k, p, s in edge if p == "und"] == [(9000, "und"), (9001, "und"), (9002, "und")]
    assert len(edge) == 7
    assert all(0 <= s <= 1 for *_, s in edge)
    assert langid.keep(odd(spark), net, 0.3).count() == 4
    assert langid.identify(docs.limit(0), net).count() == 0
    nothing = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs.limit(3), nothing).collect()} == {"und"}


def test_patterns_speak_without_a_term():
    # one voter: fired, number of fired, any fired; then capitals, "!", repeated words; the bias
    model = toxicity.Model(["term"], [(0, 1)], np.array([1.0, 0, 0, 1, 2, 4, -3]))
    texts = ["quiet words", "LOUD WORDS", "words!", "no no no no", "a term", "", "NO!! NO!! NO!! NO!! NO!!"]
    logit = np.array([-3.0, -2, -1, 1, -2, -3, 4])
    assert np.allclose(model.scores(texts), 1 / (1 + np.exp(-logit)))


def test_toxicity_on_held_out_documents(spark, docs):
    model = toxicity.fit(docs.select("doc_id", "text", "lang"), docs.select("doc_id", "toxic"), learn=toxicity.learn_fold())
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    caught = [got[r.doc_id] >= 0.7 for r in held if r.toxic]
    assert sum(caught) >= 0.85 * len(caught) > 0
    assert not any(got[r.doc_id] >= 0.7 for r in held if not r.toxic)
    edge = [(r.doc_id, r.score) for r in toxicity.score(odd(spark), model).collect()]
    assert len(edge) == 7
    assert all(0 <= s < 0.7 for _, s in edge)
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.keep(docs, model, 0.7).count() == sum(s < 0.7 for s in got.values())
    one_sided = toxicity.fit(docs, docs.select("doc_id").selectExpr("doc_id", "0 as toxic"))
    assert {r.score for r in toxicity.score(docs, one_sided).collect()} == {0.0}


def drawn_votes(seed, n=1500):
    r = np.random.default_rng(seed)
    y = r.random(n) < 0.3
    votes = np.stack([r.random(n) < np.where(y, a, b) for a, b in ((0.6, 0.02), (0.5, 0.05), (0.4, 0.01))], 1)
    noisy = votes[:, :1] ^ (r.random((n, 1)) < 0.02)
    return y, np.concatenate([votes, noisy, ~votes.any(1)[:, None]], 1), np.array([1, 1, 1, 1, 0])


def plain_label_model(votes, polarity, labels, of, rounds):
    """The label model by loops over rows, cliques and states."""
    import math

    n, names, top = len(votes), sorted(set(of.tolist())), toxicity.STATES
    states = [[min(top, sum(int(v) for v, c in zip(row, of, strict=True) if c == k)) for k in names] for row in votes]
    prior = min(0.99, max(0.01, sum(labels) / n))

    def rates(mass, held, first):
        return [[(sum(m for m, s in zip(mass, states, strict=True) if s[k] == j) + 0.5 + held * first[k][j]) / (sum(mass) + 0.5 * (top + 1) + held) for j in range(top + 1)] for k in range(len(names))]

    nothing = [[0.0] * (top + 1) for _ in names]
    first = [rates([float(x == k) for x in labels], 0, nothing) for k in (0, 1)]
    now, q = first, []
    for _ in range(rounds):
        q = []
        for s in states:
            logit = math.log(prior / (1 - prior))
            for k, c in enumerate(names):
                if s[k]:
                    ratio = math.log(now[1][k][s[k]] / now[0][k][s[k]])
                    logit += max(ratio, 0) if any(p == 1 for p, x in zip(polarity, of, strict=True) if x == c) else min(ratio, 0)
            q.append(min(1 - 1e-4, max(1e-4, 1 / (1 + math.exp(-min(30, max(-30, logit)))))))
        now = [rates([1 - x for x in q], n * (1 - prior) * toxicity.CALIBRATION, first[0]), rates(q, n * prior * toxicity.CALIBRATION, first[1])]
    return q, now


def test_label_model_equals_plain_loops():
    y, votes, polarity = drawn_votes(1, 300)
    q, rates, of = toxicity.label_model(votes, polarity, y.astype(int), rounds=6)
    want, now = plain_label_model(votes, polarity, y.astype(int).tolist(), of, 6)
    assert np.allclose(q, want) and np.allclose(rates, now)


def test_label_model_finds_rates_and_cliques():
    y, votes, polarity = drawn_votes(2, 4000)
    q, rates, of = toxicity.label_model(votes, polarity, y.astype(int))
    assert of[0] == of[3] and len(set(of.tolist())) == 4
    assert ((q > 0.5) == y).mean() > 0.88
    assert abs(rates[1, of[1], 1] - 0.5) < 0.06 and abs(rates[0, of[1], 1] - 0.05) < 0.03


def test_labels_do_not_vote():
    y, votes, polarity = drawn_votes(3, 3000)
    q, _, _ = toxicity.label_model(votes, polarity, y.astype(int))
    seen = {}
    for row, p, label in zip(votes.tolist(), q.tolist(), y.tolist(), strict=True):
        seen.setdefault(tuple(row), set()).add((p, label))
    assert all(len({p for p, _ in x}) == 1 for x in seen.values())
    silent = seen[(False, False, False, False, True)]
    assert {label for _, label in silent} == {True, False} and max(p for p, _ in silent) < 0.5  # toxic rows that nobody votes for


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline
    from folioscope.llm import neardup

    extra = [(5000 + k, t, "en", "s0", 0) for k, t in enumerate([None, "..", "the wing and show " * 20, "the wing and show " * 20])]
    every = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    every.select("doc_id", "text", "lang", "source").write.parquet(f"{tmp_path}/documents.parquet")
    docs.select("doc_id", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    state = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, state, str(tmp_path))
        if k < 4:
            assert out.columns == state.columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        state = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append({r.doc_id for r in state.select("doc_id").collect()})
    assert {5000, 5001} & seen[0] == set() and len(seen[0]) == 602
    toxic = {r.doc_id for r in docs.collect() if r.toxic}
    assert len(seen[1] & toxic) < 0.15 * len(toxic) and len(seen[1] - toxic) > 0.98 * (len(seen[0]) - len(toxic))
    kept = {r.doc_id for r in neardup.near_duplicates(spark.read.parquet(f"{tmp_path}/1")).filter("kept").collect()}
    assert seen[2] == kept == seen[3] == seen[4] and 5003 not in kept and 5002 in kept
    ran = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert ran == {r.doc_id: r.ids_sha256 for r in state.collect()}


def test_last_stage_tells_the_place_in_the_mix(spark):
    import hashlib

    import corpus_pipeline

    rows = [(k % 40 or None, f"text {k % 30}", ["a", "a", "b"][k % 3]) for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = corpus_pipeline.stored(corpus_pipeline.mixed(spark, docs, ""), "mixed")
    got = corpus_pipeline.tokens(spark, mixed, "").collect()
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want = [(r.mix_place, r.doc_id, digest(r.text)) for r in corpus_pipeline.mixing.mix(docs).collect()]
    assert sorted((r.mix_place, r.doc_id or 0, r.decoded_sha256) for r in got) == sorted((p, d or 0, t) for p, d, t in want)


def test_the_mixing_stage_decides_the_places(spark, tmp_path):
    """Places follow the files that the last stage is given, not another reckoning of the mix."""
    import corpus_pipeline

    rows = [(k, f"text {k}", "ab"[k % 2]) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.repartitionByRange(5, "doc_id").sortWithinPartitions("doc_id").write.parquet(f"{tmp_path}/plain")
    corpus_pipeline.mixed(spark, docs, "").write.parquet(f"{tmp_path}/mixed")
    plain, mixed = ({r.doc_id: r.mix_place for r in corpus_pipeline.tokens(spark, spark.read.parquet(f"{tmp_path}/{x}"), "").collect()} for x in ("plain", "mixed"))
    assert plain == {k: k for k in range(60)}
    assert mixed != plain and sorted(mixed.values()) == list(range(60))
    assert mixed == {r.doc_id: r.mix_place for r in corpus_pipeline.mixing.mix(docs).collect()}


def test_pipeline_takes_empty_tables_nulls_long_texts_and_clashing_names(spark, docs, tmp_path):
    import corpus_pipeline

    columns = "doc_id long, text string, lang string, source string, mix_place int, row_place string, score double"
    texts = docs.select("doc_id", "text", "lang", "source").collect()
    clean = docs.filter("toxic = 0 and lang = 'en'").first().text.split()
    words = random.Random(3).choices(clean, k=30_000)  # a very long text that is no copy of a shorter one
    rows = [(*r, 1, "x", 0.5) for r in texts] + [(None, " ".join(clean), "en", "s", 1, None, None), (9001, None, None, None, 1, None, None), (9002, " ".join(words), "en", None, 1, None, None)]
    for name, held in (("full", rows), ("empty", [])):
        spark.createDataFrame(held, columns).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        docs.select("doc_id", "toxic").limit(10**6 if held else 0).write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    got = corpus_pipeline.run(spark, f"{tmp_path}/full").collect()
    ids = [r.doc_id for r in got]
    assert 9001 not in ids and 9002 in ids and sorted(r.mix_place for r in got) == list(range(len(got)))
