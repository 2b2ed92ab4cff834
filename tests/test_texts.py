"""Links, sections and chunks: cases, invariants on made texts, and each query against its SQL."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from folioscope.operators import links, passages, segments, voices
from folioscope.plans import texts as plans

SF = "/root/testdata/sf0.001"
NAMES = [name for name, f in plans.QUERIES.items() if f.__module__ == plans.__name__ and name in plans.ORACLE_SQL]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_rows_equal_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    want = duck.execute(plans.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = [str(tuple(r)) for r in got.select(*columns).collect()]
    assert rows and sorted(rows) == sorted(str(r) for r in want.fetchall())


def urls(text, *kinds):
    return [x.url for x in links.scan(text) if not kinds or x.kind in kinds]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("go [![sea](http://i.test/s.jpg)](http://t.test/sea) on", [("inline", "![sea](http://i.test/s.jpg)", "http://t.test/sea"), ("image", "sea", "http://i.test/s.jpg")]),
        ("[p [q]](http://a.test/n) [r]( http://a.test/s)", [("inline", "p [q]", "http://a.test/n"), ("inline", "r", "http://a.test/s")]),
        ("[f](http://a.test/f_(g)) [e](http://a.test/e_\\(h\\))", [("inline", "f", "http://a.test/f_(g)"), ("inline", "e", "http://a.test/e_(h)")]),
        ("<http://a.test/auto> [t](http://a.test/t 'title') [g](<http://a.test/a b>)", [("autolink", "", "http://a.test/auto"), ("inline", "t", "http://a.test/t"), ("inline", "g", "http://a.test/a b")]),
        ("[left]([right](http://a.test/r) off", [("inline", "right", "http://a.test/r")]),
        ("[d]((http://a.test/d))", [("inline", "d", "http://a.test/d")]),
        ("[open [m](http://a.test/m)", [("inline", "m", "http://a.test/m")]),
        ("[o [i](http://a.test/i) p](http://a.test/o)", [("inline", "o [i](http://a.test/i) p", "http://a.test/o")]),
        ("[k](http://a.test/k more words)", [("inline", "k", "http://a.test/k")]),
        ("[a\n\nb](http://a.test/) \\[c](http://b.test/)", [("bare", "", "http://a.test/"), ("bare", "", "http://b.test/")]),
        ("[](http://a.test/empty) [x]() [y](\nhttp://a.test/y\n)", [("inline", "", "http://a.test/empty"), ("inline", "y", "http://a.test/y")]),
        ("[amp](http://a.test/?a=1&amp;b=2)", [("inline", "amp", "http://a.test/?a=1&b=2")]),
    ],
)
def test_scanner(text, found):
    assert [(x.kind, x.label, x.url) for x in links.scan(text)] == found


@pytest.mark.parametrize(
    ("text", "url"),
    [("Look http://a.test/x.", "http://a.test/x"), ("(at http://a.test/x)", "http://a.test/x"), ("http://a.test/x_(y), so", "http://a.test/x_(y)"), ("**http://a.test/b**", "http://a.test/b"), ("http://a.test/q?c=1&d=2!", "http://a.test/q?c=1&d=2")],
)
def test_bare_urls_end_before_punctuation(text, url):
    assert urls(text) == [url]


@pytest.mark.parametrize("text", ['<img src="http://a.test/i.jpg">', '<a href="http://a.test/">http://a.test/</a>', "<!-- http://a.test/ -->", "```\nhttp://a.test/\n```", "`http://a.test/`", "[http://a.test/](http://a.test/)", "https://", "x='http://a.test/"])
def test_no_bare_urls(text):
    assert urls(text, "bare") == []


def test_unlinked_text():
    assert links.unlinked("a [b [c](d)](e) ![f](g) http://h.test/ [i](") == "a b c f http://h.test/ [i]("


def test_scanner_is_total():
    """Any text has links in order, apart or one within another's label, each where its signs stand."""
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(["[", "]", "(", ")", "![", "](u", "\\", "<", ">", "http://x.y/z", " ", "\n", "\n\n", "a", "`", '"', "<!--", "-->"]) for _ in range(rng.randrange(40)))
        found = links.scan(text)
        assert [x.start for x in found] == sorted(x.start for x in found)
        for x in found:
            assert 0 <= x.start < x.end <= len(text) and x.url
            assert text[x.start] == {"inline": "[", "image": "!", "autolink": "<", "bare": "h"}[x.kind]
        for a, b in zip(found, found[1:], strict=False):
            assert a.end <= b.start or (a.kind == "inline" and b.kind == "image" and b.end <= a.end) or (b.end <= a.end and a.kind == b.kind == "image")


def test_long_hostile_texts_end():
    for text in ("[" * 50_000, "[a](" * 20_000, "](" * 50_000, "[x](" + "(" * 20_000, "\\" * 50_000, "[](" + '"' * 20_000, "http://" * 10_000):
        links.scan(text)


def test_links_of_rows(spark):
    rows = [(1, "# [h](http://a.test/) \n\n[h2](http://a.test/#x) in text ![m](http://a.test/m)", 0, "z"), (2, None, 0, "z"), (3, "", 0, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ord int, kind string")
    found = links.links(df, "doc_id")
    view = links.link_view(links.with_roles(found, df, "doc_id"), "doc_id").collect()
    assert sorted((r.url_key, r.label, r.role, r.mentions) for r in view) == [("a.test", "h", "headline", 2), ("a.test/m", "m", "media", 1)]
    assert links.links(df.limit(0), "doc_id").count() == 0


def test_sections_and_their_parents():
    text = "lead\n# A #\none\n```\n# no\n```\n## B\n\n#### C\ntwo\n## D\n# E"
    found = segments.sections(text)
    assert [(s.level, s.heading, s.parent) for s in found] == [(0, "", None), (1, "A", None), (2, "B", 1), (4, "C", 2), (2, "D", 1), (1, "E", None)]
    assert "".join(text[s.start : s.stop] for s in found) == text
    assert [text[s.body : s.stop].strip() for s in found][3] == "two" and segments.sections("") == segments.sections(" \n") == []


def test_chunks_keep_budget_text_and_links():
    rng = random.Random(2)
    parts = ["word ", "a. ", "\n", "\n\n", "[l a b](http://x y) ", "<b x y>", "Zz! ", "loooooong" * 3, "  ", "it's ", "é. "]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(300)))
        most, overlap, chars = rng.choice([(10, 3, 80), (40, 9, 200), (5, 4, 30), (400, 60, 2000), (3, 0, 2)])
        found = segments.chunks(text, most, overlap, chars)
        assert "".join(text[c.start : c.stop] for c in found) == text
        whole = [m.span() for m in segments._WHOLE.finditer(text)]
        before = 0
        for c in found:
            assert before <= c.lead <= c.start < c.stop
            assert c.stop - c.lead <= chars and sum(c.lead <= m.start() < c.stop for m in segments._WORD.finditer(text)) <= most
            assert not any(a < c.lead < b for a, b in whole) or c.lead == c.start
            before = c.start
        if most == 400:  # room for every link: none is cut
            assert not any(a < c.stop < b for a, b in whole for c in found)


def test_chunks_prefer_blank_lines_then_sentences():
    text = "One two. Three four.\n\nFive six. Seven eight nine."
    assert [text[c.start : c.stop] for c in segments.chunks(text, 5, 0, 100)] == ["One two. Three four.\n\n", "Five six. Seven eight nine."]
    assert [text[c.lead : c.stop] for c in segments.chunks(text, 6, 2, 100)] == ["One two. Three four.\n\n", "Three four.\n\nFive six. ", "Five six. Seven eight nine."]


def test_voices_cover_the_text():
    text = "Mine.\n> said\n\n> more\nMine **[t](u)** too\n- [a](b) c.org\n[d](e)\n"
    found = voices.spans(text)
    assert [(v, text[a:b]) for v, a, b in found] == [("own", "Mine.\n"), ("quoted", "> said\n\n> more"), ("own", "\nMine "), ("link", "**[t](u)**"), ("own", " too\n"), ("link", "- [a](b) c.org\n[d](e)"), ("own", "\n")]
    rng = random.Random(3)
    for _ in range(2000):
        text = "".join(rng.choice(["> q", "[a](b)", "**[a](b)**", "w ", "\n", "\n\n", "- ", " ", "![i](j)"]) for _ in range(rng.randrange(20)))
        for headlines in (True, False):
            found = voices.spans(text, headlines)
            assert "".join(text[a:b] for _, a, b in found) == text
            assert all(a[2] == b[1] and a[0] != b[0] for a, b in zip(found, found[1:], strict=False))
            at = 0
            for line in text.split("\n"):
                if line.lstrip(" \t").startswith(">"):
                    assert {v for v, a, b in found if a < at + len(line) and b > at} == {"quoted"}
                at += len(line) + 1


def test_own_words_and_images(spark):
    text = "> theirs\nWhat I say here is long enough to be kept ![x](y)\n[only](link)\n\nand **goes** on\n![alt](http://i.test/a)\n<p>Caption &amp; <b>words</b></p>\n![](http://i.test/b)\n![again](http://i.test/a)"
    df = spark.createDataFrame([(1, text, 0), (2, "> all theirs, and long enough to be kept if it were not", 0), (3, None, 0), (4, "short", 0)], "id long, text string, ord int")
    assert [tuple(r) for r in voices.said_by(df, "id", ["own"]).collect()] == [(1, "What I say here is long enough to be kept\n\nand **goes** on\n\n<p>Caption &amp; <b>words</b></p>")]
    got = [tuple(r) for r in voices.media(df.filter("id = 1"), "id").collect()]
    assert got == [(1, 0, "y", "x", "only"), (1, 1, "http://i.test/a", "alt", "Caption & words"), (1, 2, "http://i.test/b", "", "Caption & words")]
    covers = spark.createDataFrame([(1, "http://i.test/a"), (2, "http://i.test/own"), (3, "http://i.test/s?1"), (4, "http://i.test/s#2"), (5, "IMG_1"), (6, None)], "id long, cover string")
    states = voices.cover_state(voices.media(df, "id"), covers, "id").collect()
    assert {r.id: r.state for r in states} == {1: "shown", 2: "own", 3: "shared", 4: "shared", 5: "none", 6: "none"}


def test_passages_carry_their_headers():
    text = "intro words\n# A\n## B b\n" + "one two three. " * 100 + "\n## C\n# D\nlast"
    found = passages.passages_of("Title", text, 40, 5, 1300)
    assert [x[2] for x in found][0] == "" and {tuple(x[3]) for x in found} == {(), ("A", "B b"), ("D",)}
    for number, level, heading, path, k, start, stop, words, said, whole, digest, over in found:
        assert whole == "\n".join([*filter(None, ["Title", " > ".join(path)]), said]) and text[start:stop].strip() == said
        assert words <= 40 and len(whole) <= 1300 and not over and len(digest) == 64
    assert passages.passages_of("", "", 40, 5, 1300) == passages.passages_of("", "# only\n", 40, 5, 1300) == []
    assert passages.passages_of("t" * 2000, "x " * 10, 40, 5, 1300)[0][-1]


def test_passages_by_section_and_kind_and_their_vectors(spark, tmp_path):
    rows = [(1, "T", "# Photo Journal\none\n## Deep\ntwo\n# Links!\nthree"), (2, None, "no heading"), (3, "x", None)]
    df = spark.createDataFrame(rows, "id long, title string, text string")
    found = passages.passages(df, "id", "text", "title")
    got = {(r.id, r.text): (r.input, r.kind, r.inside) for r in found.select("*", passages.content_kind(F.col("heading")).alias("kind"), passages.in_section("photo journal").alias("inside")).collect()}
    assert got == {(1, "one"): ("T\nPhoto Journal\none", "personal", True), (1, "two"): ("T\nPhoto Journal > Deep\ntwo", "essay", True), (1, "three"): ("T\nLinks!\nthree", "links", False), (2, "no heading"): ("no heading", "essay", False)}
    path, made = f"file://{tmp_path}/vectors", spark.sparkContext.accumulator(0)

    def vectors_of(rows):
        def run(batches):
            for batch in batches:
                made.add(batch.num_rows)
                yield batch

        return rows.select("id", F.array(F.length("input").cast("float")).alias("vector")).mapInArrow(run, "id string, vector array<float>")

    keyed = lambda df: passages.passages(df, "id", "text", "title").select(F.concat_ws("-", "id", "section", "ord").alias("id"), "input")
    assert passages.embed(keyed(df), path, ["input"], "m1", vectors_of)[1:] == (4, 0, 0) and made.value == 4
    changed = spark.createDataFrame([rows[0], (2, None, "another text"), rows[2]], df.schema)
    assert passages.embed(keyed(changed), path, ["input"], "m1", vectors_of)[1:] == (1, 3, 0) and made.value == 5
