"""Encoding, leaks and reading levels."""

import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumika.llm import reading
from lumika.llm.bpe import FOLDER, Encoder, encode
from lumika.llm.leaks import Coder, leaks, tiles, window_hashes, words


@pytest.fixture(scope="module")
def public():
    t = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids_are_those_of_the_public_tokenizer(public):
    r = random.Random(3)
    odd = ["", " ", "\n\n", "a" * 4097, " " * 999 + "x", "<|endoftext|> hi", "é́ ﬀ ​ß", "\x00\x01\x02", "ab" * 3000, "🙂👩‍👩‍👧" * 40, "I'll don't we've 'S", "1234567" * 50, "日本語テキスト"]
    odd += ["".join(r.choice("abc \n'é1.") for _ in range(r.randrange(300))) for _ in range(200)]
    assert [list(map(int, x)) for x in Encoder().encode(odd)] == [public(t) for t in odd]


def test_encode_keeps_rows_and_defines_null_and_empty(spark, public):
    rows = [(1, "Hello world", "c"), (2, None, "c"), (3, "", "c"), (4, "  ", "c"), (5, "x" * 50_000, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in encode(df, "doc_id", "text").collect()}
    assert got == {1: public("Hello world"), 2: [], 3: [], 4: public("  "), 5: public("x" * 50_000)}
    assert encode(df.limit(0), "doc_id", "text").count() == 0


def brute_leak(text, item, least):
    a, b = words(text), words(item)
    grams = {tuple(b[i : i + least]) for i in range(len(b) - least + 1)}
    return any(tuple(a[i : i + least]) in grams for i in range(len(a) - least + 1))


def test_leaks_are_those_of_brute_force(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(30))) for i in range(20)]
    docs = []
    for d in range(150):
        text = [r.choice(vocabulary) for _ in range(r.randrange(5, 80))]
        if d % 2:
            source = items[r.randrange(20)][1].split()
            at, n = r.randrange(15), r.randrange(9, 16)
            text[3:3] = source[at : at + n]
        docs.append((d, ", ".join(text).upper() if d % 3 else "_".join(text), "x"))
    docs += docs[:3] + [(900, None, "x"), (901, "", "x"), (None, items[0][1], "x"), (902, "long " * 40_000 + items[4][1], "x")]
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame([*items, (99, None), (98, ""), items[0]], "item_id long, text string"), 12)
    found = {(x["doc_id"], x["item_id"]) for x in got.collect()}
    want = {(d, i) for d, t, _ in docs if d is not None and t for i, s in items if brute_leak(t, s, 12)}
    assert found == want and got.count() == len(want) and (902, 4) in want


def seeds_of(text, item, least):
    import numpy as np

    a, b = (window_hashes(Coder()(t), least) for t in (text, item))
    i, j = np.nonzero(a[:, None] == b)
    return i, j


def brute_tiles(a, b, least):
    """Greedy string tiling word by word."""
    free_a, free_b, found = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return found
        free_a[i : i + n], free_b[j : j + n] = [False] * n, [False] * n
        found.append((i, j, n))


def test_tiles_are_those_of_brute_force():
    r = random.Random(3)
    for case in range(60):
        a, b = ([r.choice("ab" if case % 2 else "abcdef") for _ in range(r.randrange(1, 40))] for _ in range(2))
        least = r.randrange(1, 4)
        assert tiles(*seeds_of(" ".join(a), " ".join(b), least), least) == brute_tiles(a, b, least)


def test_tiles_cover_moved_passages():
    item = " ".join(f"a{i}" for i in range(20))
    text = " ".join([*(f"a{i}" for i in range(10, 20)), "and", *(f"a{i}" for i in range(10))])
    assert tiles(*seeds_of(text, item, 5), 5) == [(0, 10, 10), (11, 0, 10)]
    assert tiles(*seeds_of("nothing of it", item, 5), 5) == []


def test_leaks_report_coverage_and_read_many_items_in_one_pass(spark):
    items = spark.createDataFrame([(i, " ".join(f"t{i}x{k}" for k in range(20))) for i in range(3000)], "item_id long, text string")
    docs = spark.createDataFrame([(i, "before " + " ".join(f"t{i}x{k}" for k in range(3, 17)) + " after") for i in range(0, 3000, 100)], "doc_id long, text string")
    assert {tuple(r) for r in leaks(docs, items).collect()} == {(i, i, 14, 14, 20) for i in range(0, 3000, 100)}
    assert leaks(docs, items.limit(0)).count() == 0 and leaks(docs.limit(0), items).count() == 0


def test_a_passage_that_very_many_documents_hold(spark):
    passage = " ".join(f"q{k}" for k in range(13))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit(passage), F.lit(" end "), F.col("id").cast("string")).alias("text"))
    items = spark.createDataFrame([(1, passage), (2, "x " + passage), (3, "the " * 40)], "item_id long, text string")
    got = leaks(docs.unionByName(spark.createDataFrame([(9999, "the " * 3000)], "doc_id long, text string")), items)
    assert got.count() == 6001 and got.where("longest_tile = 13").count() == 6000 and got.where("doc_id = 9999").first()["shared_words"] == 40


SIMPLE = ["the cat sat on the mat.", "we saw a big red dog.", "mum gave me a bun.", "the sun is hot and I run."]
PLAIN = ["after lunch our group walked along the harbour and photographed several boats.", "most of the pictures turned out brighter than expected.", "please remember to export the album before friday."]
HARD = ["the covariance estimator degrades under heteroscedastic noise.", "regularisation of the residual operator is indispensable.", "spectral deconvolution presupposes an explicit parametrisation."]


def corpus(n, seed=1):
    r = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        level = i % 3
        own, other = (SIMPLE, PLAIN, HARD)[level], (SIMPLE, PLAIN, HARD)[(level + 1) % 3]
        docs.append((i, " ".join([r.choice(own).capitalize() for _ in range(12)] + [r.choice(other).capitalize()] * (r.random() < 0.3)), "x"))
        truth[i] = reading.LEVELS[level]
    return docs, truth


@pytest.mark.parametrize("limit", [2_000_000, 5])
def test_reading_levels(spark, monkeypatch, limit):
    monkeypatch.setattr(reading, "BROADCAST_WORDS", limit)
    docs, truth = corpus(120)
    extra = [(500, None, "x"), (501, "", "x"), (502, "Too short.", "x"), (503, "tree, lake, dog, " * 40, "x"), (504, "ISO: 100\nFNumber: 8\n" * 30, "x"), docs[0]]
    labels = [(i, ("BASIC ", "general", "Expert")[i % 3], "r") for i in range(0, 60)] + [(0, "general", "s"), (1, None, "s"), (2, "odd", "s"), (None, "basic", "s"), (9999, "basic", "s")]
    got = reading.reading_levels(spark.createDataFrame([*docs, *extra], "doc_id long, text string, clamp string"), spark.createDataFrame(labels, "doc_id long, reading_level string, reader string"))
    rows = got.collect()
    assert len(rows) == 120 and {r["doc_id"]: r["reading_level"] for r in rows} == truth


@pytest.mark.parametrize("limit", [2_000_000, 5])
def test_a_document_of_numbers_gets_the_mean_level(spark, monkeypatch, limit):
    monkeypatch.setattr(reading, "BROADCAST_WORDS", limit)
    docs, truth = corpus(30)
    numbers = [(500, " ".join(f"{i}." for i in range(1, 60)), "x")]
    labels = spark.createDataFrame([(i, truth[i]) for i in range(30)], "doc_id long, reading_level string")
    rows = reading.reading_levels(spark.createDataFrame([*docs, *numbers], "doc_id long, text string, x string"), labels).collect()
    assert len(rows) == 31 and {r["doc_id"]: r["reading_level"] for r in rows} == {**truth, 500: "general"}


@pytest.mark.parametrize("limit", [2_000_000, 5])
def test_grades_reach_documents_many_words_away(spark, monkeypatch, limit):
    """A chain of documents each of which shares words with the next one only, and is graded at one end, beside many others."""
    monkeypatch.setattr(reading, "BROADCAST_WORDS", limit)
    docs, truth = corpus(60)
    letters = "abcdefghijklmnop"
    links = [" ".join(f"q{letters[i]}{x}z" for x in letters[:15]) + "." for i in range(13)]
    chain = [(500 + i, f"{links[i]} {links[i + 1]}", "x") for i in range(12)]
    alone = [(600, " ".join(f"y{x}{y}" for x in letters for y in "abc") + ".", "x")]
    labels = spark.createDataFrame([(i, truth[i]) for i in range(60)] + [(500, "expert")], "doc_id long, reading_level string")
    rows = reading.reading_levels(spark.createDataFrame([*docs, *chain, *alone], "doc_id long, text string, x string"), labels).collect()
    got = {r["doc_id"]: r["reading_level"] for r in rows}
    assert got == {**truth, **{d: "expert" for d, *_ in chain}, 600: "general"}


def test_reading_without_labels_or_documents(spark):
    docs, _ = corpus(6)
    none = spark.createDataFrame([], "doc_id long, reading_level string")
    assert reading.reading_levels(spark.createDataFrame(docs, "doc_id long, text string, x string"), none).count() == 0
    labels = spark.createDataFrame([(1, "basic")], "doc_id long, reading_level string")
    assert reading.reading_levels(spark.createDataFrame([], "doc_id long, text string"), labels).count() == 0
