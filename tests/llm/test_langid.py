import random

import numpy as np
import pytest

from reuselens.llm import langid


def brute_phrases(symbols, reference):
    """Longest-match phrases, block by block, by substring search."""
    n, ref = 0, ",".join(map(str, [-1, *reference, -1]))
    for at in range(0, len(symbols), langid.BLOCK):
        block, i = symbols[at:at + langid.BLOCK], 0
        while i < len(block):
            j = i + 1
            while j < len(block) and "," + ",".join(map(str, block[i:j + 1])) + "," in ref:
                j += 1
            n, i = n + 1, j
    return n


def test_parse_equals_substring_search():
    rng = random.Random(3)
    reference = [rng.choice([1, 3, 4, 5, 6]) for _ in range(400)]
    a = langid.Automaton(reference, 9)
    for size in (1, 2, 7, 300, langid.BLOCK, 3 * langid.BLOCK + 5):
        text = [rng.choice([1, 1, 3, 4, 5, 6, 7, 8, 2]) for _ in range(size)]
        grid = np.zeros((-(-size // langid.BLOCK), langid.BLOCK), dtype=np.int32)
        grid.ravel()[:size] = text
        assert a.phrases(np.ascontiguousarray(grid.T)).sum() == brute_phrases(text, reference)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs, langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id") \
        .filter(langid.held_out()).collect()
    assert len(got) > 200
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "fr"), (4, "", None),
            (5, "123 !!", "en"), (6, "the dog", None), (None, "le chien", None), (6, "the dog", None),
            (7, "le chat et le chien " * 20_000, None), (8, "жжж" * 100, None)]
    docs = spark.createDataFrame([(d, t, lang, 0.5, "x") for d, t, lang in rows],
                                 "doc_id long, text string, lang string, score double, lang_pred string")
    refs = {"en": ["the cat and the dog"], "fr": ["le chat et le chien"]}
    got = sorted(((r.doc_id or 0, r.lang_pred, r.fits) for r in langid.identify(docs, refs).collect()))
    assert got == [(0, "fr", True), (1, "en", True), (2, "fr", True), (3, "und", False), (4, "und", False),
                   (5, "und", False), (6, "en", True), (6, "en", True), (7, "fr", True), (8, "en", False)]
    kept = langid.keep_known(docs, refs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 6, 6, 7]
    assert langid.identify(docs.limit(0), refs).collect() == []
    assert {r.lang_pred for r in langid.identify(docs, langid.train(docs.limit(0))).collect()} == {"und"}
    assert langid.keep_known(docs, {}).collect() == []


def test_scripts_with_many_letters_are_told_apart():
    rng = random.Random(7)
    han = [chr(0x4E00 + i) for i in range(600)]
    words = {"ru": ["кот", "собака", "дом", "жизнь", "человек"], "bg": ["котка", "куче", "къща", "живот", "човек"],
             "el": ["γάτα", "σκύλος", "σπίτι", "ζωή"], "zh": ["".join(rng.choices(han[:300], k=3)) for _ in range(200)],
             "ja": ["".join(rng.choices(han[300:], k=3)) for _ in range(200)], "en": ["cat", "dog", "house", "life", "human"]}
    text = lambda lang, n: " ".join(rng.choices(words[lang], k=n))
    model = langid.Model({lang: [text(lang, 300)] for lang in words})
    for n in (3, 10, 100):
        texts = [text(lang, n) for lang in words for _ in range(10)]
        bits, letters, size = model.bits(texts)
        assert [model.langs[i] for i in bits.argmin(axis=1)] == [lang for lang in words for _ in range(10)]
        assert model.fits(bits, letters, size).all()


def test_random_letters_are_rejected_from_short_lengths_on(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.Model(langid.train(docs))
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    for n in (50, 100, 199, 200, 400):
        assert not model.fits(*model.bits(["".join(rng.choices(letters, k=n)) for _ in range(100)])).any()
    texts = [r.text for r in docs.select("text").collect() if r.text and any(c.isalpha() for c in r.text)]
    for n in (5, 20, 50, 100, 199, 200, 400):
        assert model.fits(*model.bits([t[:n] for t in texts if any(c.isalpha() for c in t[:n])])).mean() > 0.98


def test_slices_of_a_long_text(monkeypatch):
    model = langid.Model({"en": ["the cat and the dog"], "fr": ["le chat et le chien"]})
    text = "le chat, " * 5000
    (whole,), _, (size,) = model.bits([text])
    monkeypatch.setattr(langid, "SLICE", 1000)
    bits, letters, sizes = model.bits(["the dog", text, "", None])
    assert abs(bits[1] - whole).max() < 0.1 and abs(sizes[1] - size) < 100 and letters.tolist() == [True, True, False, False]
    assert model.langs[bits[0].argmin()] == "en"


def test_too_many_languages_raise(spark):
    rows = spark.createDataFrame([(i, "some text", f"l{i}") for i in range(70)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        langid.sample_references(rows)
