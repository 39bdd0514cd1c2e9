import hashlib
import random

from reuselens.llm import substring


def brute(rows, window):
    docs = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in docs:
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i:i + window])
                first[k] = min(d, first.get(k, d))
    out = []
    for d, w in docs:
        gone = set()
        for i in range(len(w) - window + 1) if d is not None else ():
            if first[tuple(w[i:i + window])] < d:
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest(), b" ".join(kept).decode()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, " ".join(r.kept_text.split()))
                   for r in df.collect()), key=str)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    res = substring.remove_repeats(docs).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, " ".join(r.kept_text.split())) for r in res),
                  key=str) == brute(rows, 50)


def test_small_vocabulary_and_odd_rows(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(40)]
    rows += [(40, None), (41, ""), (None, rows[3][1]), (42, rows[5][1]), (42, rows[5][1]), (-1, rows[7][1] + " z"),
             (43, "é" * 5 + " \t " + " ".join(f"w{i}" for i in range(30_000))), (44, " ".join(f"w{i}" for i in range(30_000)))]
    docs = spark.createDataFrame([(t, d, "x", 1) for d, t in rows], "text string, doc_id long, first string, count int")
    for window, seed in ((8, 3), (5, 5)):
        assert got(substring.remove_repeats(docs, window=window, seed=seed)) == brute(rows, window)
    clean = substring.clean_texts(docs, window=8, seed=3)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    assert [r.text for r in clean.filter("doc_id = 40").collect()] == [None]
    assert substring.remove_repeats(docs.limit(0)).collect() == []


def test_other_text_stays_as_it_is(spark):
    same = " ".join(f"x{i}" for i in range(50))
    docs = spark.createDataFrame([(1, same), (2, f"  one\n\n{same}\n two\t three ")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in substring.clean_texts(docs).collect()} == {1: same, 2: "  one\n\ntwo\t three "}


def test_words_and_columns_that_used_to_meet(spark):
    # two words of a and b in an order that polynomials modulo a power of two cannot tell apart
    word = "a"
    while len(word) < 1024:
        word += word.translate({97: "b", 98: "a"})
    other = word.translate({97: "b", 98: "a"})
    around = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(around[:25] + [word] + around[25:])), (2, " ".join(around[:25] + [other] + around[25:])),
            (3, " ".join(around[:25] + ["\0"] + around[25:])), (4, " ".join(around[:25] + ["\0\0"] + around[25:]))]
    docs = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows],
                                 "doc_id long, text string, _dup_spans int, _dup_id string, spans int, row int")
    assert [r[2] for r in brute(rows, 50)] == [0, 0, 0, 0]
    assert got(substring.remove_repeats(docs)) == brute(rows, 50)
    clean = substring.clean_texts(docs)
    assert clean.columns == docs.columns and sorted(map(tuple, clean.collect())) == sorted(map(tuple, docs.collect()))
