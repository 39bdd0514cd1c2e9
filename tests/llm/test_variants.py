import random
import re
import zlib
from collections import Counter

import pytest

from reuselens.llm import variants as V


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) == len(b)):] == b[k + 1:]


def count(rows, divisor=199, least_length=6, least_count=5):
    n = Counter()
    upper = {c: c + 32 for c in range(65, 91)}
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(upper)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % divisor == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= least_length and c >= least_count}


def brute(n, ratio=5):
    """Near words by dropping a letter, or by putting a mark in its place."""
    index = {}
    for w in n:
        for i in range(len(w) + 1):
            if i < len(w):
                index.setdefault(w[:i] + "*" + w[i + 1:], set()).add(w)
            index.setdefault(w[:i] + "+" + w[i:], set()).add(w)
    form, rows = {}, {}
    for w in n:
        near = set()
        for i in range(len(w) + 1):
            if i < len(w):
                near |= index.get(w[:i] + "*" + w[i + 1:], set()) | index.get(w[:i] + "+" + w[i + 1:], set())
            near |= index.get(w[:i] + "*" + w[i:], set())
        near.discard(w)
        assert all(one_edit(w, x) for x in near)
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
        rows[w] = len(near)
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], rows[w], n[form[w]] if form[w] else None))
    return sorted(out)


def got(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute(count([(r.doc_id, r.text) for r in docs.collect()]))
    assert got(V.variants(docs)) == want
    assert sum(r[1] is not None for r in want) > 20


@pytest.mark.parametrize("most,longest", [(20_000, 64), (3, 64), (20_000, 2), (1, 1)])
def test_vocabulary_that_shares_its_halves(spark, most, longest):
    rng = random.Random(most + longest)
    n = {}
    while len(n) < 400:
        w = "".join(rng.choice("ab") for _ in range(rng.randint(6, 9)))
        n[("common" if rng.random() < 0.5 else "") + w + ("ending" if rng.random() < 0.3 else "")] = rng.randint(5, 3000)
    n |= {"x" * k: 7 ** (k % 5 + 1) for k in range(290, 310)} | {"q" * 6: 5, "é" * 6: 5, "éé" + "q" * 4: 30}
    vocabulary = spark.createDataFrame(list(n.items()), "word string, n long")
    near = {r.word: (r.near, r.form, r.form_n) for r in V.near_words(vocabulary, 6, most, longest).collect()}
    want = {w: (k, min((x for x in n if one_edit(w, x)), key=lambda x: (-n[x], x))) for w, _, _, _, k, _ in brute(n) if k}
    assert {w: (k, f) for w, (k, f, _) in near.items()} == want
    assert all(n[f] == m for _, f, m in near.values())


def test_machines_against_all_pairs():
    rng = random.Random(5)
    for _ in range(60):
        groups = [sorted({"".join(rng.choice("abc") for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(1, 40))})
                  for _ in range(4)]
        acceptor = V.Acceptor()
        roots = [acceptor.add(g) for g in groups]
        machine = V.Composition(acceptor)
        for root, g in zip(roots, groups):
            replaced, inserted = list(machine.pairs(root, True)), list(machine.pairs(root, False))
            assert len(set(replaced)) == len(replaced) and len(set(inserted)) == len(inserted)
            every = [(a, b) for a in g for b in g if one_edit(a, b)]
            assert sorted(replaced + [(b, a) for a, b in replaced]) == sorted(p for p in every if len(p[0]) == len(p[1]))
            assert sorted(inserted) == sorted(p for p in every if len(p[0]) < len(p[1]))
        # minimal: no two states accept the same endings
        language = {}
        for s in range(len(acceptor.arcs)):
            words = frozenset([""] * acceptor.final[s]) | {c + w for c, t in acceptor.arcs[s].items() for w in language[t]}
            language[s] = words
        assert len(set(language.values())) == len(language)


def test_odd_rows(spark):
    text = "Garden garden GARDEN gardens gardens ÉCOLES ×÷×÷×÷ " * 40 + "Gardem " * 9 + "garde " * 50
    rows = [(1, None), (2, ""), (3, text), (3, text), (None, text), (4, "a" * 5000 + " "), (5, ("a" * 5001 + " ") * 30),
            (6, ("a" * 5000 + " ") * 5), (7, "word1gardenx_gardenx-gardenx gardenx gardenx"), (8, "x" * 2_100_000 + " garden " + "y" * 10)]
    docs = spark.createDataFrame([(t, d, "n", 3, "r") for d, t in rows], "text string, doc_id long, word string, n int, root string")
    assert got(V.variants(docs)) == brute(count(rows))
    assert got(V.variants(docs, divisor=2)) == brute(count(rows, 2))
    assert V.variants(docs.limit(0)).collect() == []
    assert got(V.variants(docs, least_count=10 ** 9)) == []
