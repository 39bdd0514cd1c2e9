import itertools
import random
import re

from reuselens.llm import decontaminate as d


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def whole_rule(docs, items):
    """All alignments of all items and texts, none left out."""
    out = {}
    for item, itext in items:
        iw = words(itext)
        if item is None or not iw:
            continue
        w = min(d.WINDOW, len(iw))
        for doc, text in docs:
            if doc is None:
                continue
            dw = words(text)
            for shift in range(-len(iw) + 1, len(dw)):
                m = [0 <= shift + j < len(dw) and dw[shift + j] == x for j, x in enumerate(iw)]
                best = max(sum(m[k:k + w]) for k in range(len(iw) - w + 1))
                if best >= d.least_matches(len(iw)):
                    old = out.get((doc, item), (0, 0))
                    out[doc, item] = (max(best, old[0]), max(sum(m), old[1]))
    return out


def got(df):
    rows = df.collect()
    assert len({(r.doc_id, r.item_id) for r in rows}) == len(rows)
    return {(r.doc_id, r.item_id): (r.window_matches, r.item_matches) for r in rows}


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    exact = {(a.doc_id, b.item_id) for a in docs.collect() for b in items.collect()
             if " ".join(words(b.text)) in " ".join(words(a.text))}
    found = got(d.leaks(docs, items))
    assert exact and found.keys() >= exact
    assert {k for k, v in found.items()} == exact


def test_substitutions_and_odd_rows(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate((20, 9, 14, 7, 30, 13))]
    items += [(6, None), (7, ""), (None, items[0][1]), (8, items[0][1]), (8, items[0][1])]
    docs = []
    for i in range(60):
        _, text = items[i % 6]
        w = text.split()
        for j in rng.sample(range(len(w)), rng.randint(0, max(1, len(w) // 3))):
            w[j] = "other"
        docs.append((i, "Before, that: " + "; ".join(w).upper() + ". " + " ".join(rng.choice(vocab) for _ in range(20))))
    docs += [(100, None), (101, ""), (None, items[0][1]), (102, items[0][1]), (102, items[0][1]),
             (103, "x " * 50_000 + items[4][1])]
    frame = spark.createDataFrame([(a, b, 0, "z") for a, b in docs], "doc_id long, text string, item_id int, w string")
    bench = spark.createDataFrame([(b, a, 1) for a, b in items], "text string, item_id long, doc_id int")
    want = whole_rule([x for x in docs if x[0] != 103], items)
    found = got(d.leaks(frame, bench))
    assert found.pop((103, 4)) == (13, 30)
    assert found == want and 20 < len(want)
    kept = d.drop_leaks(frame, bench)
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(
        str(a) for a, _ in docs if a != 103 and a not in {k[0] for k in want})
    assert got(d.leaks(frame.limit(0), bench)) == {} and got(d.leaks(frame, bench.limit(0))) == {}


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = got(d.leaks(docs, items))
    monkeypatch.setattr(d, "MOST_BROADCAST", 0)
    assert got(d.leaks(docs, items)) == want


def test_every_allowed_substitution_of_short_items(spark):
    items = [(n, " ".join(f"i{n}w{j}" for j in range(n))) for n in range(1, 16)]
    docs, want = [], set()
    for n, text in items:
        may = min(n, d.WINDOW) - d.least_matches(n)
        for c in range(may + 2):
            for gone in itertools.combinations(range(n), c):
                docs.append((len(docs), "so " + " ".join("x" if j in gone else w for j, w in enumerate(text.split())) + " on"))
                want |= {(docs[-1][0], n)} if c <= may else set()
        if n > 1:
            docs.append((len(docs), text.split(" ", 1)[1]))
            docs.append((len(docs), text.rsplit(" ", 1)[0] + " " + text))
    docs.append((len(docs), "I1W0, " * 50))
    rule = whole_rule(docs, items)
    assert rule.keys() >= want and any(n == 1 for _, n in want)
    found = got(d.leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                        spark.createDataFrame(items, "item_id long, text string")))
    assert found == rule
    one = spark.createDataFrame([(1, "so B c d")], "doc_id long, text string")
    assert got(d.leaks(one, spark.createDataFrame([(4, "b C")], "item_id long, text string"))) == {(1, 4): (2, 2)}


def test_masks_leave_no_gap():
    assert d.masks_for(d.WINDOW) == list(d.MASKS)
    for masks, window, similarity in ((d.MASKS, 13, 0.8), (d.MASKS, 20, 0.7), (("111111",), 13, 0.5)):
        for n in range(1, window + 1):
            chosen = d.masks_for(n, masks, window, similarity)
            for gone in itertools.combinations(range(n), n - d.least_matches(n, window, similarity)):
                assert any(all(at + o not in gone for o, c in enumerate(m) if c == "1")
                           for m in chosen for at in range(n - len(m) + 1)), (n, gone)
