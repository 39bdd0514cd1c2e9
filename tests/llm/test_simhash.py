import numpy as np
import xxhash

from reuselens.llm import simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    fp = [brute_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 4 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    first = {}
    for (d, _), g in zip(rows, group):
        if d is not None:
            first[g] = min(d, first.get(g, d))
    return sorted(((d, f"{f:016x}", first.get(g)) for (d, _), f, g in zip(rows, fp, group)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=str)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(simhash.near_duplicates(docs)) == brute_components(rows)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977}x{i}" for i in range(100_000))
    rows = [(5, None), (3, ""), (4, " \t\n"), (9, "one two"), (8, "ONE  two"), (7, long), (6, long.upper()),
            (2, "a b c d e"), (2, "a b c d e"), (None, "a b c d e"), (None, "lone text here")]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, fp int, component_id int")
    assert got(simhash.near_duplicates(docs)) == brute_components(rows)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "2", "3", "6", "8", "None", "None"]
    assert got(simhash.near_duplicates(docs.limit(0))) == []


def test_trie_join_loses_no_link():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = base.copy()
    for _ in range(4):
        near ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    centre = np.uint64(0x0123456789ABCDEF)
    dense = np.array([centre ^ np.uint64((1 << i) | (1 << j)) for i in range(64) for j in range(64)])
    x = np.unique(np.concatenate((base, near, dense)))

    def classes(pairs):
        group = np.arange(len(x))
        for i, j in pairs:
            if group[i] != group[j]:
                group[group == max(group[i], group[j])] = min(group[i], group[j])
        return group.tolist()

    brute = [(i, j) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x[i] ^ x) <= 4) if i < j]
    a, b = simhash.trie_links(x, None, 2, 4)
    turn = lambda v: (v << np.uint64(32)) | (v >> np.uint64(32))
    c, d = simhash.trie_links(np.sort(turn(x)), None, 1, 4)
    a, b = np.concatenate((a, turn(c))), np.concatenate((b, turn(d)))
    assert classes(zip(np.searchsorted(x, a), np.searchsorted(x, b))) == classes(brute)
