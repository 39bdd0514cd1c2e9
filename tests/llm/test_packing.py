import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from reuselens.llm import packing


def reference_ids(text):
    t = Tokenizer.from_file(packing.default_vocabulary())
    return [x.ids for x in t.encode_batch([x or "" for x in text], add_special_tokens=False)]


def check(rows, docs, size):
    """rows: (doc_id, text) with distinct ids; docs: result rows."""
    want = {d: ids + [1] for (d, _), ids in zip(rows, reference_ids([t for _, t in rows]))}
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in docs:
        pieces[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    assert pieces.keys() == want.keys()
    for d, ids in want.items():
        at = 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            part = ids[at:at + r.length]
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and r.ids == part
            at += r.length
        assert at == len(ids)
    assert sorted(seqs) == list(range(len(seqs)))
    for q, rs in seqs.items():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == r.sequence_tokens <= size and (at == size or q == len(seqs) - 1)
        assert r.padded_tokens == (at if at & (at - 1) == 0 else size)


def test_round_trip_over_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check(rows, packing.pack(docs.repartition(5, "doc_id")).collect(), 2048)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " " * 300_000 + "a\n\n b"), (4, "x" * 50_000), (5, "<|endoftext|> 日本 🎉 it's ½"),
            (6, "same"), (7, "same"), (None, "no id")]
    docs = spark.createDataFrame([(d, t, 0, b"") for d, t in rows], "doc_id long, text string, part int, ids binary")
    check(rows, packing.pack(docs, size=64).collect(), 64)
    assert packing.pack(docs.limit(0)).collect() == []
    twice = packing.pack(docs.filter("doc_id = 6").union(docs.filter("doc_id = 6")), size=64).collect()
    assert len(twice) == 2 and {r.offset for r in twice} == {0, len(reference_ids(["same"])[0]) + 1}


def test_added_tokens_have_their_own_id(spark):
    rows = [(1, "hello <|endoftext|> world"), (2, "<|endoftext|><|endoftext|>"), (3, "<|endoftext|" + " |>"),
            (4, " " * 300_000 + "a <|endoftext|>\n\n b"), (5, "plain")]
    plain = Tokenizer.from_file(packing.default_vocabulary())
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = packing.pack(docs, size=1 << 20).collect()
    assert {r.doc_id: r.ids for r in found} == {d: plain.encode(t, add_special_tokens=False).ids + [1] for d, t in rows}
    assert {r.doc_id: r.ids for r in found}[1] == [31373, 220, 50256, 995, 1]
