import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from reuselens.llm import tokenfile as T
from reuselens.llm.warc import open_fs


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(T.default_vocabulary())


def want(rows, library):
    """doc_id, start, n_tokens, crc of rows in order."""
    out, at = [], 0
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    return out


def got(df):
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32, list(r.ids)) for r in df.collect()), key=lambda r: r[1])


def test_pieces_have_the_ids_of_the_library(library):
    rng = random.Random(3)
    letters = "aAbzÀàßÞÿ×÷'stdmlrev0919.,;:!?-_#<|>́éİΣ日\x01\x7f\xa0 \n\t\x1c\x85"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(2000)]
    texts += ["", "ΑΣ ΟΔΟΣ.", "a<|endoftext|>b <|startoftext|> <|END|>", "x" * 5000, "Don't 'S 'll'd", "é a ́"]
    encoder = T.WordEncoder(T.default_vocabulary(), most=100)  # emptied again and again
    for k in range(0, len(texts), 50):
        found = encoder.ids([t.encode() for t in texts[k:k + 50]])
        assert [f.tolist() for f in found] == [library.encode(t, add_special_tokens=False).ids for t in texts[k:k + 50]]


def test_every_token_has_its_own_id(library):
    # every word of the vocabulary, and each of its tokens before a letter and after one
    tokens = [t for t in library.get_vocab() if t not in ("<|startoftext|>", "<|endoftext|>")]
    shown = {chr(256 + i): chr(b) for i, b in enumerate(b for b in range(256) if not (0x21 <= b < 0x7F or 0xA1 <= b < 0xAD or b >= 0xAE))}
    texts = ["".join(shown.get(c, c) for c in t.removesuffix("</w>")).encode("latin-1", "replace").decode("utf-8", "replace") for t in tokens]
    texts = [x for t in texts for x in (t, t + "q", "q" + t, t + "e", "s" + t)]
    found = T.WordEncoder(T.default_vocabulary()).ids([t.encode() for t in texts])
    assert [f.tolist() for f in found] == [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]


@pytest.mark.parametrize("symbols,n", [(1, 1), (1, 40_000), (3, 8192), (300, 100_001), (40_000, 70_000)])
def test_code_round_trip_and_random_access(symbols, n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % symbols * 7 + 5).astype(np.uint32)
    values, counts = np.unique(ids, return_counts=True)
    table = T.Table(values, counts)
    assert int(table.freq.sum()) == 1 << table.bits and (table.freq > 0).all()
    assert T.Table.load(table.dump()).digest() == table.digest()
    blocks = T.encode_blocks(ids, table)
    assert len(blocks) == -(-n // T.BLOCK) and (T.decode_blocks(blocks, table) == ids).all()
    for first in {0, n // 3, n - 1, max(0, n - T.SEGMENT)}:
        for count in (1, T.SEGMENT, n):
            assert (T.decode_blocks(blocks, table, first, count) == ids[first:first + count]).all()
    p = counts / n
    bits = -(p * np.log2(p)).sum() * n
    assert sum(map(len, blocks)) * 8 < 1.02 * bits + 8 * 300 * (n // T.SEGMENT + 1)


def test_damage_is_found():
    ids = np.arange(50_000, dtype=np.uint32) % 100
    table = T.Table(np.arange(100), np.full(100, 500))
    block, = T.encode_blocks(ids[:T.BLOCK], table)
    for at in (20, 100, len(block) - 1):
        with pytest.raises(ValueError):
            T.decode_blocks([block[:at] + bytes([block[at] ^ 1]) + block[at + 1:]], table)
    with pytest.raises(ValueError):
        T.Table.load(table.dump()[:-5] + b"xxxxx")


def test_whole_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert got(T.read_tokens(spark, T.write_tokens(docs.repartition(5, "lang")))) == want(rows, library)


def test_odd_rows_small_files_and_lost_attempts(spark, library):
    rows = [(1, None), (2, ""), (3, "word " * 90_000), (5, "<|endoftext|> 日本 🎉 it's ½"), (6, "same"), (6, "same"), (9, "z" * 3000)]
    frame = spark.createDataFrame([(t, d, 0, b"", 1) for d, t in [*rows[::-1], (None, "no id")]],
                                  "text string, doc_id long, part int, ids binary, n int")
    path = T.write_tokens(frame, file_tokens=40_000)
    store, folder = open_fs(path)
    with store.open_output_stream(f"{folder}/part-000000-0000-lost.rans") as f:
        f.write(b"half a file")  # what a lost attempt leaves
    expected = want([(None, "no id"), *rows], library)
    assert got(T.read_tokens(spark, path)) == expected
    slim = T.read_tokens(spark, path, with_ids=False)
    assert slim.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and slim.count() == len(rows) + 1
    # one document by its place, without the rest of its file
    manifest = spark.read.parquet(f"{path}/manifest").orderBy("first_token").collect()
    assert sum(r.tokens for r in manifest) == sum(e[2] for e in expected) and len(manifest) > 1
    with store.open_input_stream(f"{folder}/frequencies") as f:
        table = T.Table.load(f.read())
    _, start, n, _, ids = expected[4]
    r = next(r for r in manifest if r.first_token <= start < r.first_token + r.tokens)
    with store.open_input_file(f"{folder}/{r.file}") as f:
        assert T.Reader(f, r.file_bytes, table).ids(start - r.first_token, n).tolist() == ids


def test_empty_table_and_string_ids(spark, library):
    empty = spark.createDataFrame([], "doc_id string, text string")
    back = T.read_tokens(spark, T.write_tokens(empty))
    assert back.collect() == [] and back.columns == ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
    named = spark.createDataFrame([("b", "two words"), ("a", "One.")], "doc_id string, text string")
    assert got(T.read_tokens(spark, T.write_tokens(named))) == want([("a", "One."), ("b", "two words")], library)
