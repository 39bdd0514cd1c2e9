"""Token ids in files of range-coded blocks (static rANS), written and read in
parallel.

One pass tokenises and writes the ids of every document; a count per token id
over the whole corpus (at most one row per entry of the vocabulary) becomes
the frequency table that all files share. The documents are range-partitioned
by id, each task codes the stream of its own documents, and a prefix sum over
one row per task gives every file its first global token.

A file (little-endian throughout)::

    magic | block ... | footer | u64 footer bytes | u32 footer crc32 | magic
    block:  u32 tokens, words, segments, crc32 of what follows
            per segment: u32 first word, u32 crc32 of its ids, LANES x u64 states
            words x u32
    footer: Arrow stream of the documents (doc_id, n_tokens), its length before it,
            then per block u64 offset, u32 tokens

A block is coded on its own. Token ``i`` of a block belongs to lane ``i mod
LANES``; all lanes share one stream of 32-bit words. At every segment start the
block keeps a checkpoint (the decoder's states and its place in the words), so
a decoder can begin at any segment; it steps all segments of many blocks at
once. Every segment carries a checksum of its ids, and every block and footer
one of its bytes; a mismatch raises.

A folder holds the files that its manifest names (a Parquet table, one row per
file, with the digest of the frequency table). Files have names of their own
for every attempt, so lost and repeated tasks leave files that no manifest
names, never wrong ones."""

from __future__ import annotations

import hashlib
import io
import json
import os
import re
import struct
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import raw_texts, stage_table, steps
from .warc import open_fs

END_ID = 2
LANES = 32
SEGMENT = 8192                # tokens between two checkpoints
BLOCK = 4 * SEGMENT           # tokens of a block
GROUP = 64 * BLOCK            # tokens that a task codes or decodes at once
FILE_TOKENS = 8 << 20         # a task starts a new file beyond this many tokens
TABLE_BITS = 20               # least log2 of the sum of all frequencies
MAGIC = b"rANStok1"
_LOW = np.uint64(1 << 31)     # states stay in [2**31, 2**63)
_32 = np.uint64(32)


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


# --- tokens ----------------------------------------------------------------
# Characters that need no normalisation but lower case, and what the vocabulary's split pattern finds among them
# besides runs of letters.
_LETTERS = "a-z\u00df-\u00f6\u00f8-\u00ff"
_ODD = re.compile("[^\\n\\x21-\\x7eA-Z\u00c0-\u00d6\u00d8-\u00de" + _LETTERS + "]")
_MARKS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\\n0-9{_LETTERS}]+")
_STOP = "\x01"


class _Places(dict):
    """Numbers of pieces, given out as they come; ``new`` lists the latest."""

    def __init__(self):
        self.new = []

    def __missing__(self, piece):
        self[piece] = len(self)
        self.new.append(piece)
        return self[piece]


class WordEncoder:
    """Ids of the ``tokenizers`` library, once per distinct piece of text.

    A piece is a run of bytes other than ASCII white space. The vocabulary
    drops white space and no token, normalisation or added token reaches over
    it, so the ids of a text are those of its pieces in order. Pieces of plain
    letters, digits and marks are lower-cased and split here and merged by
    ``tiktoken``, a line break standing for the vocabulary's word end; as every
    token is what the merges make of its own bytes, merging by the ids of what
    results is merging by the pairs of the file (tests hold the whole
    vocabulary against the library). Any other piece goes through the library.
    Ids of known pieces lie in one pool; it is emptied between batches when it
    has grown beyond ``most`` pieces or bytes of pieces (a memory bound that
    changes no id)."""

    def __init__(self, path: str, most: int = 1_000_000, most_bytes: int = 64 << 20):
        import tiktoken
        from tokenizers import Tokenizer, pre_tokenizers
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for every core
        self.tokenizer, self.most, self.most_bytes = Tokenizer.from_file(path), most, most_bytes
        if not _drops_white_space(self.tokenizer):
            raise ValueError(f"{path}: a vocabulary that lower-cases, splits at letters and drops white space is needed")
        spec = json.load(open(path, encoding="utf-8"))
        self.added = [t["content"] for t in spec["added_tokens"]]
        end = spec["model"]["end_of_word_suffix"]
        # what the file writes for each byte
        kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        shown = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in kept)}
        ranks = {bytes(shown[c] for c in t.removesuffix(end)) + b"\n" * t.endswith(end): i
                 for t, i in spec["model"]["vocab"].items() if t not in self.added}
        self.merges = tiktoken.Encoding("words", pat_str=r"[^\n]+\n", mergeable_ranks=ranks, special_tokens={})
        self.stop, = self.merges.encode_ordinary(_STOP + "\n")
        self._clear()

    def _clear(self):
        self.place = _Places()
        self.size = 0
        self.at, self.pool = np.zeros(1, dtype=np.int64), np.empty(0, dtype=np.uint32)

    def _odd(self, texts: list[str]) -> list[int]:
        """Numbers of the pieces that are not plain."""
        line = "\n".join(texts)
        places = [m.start() for m in _ODD.finditer(line)]
        for t in self.added:
            places += [m.start() for m in re.finditer(re.escape(t), line)]
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        return np.unique(np.searchsorted(ends, np.array(places, dtype=np.int64), side="right")).tolist()

    def _learn(self, new: list[bytes]):
        texts = [p.decode("utf-8", "replace") for p in new]
        odd = self._odd(texts)
        whole = [e.ids for e in self.tokenizer.encode_batch_fast([texts[k] for k in odd], add_special_tokens=False)]
        for k in odd:
            texts[k] = ""
        line = _MARKS.sub("\n\\g<0>\n", f"\n{_STOP}\n".join([*texts, ""]).lower())
        ids = self.merges.encode_to_numpy(line, disallowed_special=())
        stops = np.flatnonzero(ids == self.stop)
        count = np.diff(stops, prepend=-1) - 1
        ids = ids[ids != self.stop]
        if odd:
            split = np.cumsum(count)[odd]
            count[odd] = [len(w) for w in whole]
            ids = np.insert(ids, np.repeat(split, count[odd]), np.fromiter(chain.from_iterable(whole), np.uint32, sum(map(len, whole))))
        self.size += sum(map(len, new))
        self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(count)))
        self.pool = np.concatenate((self.pool, ids))

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of every text."""
        if len(self.place) > self.most or self.size > self.most_bytes:
            self._clear()
        number, self.place.new = self.place.__getitem__, []
        which = []
        for t in texts:
            pieces = t.split()
            which.append(np.fromiter(map(number, pieces), np.int64, len(pieces)))
        if self.place.new:
            self._learn(self.place.new)
        out = []
        for w in which:
            lo, n = self.at[w], self.at[w + 1] - self.at[w]
            out.append(self.pool[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])
        return out


def _drops_white_space(tokenizer) -> bool:
    a, b = (tokenizer.encode(t, add_special_tokens=False).ids for t in ("Bad word,x ", "bad \t\n\v\f\r  woRd,X"))
    return a == b == [i for t in ("bad", "word", ",", "x") for i in tokenizer.encode(t, add_special_tokens=False).ids]


_ENCODERS: dict[str, WordEncoder] = {}


def tokenised(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, part, row, n, ids)`` of ``docs(doc_id, text)``: the ids as
    little-endian bytes, two a token where all fit; ``part`` and ``row`` tell
    rows of one doc_id apart."""
    def run(batches):
        if vocabulary not in _ENCODERS:
            _ENCODERS[vocabulary] = WordEncoder(vocabulary)
        encoder, part, row = _ENCODERS[vocabulary], TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in steps(batch, "text"):
                n, out = [], []
                for ids in encoder.ids(raw_texts(rows.column(1))):
                    ids = np.append(ids, np.uint32(end_id))
                    n.append(len(ids))
                    out.append(ids.astype("<u4" if ids.max() > 0xFFFF else "<u2").tobytes())
                count = rows.num_rows
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(np.full(count, part, np.int32)),
                     pa.array(np.arange(row, row + count, dtype=np.int64)), pa.array(n, pa.int64()),
                     pa.array(out, pa.binary())], ["doc_id", "part", "row", "n", "ids"])
                row += count

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, part int, row bigint, n bigint, ids binary")


def _unpacked(batch: pa.RecordBatch) -> tuple[list, list[np.ndarray]]:
    n, raw = batch.column("n").to_pylist(), batch.column("ids").to_pylist()
    return n, [np.frombuffer(b, dtype="<u2" if len(b) == 2 * k else "<u4") for k, b in zip(n, raw)]


def token_counts(tokens: DataFrame) -> DataFrame:
    """``(id, n)`` of every token id that occurs; each task adds up its own."""
    def run(batches):
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for rows in steps(batch, "ids"):
                got = np.bincount(np.concatenate(_unpacked(rows)[1]).astype(np.int64))
                if len(got) < len(total):
                    got, total = total, got
                got[:len(total)] += total
                total = got
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    return tokens.select("n", "ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


# --- the code --------------------------------------------------------------
class Table:
    """Frequencies of all symbols, scaled to a power of two. Every symbol of
    the corpus has a frequency of at least 1."""

    def __init__(self, ids, counts):
        order = np.argsort(np.asarray(ids, dtype=np.int64), kind="stable")
        self.ids = np.asarray(ids, dtype=np.int64)[order].astype("<u4")
        counts = np.asarray(counts, dtype=np.int64)[order]
        self.bits = max(TABLE_BITS, int(len(counts)).bit_length() + 4)
        room, whole = 1 << self.bits, int(counts.sum())
        freq = np.array([max(1, int(c) * room // whole) for c in counts], dtype=np.int64)
        while len(freq) and (over := int(freq.sum()) - room):
            # the difference goes to the most frequent symbols, half of one at most
            top = int(np.argmax(freq))
            freq[top] -= min(over, int(freq[top]) // 2) if over > 0 else over
        self.freq = freq.astype(np.uint64)
        self.cum = np.cumsum(self.freq) - self.freq
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.number = np.zeros(int(self.ids.max()) + 1 if len(self.ids) else 0, dtype=np.uint32)
        self.number[self.ids] = np.arange(len(self.ids))

    def __reduce__(self):  # the tables are rebuilt from ids and frequencies, which the scaling leaves as they are
        return Table, (self.ids.astype(np.int64), self.freq.astype(np.int64))

    def digest(self) -> str:
        return hashlib.sha256(self.ids.tobytes() + self.freq.astype("<u4").tobytes()).hexdigest()

    def dump(self) -> bytes:
        body = struct.pack("<I", len(self.ids)) + self.ids.tobytes() + self.freq.astype("<u4").tobytes()
        return body + struct.pack("<I", zlib.crc32(body))

    @staticmethod
    def load(data: bytes) -> "Table":
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("frequency table: wrong checksum")
        n, = struct.unpack_from("<I", data)
        ids, freq = np.frombuffer(data[4:-4], dtype="<u4").reshape(2, n)
        return Table(ids, freq)


def encode_blocks(ids: np.ndarray, table: Table) -> list[bytes]:
    """Blocks of a stream of ids; all but the last hold ``BLOCK`` tokens."""
    out, whole = [], len(ids) // BLOCK
    for part in (ids[:whole * BLOCK].reshape(whole, BLOCK), ids[whole * BLOCK:][None]):
        if part.size:
            out += _encode_equal(part, table)
    return out


def _encode_equal(ids: np.ndarray, table: Table) -> list[bytes]:
    blocks, n = ids.shape
    rows = -(-n // LANES)
    symbols = np.full((blocks, rows * LANES), np.argmax(table.freq), dtype=np.uint32)  # padding costs least so
    symbols[:, :n] = table.number[ids]
    symbols = symbols.reshape(blocks, rows, LANES)
    per = SEGMENT // LANES
    segments = -(-rows // per)
    x = np.full((blocks, LANES), _LOW, dtype=np.uint64)
    words = np.empty((blocks, rows, LANES), dtype="<u4")
    sent = np.empty((blocks, rows, LANES), dtype=bool)
    states = np.empty((blocks, segments, LANES), dtype="<u8")
    bits, top = np.uint64(table.bits), np.uint64(63 - table.bits)
    for i in range(rows - 1, -1, -1):
        s = symbols[:, i]
        freq = table.freq[s]
        full = x >= (freq << top)
        words[:, i] = x.astype(np.uint32)
        sent[:, i] = full
        x = np.where(full, x >> _32, x)
        times = x // freq
        x = (times << bits) + (x - times * freq) + table.cum[s]
        if i % per == 0:
            states[:, i // per] = x
    out = []
    for b in range(blocks):
        stream = words[b][sent[b]]
        before = np.concatenate(([0], np.cumsum(sent[b].sum(axis=1))))
        body = b"".join(
            struct.pack("<II", before[k * per], zlib.crc32(ids[b, k * SEGMENT:(k + 1) * SEGMENT].astype("<u4").tobytes()))
            + states[b, k].tobytes() for k in range(segments)) + stream.tobytes()
        out.append(struct.pack("<IIII", n, len(stream), segments, zlib.crc32(body)) + body)
    return out


_SEGMENT_HEAD = np.dtype([("word", "<u4"), ("crc", "<u4"), ("state", "<u8", (LANES,))])


def decode_blocks(blocks: list[bytes], table: Table, skip: int = 0, take: int | None = None) -> np.ndarray:
    """Ids of a run of blocks, or ``take`` of them after the first ``skip``;
    only the segments that hold wanted ids are decoded, all in one sweep."""
    heads, words, sizes, base, first, at, wanted = [], [], [], [], None, 0, 0
    for block in blocks:
        n, count, segments, crc = struct.unpack_from("<IIII", block)
        body = memoryview(block)[16:]
        if zlib.crc32(body) != crc:
            raise ValueError("token block: wrong checksum")
        head = np.frombuffer(body, dtype=_SEGMENT_HEAD, count=segments)
        size = np.minimum(SEGMENT, n - SEGMENT * np.arange(segments))
        start = at + np.cumsum(size) - size
        keep = (start + size > skip) & (start < (at + n if take is None else skip + take))
        if keep.any():
            first = int(start[keep][0]) if first is None else first
            heads.append(head[keep])
            sizes.append(size[keep])
            base.append(head["word"][keep].astype(np.int64) + wanted)
            words.append(np.frombuffer(body, dtype="<u4", count=count, offset=segments * _SEGMENT_HEAD.itemsize))
            wanted += count
        at += n
    if not heads:
        return np.empty(0, dtype="<u4")
    head, size, place = np.concatenate(heads), np.concatenate(sizes), np.concatenate(base)
    stream = np.concatenate(words + [np.zeros(1, "<u4")]).astype(np.uint64)
    rows = -(-size // LANES)
    ids = np.empty((len(head), int(rows.max()) * LANES), dtype="<u4")
    for r in np.unique(rows):  # whole segments, and the last ones of blocks
        of = np.flatnonzero(rows == r)
        ids[of, :r * LANES] = _sweep(head["state"][of], place[of], stream, int(r), table)
    for k in range(len(head)):
        if zlib.crc32(ids[k, :size[k]].tobytes()) != head["crc"][k]:
            raise ValueError("token segment: wrong checksum")
    flat = np.concatenate([ids[k, :size[k]] for k in range(len(head))])
    return flat[skip - first if skip > first else 0:][:take]


def _sweep(x: np.ndarray, place: np.ndarray, stream: np.ndarray, rows: int, table: Table) -> np.ndarray:
    out = np.empty((len(x), rows, LANES), dtype="<u4")
    bits, low = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    x, last = x.copy(), len(stream) - 1
    for i in range(rows):
        slot = x & low
        s = table.symbol[slot]
        out[:, i] = s
        x = table.freq[s] * (x >> bits) + slot - table.cum[s]
        short = x < _LOW
        read = np.cumsum(short, axis=1)
        word = stream[np.minimum(place[:, None] + read - 1, last)]
        x = np.where(short, (x << _32) | word, x)
        place = place + read[:, -1]
    return table.ids[out.reshape(len(out), -1)]


# --- files -----------------------------------------------------------------
class Writer:
    """One file: documents in, coded blocks out as soon as a group is full."""

    def __init__(self, file, table: Table):
        self.file, self.table, self.at = file, table, len(MAGIC)
        self.held, self.n_held, self.tokens, self.ids, self.sizes, self.blocks = [], 0, 0, [], [], []
        file.write(MAGIC)

    def add(self, doc_id, ids: np.ndarray):
        self.ids.append(doc_id)
        self.sizes.append(len(ids))
        self.tokens += len(ids)
        for at in range(0, len(ids), GROUP):
            self.held.append(ids[at:at + GROUP])
            self.n_held += len(self.held[-1])
            if self.n_held >= GROUP:
                self._flush(self.n_held // BLOCK * BLOCK)

    def _flush(self, n: int):
        every = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        for block in encode_blocks(every[:n], self.table):
            self.blocks.append((self.at, struct.unpack_from("<I", block)[0]))
            self.file.write(block)
            self.at += len(block)
        self.held, self.n_held = [every[n:]], len(every) - n

    def close(self, kind: pa.DataType) -> int:
        self._flush(self.n_held)
        sink = io.BytesIO()
        index = pa.table([pa.array(self.ids, kind), pa.array(self.sizes, pa.int64())], ["doc_id", "n_tokens"])
        with pa.ipc.new_stream(sink, index.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(index)
        docs = sink.getvalue()
        places = np.array(self.blocks, dtype=[("offset", "<u8"), ("tokens", "<u4")])
        footer = struct.pack("<Q", len(docs)) + docs + places.tobytes()
        self.file.write(footer + struct.pack("<QI", len(footer), zlib.crc32(footer)) + MAGIC)
        return self.at + len(footer) + 12 + len(MAGIC)


class Reader:
    """Random access to one file of ``size`` bytes."""

    def __init__(self, file, size: int, table: Table):
        self.file, self.table = file, table
        tail = len(MAGIC) + 12
        end = self._read(size - tail, tail) if size >= tail + len(MAGIC) else b""
        if end[12:] != MAGIC or self._read(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a token file")
        length, crc = struct.unpack_from("<QI", end)
        self.end = size - tail - length
        footer = self._read(self.end, length)
        if zlib.crc32(footer) != crc:
            raise ValueError("token file: wrong checksum of the footer")
        n, = struct.unpack_from("<Q", footer)
        self.index = pa.ipc.open_stream(footer[8:8 + n]).read_all()
        places = np.frombuffer(footer[8 + n:], dtype=[("offset", "<u8"), ("tokens", "<u4")])
        self.offset = np.append(places["offset"].astype(np.int64), self.end)
        self.first = np.concatenate(([0], np.cumsum(places["tokens"].astype(np.int64))))

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def ids(self, first: int, count: int) -> np.ndarray:
        """``count`` ids of the file from token ``first`` on; reads only the
        blocks, and decodes only the segments, that hold them."""
        if count <= 0:
            return np.empty(0, dtype="<u4")
        a = int(np.searchsorted(self.first, first, side="right")) - 1
        b = int(np.searchsorted(self.first, first + count, side="left"))
        raw = self._read(int(self.offset[a]), int(self.offset[b] - self.offset[a]))
        cuts = self.offset[a:b + 1] - self.offset[a]
        return decode_blocks([raw[i:j] for i, j in zip(cuts[:-1], cuts[1:])], self.table, first - int(self.first[a]), count)


MANIFEST = "part int, seq int, file string, file_bytes bigint, documents bigint, tokens bigint"


def write_tokens(docs: DataFrame, path: str | None = None, vocabulary: str | None = None, end_id: int = END_ID,
                 id_col: str = "doc_id", text_col: str = "text", file_tokens: int = FILE_TOKENS) -> str:
    """Writes the ids of all rows, ascending by id (nulls first, rows of one
    id in the order of the input), and returns the folder. A null text counts
    as empty; every row ends in ``end_id``; other columns are not read; an
    empty table gives a manifest without files."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, f"llm/tokens-{uuid.uuid4().hex}")
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tokens = stage_table(tokenised(plain, vocabulary or default_vocabulary(), end_id), "token-ids")
    counts = token_counts(tokens).collect()  # at most one row per entry of the vocabulary
    table = Table([r.id for r in counts], [r.n for r in counts])
    store, folder = open_fs(path)
    store.create_dir(folder, recursive=True)
    with store.open_output_stream(f"{folder}/frequencies") as f:
        f.write(table.dump())
    parts = max(1, -(-sum(r.n for r in counts) // file_tokens), spark.sparkContext.defaultParallelism)
    ordered = tokens.repartitionByRange(int(parts), "doc_id", "part", "row").sortWithinPartitions("doc_id", "part", "row")

    def run(batches):
        store, folder = open_fs(path)
        part, seq, out, writer = TaskContext.get().partitionId(), 0, [], None
        kind = pa.int64()

        def close():
            size = writer.close(kind)
            stream.close()
            out.append((part, seq, name, size, len(writer.ids), writer.tokens))

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for rows in steps(batch, "ids"):
                for doc, ids in zip(rows.column("doc_id").to_pylist(), _unpacked(rows)[1]):
                    if writer is not None and writer.tokens >= file_tokens:
                        close()
                        writer, seq = None, seq + 1
                    if writer is None:
                        name = f"part-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.rans"
                        stream = store.open_output_stream(f"{folder}/{name}")
                        writer = Writer(stream, table)
                    writer.add(doc, ids)
        if writer is not None:
            close()
        names = [c.split(" ")[0] for c in MANIFEST.split(", ")]
        types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 6, types)], names)

    files = stage_table(ordered.select("doc_id", "n", "ids").mapInArrow(run, MANIFEST), "token-files")
    # one row per task, then the files of a task
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.groupBy("part").agg(F.sum("tokens").alias("all")).select(
        "part", F.coalesce(F.sum("all").over(order), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    (files.join(bases, "part")
     .withColumn("first_token", F.col("base") + F.coalesce(F.sum("tokens").over(within), F.lit(0))).drop("base")
     .withColumn("table_digest", F.lit(table.digest()))
     .withColumn("id_type", F.lit(plain.schema["doc_id"].dataType.simpleString()))
     .write.parquet(f"{path}/manifest"))
    return path


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document of a folder: ``doc_id, start`` (ids of all
    documents before it), ``n_tokens, ids_crc32`` (of all its ids as
    little-endian 32-bit numbers) and, if wanted, ``ids``. One task per file
    at most; a task holds a group of blocks and the document that it is in."""
    manifest = spark.read.parquet(f"{path}/manifest")
    store, folder = open_fs(path)
    with store.open_input_stream(f"{folder}/frequencies") as f:
        table = Table.load(f.read())  # at most 8 bytes per entry of the vocabulary
    about = manifest.agg(F.count("*"), F.min("table_digest"), F.max("table_digest"), F.max("id_type")).first()
    if about[0] and (about[1], about[2]) != (table.digest(),) * 2:
        raise ValueError(f"{path}: files of another frequency table")
    kind = about[3] or "bigint"
    ddl = f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else "")
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches):
        store, folder = open_fs(path)
        for batch in batches:
            for file, size, first in zip(*(batch.column(c).to_pylist() for c in ("file", "file_bytes", "first_token"))):
                with store.open_input_file(f"{folder}/{file}") as f:
                    yield from documents(Reader(f, size, table), first)

    def documents(reader, first):
        sizes = reader.index.column("n_tokens").to_numpy()
        ends = np.cumsum(sizes)
        at, doc, crc, held = 0, 0, 0, []
        while doc < len(sizes):
            got = reader.ids(at, min(GROUP, int(ends[-1]) - at))
            begin, out, lists = doc, [], []
            to = at + len(got)
            while doc < len(sizes) and (ends[doc] <= to or at < to):
                n = int(min(ends[doc], to)) - at
                piece = got[len(got) - (to - at):][:n]
                crc, at = zlib.crc32(piece.tobytes(), crc), at + n
                if with_ids:
                    held.append(piece)
                if at < ends[doc]:
                    break
                out.append(crc)
                if with_ids:
                    lists.append(np.concatenate(held).astype(np.int64))
                crc, held, doc = 0, [], doc + 1
            if out:
                n = sizes[begin:doc]
                columns = [reader.index.column("doc_id").slice(begin, doc - begin).combine_chunks(),
                           pa.array(first + ends[begin:doc] - n), pa.array(n), pa.array(out, pa.int64())]
                if with_ids:
                    columns.append(pa.array(lists, pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names)

    return manifest.select("file", "file_bytes", "first_token").repartition(max(1, about[0])).mapInArrow(run, ddl)
