"""Language identification by cross-parsing entropy.

For each language a bounded sample of labelled text becomes one reference
string, indexed by a suffix automaton. A text is parsed greedily into phrases,
each the longest match in a reference; the number of phrases times the bits
that name a place in the reference, over the number of symbols, estimates the
cross entropy of the text under that language. The language of fewest bits
wins.

Symbols are the UTF-8 bytes of lower-cased letters, so every letter of every
script counts; each run of other characters is one space. The automata are
transition tables, and the parse steps through all blocks of a batch of texts
at once, so no Python code runs per character. Blocks of ``BLOCK`` symbols are
parsed on their own (each block's last phrase counts as one, alike for every
language); all blocks of a text count, whatever its length. Bits are counted
per letter, whatever its bytes."""

from __future__ import annotations

import hashlib
import pickle
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import steps

SAMPLE_ROWS = 64        # most training documents a language
SAMPLE_SYMBOLS = 16_384  # most symbols of a language's reference
MOST_LANGUAGES = 64     # more labels are an error, not left out
BLOCK = 512
SLACK = 24              # letters; a text of n may cost 1 + SLACK / n times what random letters do
SLICE = 1 << 19         # characters that are turned into symbols at once
UNKNOWN = "und"
_PAD, _GAP, _OTHER, _FIRST = 0, 1, 2, 3  # symbol numbers


class Automaton:
    """Suffix automaton of a symbol string as a table: ``table[s * width + c]``
    is twice the (scaled) next state, plus 1 where the phrase ends before c."""

    def __init__(self, text: list[int], width: int):
        go, link, length, last = [{}], [-1], [0], 0
        for c in text:
            cur = len(go)
            go.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in go[p]:
                go[p][c] = cur
                p = link[p]
            if p >= 0:
                q = go[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    twin = len(go)
                    go.append(dict(go[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and go[p].get(c) == q:
                        go[p][c] = twin
                        p = link[p]
                    link[q] = link[cur] = twin
            last = cur
        # A symbol that the reference lacks is a phrase of its own: it ends the phrase
        # before it, and the state after it (the last row) ends at any symbol.
        alone = len(go)
        root = np.full(width, alone * width * 2 + 1, dtype=np.int32)
        for c, t in go[0].items():
            root[c] = t * width * 2 + 1
        table = np.tile(root, (alone + 1, 1))
        for s, edges in enumerate(go):
            for c, t in edges.items():
                table[s, c] = t * width * 2
        table[0, [c for c in range(width) if c not in go[0]]] -= 1  # no phrase was open
        table[:, _PAD] = np.arange(alone + 1) * width * 2  # padding keeps the state
        self.table = np.ascontiguousarray(table.ravel())
        self.bits = float(np.log2(max(2, len(text))))

    def phrases(self, columns: np.ndarray) -> np.ndarray:
        """Number of phrases of each column of ``columns`` (symbols x texts)."""
        state = np.zeros(columns.shape[1], dtype=np.int32)
        count = np.zeros(columns.shape[1], dtype=np.int32)
        for symbols in columns:
            step = self.table.take(state + symbols)
            count += step & 1
            state = step >> 1
        return count + (state != 0)


class Model:
    """Automata of all languages over one alphabet."""

    def __init__(self, references: dict[str, list[str]]):
        plain = {lang: "".join(_fold(t) for t in texts)[:SAMPLE_SYMBOLS].encode() for lang, texts in references.items()}
        present = sorted(set(b"".join(plain.values())) - {0x20})
        code = np.full(256, _OTHER, dtype=np.uint8)
        code[present] = np.arange(_FIRST, _FIRST + len(present))
        code[0x20] = _GAP
        self.code = code
        self.langs = sorted(plain)
        letters = {c for text in plain.values() for c in text.decode("utf-8", "ignore")}
        self.most_bits = float(np.log2(max(2, len(letters))))  # of letters drawn at random
        self.automata = [Automaton(code[np.frombuffer(plain[lang], dtype=np.uint8)].tolist(), _FIRST + len(present))
                         for lang in self.langs]
        self.fold = np.full(0x110000, 0x20, dtype=np.uint32)
        for cp in range(0x110000):
            if unicodedata.category(chr(cp))[0] == "L":
                low = chr(cp).lower()
                self.fold[cp] = ord(low) if len(low) == 1 else cp

    def encode(self, text: str) -> tuple[np.ndarray, int]:
        """Symbols of a text, and how many letters and gaps they are."""
        s = self.fold[np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)]
        gap = s == 0x20
        keep = ~gap
        keep[1:] |= gap[1:] & ~gap[:-1]
        keep[:1] = True
        s = s[keep]
        return self.code[np.frombuffer(s.tobytes().decode("utf-32-le", "replace").encode(), dtype=np.uint8)], len(s)

    def bits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits a letter of every text under every language, whether it has a
        letter, and its letters and gaps. Long texts go in slices."""
        out = np.zeros((len(texts), len(self.langs)))
        size = np.zeros(len(texts), dtype=np.int64)
        letters = np.zeros(len(texts), dtype=bool)
        codes, owner, held = [], [], 0

        def parse():
            blocks = [-(-len(c) // BLOCK) for c in codes]
            grid = np.zeros((max(1, sum(blocks)), BLOCK), dtype=np.uint8)
            row = 0
            for c, n in zip(codes, blocks):
                grid[row:row + n].ravel()[:len(c)] = c
                row += n
            columns = np.ascontiguousarray(grid.T).astype(np.int32)
            of = np.repeat(np.array(owner, dtype=np.int64), blocks)
            for k, a in enumerate(self.automata):
                out[:, k] += np.bincount(of, weights=a.phrases(columns)[:len(of)], minlength=len(texts)) * a.bits
            codes.clear()
            owner.clear()

        for i, t in enumerate(texts):
            for at in range(0, len(t or ""), SLICE):
                c, n = self.encode(t[at:at + SLICE])
                size[i] += n
                letters[i] |= bool((c >= _OTHER).any())
                codes.append(c)
                owner.append(i)
                held += len(c)
                if held > 4 * SLICE:
                    parse()
                    held = 0
        parse()
        return out / np.maximum(size, 1)[:, None], letters, size

    def fits(self, bits: np.ndarray, letters: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether a text is in some language of the model: it has letters, and
        costs fewer bits than random letters do. The shorter a text is, the less
        its bits tell: the bound widens with 1 / length."""
        if not self.langs:
            return np.zeros(len(letters), dtype=bool)
        return letters & (bits.min(axis=1) < self.most_bits * (1 + SLACK / np.maximum(size, 1)))


def _fold(text: str) -> str:
    out = []
    for c in text:
        if unicodedata.category(c)[0] == "L":
            low = c.lower()
            out.append(low if len(low) == 1 else c)
        elif not out or out[-1] != " ":
            out.append(" ")
    return "".join(out) + " "


_MODELS: dict[str, Model] = {}


def _model(packed: bytes) -> Model:
    key = hashlib.sha1(packed).hexdigest()
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(pickle.loads(packed))
    return _MODELS[key]


def sample_references(train: DataFrame, text_col: str = "text", lang_col: str = "lang",
                      rows: int = SAMPLE_ROWS) -> dict[str, list[str]]:
    """Training texts of each language: of its distinct texts the first
    ``rows`` by hash, one excerpt of ``2 * SAMPLE_SYMBOLS / rows`` characters
    each from a place that the hash gives. The sample is bounded by
    ``MOST_LANGUAGES`` (more labels raise); the group limit is pushed below the shuffle, so a language
    that holds most rows sends no more than others."""
    per = 2 * SAMPLE_SYMBOLS // rows
    t = (train.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
         .select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"),
                 F.xxhash64(F.col(text_col)).alias("h"))
         .filter(F.col("text").rlike(r"\p{L}")))
    room = F.greatest(F.length("text") - per, F.lit(0)) + 1
    t = t.select("lang", "h", F.substring("text", (F.pmod("h", room) + 1).cast("int"), F.lit(per)).alias("text"))
    rank = F.dense_rank().over(Window.partitionBy("lang").orderBy("h"))
    labels = t.select("lang").distinct().count()
    if labels > MOST_LANGUAGES:
        raise ValueError(f"{labels} languages; a table for each of them is held in every task, at most {MOST_LANGUAGES}")
    picked = t.withColumn("r", rank).filter(F.col("r") <= rows).groupBy("lang", "r").agg(F.min("text").alias("text"))
    out: dict[str, list[str]] = {}
    for r in picked.orderBy("lang", "r").collect():  # at most rows x languages excerpts
        out.setdefault(r.lang, []).append(r.text)
    return out


def identify(docs: DataFrame, references: dict[str, list[str]], id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, lang_pred, score, bits`` (bits a
    letter under the winner) and ``fits`` (see ``Model.fits``). ``score`` is one less the ratio of the winner's
    bits to the runner-up's (1 if the model knows one language only).

    A null, empty or letterless text, and any text under a model without
    languages, gets ``und``, score 0 and null bits. Ties go to the language
    first in order. Repeated rows, null ids and other columns do no harm; an
    empty table gives no rows."""
    packed = pickle.dumps(references)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        model = _model(packed)
        for batch in batches:
            for part in steps(batch, "text"):
                texts = part.column(1).to_pylist()
                bits, letters, size = model.bits(texts)
                known = letters & (len(model.langs) > 0)
                lang, score, cost = [], [], []
                for b, ok in zip(bits, known):
                    if not ok:
                        lang.append(UNKNOWN)
                        score.append(0.0)
                        cost.append(None)
                        continue
                    best = int(np.argmin(b))
                    rest = np.delete(b, best)
                    lang.append(model.langs[best])
                    score.append(float(1 - b[best] / rest.min()) if len(rest) else 1.0)
                    cost.append(float(b[best]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                     pa.array(cost, pa.float64()), pa.array(model.fits(bits, letters, size))],
                    ["doc_id", "lang_pred", "score", "bits", "fits"])

    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, bits double, fits boolean")


def held_out(id_col: str = "doc_id", fold: int = 2, folds: int = 4) -> F.Column:
    """Whether a document is kept from training: crc32 of its id as text modulo ``folds``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, list[str]]:
    """References from the documents that are not held out."""
    return sample_references(docs.filter(~held_out(id_col)), text_col, lang_col)


def keep_known(docs: DataFrame, references: dict[str, list[str]], id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text fits some language of the model (see
    ``Model.fits``); null, empty and letterless texts go. One pass, without a
    shuffle."""
    out = docs.schema

    def run(batches):
        model = _model(packed)
        for batch in batches:
            if not batch.num_rows:
                continue
            keep = np.zeros(batch.num_rows, dtype=bool)
            at = 0
            for part in steps(batch, text_col):
                texts = part.column(part.schema.get_field_index(text_col)).to_pylist()
                keep[at:at + len(texts)] = model.fits(*model.bits(texts))
                at += len(texts)
            yield batch.filter(pa.array(keep))

    packed = pickle.dumps(references)
    return docs.mapInArrow(run, out)
