"""Spelling variants by composition of finite-state machines.

Words that differ by one edit are the pairs that the composition *acceptor of
the vocabulary - one-edit transducer - the same acceptor* accepts. Its initial
states are dealt to Spark tasks: if two words differ by one edit, either their
first halves are equal or their last halves are (halves of the shorter one), so
a word goes to the initial states that its halves name, once for the words of
its own length (a replaced letter) and once for those one longer and one
shorter (an inserted or deleted one). Words that share a half differ in the
rest, the window: it becomes the input of the machines.

A task builds one minimised acceptor for the windows of a bundle of initial
states (each has a root of its own, all share the states that accept the same
endings) and walks the composed machine from every root. Before the edit both
sides are in one state; after it the pair of states accepts the endings that
both have, which is worked out once per pair of states.

An initial state with more than ``MOST`` words, or windows beyond ``LONGEST``
letters, is split by halving the window again, so no task holds an unbounded
group; a state with one word has no pairs and is dropped. Every pair belongs to
one state only, that whose window holds the first letter in which the words
differ. Tasks add up what the pairs tell about each word; pairs themselves never
leave a task."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP_CHARS, stage_table, steps

LEAST_LENGTH, LEAST_COUNT, RATIO, DAMAGE = 6, 5, 5, 199
MOST = 20_000      # words of an initial state
LONGEST = 64       # letters of a window
BUNDLE = 20_000    # words in one acceptor
HELD = 200_000     # words that a task adds up before it passes them on
_UPPER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))
_LETTER = "a-zÀ-ÿ"


# --- words -----------------------------------------------------------------
def _runs(text: str, least: int):
    """Lists of the maximal runs of at least ``least`` letters; long texts go
    in slices that end outside a run."""
    found, other = re.compile(f"[{_LETTER}]{{{least},}}"), re.compile(f"[^{_LETTER}]")
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > STEP_CHARS and (gap := other.search(text, at + STEP_CHARS)):
            end = gap.end()
        yield found.findall(text[at:end] if at or end < len(text) else text)
        at = end


def _damaged(run: str, crc: int, divisor: int) -> str:
    h = zlib.crc32(run.encode(), crc)
    if h % divisor:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1:]


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
          divisor: int = DAMAGE) -> DataFrame:
    """``(word, n)``: all distinct words of at least ``least_length`` letters
    and their occurrences. A task adds up its own before they are shuffled."""
    plain = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc_id"),
                        F.col(text_col).cast("string").alias("text"))

    def run(batches):
        total: Counter = Counter()

        def flush():
            names, n = list(total), list(total.values())
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(n, pa.int64())], ["word", "n"])

        for batch in batches:
            for part in steps(batch, "text"):
                texts = part.column(1).cast(pa.binary()).to_pylist()
                for doc, text in zip(part.column(0).to_pylist(), texts):
                    crc = zlib.crc32(f"{doc}:".encode())
                    for found in _runs((text or b"").translate(_UPPER).decode("utf-8", "replace"), least_length):
                        for word, n in Counter(found).items():
                            word = _damaged(word, crc, divisor)
                            if len(word) >= least_length:
                                total[word] += n
                if len(total) > HELD:
                    yield flush()
        yield flush()

    return plain.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


# --- machines --------------------------------------------------------------
class Acceptor:
    """Minimised acyclic acceptor with one root per initial state. Equal
    states (same finality, same arcs) exist once; states are numbers."""

    def __init__(self):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.known: dict[tuple, int] = {}

    def _state(self, final: bool, arcs: dict[str, int]) -> int:
        key = (final, *arcs.items())
        if key not in self.known:
            self.known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
        return self.known[key]

    def add(self, strings: list[str]) -> int:
        """Root of the acceptor of sorted, distinct strings. The path of the
        latest string is open; what the next one leaves is closed and shared."""
        path, last = [[False, {}]], ""

        def close(depth: int):
            while len(path) > depth + 1:
                final, arcs = path.pop()
                path[-1][1][last[len(path) - 1]] = self._state(final, arcs)

        for s in strings:
            same = 0
            while same < len(last) and same < len(s) and last[same] == s[same]:
                same += 1
            close(same)
            path.extend([False, {}] for _ in range(len(s) - same))
            path[len(s)][0] = True
            last = s
        close(0)
        return self._state(*path[0])


class Composition:
    """The acceptor, one edit, and the acceptor again. ``replace``: the edit
    puts another letter in place of one; else it inserts a letter (the first
    side is the shorter). The transducer is unambiguous: a letter is inserted
    only where another one, or the end, follows, so a pair has one path."""

    def __init__(self, acceptor: Acceptor):
        self.a = acceptor
        self.both: dict[tuple[int, int], list[str]] = {}
        self.replaced: dict[int, list[tuple[str, str]]] = {}
        self.inserted: dict[int, list[tuple[str, str]]] = {}

    def common(self, u: int, v: int) -> list[str]:
        """Endings that both states accept: the paths after the edit."""
        if u > v:
            u, v = v, u
        if (u, v) not in self.both:
            x, y = self.a.arcs[u], self.a.arcs[v]
            out = [""] if self.a.final[u] and self.a.final[v] else []
            for c, t in x.items():
                if c in y:
                    out += [c + rest for rest in self.common(t, y[c])]
            self.both[u, v] = out
        return self.both[u, v]

    def edits(self, p: int, replace: bool) -> list[tuple[str, str]]:
        """Pairs of endings of one state whose first letters are the edit."""
        memo = self.replaced if replace else self.inserted
        if p not in memo:
            arcs, out = list(self.a.arcs[p].items()), []
            if replace:
                for i, (c, t) in enumerate(arcs):
                    for d, s in arcs[i + 1:]:
                        out += [(c + rest, d + rest) for rest in self.common(t, s)]
            else:
                for d, s in arcs:
                    if self.a.final[p] and self.a.final[s]:
                        out.append(("", d))
                    for c, t in arcs:
                        if c != d and c in self.a.arcs[s]:
                            out += [(c + rest, d + c + rest) for rest in self.common(t, self.a.arcs[s][c])]
            memo[p] = out
        return memo[p]

    def pairs(self, root: int, replace: bool):
        """All accepted pairs from one initial state."""
        stack = [(root, "")]
        while stack:
            p, prefix = stack.pop()
            for x, y in self.edits(p, replace):
                yield prefix + x, prefix + y
            stack.extend((t, prefix + c) for c, t in self.a.arcs[p].items())


# --- initial states in Spark -------------------------------------------------
# ``short`` letters of the shorter word of a pair, whether both have as many, and the letters that are fixed at
# the start and at the end
_KEY = ["short", "same", "head", "tail", "first", "last"]


def _halved(rows: DataFrame) -> DataFrame:
    """Both halves of the window of every row: the first of ``n`` letters
    fixed, or the rest of them."""
    n = F.col("short") - F.col("head") - F.col("tail")
    half = F.floor(n / 2).cast("int")
    two = F.filter(F.array(F.struct((F.col("head") + half).alias("head"), F.col("tail").alias("tail")),
                           F.struct(F.col("head").alias("head"), (F.col("tail") + n - half).alias("tail"))),
                   lambda w: F.col("short") > w["head"] + w["tail"])
    return rows.select("word", "n", "short", "same", F.explode(two).alias("w")).select(
        "word", "n", "short", "same", "w.head", "w.tail",
        F.substring("word", F.lit(1), F.col("w.head")).alias("first"),
        F.substring("word", F.length("word") - F.col("w.tail") + 1, F.col("w.tail")).alias("last"))


def _initial_states(vocabulary: DataFrame, least_length: int, most: int, longest: int) -> DataFrame:
    size = F.length("word")
    kinds = F.array(F.struct(size.alias("short"), F.lit(True).alias("same")),
                    F.struct(size.alias("short"), F.lit(False).alias("same")),
                    F.struct((size - 1).alias("short"), F.lit(False).alias("same")))
    rows = (vocabulary.select("word", "n", F.explode(kinds).alias("k")).select("word", "n", "k.short", "k.same")
            .filter(F.col("short") >= least_length).withColumn("head", F.lit(0)).withColumn("tail", F.lit(0)))
    ready = None
    while True:
        rows = _halved(rows)
        sizes = rows.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        sized = stage_table(rows.join(sizes, _KEY), "variant-states")
        wide = F.col("short") - F.col("head") - F.col("tail")
        again = ((F.col("size") > most) | (wide > longest)) & (wide > 1)
        part = sized.filter(~again).drop("size")
        ready = part if ready is None else ready.unionByName(part)
        rows = sized.filter(again).drop("size")
        if rows.isEmpty():
            return ready


NEAR = "word string, n bigint, near bigint, form string, form_n bigint"


def _near(batches):
    """Near words of rows that come sorted by initial state, added up per word."""
    best: dict[str, list] = {}
    key, group, bundle, held = None, [], [], 0

    def note(x, nx, y, ny):
        b = best.get(x)
        if b is None:
            best[x] = [nx, 1, y, ny]
            return
        b[1] += 1
        if ny > b[3] or ny == b[3] and y < b[2]:
            b[2], b[3] = y, ny

    def work():
        acceptor = Acceptor()
        machine = Composition(acceptor)
        roots = [acceptor.add([w for w, _, _ in rows]) for _, rows in bundle]
        for root, ((short, same, head, tail, _, _), rows) in zip(roots, bundle):
            of = {w: (x, n) for w, x, n in rows}
            for a, b in machine.pairs(root, same):
                if tail and len(a) != len(b) and b.startswith(a):
                    continue  # they first differ behind the window
                (x, nx), (y, ny) = of[a], of[b]
                note(x, nx, y, ny)
                note(y, ny, x, nx)
        bundle.clear()

    def flush():
        columns = list(zip(*((x, *b) for x, b in best.items()))) or [[]] * 5
        best.clear()
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                          [c.split(" ")[0] for c in NEAR.split(", ")])

    for batch in batches:
        for *k, window, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            if k != key:
                if len(group) > 1:
                    bundle.append((key, group))
                    held += len(group)
                key, group = k, []
                if held >= BUNDLE:
                    work()
                    held = 0
                    if len(best) > HELD:
                        yield flush()
            group.append((window, word, n))
    if len(group) > 1:
        bundle.append((key, group))
    work()
    yield flush()


def near_words(vocabulary: DataFrame, least_length: int = LEAST_LENGTH, most: int = MOST,
               longest: int = LONGEST) -> DataFrame:
    """``(word, near, form, form_n)`` for every word of ``vocabulary(word, n)``
    that has a near word: how many there are, and the one of largest ``n`` (the
    first in code-point order of several)."""
    states = _initial_states(vocabulary, least_length, most, longest)
    window = F.substring("word", F.col("head") + 1, F.length("word") - F.col("head") - F.col("tail"))
    dealt = (states.select(*_KEY, window.alias("window"), "word", "n").repartition(*_KEY)
             .sortWithinPartitions(*_KEY, "window").mapInArrow(_near, NEAR))
    return dealt.groupBy("word").agg(
        F.sum("near").alias("near"), F.min_by("form", F.struct(-F.col("form_n"), "form")).alias("form"),
        F.max("form_n").alias("form_n"))


def _roots(links: DataFrame) -> DataFrame:
    """``(word, root)`` of ``links(word, form)``, which have no cycles: every
    round doubles the length of the path that a row has followed."""
    at = stage_table(links.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        on = at.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        step = stage_table(at.join(on, at["root"] == on["_w"], "left").select(
            "word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "variant-roots")
        at = step.drop("moved")
        if step.filter("moved").isEmpty():
            return at


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
             least_count: int = LEAST_COUNT, ratio: int = RATIO, divisor: int = DAMAGE, most: int = MOST,
             longest: int = LONGEST) -> DataFrame:
    """One row per word of at least ``least_length`` letters and
    ``least_count`` occurrences: ``word, form, root, n, n_near, form_n``. The
    form is the word's near word of largest ``n``, the first in code-point order
    of several, if it occurs ``ratio`` times as often; the root is where the
    forms lead, the word itself without one.

    Null and empty texts have no words; a null id counts as an empty one;
    repeated rows count repeatedly; other columns are not read; words of any
    length take part; an empty table gives no rows."""
    vocabulary = stage_table(words(docs, id_col, text_col, least_length, divisor).filter(F.col("n") >= least_count),
                             "vocabulary")
    near = stage_table(near_words(vocabulary, least_length, most, longest), "variant-near")
    known = vocabulary.join(near, "word", "left").withColumn(
        "is_form", F.coalesce(F.col("form_n") >= ratio * F.col("n"), F.lit(False)))
    known = stage_table(known.select("word", F.when(F.col("is_form"), F.col("form")).alias("form"), "n",
                                     F.coalesce("near", F.lit(0)).alias("n_near"),
                                     F.when(F.col("is_form"), F.col("form_n")).alias("form_n")), "variant-words")
    roots = _roots(known.filter("form is not null").select("word", "form"))
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
