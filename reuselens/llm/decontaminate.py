"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions.

A fixed mask names the positions of a span of words that count; the others
may hold any word. Every position of a training text and of a benchmark item
is hashed under each mask, and equal hashes are hits. A hit fixes how item and
text are aligned, and the words around it are then compared one by one: the
item has leaked if, in some stretch of ``WINDOW`` consecutive item words (all
words of a shorter item), at least ``SIMILARITY`` of the aligned words are equal.

Which words may differ decides whether a mask is hit. For every item length
of the benchmark all such choices are gone through, and masks that the given
ones leave a gap for are added for items of that length; texts are hashed
under them only if the benchmark holds such items."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage_table

#: Fixed masks: 1 counts, 0 is ignored. Five of eight words.
MASKS = ("11011001", "10110101", "11100011")
#: What items too short for the masks, or not covered by them, are hashed under as well, as far as needed.
SHORT_MASKS = ("11111", "1111", "110011", "11011", "10111", "11101", "111", "11", "1")
#: So many choices of differing words are gone through at most.
MOST_CHOICES = 20_000
WINDOW = 13
SIMILARITY = 0.8
#: The hashes of a benchmark are broadcast up to so many rows (16 bytes each); beyond, the join is shuffled.
MOST_BROADCAST = 1_000_000


def _once(column: Column) -> Column:
    """The value of ``column`` as a row of its own: an expression above reads
    the value, where Catalyst would otherwise compute the column again for
    every element of an array."""
    return F.explode(F.array(column))


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words (runs of letters and digits) of a text."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _places(mask: str) -> list[int]:
    return [o for o, c in enumerate(mask) if c == "1"]


def masks_for(width: int, masks: tuple[str, ...] = MASKS, window: int = WINDOW, similarity: float = SIMILARITY) -> list[str]:
    """The masks for stretches of ``width`` words: whichever of them differ
    within the rule, one mask is hit. ``masks`` that fit come first; what they
    miss is left to the fewest of ``SHORT_MASKS``, and what these miss to a
    run of words, one of which no choice of differing words can break."""
    differ = width - least_matches(width, window, similarity)
    chosen = [m for m in masks if len(m) <= width]
    run = "1" * max(1, width // (differ + 1))
    if math.comb(width, differ) > MOST_CHOICES:
        return list(dict.fromkeys([*chosen, run]))

    def hits(mask: str, gone: tuple[int, ...]) -> bool:
        return any(not any(at + o in gone for o in _places(mask)) for at in range(width - len(mask) + 1))

    missed = [g for g in combinations(range(width), differ) if not any(hits(m, g) for m in chosen)]
    while missed:
        more = max(SHORT_MASKS, key=lambda m: sum(hits(m, g) for g in missed))
        if not any(hits(more, g) for g in missed):
            more = run
        chosen.append(more)
        missed = [g for g in missed if not hits(more, g)] if more != run else []
    return chosen


def seeds(words: DataFrame, masks: list[str]) -> DataFrame:
    """``(id, k, at, seed)`` for every mask (the ``k``-th) and position of
    ``words(id, w)``. Where a mask reaches over the end its seed is of the
    words that are there; no seed of a whole mask equals it."""
    room = F.size("w") - min(map(len, masks)) + 1
    at = F.sequence(F.lit(0), room - 1)

    def under(k: int, mask: str) -> Column:
        return F.transform(at, lambda i: F.xxhash64(F.lit(k), *[F.get("w", i + o) for o in _places(mask)]))

    every = F.flatten(F.array(*[under(k, m) for k, m in enumerate(masks)]))
    rows = words.filter(room > 0).select("id", room.alias("room"), F.posexplode(every).alias("p", "seed"))
    return rows.select("id", F.floor(F.col("p") / F.col("room")).cast("int").alias("k"),
                       F.pmod("p", "room").alias("at"), "seed")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_id_col: str = "item_id", item_text_col: str = "text", masks: tuple[str, ...] = MASKS,
          window: int = WINDOW, similarity: float = SIMILARITY) -> DataFrame:
    """One row per leaked item and document: ``doc_id, item_id, item_words,
    window_words, window_matches`` (equal words in the best stretch),
    ``item_matches`` (equal words of the whole item) and ``similarity`` (of
    the best stretch).

    Null and empty texts and items match nothing, as do rows with a null id.
    Items that may not differ at all (under 5 words) match where their words
    stand in a row. Repeated rows count once. Empty tables give no rows; other
    columns are not read."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null")
    items = (benchmark.select(F.col(item_id_col).alias("id"), word_hashes(F.col(item_text_col).cast("string")).alias("w"))
             .filter("id is not null").distinct())
    items = stage_table(items, "items")
    # at most ``window`` rows
    widths = [r.n for r in items.select(F.least(F.size("w"), F.lit(window)).alias("n")).filter("n > 0").distinct().collect()]
    used = {n: masks_for(n, masks, window, similarity) for n in widths}
    every = list(dict.fromkeys(m for n in sorted(used, reverse=True) for m in used[n])) or list(masks)
    known = items.select(F.struct("id", F.size("w").alias("n")).alias("id"), "w")
    n, spans = F.col("of.n"), F.array(*[F.lit(len(m)) for m in every])
    wanted, whole = F.lit(False), F.lit(False)
    for width, chosen in used.items():
        here = F.least(n, F.lit(window)) == width
        wanted |= here & F.col("k").isin([every.index(m) for m in chosen])
        if chosen == ["1" * width]:
            whole |= here & (n == width)
    keys = stage_table(seeds(known, every).withColumnRenamed("id", "of")
                       .filter(wanted & (F.col("at") + F.get(spans, F.col("k")) <= n))
                       .select(F.col("of.id").alias("item_id"), F.col("at").alias("item_at"), "seed", whole.alias("whole"))
                       .distinct(), "item-seeds")
    few = keys.count() <= MOST_BROADCAST
    small = F.broadcast if few else (lambda df: df)
    found = seeds(texts.select("id", _once(word_hashes(F.col("text"))).alias("w")), every).join(small(keys), "seed")
    # An alignment that many hits agree on is one candidate; a hit on all words of an item is as good as any other.
    shift = F.col("at") - F.col("item_at")
    candidates = stage_table(
        found.groupBy("id", "item_id", F.when(~F.col("whole"), shift).alias("own")).agg(F.min(shift).alias("shift"))
        .select("id", "item_id", "shift"), "alignments")

    right = small(items.select(F.col("id").alias("item_id"), F.col("w").alias("iw")))
    pairs = (texts.join(candidates, "id").select("id", "item_id", "shift", _once(word_hashes(F.col("text"))).alias("w"))
             .join(right, "item_id")
             .select("id", "item_id", F.size("iw").alias("n"), _once(F.transform("iw", lambda x, j: F.when(
                 F.get("w", F.col("shift") + j) == x, 1).otherwise(0))).alias("m")))
    width = F.least(F.lit(window), F.col("n"))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.col("n") - width + 1), lambda k: F.aggregate(
        F.slice("m", k, width), F.lit(0), lambda a, x: a + x)))
    scored = pairs.select("id", "item_id", "n", width.alias("width"), best.alias("best"),
                          F.aggregate("m", F.lit(0), lambda a, x: a + x).alias("total"))
    need = F.ceil(F.col("width") * F.lit(similarity) - F.lit(1e-9))
    return (scored.filter(F.col("best") >= need).groupBy("id", "item_id")
            .agg(F.max("n").alias("item_words"), F.max("width").alias("window_words"),
                 F.max("best").alias("window_matches"), F.max("total").alias("item_matches"))
            .select(F.col("id").alias("doc_id"), "item_id", "item_words", "window_words", "window_matches", "item_matches",
                    (F.col("window_matches") / F.col("window_words")).alias("similarity")))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` into which no item of ``benchmark`` leaked (rows
    with a null id are not judged and stay)."""
    bad = stage_table(leaks(docs, benchmark, id_col, **options).select(F.col("doc_id").alias("_bad")).distinct(), "leaks")
    return docs.join(bad, docs[id_col] == bad["_bad"], "left_anti")


def least_matches(words: int, window: int = WINDOW, similarity: float = SIMILARITY) -> int:
    """Equal words that an item of ``words`` words needs in its best stretch."""
    return math.ceil(min(words, window) * similarity - 1e-9)
