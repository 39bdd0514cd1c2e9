"""Derived views over the driver tables (FIXTURES.md part B).

All are plain expressions so that the DuckDB oracle defines them
identically (see ``reuselens.plans.oracle``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constraints as C
from .tables import load

# ---------------------------------------------------------------------
# The eight perturbation families and the control
# templates of the evaluation design, in their natural order.
# ---------------------------------------------------------------------
FAMILIES = [
    ("numeric", "in_design", "Answer in exactly 3 bullet points.", "Answer in exactly 10 bullet points."),
    ("negation", "in_design", "Include examples from Python.", "Do not include anything related to Python."),
    ("language", "in_design", "Answer in French.", "Answer in German."),
    ("entity", "in_design", "Focus on Python.", "Focus on Go."),
    ("format", "in_design", "Answer as a markdown table.", "Answer as a single prose paragraph."),
    ("register", "held_out", "Explain it for a five-year-old.", "Explain it for a domain expert."),
    ("temporal", "held_out", "Answer as of 2019.", "Answer as of today."),
    ("polarity", "held_out", "Focus only on the benefits.", "Focus only on the drawbacks."),
]
CONTROL_FAMILIES = ["numeric", "language", "format"]
CONTROL_NUMBERS = [3, 5, 7, 10]
CONTROL_LANGUAGES = ["French", "German", "Spanish", "Hindi", "Japanese"]
CONTROL_FORMATS = ["markdown table", "JSON object", "bulleted list", "numbered list"]
# control templates: (suffix_a, suffix_b) with {} for the chosen value
CONTROL_TEMPLATES = {
    "numeric": ("Answer in exactly {} bullet points.", "Respond using exactly {} bullet points."),
    "language": ("Answer in {}.", "Respond in {}."),
    "format": ("Answer as a {}.", "Give the answer as a {}."),
}
# ---------------------------------------------------------------------

BASE_MIN_LEN, BASE_MAX_LEN = 20, 300


def lexicon_phrases() -> list[str]:
    """Requests that use every entry of the extraction lexicons, by rule."""
    nouns = [n.removesuffix("?").removesuffix("s") for n in C.OUTPUT_NOUNS]
    numbers = [*C.NUM_WORDS, "3", "12", "007", "9" * 40]
    out = [f"Give {v} {nouns[i % len(nouns)]}{'s' if i % 2 else ''}." for i, v in enumerate(numbers)]
    out += [f"Explain it {cue} any Jargon, please." for cue in C.NEG_CUES]
    out += [f"Answer {('in', 'into', 'to')[i % 3]} {lang.title()}." for i, lang in enumerate(C.LANGUAGES)]
    out += [f"Write it as {phrase}." for phrases in C.FORMATS.values() for phrase in phrases]
    return out


def prompted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): every whole document, followed by a request; document
    ``d`` gets phrase ``d mod n`` of the lexicon phrases."""
    ph = lexicon_phrases()
    pick = F.element_at(F.array(*[F.lit(x) for x in ph]), (F.pmod("doc_id", F.lit(len(ph))) + 1).cast("int"))
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", F.concat("text", F.lit("\n"), pick).alias("text"))


def families_array() -> F.Column:
    """The family table as an array<struct> literal: ``explode`` it to
    pair every row with every family without a join."""
    return F.array(*[
        F.struct(F.lit(i).alias("family_ord"), F.lit(f).alias("family"), F.lit(s).alias("split"),
                 F.lit(a).alias("suffix_a"), F.lit(b).alias("suffix_b"))
        for i, (f, s, a, b) in enumerate(FAMILIES)])


def families(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(families_array()).alias("f")).select("f.*")


#: Sentence ``n`` of document ``d`` has the id ``d * SENTENCES + n``.
SENTENCES = 1 << 24


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every line of every document of 20..300 characters:
    (base_id, doc_id, n, base, category)."""
    docs = load(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return (docs.select("doc_id", F.col("lang").alias("category"), F.posexplode(F.split("text", r"\n|\. ")).alias("n", "base"))
            .filter(F.length("base").between(BASE_MIN_LEN, BASE_MAX_LEN))
            .select((F.col("doc_id") * SENTENCES + F.col("n")).alias("base_id"), "doc_id", "n", "base", "category"))


def base_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per distinct (sentence, lang), keeping the lowest id."""
    return (sentences(spark, sf_dir).groupBy("base", "category").agg(F.min("base_id").alias("base_id"))
            .select("base_id", "base", "category"))


def labelled_natural_pairs(spark: SparkSession, sf_dir: str, offset: int) -> DataFrame:
    """Natural prompt pairs: each sentence of document ``d`` with the sentence
    at the same place in document ``d + offset`` of the same language, copies
    included. label = 1 when both normalise to the same text or both documents
    carry quality = 1 in ``labels``, else 0."""
    from ..functions.keys import normalize_text
    b = sentences(spark, sf_dir)
    left = b.select(F.col("base_id").alias("base_a"), (F.col("doc_id") + offset).alias("doc_id"), "n", "category",
                    F.col("base").alias("text_a"))
    right = b.select(F.col("base_id").alias("base_b"), "doc_id", "n", "category", F.col("base").alias("text_b"))
    # the labels of both documents come last: before, a large table of them would shuffle every sentence once more
    q = load(spark, sf_dir, "labels", "doc_id", "quality")
    p = left.join(right, ["doc_id", "n", "category"]).withColumn("doc_a", F.col("doc_id") - offset)
    p = (p.join(q.select(F.col("doc_id").alias("doc_a"), F.col("quality").alias("q_a")), "doc_a", "left")
         .join(q.select("doc_id", F.col("quality").alias("q_b")), "doc_id", "left"))
    same = normalize_text(F.col("text_a")) == normalize_text(F.col("text_b"))
    both_q = (F.col("q_a") == 1) & (F.col("q_b") == 1)
    return p.select(
        "base_a", "base_b", "text_a", "text_b", "category",
        F.when(same | F.coalesce(both_q, F.lit(False)), 1).otherwise(0).alias("label"))
