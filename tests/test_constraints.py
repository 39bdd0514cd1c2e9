"""Golden extraction and compatibility rows (model: the reference's
table-driven unit tests plus edge cases read from its code)."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from reuselens.functions.constraints import compatible, constraint_diff, diff_dims, extract_constraints

GOLDEN = [
    ("Answer in exactly 3 bullet points.", dict(count=3, format="bullets", entities=["3"])),
    ("Answer in exactly three bullet points.", dict(count=3, format="bullets", entities=None)),
    ("Give me 5 steps.", dict(count=5)),
    ("Do not include anything related to Python.",
     dict(negation="include anything related to python", entities=["Python"])),
    ("Include examples from Python.", dict(negation=None, entities=["Python"])),
    ("Answer in French.", dict(language="french")),
    ("Please respond in Spanish now.", dict(language="spanish")),
    ("Tell me a story.", dict(language=None, count=None, format=None, negation=None)),
    ("Focus on Python.", dict(entities=["Python"])),
    ("Answer as of 2019.", dict(entities=["2019"])),
    ("Give a markdown table", dict(format="table")),
    ("Make a bulleted list", dict(format="bullets")),
    ("Return a JSON object", dict(format="json")),
    ("Write a single prose paragraph", dict(format="prose")),
    ("Show a code snippet", dict(format="code")),
    ("explain Python", dict(entities=None)),
    ("Why not?", dict(negation=None)),
    ("List 3 checkpoints", dict(count=3)),
    ("Give 10 keywords", dict(count=10)),
    ("Give 3 very short points", dict(count=None)),
    ("List 99999999999999 items", dict(count=99999999999999)),
    ("List " + "9" * 39 + " items", dict(count=int("9" * 39))),
    ("List 007 items", dict(count=7)),
    ("List 000 items", dict(count=0)),
    ("Théâtre Paris", dict(entities=None)),
    ("Translate this into German please", dict(language="german")),
    ("Avoid jargon, and keep it short. Next.", dict(negation="jargon, and keep it short")),
    ("Write   without   the   Intro!", dict(negation="the intro")),
    ("Use ٣ points", dict(count=3)),
]


def _row(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(extract_constraints(F.col("t")).alias("c")).first()["c"]


@pytest.mark.parametrize("text,expect", GOLDEN)
def test_golden(spark, text, expect):
    c = _row(spark, text)
    for k, v in expect.items():
        got = c[k]
        if k == "count" and got is not None:
            got = int(got)
        assert got == v, (text, k, got, v)


def test_entities_two_sentences(spark):
    c = _row(spark, "Compare Rust and Go. Then Java wins.")
    # first capitalised word of each sentence is dropped
    assert c["entities"] == ["Go", "Java", "Rust"]


def test_compatibility(spark):
    rows = [
        ("What is a tardigrade?", "Tell me about tardigrades please", True, []),
        ("Answer in exactly 3 bullet points.", "Answer in exactly 10 bullet points.", False,
         ["count", "entities"]),
        ("Answer in exactly 3 bullet points.", "Respond using exactly 3 bullet points.", True, []),
    ]
    df = spark.createDataFrame([(a, b) for a, b, _, _ in rows], "a string, b string")
    out = df.select(
        compatible(extract_constraints(F.col("a")), extract_constraints(F.col("b"))).alias("ok"),
        diff_dims(extract_constraints(F.col("a")), extract_constraints(F.col("b"))).alias("dims"),
        constraint_diff(extract_constraints(F.col("a")), extract_constraints(F.col("b"))).alias("d"),
    ).collect()
    for r, (_, _, ok, dims) in zip(out, rows):
        assert r["ok"] == ok
        assert r["dims"] == dims
    assert Decimal(out[1]["d"]["count"]["a"]) == 3 and Decimal(out[1]["d"]["count"]["b"]) == 10
