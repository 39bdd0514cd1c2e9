import re

import pytest

from reuselens.llm import licences as li


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for i in range(len(words)):
        for phrase, label in li.BASE.items():
            p = phrase.split()
            if words[i:i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in df.collect()), key=str)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = sorted(((r.doc_id, *brute(r.text)) for r in docs.collect()), key=str)
    assert sum(w[2] for w in want) > 5
    assert got(li.scan(docs)) == want


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "CC BY cc-by; cc by"), (4, "The GNU General\nPublic  License, gnu GENERAL public license"),
            (5, "xcc by cc byé éMIT license MIT-License"), (None, "apache license"), (6, "apache license"),
            (6, "apache license"), (7, "word " * 200_000 + "MIT license")]
    docs = spark.createDataFrame([(d, t, 3, "q") for d, t in rows], "doc_id long, text string, n_words int, labels string")
    found = li.scan(docs)
    assert got(found) == sorted(((d, *brute(t)) for d, t in rows), key=str)
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) <= set(r.labels.split(",")) for r in found.collect())
    assert li.scan(docs.limit(0)).collect() == []


@pytest.mark.parametrize("line, text, labels, use", [
    ("MIT", "MIT", {"mit"}, 1),
    ("(MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0", None, {"mit", "apache", "gpl"}, 2),
    ("MIT AND GPL-3.0-or-later OR Apache-2.0", None, {"mit", "gpl", "apache"}, 1),
    ("gpl-2.0 and the rest of the line", "gpl-2.0", {"gpl"}, 3),
    ("MIT */", "MIT", {"mit"}, 1),
])
def test_expressions(line, text, labels, use):
    assert li.parse_expression(line) == (text or line, labels, use)


@pytest.mark.parametrize("line", ["", "()", "MIT)x"[3:], "unheard-of", "AND MIT", "(MIT"])
def test_no_expression(line):
    assert li.parse_expression(line) is None


def test_tags_count(spark):
    docs = spark.createDataFrame([(1, "// SPDX-License-Identifier: MIT OR MPL-2.0\ncode"), (2, "spdx license identifier mit")],
                                 "doc_id long, text string")
    r = {x.doc_id: x for x in li.scan(docs).collect()}
    assert (r[1].labels, r[1].expressions, r[1].allowed_use) == ("mit,mpl", ["MIT OR MPL-2.0"], "permissive")
    assert (r[2].labels, r[2].expressions, r[2].score) == ("", [], 0.0)


@pytest.mark.parametrize("line, text, labels, use", [
    ("MIT AND CDDL-1.0", None, {"mit", "cddl"}, "weak-copyleft"),
    ("GPL-2.0-only OR CECILL-2.1", None, {"gpl", "cecill"}, "copyleft"),
    ("MIT AND (Foo-1.0 OR LicenseRef-x) */", "MIT AND (Foo-1.0 OR LicenseRef-x)", {"mit", "unknown"}, "unknown"),
    ("MIT OR Foo-1.0", None, {"mit", "unknown"}, "permissive"),
    ("MIT AND Foobar", None, {"mit", "unknown"}, "unknown"),
    ("MIT and some-licence -->", "MIT and some-licence", {"mit", "unknown"}, "unknown"),
    ("DocumentRef-a.b:LicenseRef-c WITH Some-exception", None, {"unknown"}, "unknown"),
    *((x, None, {label}, use) for x, label, use in [
        ("CDDL-1.1", "cddl", "weak-copyleft"), ("Artistic-2.0", "artistic", "permissive"), ("EUPL-1.2", "eupl", "copyleft"),
        ("OFL-1.1", "ofl", "weak-copyleft"), ("PostgreSQL", "postgresql", "permissive"), ("Python-2.0", "python", "permissive"),
        ("BSL-1.0", "bsl", "permissive"), ("WTFPL", "wtfpl", "permissive"), ("LicenseRef-own", "unknown", "unknown"),
        ("CC-BY-4.0", "cc-by", "permissive"), ("CC-BY-SA-4.0", "cc-by-sa", "copyleft"), ("CC-BY-NC-4.0", "cc-by-nc", "restricted"),
        ("CC-BY-NC-ND-4.0", "cc-by-nc-nd", "restricted"), ("CC-BY-ND-3.0", "cc-by-nd", "restricted")]),
])
def test_whole_expressions(line, text, labels, use):
    found = li.parse_expression(line)
    assert (found[0], found[1], li.USE[found[2]]) == (text or line, labels, use)


@pytest.mark.parametrize("line", ["See LICENSE for details", "SEE LICENSE IN file", "the licence"])
def test_prose_is_no_expression(line):
    assert li.parse_expression(line) is None


def test_long_lines_take_linear_time():
    import time
    start = time.time()
    for line in ("(" * 1_000_000, "MIT OR " * 150_000, "(MIT) AND " * 100_000 + "MIT", "MIT " * 250_000, "a " * 500_000):
        li.parse_expression(line)
    assert time.time() - start < 25


@pytest.mark.parametrize("line", [
    "MIT", "(MIT", "MIT)", "(MIT OR Apache-2.0) AND GPL-2.0", "MIT AND", "MIT OR (Apache-2.0", "GPL-2.0 WITH Classpath-exception-2.0",
    "(MIT) WITH x-1", "GPL-2.0 WITH a-1 WITH b-1", "GPL-2.0 WITH (a-1)", "MIT AND GPL-2.0 WITH", "with MIT", "MIT with OR", "((MIT))",
    "MIT OR GPL-2.0 WITH c-1 AND Apache-2.0 tail", "", "()", "MIT () OR", "MIT OR GPL-2.0 WITH and",
])
def test_longest_prefix_that_parses(line):
    tokens = [m[1] for m in li._TOKEN.finditer(line)]
    best = None
    for n in range(1, len(tokens) + 1):
        try:
            li.evaluate(li.to_postfix(tokens[:n]))
            best = " ".join(tokens[:n])
        except ValueError:
            pass
    found = li.parse_expression(line)
    if "tail" not in line:
        assert (found and re.sub(r"([()])", r" \1 ", found[0]).split()) == (best and re.sub(r"([()])", r" \1 ", best).split())
