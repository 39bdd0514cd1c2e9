"""Licence scans: an Aho-Corasick automaton finds licence phrases and
identifier tags in the words of a text; the expression after a tag goes
through a shunting-yard parser and is evaluated.

Words are runs of ASCII digits and letters (A-Z lower-cased) and of all
characters beyond ASCII. A phrase matches where its words stand in a row."""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw_texts, steps

# ---------------------------------------------------------------------
# Base phrases and their labels (contract of op10).
# ---------------------------------------------------------------------
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# ---------------------------------------------------------------------
#: Phrases of common notices besides the base ones.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "licensed under the apache license": "apache",
    "creative commons attribution": "cc-by",
    "cc0": "cc0",
    "public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
#: The words of the tag; in the text they are joined by hyphens and followed by a colon.
TAG = "spdx license identifier"
#: Label and restrictiveness of identifiers, by the first prefix that fits.
FAMILIES = [
    ("agpl", "agpl", 3), ("lgpl", "lgpl", 2), ("gpl", "gpl", 3), ("apache", "apache", 1), ("mit", "mit", 1),
    ("bsd-protection", "bsd-protection", 3), ("bsd-3-clause-no-nuclear", "bsd-restricted", 4),
    ("bsd-3-clause-no-military", "bsd-restricted", 4), ("bsd", "bsd", 1), ("0bsd", "bsd", 1), ("isc", "isc", 1),
    ("mpl", "mpl", 2), ("epl", "epl", 2), ("zlib", "zlib", 1), ("cc0", "cc0", 0),
    ("cc-by-nc-sa", "cc-by-nc-sa", 4), ("cc-by-nc-nd", "cc-by-nc-nd", 4), ("cc-by-nc", "cc-by-nc", 4),
    ("cc-by-nd", "cc-by-nd", 4), ("cc-by-sa", "cc-by-sa", 3), ("cc-by", "cc-by", 1), ("unlicense", "public-domain", 0),
    ("cecill-b", "cecill-b", 1), ("cecill-c", "cecill-c", 2), ("cdla-permissive", "cdla-permissive", 1),
    ("cdla-sharing", "cdla-sharing", 3),
    *((x, x, 0) for x in ("pddl", "blessing")),
    *((x, x, 1) for x in "afl artistic beerware blueoak bsl bzip2 curl efl fsfap ftl hpnd icu imagemagick info-zip libpng "
                         "mulanpsl ncsa ntp odc-by openssl php postgresql psf python ruby sgi-b tcl unicode upl w3c wtfpl "
                         "x11 xnet zend zpl".split()),
    *((x, x, 2) for x in "cddl cpl ipl lppl ms-pl ms-rl npl ofl sissl".split()),
    *((x, x, 3) for x in "cecill copyleft-next eupl gfdl odbl osl qpl rpl sleepycat".split()),
    *((x, x, 4) for x in "busl elastic polyform-noncommercial sspl".split()),
]
#: Of an identifier in none of the families.
UNKNOWN = ("unknown", 5)
USE = ("public-domain", "permissive", "weak-copyleft", "copyleft", "restricted", "unknown")

_WORDS = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
               for b in range(256))
_TAG_AT = re.compile(rb"spdx-license-identifier:[ \t]*([^\r\n]*)", re.I)
_TOKEN = re.compile(r"[ \t]*([()]|(?:DocumentRef-[A-Za-z0-9.-]+:)?[A-Za-z0-9](?:[A-Za-z0-9.+-]*[A-Za-z0-9+])?)")
_SHAPED = re.compile(r"(?=.*(?:\d|[A-Z].*-|-.*[A-Z]))")  # as identifiers are, and words of prose hardly
_NEXT_WORD = re.compile(r"[ \t]+(?!(?:and|or|with)\b)[A-Za-z0-9]", re.I)
_POWER = {"with": 3, "and": 2, "or": 1}


def family(identifier: str) -> tuple[str, int] | None:
    low = identifier.lower().rstrip("+")
    return next(((label, rank) for prefix, label, rank in FAMILIES
                 if low == prefix or low.startswith(prefix + "-")), None)


def to_postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: operands and ``with``, ``and``, ``or`` (binding in this
    order, all to the left) with brackets, to postfix. ``ValueError`` if it is
    no expression."""
    out, ops, operand = [], [], True
    for t in tokens:
        low = t.lower()
        if t == "(":
            if not operand:
                raise ValueError(t)
            ops.append(t)
        elif t == ")":
            if operand:
                raise ValueError(t)
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops:
                raise ValueError(t)
            ops.pop()
        elif low in _POWER:
            if operand:
                raise ValueError(t)
            while ops and ops[-1] != "(" and _POWER[ops[-1]] >= _POWER[low]:
                out.append(ops.pop())
            ops.append(low)
            operand = True
        else:
            if not operand:
                raise ValueError(t)
            out.append(t)
            operand = False
    if operand or "(" in ops:
        raise ValueError("unfinished")
    return out + ops[::-1]


def evaluate(postfix: list[str]) -> tuple[set[str], int]:
    """Labels and restrictiveness: the lesser of both sides of ``or`` (the
    user may choose), the greater of ``and``; ``with`` an exception makes a
    copyleft licence a weak one. An unknown licence is more restrictive than
    any other, and no exception changes that."""
    stack: list = []
    for t in postfix:
        if t in _POWER:
            right, left = stack.pop(), stack.pop()
            if t == "with":
                if not isinstance(left, str) or not isinstance(right, str):
                    raise ValueError("with joins a licence and an exception")
                labels, rank = _known(left)
                stack.append((labels, min(rank, 2) if rank <= 3 else rank))
            else:
                (a, x), (b, y) = _known(left), _known(right)
                stack.append((a | b, min(x, y) if t == "or" else max(x, y)))
        else:
            stack.append(t)
    return _known(stack.pop())


def _known(x) -> tuple[set[str], int]:
    if isinstance(x, str):
        label, rank = family(x) or UNKNOWN
        return {label}, rank
    return x


def _names_licence(t: str, before: list[str], line: str, end: int) -> bool:
    """Whether an operand that ends at ``end`` is an identifier, known or not. A plain word is
    prose if another word follows it, or if it stands first in lower case."""
    if family(t) or _SHAPED.match(t):
        return True
    upper = t != t.lower()
    if before and before[-1] in ("AND", "OR") and upper:
        return True
    return not _NEXT_WORD.match(line, end) and (upper or bool(before))


def parse_expression(line: str) -> tuple[str, set[str], int] | None:
    """The longest expression at the start of ``line`` that parses: its text,
    labels and restrictiveness."""
    tokens, at, operand, whole = [], 0, True, (0, 0)
    single = joined = False  # whether the latest operand is one identifier, and whether "with" stands before
    levels = [[False, False]]  # of each open bracket: whether "with" stands before it, and an operator in it
    while m := _TOKEN.match(line, at):
        t, low = m[1], m[1].lower()
        # operands and operators alternate; what breaks that, or names no licence, is prose
        if operand != (t == "(" or t != ")" and low not in _POWER) or t == ")" and len(levels) == 1 or not (
                t in "()" or low in _POWER or joined or _names_licence(t, tokens, line, m.end())):
            break
        if t == "(":
            levels.append([joined, False])
            joined = False
        elif low in _POWER:
            if low == "with" and not single:  # it joins a licence and an exception
                break
            joined = low == "with"
            levels[-1][1] = True
        else:
            if t == ")":
                joined, compound = levels.pop()
                single = single and not compound
                if joined and not single:
                    break
            else:
                single = True
            single, joined = single and not joined, False
        operand = low in _POWER or t == "("
        tokens.append(t)
        at = m.end()
        if not operand and len(levels) == 1:
            whole = len(tokens), at  # an expression so far
    n, end = whole
    if not n:
        return None
    labels, rank = evaluate(to_postfix(tokens[:n]))
    return line[:end].strip(), labels, rank


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    both: dict[str, list] = {}
    for phrase, label in BASE.items():
        both.setdefault(phrase, []).append((True, label))
    for phrase, label in NOTICES.items():
        both.setdefault(phrase, []).append((False, label))
    both.setdefault(TAG, []).append((False, None))
    for phrase, what in both.items():
        a.add_word(f" {phrase} ", (len(phrase) + 2, what))
    a.make_automaton()
    return a


def scan_text(text: bytes, a: ahocorasick.Automaton) -> dict:
    words = text.translate(_WORDS).split()
    plain = b" %s " % b" ".join(words)
    base, own, places, at, tagged = set(), set(), [], None, False
    for end, (size, what) in a.iter(plain.decode("latin-1")):
        for is_base, label in what:
            if is_base:
                base.add(label)
                places.append(end - size + 1)
            elif label:
                own.add(label)
            else:
                tagged = True
    expressions, ranks = [], []
    if tagged:
        for m in _TAG_AT.finditer(text):
            found = parse_expression(m[1].decode("utf-8", "replace"))
            if found:
                expressions.append(found[0])
                own |= found[1]
                ranks.append(found[2])
    if places:
        at = np.searchsorted(np.flatnonzero(np.frombuffer(plain, dtype=np.uint8) == 0x20), places)
    weight = len(places) + len(own - base) + 3 * len(expressions)
    return {"n_words": len(words), "n_base": len(places), "first_word": None if at is None else int(at.min()),
            "last_word": None if at is None else int(at.max()), "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | own)), "expressions": expressions,
            "allowed_use": USE[max(ranks)] if ranks else None, "score": 1 - 0.5 ** weight}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_base`` (places of base
    phrases), ``first_word, last_word`` (their first and last start, else
    null), ``base_labels, labels`` (sorted, comma-joined; empty if none),
    ``expressions`` (those that parse after identifier tags), ``allowed_use``
    (of the most restrictive of them, ``unknown`` if
    that is in no family, else null) and ``score`` (0 without any
    finding, nearer to 1 with each).

    A null text is empty: no words, no labels. Overlapping places all count.
    Repeated rows and null ids come back; an empty table gives no rows; other
    columns are not read. Whole texts are scanned, one pass, no shuffle."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fields = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
              ("base_labels", pa.string()), ("labels", pa.string()), ("expressions", pa.list_(pa.string())),
              ("allowed_use", pa.string()), ("score", pa.float64())]

    def run(batches):
        a = automaton()
        for batch in batches:
            for part in steps(batch, "text"):
                rows = [scan_text(t, a) for t in raw_texts(part.column(1))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array([r[n] for r in rows], kind) for n, kind in fields)],
                    ["doc_id", *(n for n, _ in fields)])

    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
                             "base_labels string, labels string, expressions array<string>, allowed_use string, score double")
