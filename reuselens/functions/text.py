"""Regex building blocks that give Python-``re`` (Unicode ``str``) results
on the JVM regex engine, plus their RE2 (DuckDB oracle) counterparts.

Java's ``\\w \\d \\s \\b`` are ASCII by default and ``(?U)`` over-matches
combining marks, so the patterns never use them. Instead:

* word character  ``[\\p{L}\\p{N}_]``
* word boundary   ``(?<!W)`` before and ``(?!W)`` after (RE2 has no
  lookaround; the oracle consumes one boundary character instead)
* digit           ``\\p{Nd}``
* whitespace      the explicit class ``WS`` (Python's ``str.isspace`` set)
* line anchors    ``(?md)`` so ``^``/``$``/``.`` only know ``\\n``
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

W = r"[\p{L}\p{N}_]"
NOT_W = r"[^\p{L}\p{N}_]"
WS = r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\p{Z}]"
B_START = rf"(?<!{W})"
B_END = rf"(?!{W})"
# RE2 forms: the boundary character is consumed.
RE2_B_START = rf"(?:^|{NOT_W})"
RE2_B_END = rf"(?:{NOT_W}|$)"


@lru_cache(maxsize=1)
def _digit_blocks() -> tuple[str, str]:
    """Every Unicode decimal digit and its ASCII value, from the rule that
    Nd digits come in runs of ten starting at a zero."""
    src, dst = [], []
    for cp in range(0x110000):
        ch = chr(cp)
        if cp > 0x7F and unicodedata.category(ch) == "Nd":
            src.append(ch)
            dst.append(str(unicodedata.digit(ch)))
    return "".join(src), "".join(dst)


def ascii_digits(c: Column) -> Column:
    """Map every decimal digit to ASCII so ``try_cast`` sees a number."""
    src, dst = _digit_blocks()
    return F.translate(c, src, dst)


def collapse_ws(c: Column) -> Column:
    """Python ``re.sub(r"\\s+", " ", s).strip()``."""
    return F.trim(F.regexp_replace(c, WS + "+", " "))


def nullif_empty(c: Column) -> Column:
    return F.when(c == F.lit(""), F.lit(None)).otherwise(c)
