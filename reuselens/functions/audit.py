"""Response audit (U1-U9): observable properties of a served response and
their comparison with what the request asked for. Native expressions
except JSON validity, which no engine's parser matches Python's on
(trailing text, NaN, duplicate keys): that one is an Arrow-batched UDF
applied only to rows whose stripped text starts with '{' or '[' (or is
empty)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .constraints import COUNT_NOUN_RE
from .text import WS

# ---------------------------------------------------------------------
# Script ranges checked in this order, then Latin marker
# characters in this order; list-type count nouns; length band limits.
# ---------------------------------------------------------------------
SCRIPT_RANGES = [
    ("russian", 0x0400, 0x04FF),
    ("japanese", 0x3040, 0x30FF),
    ("chinese", 0x4E00, 0x9FFF),
    ("arabic", 0x0600, 0x06FF),
    ("korean", 0xAC00, 0xD7A3),
    ("hindi", 0x0900, 0x097F),
]
LATIN_MARKERS = [
    ("german", "äöüß"),
    ("french", "éèêëàâùûçœ"),
    ("spanish", "ñ¿¡"),
    ("portuguese", "ãõ"),
    ("italian", "ìò"),
]
LIST_TYPE_NOUNS = ["bullet", "bullets", "point", "points", "item", "items", "step", "steps"]
SHORT_BELOW, MEDIUM_BELOW = 200, 800
# ---------------------------------------------------------------------

BULLET_LINE_RE = rf"(?md)^{WS}*(?:[-*•]|\p{{Nd}}+[.)]){WS}+"
TABLE_ROW_RE = rf"(?md)^{WS}*\|.+\|{WS}*$"


def bullet_count(text: Column) -> Column:
    """Lines starting with - * • or N. / N); NULL when none."""
    n = F.regexp_count(text, F.lit(BULLET_LINE_RE))
    return F.when(n > 0, n.cast("int"))


def table_present(text: Column) -> Column:
    """U2."""
    return text.rlike(TABLE_ROW_RE)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{WS}+|{WS}+\z", "")


def _json_ok(s: pd.Series) -> pd.Series:
    def ok(t):
        if t is None:
            return None
        try:
            json.loads(t)
            return True
        except ValueError:
            return False
    return s.map(ok)


_JSON_UDF = None


def json_valid(text: Column) -> Column:
    """None unless the stripped text is empty or starts with { or [;
    then whether it parses as JSON (empty never does)."""
    global _JSON_UDF
    if _JSON_UDF is None:
        _JSON_UDF = F.pandas_udf(_json_ok, "boolean")
    s = stripped(text)
    cand = (s == "") | F.substring(s, 1, 1).isin("{", "[")
    # non-candidates reach the UDF as NULL and are skipped there
    return F.when(s == "", F.lit(False)).when(cand, _JSON_UDF(F.when(cand & (s != ""), s)))


def response_language(text: Column) -> Column:
    """First script present (in list order), else first Latin marker
    present in the lower-cased text, else english."""
    e = None
    for lang, lo, hi in SCRIPT_RANGES:
        cond = text.rlike(f"[\\x{{{lo:X}}}-\\x{{{hi:X}}}]")
        e = F.when(cond, F.lit(lang)) if e is None else e.when(cond, F.lit(lang))
    low = F.lower(text)
    for lang, chars in LATIN_MARKERS:
        e = e.when(low.rlike(f"[{chars}]"), F.lit(lang))
    return e.otherwise(F.lit("english"))


def length_band(text: Column) -> Column:
    """U6 (computed, never compared)."""
    n = F.length(text)
    return F.when(n < SHORT_BELOW, "short").when(n < MEDIUM_BELOW, "medium").otherwise("long")


def response_properties(text: Column) -> Column:
    """Struct of U1-U6 and the response format (U4: json > table >
    bullets > prose; never code)."""
    b, t, j = bullet_count(text), table_present(text), json_valid(text)
    fmt = (F.when(F.coalesce(j, F.lit(False)), "json").when(t, "table").when(F.coalesce(b, F.lit(0)) > 0, "bullets")
           .otherwise("prose"))
    return F.struct(b.alias("bullet_count"), t.alias("table_present"), j.alias("json_valid"),
                    response_language(text).alias("language"), length_band(text).alias("length_band"),
                    fmt.alias("format"))


def count_is_list_type(request_text: Column) -> Column:
    """U8: the noun of the request's first count phrase is a list noun."""
    noun = F.lower(F.regexp_extract(request_text, COUNT_NOUN_RE, 1))
    return noun.isin(*LIST_TYPE_NOUNS)


def audit_output(constraints: Column, list_type: Column, props: Column) -> Column:
    """struct(ok, diff_dims, count/format/language diffs); only the
    dimensions the request set are checked; count only when the request's
    count noun is a list noun (``list_type``, see ``count_is_list_type``)."""
    c_cnt = constraints["count"].isNotNull() & list_type & \
        ~constraints["count"].eqNullSafe(props["bullet_count"].cast("string"))
    c_fmt = constraints["format"].isNotNull() & (props["format"] != constraints["format"])
    c_lang = constraints["language"].isNotNull() & (props["language"] != constraints["language"])
    dims = F.array_compact(F.array(F.when(c_cnt, F.lit("count")), F.when(c_fmt, F.lit("format")),
                                   F.when(c_lang, F.lit("language"))))
    return F.struct(
        (F.size(dims) == 0).alias("ok"),
        F.when(F.size(dims) > 0, F.array_join(dims, "|")).alias("diff_dims"),
        F.when(c_cnt, F.concat_ws("->", constraints["count"],
                                  F.coalesce(props["bullet_count"].cast("string"), F.lit("null")))).alias("count_diff"),
        F.when(c_fmt, F.concat_ws("->", constraints["format"], props["format"])).alias("format_diff"),
        F.when(c_lang, F.concat_ws("->", constraints["language"], props["language"])).alias("language_diff"))
