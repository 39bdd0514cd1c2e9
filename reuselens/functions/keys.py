"""Request keys and projections over a chat message array.

``messages`` is ``array<struct<role: string, content: string>>`` in turn
order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS

NUL = "\u0000"


def user_text(messages: Column) -> Column:
    """User contents joined by one space; other roles ignored."""
    return F.array_join(F.transform(F.filter(messages, lambda m: m["role"] == "user"),
                                    lambda m: m["content"]), " ")


def normalize_text(text: Column) -> Column:
    """P2 on a plain string: lower, collapse whitespace runs, strip."""
    return F.trim(F.regexp_replace(F.lower(text), WS + "+", " "))


def raw_hash(messages: Column) -> Column:
    """sha256 over ``role:content`` of every turn joined by NUL."""
    return F.sha2(F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), m["content"])),
                               NUL), 256)


def python_float_str(x: Column) -> Column:
    """``str(float)`` as Python prints it. The JVM prints the same digits
    but switches to exponent form below 1e-3 and from 1e7, Python below
    1e-4 and from 1e16; rewrite those ranges."""
    s = x.cast("string")
    mant = F.regexp_extract(s, r"^(-?)(\d)(?:\.(\d+))?E(-?\d+)$", 2)
    frac = F.regexp_replace(F.regexp_extract(s, r"^(-?)(\d)(?:\.(\d+))?E(-?\d+)$", 3), "0+$", "")
    sign = F.regexp_extract(s, r"^(-?)", 1)
    exp = F.regexp_extract(s, r"E(-?\d+)$", 1).try_cast("int")
    digits = F.concat(mant, frac)
    ax = F.abs(x)
    # 1e-4 <= |x| < 1e-3: JVM "d.dddE-4" -> "0.000dddd"
    small = F.concat(sign, F.lit("0.000"), digits)
    # |x| < 1e-4: Python "d.ddde-05"
    py_exp = F.concat(sign, mant, F.when(frac != "", F.concat(F.lit("."), frac)).otherwise(F.lit("")),
                      F.lit("e"), F.when(exp < 0, F.lit("-")).otherwise(F.lit("+")),
                      F.lpad(F.abs(exp).cast("string"), 2, "0"))
    # 1e7 <= |x| < 1e16: Python "dddddddd.0"-style positional
    big = F.concat(sign, F.rpad(digits, exp + 1, "0"), F.lit(".0"))
    return (F.when(x.isNull(), F.lit(None))
            .when((ax == 0) | ((ax >= 1e-3) & (ax < 1e7)) | F.isnan(x), s)
            .when((ax >= 1e-4) & (ax < 1e-3), small)
            .when(ax < 1e-4, py_exp)
            .when(ax < 1e16, F.when(F.length(digits) <= exp + 1, big).otherwise(s))
            .otherwise(py_exp))


def first_system_prompt(messages: Column) -> Column:
    return F.coalesce(F.get(F.filter(messages, lambda m: m["role"] == "system"), 0)["content"], F.lit(""))


def params_hash(messages: Column, temperature: Column, max_tokens: Column, model: Column) -> Column:
    """P5: sha256 of first system prompt (or ""), str(temperature),
    str(max_tokens), model, joined by NUL."""
    return F.sha2(F.concat_ws(NUL, first_system_prompt(messages), python_float_str(temperature),
                              max_tokens.cast("string"), model), 256)


def api_key_hash(key: Column) -> Column:
    """P6."""
    return F.sha2(key, 256)


def estimated_prompt_tokens(messages: Column) -> Column:
    """Len of all contents (every role) concatenated, integer-divided by 4."""
    return F.floor(F.length(F.array_join(F.transform(messages, lambda m: m["content"]), "")) / 4).cast("bigint")


# ---------------------------------------------------------------------
# Cents per 1000 tokens, per upstream model, with default.
# ---------------------------------------------------------------------
MODEL_RATES = [("gemini-3.5-flash-lite", 0.03, 0.25)]
DEFAULT_RATE = (0.03, 0.25)
# ---------------------------------------------------------------------


def token_cost_cents(prompt_tokens: Column, completion_tokens: Column, in_rate: Column, out_rate: Column) -> Column:
    """(p / 1000) * input + (c / 1000) * output."""
    return (prompt_tokens / F.lit(1000.0)) * in_rate + (completion_tokens / F.lit(1000.0)) * out_rate
