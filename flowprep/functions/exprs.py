"""Column-level functions (FN-1..14).  All built-in expressions: they stay in codegen."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text a Python float() accepts: optional blanks, sign, digits with single
# underscores between them, fraction, exponent, or inf / infinity / nan.
_DIGITS = r"[0-9](?:_?[0-9])*"
NUMBER_TEXT = (r"^\s*[+-]?(?:(?:" + _DIGITS + r"(?:\." + f"(?:{_DIGITS})?" + r")?|\." + _DIGITS + r")"
               r"(?:[eE][+-]?" + _DIGITS + r")?|(?i:inf|infinity|nan))\s*$")

INF = float("inf")


def col_(c: Column | str) -> Column:
    """A top-level column by name; names holding dots (e.g. dummy columns of a value
    like ``1.5``) are quoted so they are not read as struct paths."""
    if isinstance(c, str):
        return F.col(f"`{c}`") if "." in c and not c.startswith("`") else F.col(c)
    return c


def is_number_text(c: Column | str) -> Column:
    """FN-4 guard: true when the text parses as a Python float."""
    return col_(c).rlike(NUMBER_TEXT)


def parse_number(c: Column | str) -> Column:
    """FN-4: number text to double, NULL when it does not parse."""
    x = col_(c)
    clean = F.replace(F.trim(x), F.lit("_"), F.lit(""))
    return F.when(is_number_text(x), clean.try_cast("double"))


def strict_number(c: Column | str, name: str = "value") -> Column:
    """FN-5: number text to double; the job fails on the first bad text."""
    x = col_(c)
    return F.when(x.isNull() | is_number_text(x), F.replace(F.trim(x), F.lit("_"), F.lit("")).try_cast("double")) \
        .otherwise(F.raise_error(F.concat(F.lit(f"not a number in {name}: "), x)))


def non_finite_to_null(c: Column | str) -> Column:
    """FN-6: NaN, +Infinity and -Infinity become NULL (one missing-value model)."""
    x = col_(c)
    return F.when(F.isnan(x) | x.isin(F.lit(INF), F.lit(-INF)), F.lit(None).cast("double")).otherwise(x)


def ascii_only(c: Column | str) -> Column:
    """FN-2: drop every non-ASCII character."""
    return F.regexp_replace(col_(c), r"[^\x00-\x7F]", "")


def squeeze_blanks(c: Column | str) -> Column:
    """FN-3: collapse runs of blanks to one."""
    return F.regexp_replace(col_(c), " +", " ")


def contains_ignore_case(c: Column | str, needle: str) -> Column:
    """FN-7 (fixed): case-insensitive substring test, the needle taken literally."""
    return col_(c).rlike("(?i)" + re.escape(needle).replace("\\ ", " "))


def split_list(c: Column | str, sep: str = ",") -> Column:
    """FN-8: split on ``sep``; one trailing empty item is dropped."""
    parts = F.split(col_(c), re.escape(sep), -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def argmax(scores: Column | str) -> Column:
    """FN-10: 0-based index of the largest score, first on ties."""
    s = col_(scores)
    return (F.array_position(s, F.array_max(s)) - 1).cast("int")


def threshold(scores: Column | str, at: float = 0.5) -> Column:
    """FN-11: scores rounded to 0/1 (``p > 0.5``; 0.5 rounds to even, i.e. 0)."""
    return F.transform(col_(scores), lambda p: (p > F.lit(at)).cast("int"))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    """FN-12: sum of squared differences of two equal-length arrays."""
    diffs = F.zip_with(col_(a), col_(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(diffs, F.lit(0.0), lambda acc, d: acc + d)


def one_hot(code: Column | str, k: int | Column) -> Column:
    """FN-14: one-hot int array of length ``k`` for a 0-based code."""
    kk = F.lit(k) if isinstance(k, int) else k
    c = col_(code)
    return F.transform(F.sequence(F.lit(0), kk - 1), lambda i: (i == c).cast("int"))


def student_t_two_sided_p(t: Column | str, df_even: Column | str) -> Column:
    """FN-13: two-sided p-value of Student's t for an even number of degrees of freedom.

    For even ``v``: ``P(|T| < t) = sin(a) * sum_{j=0}^{v/2-1} c_j cos(a)^(2j)`` with
    ``a = atan(|t| / sqrt(v))``, ``c_0 = 1``, ``c_j = c_{j-1} (2j-1) / (2j)``
    (Abramowitz & Stegun 26.7.3); the p-value is one minus that.
    """
    tt = F.abs(col_(t))
    v = col_(df_even)
    theta = F.atan(tt / F.sqrt(v.cast("double")))
    cos2 = F.pow(F.cos(theta), 2)
    init = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc, j):
        term = acc["term"] * (2 * j - 1) / (2 * j) * cos2
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    half = (v / 2).cast("int")
    series = F.when(half > 1, F.aggregate(F.sequence(F.lit(1), half - 1), init, step)["total"]) \
        .otherwise(F.lit(1.0))
    return F.lit(1.0) - F.sin(theta) * series
