"""Scalar column functions.

A missing number is NULL everywhere; NaN and infinities are turned into NULL on the way in because
Spark orders NaN above every number and lets it poison averages.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6
LOGIT_BOUND = 30.0

# Upper bounds (days or counts) and the bin names they close.
DURATION_BINS = [(0, "0"), (30, "1_30"), (90, "31_90"), (180, "91_180"), (365, "181_365"), (730, "366_730")]
DURATION_REST = "gt730"
COUNT_BINS = [(1, "1"), (2, "2"), (5, "3_5"), (10, "6_10")]
COUNT_REST = "gt10"
RECENCY_BINS = [(7, "0_7"), (30, "8_30"), (90, "31_90"), (180, "91_180"), (365, "181_365")]
RECENCY_REST = "gt365"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_float(c: Column | str) -> Column:
    """Number or NULL: text that does not parse, NaN and infinities become NULL."""
    v = _col(c).try_cast("double")
    finite = ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    return F.when(finite, v)


def nonnegative_day(c: Column | str) -> Column:
    return F.greatest(F.coalesce(safe_float(c), F.lit(0.0)), F.lit(0.0))


#: One element of a list literal: a quoted string with escapes, a number, or a named constant.
_ELEMENT = (
    r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\""
    r"|[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|None|True|False"
)


def parse_list_cell(c: Column | str) -> Column:
    """Text cell to array<string>.

    ``[…]`` and ``(…)`` literals of strings, numbers and constants are split into their elements, ``None``
    is a NULL element; quotes are read before anything else, so their contents stay as they are. A
    literal that does not parse (as with a bare ``nan``) and any other text become a one-element array, NULL
    and blank text an empty array.
    """
    raw = _col(c)
    text = F.trim(raw)
    literal = text.rlike(rf"^(?:\[\s*\]|\(\s*\)|\[\s*(?:{_ELEMENT})(?:\s*,\s*(?:{_ELEMENT}))*\s*,?\s*\]|\(\s*(?:{_ELEMENT})(?:\s*,\s*(?:{_ELEMENT}))*\s*,?\s*\))$")
    found = F.regexp_extract_all(text, F.lit(f"({_ELEMENT})"), F.lit(1))

    def value(e: Column) -> Column:
        quoted = F.substring(e, 1, 1).isin("'", '"')
        inner = F.regexp_replace(e.substr(F.lit(2), F.length(e) - 2), r"\\(.)", "$1")
        return F.when(quoted, inner).when(e != "None", e)

    return (
        F.when(raw.isNull() | (text == ""), F.array().cast("array<string>"))
        .when(literal, F.transform(found, value))
        .otherwise(F.array(raw))
    )


def _bins(value: Column, bins: list[tuple[int, str]], rest: str) -> Column:
    chain = None
    for upper, name in bins:
        test = value <= F.lit(upper)
        chain = F.when(test, name) if chain is None else chain.when(test, name)
    return chain.otherwise(rest)


def duration_bin(days: Column | str) -> Column:
    return _bins(_col(days), DURATION_BINS, DURATION_REST)


def count_bin(n: Column | str) -> Column:
    return _bins(_col(n), COUNT_BINS, COUNT_REST)


def recency_bin(days: Column | str) -> Column:
    return _bins(_col(days), RECENCY_BINS, RECENCY_REST)


def clip_prob(p: Column | str, eps: float = EPS) -> Column:
    """Probability away from 0 and 1; NULL stays NULL (``greatest`` alone would make it the lowest)."""
    v = _col(p)
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(eps)), F.lit(1.0 - eps)))


def logit(p: Column | str, eps: float = EPS) -> Column:
    q = clip_prob(p, eps)
    return F.ln(q / (F.lit(1.0) - q))


def sigmoid(x: Column | str, bound: float | None = LOGIT_BOUND) -> Column:
    """Logistic function; ``bound`` limits the argument, ``None`` leaves it as it is. NULL stays NULL."""
    v = _col(x)
    if bound is not None:
        v = F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(-bound)), F.lit(bound)))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-v))


def known_score(p: Column | str) -> Column:
    """The score; a NULL is an error, as a missing risk is no evidence for either outcome."""
    v = _col(p).cast("double")
    return F.coalesce(v, F.raise_error(F.lit("a risk is NULL")).cast("double"))


def score_transform(p: Column | str, mode: str) -> Column:
    if mode == "prob":
        return clip_prob(p)
    if mode == "logit":
        return logit(p)
    raise ValueError(f"Unknown score transform: {mode}")


def subgroup_label(flag: Column | str) -> Column:
    f = _col(flag)
    return F.when(f.isNull(), "all").when(f, "high_repeat_top10").otherwise("other_90")


def split_model_name(name: Column | str) -> tuple[Column, Column]:
    """Base model name and whether the numeric variant was meant."""
    n = _col(name)
    return F.regexp_replace(n, "_numeric$", ""), n.endswith("_numeric")


def format_delta_ci(point: Column | str, low: Column | str, high: Column | str) -> Column:
    return F.format_string("%+.3f [%+.3f, %+.3f]", _col(point), _col(low), _col(high))
