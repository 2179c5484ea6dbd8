"""Numeric expressions: exact sums, tolerant parsing, bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Amounts are added as decimals, so a total does not depend on the order in which
# partitions are merged or on re-executed tasks.
EXACT = "decimal(38,12)"

# Every character Python's str.strip() takes for a blank.
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Java also reads '1.0D', '1f' or 'NaN' as numbers; only these characters may occur.
NUMBER_CHARACTERS = "0123456789+-.eE"


def exact(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(EXACT)


def exact_and_rest(c: str | Column) -> tuple[Column, Column]:
    """An amount as a decimal, null from 1e18 on, and as a double what the decimal does not hold."""
    value = (F.col(c) if isinstance(c, str) else c).cast("double")
    decimal = exact(F.when(F.abs(value) < 1e18, value))
    return decimal, value - F.coalesce(decimal.cast("double"), F.lit(0.0))


def total(c: str | Column) -> Column:
    """Sum of an amount, as double: exact for what fits the decimal, nothing is lost otherwise.

    What a decimal cannot hold (very large or very small parts) is added as double.
    """
    decimal, rest = exact_and_rest(c)
    return F.coalesce(F.sum(decimal).cast("double"), F.lit(0.0)) + F.sum(rest)


def mean(c: str | Column) -> Column:
    """Exact mean over non-null amounts (null for an empty group)."""
    value = F.col(c) if isinstance(c, str) else c
    return F.try_divide(total(value), F.count(value))


def ratio(a: str | Column, b: str | Column) -> Column:
    """``a / b`` as double; null where ``b`` is zero or null."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.try_divide(a.cast("double"), b.cast("double"))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def parse_number(c: Column) -> Column:
    """Text to double: all blanks out, comma as decimal point, anything else null."""
    text = F.translate(c.cast("string"), "," + BLANKS, ".")
    plain = F.translate(text, NUMBER_CHARACTERS, "") == ""
    return F.when(plain, text.try_cast("double"))


def band(c: Column, upper_edges: list[float], labels: list[str]) -> Column:
    """Label of the right-closed interval ``(edge[i-1], edge[i]]``; the last one is open above.

    Values at or below ``upper_edges[0]`` get null, like a cut with that lowest edge.
    """
    low, *rest = upper_edges
    out = F.when(c <= low, F.lit(None).cast("string"))
    for edge, label in zip(rest, labels):
        out = out.when(c <= edge, label)
    return out.when(c > upper_edges[-1], labels[-1])
