"""Column expressions shared by the operators (all JVM-side, codegen friendly)."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..roles import TIER_LABELS, UNKNOWN_TIER

def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: Decimals to which amounts given as doubles are summed exactly.
AMOUNT_DECIMALS = 6
_UNIT = 10**AMOUNT_DECIMALS


def money_parts(c: str | Column, prefix: str) -> list[Column]:
    """Aggregates of an amount that can be summed again: whole units and the
    fraction as longs, whether any value is NaN or infinite, and the plain sum."""
    x = col(c).cast("double")
    unit = F.floor(x)
    rest = F.floor((x - unit) * F.lit(float(_UNIT)) + F.lit(0.5)).cast("long")
    odd = F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return [
        F.sum(F.when(~odd, unit)).alias(f"{prefix}_unit"),
        F.sum(F.when(~odd, rest)).alias(f"{prefix}_rest"),
        F.bool_or(F.coalesce(odd, F.lit(False))).alias(f"{prefix}_odd"),
        F.sum(x).alias(f"{prefix}_plain"),
    ]


def money_again(prefix: str) -> list[Column]:
    """The parts of many groups as the parts of their union."""
    return [
        *(F.sum(f"{prefix}_{p}").alias(f"{prefix}_{p}") for p in ("unit", "rest")),
        F.bool_or(f"{prefix}_odd").alias(f"{prefix}_odd"),
        F.sum(f"{prefix}_plain").alias(f"{prefix}_plain"),
    ]


def _total(unit: Column, rest: Column, odd: Column, plain: Column) -> Column:
    exact = unit.cast("decimal(20,0)") + rest.cast("decimal(20,0)") * F.lit(Decimal(1) / _UNIT)
    return F.when(odd, plain).otherwise(exact.cast("double"))


def money_total(prefix: str) -> Column:
    """The sum that ``money_parts`` columns stand for."""
    return _total(*(F.col(f"{prefix}_{p}") for p in ("unit", "rest", "odd", "plain")))


def money_less(prefix: str, c: str | Column) -> Column:
    """The sum that ``money_parts`` columns stand for, less one of its amounts (NULL
    takes nothing off).  NaN if the group holds a NaN or infinite amount."""
    x = col(c).cast("double")
    unit = F.floor(x)
    rest = F.floor((x - unit) * F.lit(float(_UNIT)) + F.lit(0.5)).cast("long")
    odd = F.col(f"{prefix}_odd")
    less = [F.col(f"{prefix}_{p}") - F.coalesce(v, F.lit(0)) for p, v in (("unit", unit), ("rest", rest))]
    return _total(less[0], less[1], odd, F.when(odd, F.lit(float("nan"))))


def money_sum(c: str | Column) -> Column:
    """Order-independent sum of an amount, returned as double.

    Double sums depend on the order rows arrive in.  Whole units and fractions
    (at AMOUNT_DECIMALS decimals, lossless for amounts with no more of them) are
    summed as longs: exact on every run and partitioning; the result is the
    double nearest the exact total.  A NaN or infinite amount makes the sum
    what adding doubles makes it.
    """
    return _total(*money_parts(c, "m"))


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den as double, NULL when den is 0 or NULL (no ANSI error)."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def label_double(label: str) -> Column:
    return F.col(label).cast("double")


def amount_bucket(amount: str | Column, thresholds: Sequence[float]) -> Column:
    """0 for amount <= t0, i for t[i-1] < amount <= t[i], len(t) above the last.

    NULL amount gives NULL.
    """
    a = col(amount)
    expr = F.when(a <= F.lit(float(thresholds[0])), F.lit(0))
    for i in range(1, len(thresholds)):
        expr = expr.when(a <= F.lit(float(thresholds[i])), F.lit(i))
    return expr.when(a > F.lit(float(thresholds[-1])), F.lit(len(thresholds)))


def tier_expr(rate: str | Column, bins: str | Column) -> Column:
    """Risk tier of a rate against sorted distinct edges ``bins``.

    Smallest i >= 1 with rate <= bins[i] names the tier (1 low, 2 medium,
    3 high, 4 and above very_high).  NULL rate, fewer than two edges or a
    rate above the last edge give 'unknown'.  ``size(filter(bins, x < rate))``
    is the number of edges strictly below the rate, so i = max(1, that).
    """
    r = col(rate)
    b = col(bins)
    below = F.size(F.filter(b, lambda x: x < r))
    labels = F.array(*[F.lit(t) for t in TIER_LABELS])
    pos = F.least(F.greatest(below, F.lit(1)), F.lit(len(TIER_LABELS)))
    return (
        F.when(r.isNull() | b.isNull() | (F.size(b) < 2), F.lit(UNKNOWN_TIER))
        .when(below >= F.size(b), F.lit(UNKNOWN_TIER))
        .otherwise(F.element_at(labels, pos))
    )


def category_text(c: str | Column) -> Column:
    """Category value as text; the empty string gets a token (one-hot refuses it)."""
    s = col(c).cast("string")
    return F.when(s == F.lit(""), F.lit("__empty__")).otherwise(s)


def quote_literal(c: Column) -> Column:
    """Render a string value as a quoted literal with backslash escapes."""
    esc = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    return F.concat(F.lit("'"), esc, F.lit("'"))


def fmt3(c: Column) -> Column:
    return F.format_string("%.3f", c)
