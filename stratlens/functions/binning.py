"""Bin expressions and labels: interval lookup, value and interval labels, quantile ranks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

NA, TOTAL, OUT = "<NA>", "TOTAL", "<OUT>"


def named(name: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def clean(x: Column, is_float: bool) -> Column:
    """NaN counts as missing."""
    return F.when(F.isnan(x), None).otherwise(x) if is_float else x


def number(v: float | int | None, kind: str = "double") -> str:
    return f"cast({'null' if v is None else repr(str(v))} as {kind})"


def literals(values: list, kind: str) -> Column:
    """An array of numbers and nulls, parsed from one text: a call of the JVM for each is slow."""
    return F.expr(f"array({', '.join(number(v, kind) for v in values)})")


def interval_index(x: Column | str, edges: list[float]) -> Column:
    """1-based interval (lower, upper] of x, the lowest edge included; null outside or for null.

    A balanced tree of comparisons: its depth is the logarithm of the number of edges.  Where x is a text, an
    expression over doubles or longs, the tree is parsed from one text, which takes fewer calls of the JVM.
    """
    if isinstance(x, str):
        at = [number(e, "bigint" if isinstance(e, int) else "double") for e in edges]

        def find(lo: int, hi: int) -> str:
            mid = (lo + hi) // 2
            return str(hi) if hi - lo == 1 else f"case when {x} <= {at[mid]} then {find(lo, mid)} else {find(mid, hi)} end"

        inside = f"{x} = {at[0]}" if len(at) == 1 else f"{x} >= {at[0]} and {x} <= {at[-1]}"
        return F.expr(f"case when {inside} then {1 if len(at) == 1 else find(0, len(at) - 1)} end")
    if len(edges) == 1:
        return F.when(x == edges[0], F.lit(1))

    def search(lo: int, hi: int) -> Column:  # the edges[lo] < x <= edges[hi] case
        if hi - lo == 1:
            return F.lit(hi)
        mid = (lo + hi) // 2
        return F.when(x <= edges[mid], search(lo, mid)).otherwise(search(mid, hi))

    return F.when((x >= edges[0]) & (x <= edges[-1]), search(0, len(edges) - 1))


def quantile_ranks(n: int, bins: int) -> list[int]:
    """0-based ranks of the lower quantiles i / bins of n sorted values, in the float arithmetic users know."""
    return [math.floor(((i / bins) * 100 / 100) * (n - 1)) for i in range(bins + 1)]


def _rounded(x: float, digits: int) -> float:
    if x == 0 or math.isinf(x):
        return x
    whole = math.trunc(x)
    if whole == 0:
        places = -int(math.floor(math.log10(abs(x - whole)))) - 1 + digits
    else:
        places = digits
    return float(np.around(x, places))


def interval_labels(edges: list[float]) -> list[str]:
    """Texts such as ``(0.999, 2.0]`` with as few digits as keep the edges apart."""
    if len(edges) == 1:
        return [f"[{edges[0]}, {edges[0]}]"]
    digits = next((p for p in range(3, 20) if len({_rounded(e, p) for e in edges}) == len(edges)), 3)
    shown = [_rounded(float(e), digits) for e in edges]
    left = [shown[0] - 10**-digits, *shown[1:-1]]
    return [f"({a}, {b}]" for a, b in zip(left, shown[1:])]


def float_label(x: Column) -> Column:
    """A double or float as its shortest text with Python's rules: 1e7 is 10000000.0, 1e-5 is 1e-05."""
    s = x.cast("string")
    m, e = F.substring_index(s, "E", 1), F.substring_index(s, "E", -1).cast("int")
    sign = F.when(m.startswith("-"), "-").otherwise("")
    digits = F.regexp_replace(F.regexp_replace(m, "[-.]", ""), "(?<=.)0$", "")
    large = F.when(F.length(digits) <= e + 1, F.concat(F.rpad(digits, e + 1, "0"), F.lit(".0"))).otherwise(F.concat(F.substring(digits, F.lit(1), e + 1), F.lit("."), F.substring(digits, e + 2, F.lit(99))))
    power = F.concat(F.when(e < 0, "-").otherwise("+"), F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))), "0"))
    science = F.concat(F.regexp_replace(m, r"\.0$", ""), F.lit("e"), power)
    return (
        F.when(~s.contains("E"), s)
        .when(e.between(7, 15), F.concat(sign, large))
        .when(e == -4, F.concat(sign, F.lit("0.000"), digits))
        .otherwise(science)
    )


def value_label(x: Column, kind: str) -> Column:
    if kind in ("double", "float"):
        return float_label(x)  # a float has fewer digits than the double it becomes
    if kind == "boolean":
        return F.initcap(x.cast("string"))
    return x.cast("string")
