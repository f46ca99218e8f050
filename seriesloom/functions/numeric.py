"""Arithmetic and comparison on typed columns with IEEE results, safe with ANSI mode on."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .types import ValueType, convert, promote

ARITHMETIC = ("+", "-", "*", "/", "%")
COMPARISON = ("==", "!=", ">", "<", ">=", "<=")
MIRRORED = {"==": "==", "!=": "!=", ">": "<", "<": ">", ">=": "<=", "<=": ">="}


def result_type(op: str, left: ValueType, right: ValueType) -> ValueType:
    """Division and remainder are always Float64; the others promote."""
    return ValueType.FLOAT64 if op in "/%" else promote(left, right)


def ieee_div(n: Column, d: Column) -> Column:
    """n / d on doubles; by zero it gives infinities and NaN instead of an error."""
    return F.when(d != 0, n / d).otherwise(n * F.pow(d, F.lit(-1.0)))


def ieee_mod(n: Column, d: Column) -> Column:
    """Truncated remainder on doubles, with the dividend's sign; by zero NaN."""
    return F.when(d != 0, n % d).otherwise(F.when(n.isNotNull() & d.isNotNull(), F.lit(float("nan"))))


def arithmetic(op: str, left: Column, lt: ValueType, right: Column, rt: ValueType) -> tuple[Column, ValueType]:
    kind = result_type(op, lt, rt)
    a, b = convert(left, lt, kind), convert(right, rt, kind)
    if op == "/":
        return ieee_div(a, b), kind
    if op == "%":
        return ieee_mod(a, b), kind
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b}[op](), kind


def compare(op: str, left: Column, lt: ValueType, right: Column, rt: ValueType) -> Column:
    """With a NaN on either side only != holds (Spark by itself takes NaN as equal to NaN and above all else)."""
    kind = promote(lt, rt)
    a, b = convert(left, lt, kind), convert(right, rt, kind)
    plain = {"==": lambda: a == b, "!=": lambda: a != b, ">": lambda: a > b, "<": lambda: a < b, ">=": lambda: a >= b, "<=": lambda: a <= b}[op]()
    if kind is not ValueType.FLOAT64:
        return plain
    nan = F.isnan(a) | F.isnan(b)
    return (plain | nan) if op == "!=" else (plain & ~nan)


def fold(op: str, a: float, b: float) -> float:
    """The same arithmetic on two literals."""
    if op == "/":
        if b != 0:
            return a / b
        return math.nan if a == 0 or math.isnan(a) else math.copysign(math.inf, a) * math.copysign(1.0, b)
    if op == "%":
        return math.nan if b == 0 or math.isinf(a) else math.fmod(a, b)
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b}[op]()


def nan_last_max(c: Column) -> Column:
    """max that gives NaN only if there is nothing else."""
    return F.coalesce(F.max(F.when(~F.isnan(c), c)), F.max(c))
