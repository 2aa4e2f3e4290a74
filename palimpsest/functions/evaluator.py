"""Arithmetic and settings functions, as expressions over columns. All numbers
are doubles, and results that have no value are NaN or infinite, not null."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan() -> Column:
    return F.lit(float("nan"))


def infinity(sign: int = 1) -> Column:
    return F.lit(sign * float("inf"))


def divide(x: Column, y: Column) -> Column:
    return F.when(y != 0, x / y).when((x == 0) | F.isnan(x), nan()).otherwise(F.signum(x) * infinity())


def remainder(x: Column, y: Column) -> Column:
    """Remainder with the sign of ``x``; NaN for ``y`` 0."""
    return F.when(y == 0, nan()).otherwise(x % y)


def natural_log(x: Column) -> Column:
    return F.when(x > 0, F.log(x)).when(x == 0, infinity(-1)).otherwise(nan())


def log_ten(x: Column) -> Column:
    """``log`` of the settings language: to base 10."""
    return F.when(x > 0, F.log10(x)).when(x == 0, infinity(-1)).otherwise(nan())


def whole(x: Column, rounded: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) >= 2**53), x).otherwise(rounded.cast("double"))


def floor(x: Column) -> Column:
    return whole(x, F.floor(x))


def ceil(x: Column) -> Column:
    return whole(x, F.ceil(x))


def factorial(x: Column) -> Column:
    """NaN below 0, infinite from 171 on; the fraction is dropped."""
    n = floor(x).cast("int")
    steps = F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(170)), F.lit(1)))
    product = F.aggregate(steps, F.lit(1.0), lambda acc, k: acc * k)
    return F.when((x < 0) | F.isnan(x), nan()).when(n > 170, infinity()).otherwise(product)


def combinations(n: Column, r: Column) -> Column:
    """Number of ways to choose; NaN if negative or ``n < r``."""
    small = F.least(r, n - r).cast("int")
    steps = F.sequence(F.lit(1), F.greatest(small, F.lit(1)))
    product = F.aggregate(steps, F.lit(1.0), lambda acc, k: acc * (n.cast("int") - small + k) / k)
    return F.when((n < 0) | (r < 0) | (n < r), nan()).when(small == 0, F.lit(1.0)).otherwise(F.round(product))


def permutations(n: Column, r: Column) -> Column:
    return combinations(n, r) * factorial(r)


def power(x: Column, y: Column) -> Column:
    return F.pow(x, y)


FUNCTIONS = {
    "abs": F.abs, "acos": F.acos, "asin": F.asin, "atan": F.atan, "atan2": F.atan2, "ceil": ceil, "cos": F.cos, "cosh": F.cosh,
    "e": F.e, "exp": F.exp, "fac": factorial, "floor": floor, "ln": natural_log, "log": log_ten, "log10": log_ten,
    "ncr": combinations, "npr": permutations, "pi": F.pi, "pow": power, "sin": F.sin, "sinh": F.sinh, "sqrt": F.sqrt,
    "tan": F.tan, "tanh": F.tanh,
}


def as_boolean(word: Column) -> Column:
    """A setting as a truth value; null if it is no such word."""
    low = F.lower(F.trim(word))
    return F.when(low.isin("1", "y", "yes", "t", "true", "on"), True).when(low.isin("0", "n", "no", "f", "false", "off"), False)


def is_expression(word: Column) -> Column:
    """Whether a number setting is arithmetic: it has an operator that is neither
    its sign nor part of an exponent."""
    bare = F.regexp_replace(F.trim(word), r"(?i)(?<=[0-9.])e[+-]?(?=[0-9])", "")
    return F.regexp_replace(bare, r"^[+-]", "").rlike(r"[-+*/^%(,]")


# How tightly the binary operators bind; all go from left to right,
# and signs and functions of one number bind more tightly than any of them.
BINDING = {",": 0, "+": 1, "-": 1, "*": 2, "/": 2, "%": 2, "^": 3}
_TOKEN = re.compile(r"\s*(?:([0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?)|([a-z][a-z0-9_]*)|([-+*/%^(),]))")
_CONSTANTS = {"e": np.e, "pi": np.pi}


def _factorial(x: float) -> float:
    return np.nan if not x >= 0 else np.inf if x >= 171 else float(math.factorial(int(x)))


def _combinations(n: float, r: float) -> float:
    return float(math.comb(int(n), int(r))) if 0 <= r <= n < 2**31 else np.nan


_ONE = {f: getattr(np, name) for f, name in {
    "abs": "abs", "acos": "arccos", "asin": "arcsin", "atan": "arctan", "ceil": "ceil", "cos": "cos", "cosh": "cosh", "exp": "exp", "floor": "floor",
    "ln": "log", "log": "log10", "log10": "log10", "sin": "sin", "sinh": "sinh", "sqrt": "sqrt", "tan": "tan", "tanh": "tanh",
}.items()} | {"fac": _factorial}
_TWO = {"atan2": np.arctan2, "pow": np.power, "ncr": _combinations, "npr": lambda n, r: _combinations(n, r) * _factorial(r)}
_BINARY = {"+": np.add, "-": np.subtract, "*": np.multiply, "/": np.divide, "%": np.fmod, "^": np.power}


def arithmetic(text: str) -> float | None:
    """Value of one expression, None if it is none. Two stacks, of values and of
    what waits for them; a comma makes a list, of which only functions of two
    numbers take more than the last."""
    values: list[list[float]] = []
    waiting: list[str] = []

    def settle(least: int) -> None:
        while waiting and BINDING.get(waiting[-1], -1) >= least:
            y, x = values.pop(), values.pop()
            op = waiting.pop()
            values.append(x + y if op == "," else [float(_BINARY[op](x[-1], y[-1]))])

    def signs() -> None:
        while waiting and (waiting[-1] in _ONE or waiting[-1] in ("neg", "pos")):
            f, x = waiting.pop(), values.pop()[-1]
            values.append([float(_ONE[f](x)) if f in _ONE else -x if f == "neg" else x])

    at, operand, text = 0, True, text.rstrip()
    with np.errstate(all="ignore"):
        while at < len(text):
            m = _TOKEN.match(text, at)
            if m is None:
                return None
            at = m.end()
            number, name, sign = m.groups()
            if operand and (number or name in _CONSTANTS):
                values.append([float(number) if number else _CONSTANTS[name]])
                empty = re.compile(r"\s*\(\s*\)").match(text, at) if name else None
                at = empty.end() if empty else at
                signs()
                operand = False
            elif operand and (name in _ONE or sign in ("+", "-")):
                waiting.append(name or {"+": "pos", "-": "neg"}[sign])
            elif operand and (name in _TWO or sign == "("):
                waiting.append(name or "(")
                if name:
                    opening = _TOKEN.match(text, at)
                    if opening is None or opening.group(3) != "(":
                        return None
                    at = opening.end()
            elif not operand and sign == ")":
                settle(0)
                if not waiting:
                    return None
                inner, f = values.pop(), waiting.pop()
                if f in _TWO and len(inner) != 2:
                    return None
                values.append([float(_TWO[f](*inner))] if f in _TWO else inner[-1:])
                signs()
            elif not operand and sign in BINDING:
                settle(BINDING[sign])
                waiting.append(sign)
                operand = True
            else:
                return None
        if operand:
            return None
        settle(0)
    return values[0][-1] if not waiting and len(values) == 1 else None


@F.pandas_udf(T.DoubleType())
def expression(words: pd.Series) -> pd.Series:
    """Values of arithmetic in settings, each different text worked out once; null
    for what is none."""
    known = {w: arithmetic(w) for w in words.dropna().unique()}
    return words.map(known).astype("float64")


def plain_number(word: Column) -> Column:
    """A decimal number, with or without an exponent, as a double; else null."""
    return F.when(word.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), word.try_cast("double"))


def as_float(word: Column) -> Column:
    """A setting as a double: arithmetic, or a number with an ``f`` or ``l`` behind."""
    bare = F.regexp_replace(F.trim(word), r"(?<=[0-9.])[fFlL]$", "")
    return F.when(is_expression(word), expression(F.trim(word))).otherwise(plain_number(bare))


def as_integer(word: Column) -> Column:
    """A setting as a long: arithmetic without its fraction, or a whole number, also
    in base 16 or 8, with ``u`` and ``l`` behind; null for anything else."""
    bare = F.regexp_replace(F.trim(word), r"(?i)(?<=[0-9a-f])[ul]{1,3}$", "")
    sign = F.when(bare.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(bare, r"^[+-]", "")
    base = lambda pattern, radix: F.when(digits.rlike(rf"^{pattern}$"), sign * F.conv(F.regexp_extract(digits, pattern, 1), radix, 10).cast("long"))
    plain = F.coalesce(base(r"0[xX]([0-9a-fA-F]+)", 16), base(r"0([0-7]+)", 8), plain_number(bare).cast("long"))
    return F.when(is_expression(word), truncated(expression(F.trim(word)))).otherwise(plain)


def truncated(x: Column) -> Column:
    return F.when(F.abs(x) < float(2**63), x).cast("long")


def resolve(flag: Column, environment: Column, file: Column, default: Column) -> Column:
    """A setting's value: the command line goes before the environment, that
    before the file, and the default comes last."""
    return F.coalesce(flag, environment, file, default)


def source_of(flag: Column, environment: Column, file: Column) -> Column:
    return F.when(flag.isNotNull(), "cli").when(environment.isNotNull(), "env").when(file.isNotNull(), "file").otherwise("default")
