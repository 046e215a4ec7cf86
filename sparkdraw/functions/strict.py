"""Strict readings of positional fields, as Column builders.

Fields are strings in which a character stands for a byte. Spark's casts accept more than the format
does (type suffixes, hexadecimal, control characters), so a pattern guards each cast.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that the format trims. Vertical tab is not part of it.
BLANK = " \t\n\f\r"

_UNSIGNED = r"^\+?[0-9]+$"
_SIGNED = r"^[+-]?[0-9]+$"
_FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: Numbers of _FLOAT that cannot be too large for a double.
_SMALL = r"^[+-]?([0-9]{1,300}(\.[0-9]*)?|\.[0-9]+)$"


def trimmed(x: Column) -> Column:
    return F.btrim(x, F.lit(BLANK))


def unsigned(x: Column) -> Column:
    """Digits with an optional plus, up to 2**63 - 1; else null."""
    t = trimmed(x)
    return F.when(t.rlike(_UNSIGNED), t.try_cast("bigint"))


def signed(x: Column) -> Column:
    t = trimmed(x)
    return F.when(t.rlike(_SIGNED), t.try_cast("bigint"))


def finite(x: Column) -> Column:
    """A finite decimal number; else null."""
    t = trimmed(x)
    value = t.try_cast("double")
    return F.when(t.rlike(_SMALL), value).when(t.rlike(_FLOAT), F.when(F.abs(value) < float("inf"), value))


def flag(x: Column) -> Column:
    """Exactly 0 or 1; else null."""
    n = signed(x)
    return F.when(n.isin(0, 1), n == 1)


def number(x: str) -> int | None:
    """``unsigned`` for a string at hand."""
    x = x.strip(BLANK)
    return value if re.fullmatch(_UNSIGNED, x, re.ASCII) and (value := int(x)) < 1 << 63 else None


def real(x: str) -> float | None:
    """``finite`` for a string at hand."""
    x = x.strip(BLANK)
    return value if re.fullmatch(_FLOAT, x, re.ASCII) and abs(value := float(x)) < math.inf else None


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def whole(values: Column) -> Column:
    """Whether an array has no null."""
    return F.forall(values, lambda x: x.isNotNull())


class Fields:
    """Typed access to a column that is an array of fields."""

    def __init__(self, name: str):
        self.name = name

    @property
    def array(self) -> Column:
        return F.col(self.name)

    @property
    def size(self) -> Column:
        return F.size(self.name)

    def raw(self, i) -> Column:
        return F.get(self.array, i if isinstance(i, Column) else F.lit(i))

    def u(self, i) -> Column:
        return unsigned(self.raw(i))

    def i(self, i) -> Column:
        return signed(self.raw(i))

    def f(self, i) -> Column:
        return finite(self.raw(i))

    def b(self, i) -> Column:
        return flag(self.raw(i))

    def count(self, i) -> Column:
        """A count that the record could hold; a larger one is null, so arithmetic on it is safe."""
        n = self.u(i)
        return F.when(n <= self.size, n.cast("int"))

    def slice(self, start, n) -> Column:
        start = start if isinstance(start, Column) else F.lit(start)
        n = n if isinstance(n, Column) else F.lit(n)
        return F.slice(self.array, F.greatest(start + 1, F.lit(1)), F.greatest(n, F.lit(0)))

    def us(self, start, n) -> Column:
        return F.transform(self.slice(start, n), unsigned)

    def is_(self, start, n) -> Column:
        return F.transform(self.slice(start, n), signed)

    def fs(self, start, n) -> Column:
        return F.transform(self.slice(start, n), finite)
