"""Predicates on one key column each. They are two-valued: never null, so negation and OR are plain."""

from __future__ import annotations

import datetime
import decimal
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMBERS = (*WHOLE, T.FloatType, T.DoubleType, T.DecimalType)
TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)
#: The column types that a value of a Python type may be compared with; others take any.
KINDS = {bool: (T.BooleanType,), int: NUMBERS, float: NUMBERS, decimal.Decimal: NUMBERS, str: (T.StringType,), bytes: (T.BinaryType,), datetime.datetime: TIMES, datetime.date: TIMES}


@dataclass(frozen=True)
class Constraint:
    """test: the column's predicate. first: keep only one row for each combination of the key columns before this one.
    kinds: the column types that it is for (none: any)."""

    test: Callable[[Column], Column]
    is_any: bool = False
    first: bool = False
    kinds: tuple[type, ...] = ()

    def check(self, name: str, kind: T.DataType) -> None:
        if self.kinds and not isinstance(kind, self.kinds):
            raise TypeError(f"the constraint on {name} is not for {kind.simpleString()}")

    def on(self, column: Column) -> Column:
        return F.coalesce(self.test(column), F.lit(False))


def anything() -> Constraint:
    return Constraint(lambda c: F.lit(True), is_any=True)


def exact(value) -> Constraint:
    """Equality in which null equals null; NaN equals nothing."""
    if isinstance(value, float):
        return Constraint(lambda c: c.eqNullSafe(F.lit(value)) & ~F.isnan(c.cast("double")), kinds=NUMBERS)
    return Constraint(lambda c: c.eqNullSafe(F.lit(value)), kinds=KINDS.get(type(value), ()))


def up_to(value, including: bool = True) -> Constraint:
    """At most (or below) a value; nulls never match."""
    return Constraint(lambda c: (c <= F.lit(value)) if including else (c < F.lit(value)), kinds=() if isinstance(value, str) else KINDS.get(type(value), ()))


def between(low, high, including: bool = True) -> Constraint:
    """From low, always included, to high."""
    return Constraint(lambda c: (c >= F.lit(low)) & ((c <= F.lit(high)) if including else (c < F.lit(high))))


def predicate(test: Callable[[Column], Column]) -> Constraint:
    """Any expression on the column, which it sees as it is, nulls included."""
    return Constraint(test)


def text_predicate(test: Callable[[Column], Column]) -> Constraint:
    """Any expression on a string, for which null is the empty string."""
    return Constraint(lambda c: test(_text(c)), kinds=(T.StringType,))


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def starts_with(prefix: str) -> Constraint:
    """Strings that start so; the empty prefix matches all, null included."""
    return Constraint(lambda c: c.startswith(prefix), kinds=(T.StringType,)) if prefix else anything()


def ends_with(suffix: str) -> Constraint:
    return text_predicate(lambda c: c.endswith(suffix))


def contains(part: str) -> Constraint:
    return text_predicate(lambda c: c.contains(part))


#: Letters whose capital form has more letters (such as sharp s) stay themselves; they are kept apart by code points for private use.
LONG = "".join(chr(k) for k in range(0x10000) if not 0xD800 <= k < 0xE000 and len(chr(k).upper()) > 1)
KEPT = "".join(chr(0x10F000 + k) for k in range(len(LONG)))


def _upper(value: str) -> str:
    return value.translate(str.maketrans(LONG, KEPT)).upper()


def contains_ignoring_case(part: str) -> Constraint:
    """Case is compared letter by letter."""
    return text_predicate(lambda c: F.upper(F.translate(c, LONG, KEPT)).contains(_upper(part)))


def exact_ignoring_case(value: str) -> Constraint:
    """Case is compared letter by letter."""
    return text_predicate(lambda c: F.upper(F.translate(c, LONG, KEPT)) == _upper(value))


def list_contains(item) -> Constraint:
    return Constraint(lambda c: F.array_contains(c, item), kinds=(T.ArrayType,))


def list_starts_with(item) -> Constraint:
    """Lists whose first element is this."""
    return Constraint(lambda c: F.get(c, F.lit(0)) == F.lit(item), kinds=(T.ArrayType,))


def first(inner: Constraint) -> Constraint:
    """One row of each combination of the key columns before: that with the least value here that matches."""
    return replace(inner, first=True)
