"""Row-level expressions shared by every operator."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def as_column(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def finite(value: ColumnLike) -> Column:
    """The number, or null when it is NaN or infinite (missing is never zero)."""
    number = as_column(value).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), number)


def positive(value: ColumnLike) -> Column:
    number = finite(value)
    return F.when(number > 0, number)


def nonnegative(value: ColumnLike) -> Column:
    number = finite(value)
    return F.when(number >= 0, number)


def half_even(value: ColumnLike, digits: int) -> Column:
    """Round half to even on the scaled double, as numpy does."""
    scale = float(10 ** digits)
    return F.rint(as_column(value) * scale) / scale


def ratio(numerator: ColumnLike, denominator: ColumnLike) -> Column:
    """Division that gives null for a zero or missing denominator."""
    bottom = as_column(denominator)
    return F.when(bottom != 0, as_column(numerator) / bottom)


def ladder(value: ColumnLike, steps: Iterable[tuple[float, object]], *, lower: bool = False,
           strict: bool = False, otherwise: object = 0.0) -> Column:
    """First matching threshold wins; null stays null.

    ``lower`` compares with <= instead of >=; ``strict`` compares with >.
    """
    number = as_column(value)
    chain = F.when(number.isNull(), F.lit(None))
    for bound, result in steps:
        hit = number <= bound if lower else (number > bound if strict else number >= bound)
        chain = chain.when(hit, result if isinstance(result, Column) else F.lit(result))
    return chain.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def first_known(*values: ColumnLike) -> Column:
    return F.coalesce(*[finite(value) for value in values])


def known_sum(*values: Column) -> Column:
    """Sum of the known values; null when none is known."""
    total = sum((F.coalesce(value, F.lit(0.0)) for value in values), F.lit(0.0))
    return F.when(F.coalesce(*values).isNotNull(), total)


def messages(*rules: tuple[Column, Column | str]) -> Column:
    """Array of the texts whose condition holds, in rule order."""
    texts = [F.when(condition, text if isinstance(text, Column) else F.lit(text)) for condition, text in rules]
    return F.array_compact(F.array(*texts))


def one_of(value: ColumnLike, allowed: Sequence[str]) -> Column:
    return F.coalesce(as_column(value).isin(*allowed), F.lit(False))


def filled(value: ColumnLike) -> Column:
    """True when a string holds something."""
    return F.coalesce(F.length(as_column(value).cast("string")) > 0, F.lit(False))
