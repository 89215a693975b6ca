"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_stable(value: Column, digits: int) -> Column:
    """Half-up rounding that does not depend on the order a sum was taken in.

    Rounding to a fine scale first removes the last-bit noise a distributed sum
    carries, so decimal ties always fall the same way.
    """
    return F.round(F.round(value, 8), digits)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields null on a zero denominator, also under ANSI mode."""
    return F.try_divide(numerator, denominator)


def key_id(*parts: Column) -> Column:
    """A reproducible 60-bit id of a natural key.

    Ids made from the key need no global ordering step and come out the same
    when a task or a whole batch is run again.
    """
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
