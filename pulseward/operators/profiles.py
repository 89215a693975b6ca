"""What inference needs to know of a table's columns, from one pass; profiles of parts of a table merge into that of the whole.

A column of text is placed in a lattice of types: every value is a set of types it can be read as, written as bits, and the
column's types are those common to all its values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseward.functions.dates import parsed_time, short_date_number

# Narrowest first; a column takes the first of these that all its values have.
KINDS = {"bigint": 1, "decimal(38,0)": 2, "double": 4, "boolean": 8}
#: A time in any of the forms of ``parsed_time``, month or day first, and in ISO form.
TIME, ISO_TIME = 16, 32

WHOLE_NUMBER = r"^\s*[+-]?\d{1,18}\s*$"
LONG_NUMBER = r"^\s*[+-]?\d{19,38}\s*$"
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
TRUTH = r"(?i)^(true|false)$"
#: Characters of a written time, at most.
TIME_LENGTH = 40

PROFILE = (
    "ordinal int, column_name string, data_type string, rows bigint, present bigint, characters bigint, longest int, "
    "kinds int, first_number int, second_number int, distinct_sketch binary"
)


def is_numeric(kind: T.DataType) -> bool:
    """Numbers and booleans count as numeric."""
    return isinstance(kind, (T.NumericType, T.BooleanType))


def _bits(tests: list[tuple[Column, int]]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(test, bit).otherwise(0) for test, bit in tests])


def readable_as(value: Column) -> Column:
    """The types of ``KINDS`` a text can be read as. Patterns decide, and only whole numbers of 19 digits or more are cast.

    A failed cast costs an exception per value. Whole numbers beyond a bigint are decimals, so that no two become the same.
    """
    fits = value.try_cast("bigint").isNotNull()
    return (
        F.when(value.rlike(WHOLE_NUMBER), 7)
        .when(value.rlike(LONG_NUMBER), F.when(fits, 7).otherwise(6))
        .when(value.rlike(NUMBER), 4)
        .when(value.rlike(TRUTH), 8)
        .otherwise(0)
    )


def written_times(value: Column) -> Column:
    """``TIME`` and ``ISO_TIME`` where a text is one; texts that are long or have no digit are none and are not parsed."""
    likely = (F.length(value) <= TIME_LENGTH) & value.rlike(r"\d")
    time = F.coalesce(parsed_time(value), parsed_time(value, day_first=True))
    return F.when(likely, _bits([(time.isNotNull(), TIME), (F.try_to_timestamp(value).isNotNull(), ISO_TIME)])).otherwise(0)


def column_profiles(
    df: DataFrame, types: bool = False, times: list[str] | None = None, distinct: bool = False
) -> DataFrame:
    """One row per column, by one aggregate over the table; none for a table without columns.

    Always rows, values present, and characters and longest text of columns that are not numeric. ``types`` adds the
    types a text column can be read as, ``times`` says which text columns may hold times and adds their forms and the
    largest numbers in the places of month and day, ``distinct`` a sketch of the distinct values.
    Where a fact was not asked for or there is no value, it is null.
    """
    aggregates, entries = [F.count("*").alias("rows")], []
    if not df.columns:
        return df.sparkSession.createDataFrame([], PROFILE)

    def fact(name: str, i: int, value: Column, kind: str) -> Column:
        aggregates.append(value.cast(kind).alias(f"{name}{i}"))
        return F.col(f"{name}{i}").alias(name)

    for i, f in enumerate(df.schema.fields):
        c, text = F.col(f"`{f.name}`"), isinstance(f.dataType, T.StringType)
        timed = text and f.name in (times or [])
        length = F.lit(None).cast("int") if is_numeric(f.dataType) else F.length(c.cast("string"))
        bits = [readable_as(c)] * (text and types) + [written_times(c)] * timed
        kinds = F.bit_and(F.when(c.isNotNull(), reduce(lambda a, b: a.bitwiseOR(b), bits))) if bits else F.any_value(F.lit(None))
        numbers = [F.max(short_date_number(c, place)) if timed else F.any_value(F.lit(None)) for place in (1, 2)]
        sketch = F.hll_sketch_agg(F.when(c.isNotNull(), F.xxhash64(c))) if distinct else F.any_value(F.lit(None))
        entries.append(
            F.struct(
                F.lit(i).alias("ordinal"),
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("data_type"),
                F.col("rows"),
                fact("present", i, F.count(c), "bigint"),
                fact("characters", i, F.sum(length), "bigint"),
                fact("longest", i, F.max(length), "int"),
                fact("kinds", i, kinds, "int"),
                fact("first_number", i, numbers[0], "int"),
                fact("second_number", i, numbers[1], "int"),
                fact("distinct_sketch", i, sketch, "binary"),
            )
        )
    return df.agg(*aggregates).select(F.explode(F.array(*entries)).alias("c")).select("c.*")


def merge_profiles(profiles: DataFrame) -> DataFrame:
    """Profiles of parts of a table as the profile of all of it."""
    return profiles.groupBy("ordinal", "column_name", "data_type").agg(
        *[F.sum(c).alias(c) for c in ("rows", "present", "characters")],
        F.max("longest").alias("longest"),
        F.bit_and("kinds").alias("kinds"),
        *[F.max(c).alias(c) for c in ("first_number", "second_number")],
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
    )


def narrowest_type(kinds: Column, data_type: Column) -> Column:
    """The type of a column by its profile: text takes the narrowest type of all its values, double if it has none."""
    text = F.when(kinds.isNull(), "double")
    for name, bit in KINDS.items():
        text = text.when(kinds.bitwiseAND(bit) > 0, name)
    return F.when(data_type == "string", text.otherwise("string")).otherwise(data_type)
