"""The missing-value predicates. Operators differ in what they call missing, so each predicate has a name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A number as JavaScript's Number() reads a trimmed text, without the infinities.
NUMBER = r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)$"
HEX = r"^0[xX][0-9a-fA-F]{1,15}$"


def trimmed(c: Column) -> Column:
    """Without white space (the six ASCII kinds) at either end."""
    return F.btrim(c.cast("string"), F.lit(" \t\n\x0b\x0c\r"))


def blank(c: Column) -> Column:
    """Null, or empty once trimmed: SELECT, SORT, TABLES."""
    return c.isNull() | (trimmed(c) == "")


def empty(c: Column) -> Column:
    """Null or the empty text; white space is a value: SUMMARIZE, RELATE, MERGE."""
    return c.isNull() | (c.cast("string") == "")


def number(c: Column) -> Column:
    """A finite double, else null."""
    text = trimmed(c)
    plain = F.when(text.rlike(NUMBER), text.try_cast("double"))
    value = F.coalesce(plain, F.when(text.rlike(HEX), F.conv(F.substring(text, 3, 15), 16, 10).try_cast("double")))
    return F.when(F.abs(value) < float("inf"), value)


def finite(df: DataFrame, name: str) -> Column:
    """A column as a finite double: numbers as they are, texts if they read as one, truth values never."""
    kind = df.schema[name].dataType.typeName()
    if kind in ("boolean", "binary", "date", "timestamp"):
        return F.lit(None).cast("double")
    c = F.col(f"`{name}`")
    if kind == "string":
        return number(c)
    value = c.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def yes_no(c: Column) -> Column:
    """True for yes, true, 1; false for no, false, 0; else null."""
    text = F.lower(trimmed(c))
    return F.when(text.isin("yes", "true", "1"), True).when(text.isin("no", "false", "0"), False)
