"""Column-expression helpers shared by the operators (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TWO_32 = 4294967296.0


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def md5_unit(*parts: str | Column, seed: int | str | None = None) -> Column:
    """Deterministic uniform number in [0, 1) from md5 of the parts (and an
    optional seed).  The same value is computable in DuckDB, so everything
    randomised this way is oracle-checkable and stable under re-execution."""
    cols = [col_(p).cast("string") for p in parts]
    if seed is not None:
        cols.append(F.lit(f":{seed}"))
    text = cols[0] if len(cols) == 1 else F.concat(*cols)
    return md5_int(text) / F.lit(TWO_32)


def md5_int(text: Column) -> Column:
    """First 32 bits of md5(text) as a non-negative bigint."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def number(c: str | Column) -> Column:
    """A numeric column as double with NaN as missing, as pandas aggregates it."""
    x = col_(c).cast("double")
    return F.when(~F.isnan(x), x)


def measured(df: DataFrame, c: str) -> Column:
    """A numeric column with NaN as missing; integers and decimals stay as they are."""
    return number(c) if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)) else F.col(c)


def fmt_fixed(c: Column, digits: int) -> Column:
    """Python ``{x:.Nf}``."""
    return F.format_string(f"%.{digits}f", c)


def fmt_grouped(c: Column, digits: int) -> Column:
    """Python ``{x:,.Nf}`` (thousands separators)."""
    return F.format_string(f"%,.{digits}f", c)


def ts_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def ts_text_micros(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def r6(c: Column) -> Column:
    return F.round(c, 6)
