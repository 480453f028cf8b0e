"""Row-level column expressions shared by the operators.

All are built-in Spark expressions: they stay inside whole-stage codegen.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S


def date_lit(value: dt.date | str) -> Column:
    if isinstance(value, str):
        value = dt.date.fromisoformat(value)
    return F.lit(value)


def ts_lit(value: dt.datetime | str) -> Column:
    """A timestamp without time zone, as the tables store it."""
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    return F.lit(value).cast("timestamp_ntz")


def days_left(date_col: str | Column, as_of) -> Column:
    """Whole days from ``as_of`` to the date; null stays null (an int, not an interval)."""
    c = F.col(date_col) if isinstance(date_col, str) else date_col
    return F.datediff(c, date_lit(as_of))


def stock_alert(days: Column) -> Column:
    """Negative: expired; 0 to 3 days: expiring; otherwise none."""
    return F.when(days < 0, F.lit(S.STOCK_EXPIRED)).when(days <= 3, F.lit(S.STOCK_EXPIRING))


def task_alert(days: Column) -> Column:
    """Negative: overdue; 0 or 1 day: due soon; otherwise none. Status is not looked at."""
    return F.when(days < 0, F.lit(S.TASK_OVERDUE)).when(days <= 1, F.lit(S.TASK_DUE_SOON))


def expiry_band(days: Column) -> Column:
    return (F.when(days < 0, F.lit(S.BAND_EXPIRED))
            .when(days == 0, F.lit(S.BAND_TODAY))
            .when(days <= 1, F.lit(S.BAND_TOMORROW))
            .otherwise(F.lit(S.BAND_LATER)))


def ordinal(col: str | Column, labels: Sequence[str]) -> Column:
    """Position of an enum label in its declaration (1-based); sorts like the enum."""
    c = F.col(col) if isinstance(col, str) else col
    expr = None
    for i, label in enumerate(labels, start=1):
        expr = (F.when(c == label, F.lit(i)) if expr is None else expr.when(c == label, F.lit(i)))
    return expr


def truthy(value) -> bool:
    """Optional arguments filter only when truthy: None, 0 and '' mean no filter."""
    return bool(value)


def like_contains(text: str) -> str:
    """LIKE pattern ``%text%``. ``%`` and ``_`` in the text stay wildcards; a
    backslash is doubled so that it is a literal character."""
    return "%" + text.replace("\\", "\\\\") + "%"


def iso_date(col: str | Column) -> Column:
    """``YYYY-MM-DD`` text of a date, null stays null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.date_format(c, "yyyy-MM-dd")


def iso_timestamp(col: str | Column, sep: str = "T") -> Column:
    """Text of a timestamp the way Python's ``isoformat`` prints it: seconds, and six
    fractional digits only when the fraction is not zero."""
    c = F.col(col) if isinstance(col, str) else col
    base = F.date_format(c, f"yyyy-MM-dd'{sep}'HH:mm:ss")
    frac = F.date_format(c, "SSSSSS")
    return F.when(c.isNull(), F.lit(None)).when(frac == "000000", base).otherwise(F.concat(base, F.lit("."), frac))


def strict_date(text: str | Column) -> Column:
    """Parse ``YYYY-M-D`` text like ``strptime('%Y-%m-%d')``: one- or two-digit month
    and day, four-digit year; impossible dates and other shapes give null."""
    c = F.col(text) if isinstance(text, str) else text
    shaped = c.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$")
    return F.when(shaped, F.try_to_date(c, "yyyy-M-d"))


def parse_decimal(text: str | Column, precision: int = 38, scale: int = 10) -> Column:
    """Text to a wide decimal, null when it is not a number (never fails the job)."""
    c = F.col(text) if isinstance(text, str) else text
    return F.trim(c).try_cast(f"decimal({precision},{scale})")


def to_response(df, *, keep_decimals: bool = False):
    """The response edge: decimals become doubles, dates ``YYYY-MM-DD`` text and
    timestamps ISO text, as the reference's JSON answers print them."""
    from pyspark.sql import types as T

    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DecimalType) and not keep_decimals:
            c = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = iso_date(c)
        elif isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)):
            c = iso_timestamp(c)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)
