"""Column expressions shared by the operators. All of them stay inside whole-stage codegen."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Prices and the time zone in which deadlines are given.
PRICE_PER_TB_SCANNED = 5.0
PRICE_PER_DPU_HOUR = 0.44
DEADLINE_ZONE = "America/Los_Angeles"


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def instant(when: date | datetime) -> Column:
    """A literal timestamp without time zone, whatever the session zone is."""
    if not isinstance(when, datetime):
        when = datetime.combine(when, time.min)
    return F.lit(when.isoformat(sep=" ")).cast("timestamp_ntz")


def between_days(df: DataFrame, column: str, first: date, last: date) -> Column:
    """``first <= day(column) <= last`` with the column left bare, so the parquet reader can use it."""
    if isinstance(df.schema[column].dataType, T.DateType):
        return (F.col(column) >= F.lit(first)) & (F.col(column) <= F.lit(last))
    return (F.col(column) >= instant(first)) & (F.col(column) < instant(last + timedelta(days=1)))


def from_day(df: DataFrame, column: str, first: date) -> Column:
    first = F.lit(first) if isinstance(df.schema[column].dataType, T.DateType) else instant(first)
    return F.col(column) >= first


def on_day(df: DataFrame, column: str, day: date) -> Column:
    return between_days(df, column, day, day)


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Share in percent, NULL when the whole is 0."""
    return F.round(F.try_divide(part.cast("double") * 100, whole.cast("double")), digits)


def number_or_zero(c: str | Column, type_: str = "decimal(18,6)") -> Column:
    """Numeric text; blank, NULL and unparsable count as 0."""
    return F.coalesce(as_col(c).try_cast(type_), F.lit(0).cast(type_))


def money(c: Column, type_: str = "decimal(28,2)") -> Column:
    return c.cast(type_)


def when_status(ok: Column, otherwise: str = "FAIL") -> Column:
    """PASS where true; false and NULL take the other status."""
    return F.when(ok, F.lit("PASS")).otherwise(F.lit(otherwise))


def local_time(ts: str | Column, zone: str = DEADLINE_ZONE) -> Column:
    """UTC wall clock to local wall clock."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), as_col(ts).cast("timestamp_ntz"))


def hours_between(earlier: Column, later: Column) -> Column:
    """Elapsed hours with fraction."""
    micros = F.timestamp_diff("MICROSECOND", earlier, later)
    return micros / F.lit(3600 * 1000000.0)


def scan_cost(scanned_bytes: str | Column, price_per_tb: float = PRICE_PER_TB_SCANNED) -> Column:
    return F.round(as_col(scanned_bytes).cast("double") / F.lit(float(1024**4)) * F.lit(price_per_tb), 6)


def dpu_cost(dpu_seconds: str | Column, price_per_hour: float = PRICE_PER_DPU_HOUR) -> Column:
    """Unrounded run cost; NULL seconds cost nothing."""
    return F.coalesce(as_col(dpu_seconds).cast("double"), F.lit(0.0)) / 3600.0 * F.lit(price_per_hour)


def business_key(parts: list[str], dates: tuple[str, ...] = (), lower: tuple[str, ...] = (), sep: str = "^") -> Column:
    """One comparable text key: trimmed parts, blanks for NULL, text dates brought to one format."""
    pieces = []
    for name in parts:
        piece = F.col(name)
        if name in dates:
            piece = piece.cast("string").try_cast("date").cast("string")
        else:
            piece = F.trim(piece.cast("string"))
        piece = F.coalesce(piece, F.lit(""))
        pieces.append(F.lower(piece) if name in lower else piece)
    return F.concat_ws(sep, *pieces)


def first_match(default: str, *choices: tuple[Column, str]) -> Column:
    """The label of the first condition that holds."""
    label = None
    for condition, value in choices:
        label = F.when(condition, F.lit(value)) if label is None else label.when(condition, F.lit(value))
    return label.otherwise(F.lit(default))


def like_any(c: str | Column, *patterns: str) -> Column:
    found = F.lit(False)
    for pattern in patterns:
        found = found | as_col(c).like(pattern)
    return found


def wider_number(a: T.DataType, b: T.DataType) -> T.DataType:
    """A number type that holds the values of both; double beside any other, decimals with room for both parts."""
    whole = {T.ByteType(): 3, T.ShortType(): 5, T.IntegerType(): 10, T.LongType(): 19}
    if a in whole and b in whole:
        return max(a, b, key=whole.get)
    if any(isinstance(x, T.FractionalType) and not isinstance(x, T.DecimalType) for x in (a, b)):
        return T.DoubleType()
    left, scale = zip(*((x.precision - x.scale, x.scale) if isinstance(x, T.DecimalType) else (whole[x], 0) for x in (a, b)))
    return T.DecimalType(min(38, max(left) + max(scale)), min(max(scale), 38 - min(38, max(left))))
