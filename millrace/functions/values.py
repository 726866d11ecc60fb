"""Column expressions for numbers, dates and missing values.

One rule runs through the library: NaN and infinities are turned into NULL as soon as a number is
read or computed, because Spark orders NaN above every number and treats it as equal to itself.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, functions as F, types as T

from millrace.functions.text import let

# Date formats tried after the ISO forms, in this order.
DATE_FORMATS = ("MM/dd/yyyy", "yyyyMMdd")

NUMERIC_TYPES = (T.NumericType, T.BooleanType)


def is_numeric(dtype: T.DataType) -> bool:
    """Booleans count as numeric."""
    return isinstance(dtype, NUMERIC_TYPES)


def is_datetime(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType))


def finite(col: Column) -> Column:
    """NULL for NaN and both infinities."""
    return F.when(F.isnan(col) | (F.abs(col) == float("inf")), F.lit(None)).otherwise(col)


def as_double(col: Column, dtype: T.DataType | None = None) -> Column:
    """Numeric reading of any column, NULL where there is none."""
    if isinstance(dtype, (T.IntegralType, T.BooleanType, T.DecimalType)):
        return col.cast("double")
    if dtype is not None and (is_datetime(dtype) or is_nested(dtype)):
        return F.lit(None).cast("double")
    if isinstance(dtype, T.FractionalType):
        return finite(col.cast("double"))
    text = col.cast("string")
    # Java also reads a trailing type letter ("1d", "2f"), which is no number here.
    return finite(F.when(~text.rlike(r"[0-9.][dDfF]\s*$"), text.try_cast("double")))


def as_long(col: Column, dtype: T.DataType | None = None) -> Column:
    if isinstance(dtype, (T.IntegralType, T.BooleanType)):
        return col.cast("bigint")
    number = as_double(col, dtype)
    return F.when(number == F.floor(number), number.try_cast("bigint"))


def as_boolean(col: Column, dtype: T.DataType | None = None) -> Column:
    if isinstance(dtype, T.BooleanType):
        return col
    if is_numeric(dtype) if dtype is not None else False:
        number = col.cast("double")
        return F.when(number == 1, F.lit(True)).when(number == 0, F.lit(False))
    return col.cast("string").try_cast("boolean")


def as_timestamp(col: Column, dtype: T.DataType | None = None) -> Column:
    """UTC instant; text is tried as ISO first, then with the fixed formats.

    A number is a count of nanoseconds since the epoch.
    """
    if dtype is not None and is_datetime(dtype):
        return col.cast("timestamp")
    if isinstance(dtype, T.BooleanType) or (dtype is not None and is_nested(dtype)):
        return F.lit(None).cast("timestamp")
    if dtype is not None and is_numeric(dtype):
        return F.timestamp_micros(F.floor(finite(col.cast("double")) / 1000).cast("bigint"))
    text = F.trim(col.cast("string"))
    # A bare time of day is not a date.
    dated = F.when(~text.rlike(r"^\d{1,2}:\d{2}"), text)
    tries = [F.try_to_timestamp(dated)] + [F.try_to_timestamp(dated, F.lit(fmt)) for fmt in DATE_FORMATS]
    return F.coalesce(*tries)


def epoch_seconds(col: Column) -> Column:
    return F.unix_micros(col.cast("timestamp")) / F.lit(1e6)


def parse_instant(value: object) -> datetime | None:
    """Driver-side reading of one request value (a filter bound); None if it is no date."""
    if value in (None, ""):
        return None
    if isinstance(value, datetime):
        moment = value
    else:
        text = str(value).strip()
        moment = None
        for reader in (
            datetime.fromisoformat,
            lambda t: datetime.strptime(t, "%m/%d/%Y"),
            lambda t: datetime.strptime(t, "%Y%m%d"),
            lambda t: datetime.strptime(t, "%Y"),
        ):
            try:
                moment = reader(text)
                break
            except ValueError:
                continue
        if moment is None:
            return None
    if moment.tzinfo is not None:
        moment = moment.astimezone(timezone.utc).replace(tzinfo=None)
    return moment


def instant_literal(moment: datetime, dtype: T.DataType) -> Column:
    """A foldable literal of the column's own time type, so the comparison reaches the scan."""
    text = moment.isoformat(sep=" ")
    kind = "timestamp_ntz" if isinstance(dtype, T.TimestampNTZType) else "timestamp"
    return F.lit(text).cast(kind)


def canonical_scalar(col: Column) -> Column:
    """Text under which equal scalars are equal: ``0``, ``0.0`` and ``"0.0"`` are all ``0``.

    Integral numbers lose their fraction, other numbers keep 12 significant digits,
    booleans are lower case and missing values are empty.
    """
    # Each step is bound once: written out, the reading of the number would stand in every branch several times.
    return let(F.trim(col.cast("string")), lambda text: F.when(text.isNull() | (text == ""), F.lit("")).otherwise(
        let(let(F.when(~text.rlike(r"[0-9.][dDfF]\s*$"), text.try_cast("double")), finite), lambda number: _canonical(text, number))
    ))


def _canonical(text: Column, number: Column) -> Column:
    magnitude = F.floor(F.log10(F.abs(number)))
    digits = F.lit(11) - magnitude.cast("int")

    def fraction(rounded: Column) -> Column:
        plain = F.regexp_replace(F.format_string("%.17f", rounded), r"\.?0+$", "")
        # The shortest decimal form of the rounded double is its 12-digit form.
        return let(rounded.cast("string"), lambda shortest: F.when(shortest.contains("E"), plain).otherwise(shortest))

    return (
        F.when(number.isNull(), F.when(F.lower(text).isin("true", "false"), F.lower(text)).otherwise(text))
        .when((number == F.floor(number)) & (F.abs(number) < 1e18), number.try_cast("bigint").cast("string"))
        .otherwise(let(F.pow(F.lit(10.0), digits.cast("double")), lambda scale: let(F.rint(number * scale) / scale, fraction)))
    )
