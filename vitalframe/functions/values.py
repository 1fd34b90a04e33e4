"""Value-level expressions: inferred type, emptiness, text form, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The shapes of strings, first match wins.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2})?"
PHONE = r"^(?:\+\d[\d\s\-\(\)]{6,19}|\(\d{2,4}\)[\d\s\-]{4,16}|\d{1,4}[\s\-]\d{2,5}[\s\-\d]{2,15})$"
NUMERIC_ID = r"^\d{10,}$"
DATE_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]'Z'",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd",
    "dd/MM/yyyy",
    "MM/dd/yyyy",
    "yyyy/MM/dd",
)


def string_type(s: Column) -> Column:
    """The type label of a string value."""
    low = F.lower(F.trim(s))
    return (
        F.when(s == "", "string")
        .when(low.startswith("http://") | low.startswith("https://"), "url")
        .when(F.substring(s, 1, 20).contains("://") | low.startswith("uri:"), "uri")
        .when(s.contains("@") & s.rlike(EMAIL), "email")
        .when((F.length(s) == 36) & s.rlike(UUID), "uuid")
        .when((F.length(s) >= 10) & s.rlike(ISO_DATE), "date")
        .when(s.rlike(PHONE), "phone")
        .when(s.rlike(NUMERIC_ID), "numeric_id")
        .otherwise("string")
    )


def normalised(c: Column, kind: T.DataType) -> tuple[Column, T.DataType]:
    """Values as JSON would hold them: decimals as doubles, times as ISO text,
    bytes as base64, NaN and infinities as null."""
    if isinstance(kind, T.DecimalType):
        return c.cast("double"), T.DoubleType()
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        d = c.cast("double")
        return F.when(F.isnan(d) | (F.abs(d) == float("inf")), F.lit(None).cast("double")).otherwise(d), T.DoubleType()
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        return F.when(F.date_format(c, "SSSSSS") == "000000", whole).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")), T.StringType()
    if isinstance(kind, T.DateType):
        return F.date_format(c, "yyyy-MM-dd"), T.StringType()
    if isinstance(kind, T.BinaryType):
        return F.base64(c), T.StringType()
    return c, kind


def infer_type(c: Column, kind: T.DataType) -> Column:
    """Type label of each value of a typed column."""
    if isinstance(kind, T.BooleanType):
        label = F.lit("bool")
    elif isinstance(kind, T.IntegralType):
        label = F.lit("int")
    elif isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        label = F.lit("float")
    elif isinstance(kind, (T.StructType, T.MapType)):
        label = F.lit("object")
    elif isinstance(kind, T.ArrayType):
        label = F.lit("array")
    else:
        label = string_type(c.cast("string"))
    return F.when(c.isNull(), "null").otherwise(label)


def is_empty(c: Column, kind: T.DataType) -> Column:
    """Null, empty string, empty array or empty object."""
    if isinstance(kind, T.StringType):
        return c.isNull() | (c == "")
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return c.isNull() | (F.size(c) == 0)
    if isinstance(kind, T.StructType) and not kind.fields:
        return F.lit(True)
    return c.isNull()


def parse_date(s: Column) -> Column:
    """The first of the known formats that reads the text; null if none does."""
    return F.coalesce(*(F.try_to_timestamp(s, F.lit(f)) for f in DATE_FORMATS))
