"""Text helpers: caps, previews, white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

BODY_CAP, PROMPT_CAP, PREVIEW = 25_000, 10_000, 500


def cap(c: Column, n: int) -> Column:
    """The first n code points and an ellipsis of three dots, if there are more."""
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def clean_string(c: Column) -> Column:
    """Null to an empty string, anything else to text. Spark's strings can't hold lone surrogates."""
    return F.coalesce(c.cast("string"), F.lit(""))


def valid(c: Column) -> Column:
    """Without bytes that aren't UTF-8."""
    return F.when(F.is_valid_utf8(c), c).otherwise(F.replace(F.make_valid_utf8(c), F.lit("\ufffd"), F.lit("")))


def clean_json_data(c: Column, kind: DataType) -> Column:
    """A value of any shape with all its strings, map keys included, made valid(); nulls and other values stay as they are."""
    if isinstance(kind, StringType):
        return valid(c)
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: clean_json_data(x, kind.elementType))
    if isinstance(kind, MapType):
        keys = F.transform_keys(c, lambda k, v: clean_json_data(k, kind.keyType))
        return F.transform_values(keys, lambda k, v: clean_json_data(v, kind.valueType))
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*[clean_json_data(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return c


def truncate_text(c: Column, n: int = PREVIEW) -> Column:
    return cap(clean_string(c), n)


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def timestamp(c: Column | None = None) -> Column:
    return F.date_format(F.current_timestamp() if c is None else c, "yyyyMMdd_HHmmss")
