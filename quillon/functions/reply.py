"""Answers of a scoring service: the JSON object inside free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHAPE = "struct<ai_probability: string, flags: array<string>, summary: string>"


def parse_reply(content: Column) -> Column:
    """(ai_probability as text, flags, summary) from the first brace to the last; what is missing is "0", none and "".

    A single string instead of an array of flags is read as its characters. Broken JSON is all defaults.
    """
    text = F.regexp_extract(content, r"(?s)(\{.*\})", 1)
    raw = lambda key: F.get_json_object(text, f"$.{key}")
    # inside brackets, so that anything after the first object is an error, too
    ok = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull() & (text != "")
    listed = F.from_json(raw("flags"), "array<string>")
    single = F.when(raw("flags").isNotNull() & ~raw("flags").startswith("["), F.filter(F.split(raw("flags"), ""), lambda x: x != ""))
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(ok, F.coalesce(raw("ai_probability"), F.lit("0"))).otherwise("0").alias("ai_probability"),
        F.when(ok, F.coalesce(listed, single, none)).otherwise(none).alias("flags"),
        F.when(ok, F.coalesce(raw("summary"), F.lit(""))).otherwise("").alias("summary"),
    )
