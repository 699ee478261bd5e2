"""Images inside HTML bodies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DATA_URI = r"(?i)data:image/[^;]+;base64,([\s=/+0-9a-zA-Z]+)"


def data_uri_images(html: Column) -> Column:
    """Array of the bytes of all data-URI images that decode, in order; what isn't padded to fours doesn't.

    White space inside the payload is dropped; anything after its padding is ignored.
    """
    payload = F.transform(F.regexp_extract_all(html, F.lit(DATA_URI), F.lit(1)), lambda x: F.regexp_replace(x, r"\s+", ""))
    whole = F.filter(payload, lambda x: (F.char_length(x) % 4 == 0) & (x != ""))
    return F.filter(F.transform(whole, lambda x: F.try_to_binary(x, F.lit("base64"))), lambda b: b.isNotNull())
