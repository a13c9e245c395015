"""Lease keys: ``<sub_id>.<client_id>``."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def lease_key(sub_id: Column | str, client_id: Column | str) -> Column:
    sub_id = F.col(sub_id) if isinstance(sub_id, str) else sub_id
    return F.concat_ws(".", sub_id.cast("string"), client_id)


def parse_lease_key(key: Column | str) -> Column:
    """struct(sub_id decimal(20,0), client_id), split at the first dot; NULL if the key is invalid.

    The id is unsigned 64-bit, which a bigint cannot hold.
    """
    key = F.col(key) if isinstance(key, str) else key
    pattern = r"(?s)^([0-9]+)\.(.+)$"
    digits = F.regexp_extract(key, pattern, 1)
    # Numbers too long for the cast come out NULL and are invalid all the same.
    value = F.regexp_replace(digits, "^0+(?=.)", "").try_cast("decimal(38,0)")
    fits = (digits != "") & (value <= F.lit(str(2**64 - 1)).cast("decimal(38,0)"))
    return F.when(
        fits, F.struct(value.cast("decimal(20,0)").alias("sub_id"), F.regexp_extract(key, pattern, 2).alias("client_id"))
    )


def key_matches(key: Column | str, pattern: str) -> Column:
    """Whether a key fits a pattern of dot-separated tokens: ``*`` is any one token, ``>`` all that follow."""
    parts: list[str] = []
    rest = ""
    for i, token in enumerate(pattern.split(".")):
        if token == ">":
            # Nothing after it counts, and it also accepts a key that ends here.
            rest = ".*" if i == 0 else r"(\..*)?"
            break
        parts.append("[^.]*" if token == "*" else re.sub(r"([^A-Za-z0-9_])", r"\\\1", token))
    column = F.col(key) if isinstance(key, str) else key
    return column.rlike("(?s)^" + r"\.".join(parts) + rest + r"\z")
