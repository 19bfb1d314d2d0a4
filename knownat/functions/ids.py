"""Identifiers, composite keys and the reproducible hash score used for sampling order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_SPAN = float(2**64 - 1)


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def pad_id(value: Column | str, width: int = 10) -> Column:
    """Left-pad with zeros; longer ids are kept whole (``lpad`` alone would cut them)."""
    text = _column(value).cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def composite_key(*parts: Column | str) -> Column:
    return F.concat_ws("|", *[_column(p).cast("string") for p in parts])


def split_key(key: Column | str) -> Column:
    return F.split(_column(key), r"\|")


def hash_score(identity: Column | str, seed: int) -> Column:
    """First eight bytes of sha256('seed:id') scaled to [0, 1]."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), _column(identity).cast("string")), 256)
    high = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double")
    return high / F.lit(HASH_SPAN)
