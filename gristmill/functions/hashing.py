"""Reproducible uniform draws from keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column, salt: str, seed: int = 42) -> Column:
    """A draw in [0, 1) that depends on seed, salt and key alone: the first 52 bits of an MD5 digest."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), key.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def uniform_sql(key: str, salt: str, seed: int = 42) -> str:
    """The same draw as SQL for other engines."""
    return f"(CAST(('0x' || substr(md5('{seed}|{salt}|' || CAST({key} AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE)"


def row_hash(*cells: Column) -> Column:
    """An MD5 digest of cells as text, with a unit separator between them; a null cell is empty."""
    return F.md5(F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("")) for c in cells)))
