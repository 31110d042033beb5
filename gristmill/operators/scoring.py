"""Checks of tables to be scored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words for true and false.
TRUE_WORDS, FALSE_WORDS = ("true", "yes", "t", "y", "1"), ("false", "no", "f", "n", "0")


def checked_columns(df: DataFrame, wanted: Sequence[str], ignorable: Sequence[str] = ()) -> DataFrame:
    """The wanted columns in their order; missing ones, and others that are not ignorable, are errors."""
    missing = [c for c in wanted if c not in df.columns]
    extra = [c for c in df.columns if c not in wanted and c not in ignorable]
    if missing or extra:
        raise ValueError("; ".join(f"{what}: {', '.join(x)}" for what, x in (("missing columns", missing), ("unknown columns", extra)) if x))
    return df.select(*wanted)


def numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text columns as numbers: numerals cast, or words of truth as 0 and 1 where a column has nothing else.

    One aggregate over all columns finds the first value that is neither, which is an error.
    """
    text = [c for c, kind in df.dtypes if c in columns and kind == "string"]
    if not text:
        return df
    word = lambda c: F.lower(F.trim(c))
    number = lambda c: F.col(c).try_cast("double")
    tests = []
    for c in text:
        given = F.col(c).isNotNull()
        tests += [F.first(F.when(given & number(c).isNull(), F.col(c)), ignorenulls=True).alias(f"bad_{c}"), F.count_if(given & ~word(c).isin(*TRUE_WORDS, *FALSE_WORDS)).alias(f"words_{c}")]
    found = df.agg(*tests).first()
    made = {}
    for c in text:
        if found[f"bad_{c}"] is None:
            made[c] = number(c)
        elif found[f"words_{c}"] == 0:
            made[c] = F.when(word(c).isin(*TRUE_WORDS), 1.0).when(word(c).isin(*FALSE_WORDS), 0.0)
        else:
            raise ValueError(f"column {c} needs numbers, but has {found[f'bad_{c}']!r}")
    return df.withColumns(made)
