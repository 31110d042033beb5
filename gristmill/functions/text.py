"""Scalar text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_name(name: Column) -> Column:
    """Letters and digits of a column name, in lower case."""
    return F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]", "")


def word_tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def unicode_words(text: Column) -> Column:
    """Lower-case words of two or more letters, digits or underscores of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


#: How names of exceptions end, what stands for quoted text and for numbers, and a signature's length.
EXCEPTION_ENDINGS = ("Error", "Exception", "Warning")
QUOTED_MARK, NUMBER_MARK, SIGNATURE_LENGTH = "'…'", "N", 200


def error_signature(log: Column, length: int = SIGNATURE_LENGTH) -> Column:
    """What an error log says once its data are masked: equal for errors of one kind.

    It is the last line that starts with an exception's name, or the last line with text if there is none; of a log
    without text it is ``unknown error``, of a null log null.
    """
    lines = F.filter(F.transform(F.split(log, r"\R"), lambda line: F.btrim(line, F.lit(" \t\f\x0b"))), lambda line: line != "")
    named = F.filter(lines, lambda line: F.regexp_substr(line, F.lit(r"^[\w.]*\w(?:" + "|".join(EXCEPTION_ENDINGS) + r")\b")).isNotNull())
    line = F.coalesce(F.try_element_at(named, F.lit(-1)), F.try_element_at(lines, F.lit(-1)), F.lit("unknown error"))
    # The line falls into quoted stretches, runs of digits, runs of anything else, and quotes that nothing closes.
    tokens = F.regexp_extract_all(line, F.lit(r"""'[^']*'|"[^"]*"|[0-9]+|[^'"0-9]+|['"]"""), F.lit(0))
    masked = F.transform(tokens, lambda t: F.when(t.rlike("^[0-9]"), NUMBER_MARK).when((F.length(t) > 1) & t.rlike("^['\"]"), QUOTED_MARK).otherwise(t))
    return F.when(log.isNotNull(), F.substring(F.array_join(masked, ""), 1, length))


def composite_key(*parts: Column) -> Column:
    """Parts joined by "-"; a null part is written as ``nan``, so that keys keep their number of parts."""
    return F.concat_ws("-", *(F.coalesce(p.cast("string"), F.lit("nan")) for p in parts))


#: The forms in which dates are written; a time of day may follow those that begin with the year.
YEAR_FIRST, YEAR_LAST = ("yyyy-M-d", "yyyy/M/d", "yyyy-M", "yyyy/M"), ("d-M-yyyy", "d/M/yyyy", "M-d-yyyy", "M/d/yyyy")


def date_like(text: Column) -> Column:
    """Whether a text is a date, or a month, in one of the stated forms, with or without a time of day; null of null."""
    forms = [*YEAR_LAST, *YEAR_FIRST, *(f"{day}{sep}H:mm{seconds}" for day in YEAR_FIRST for sep in (" ", "'T'") for seconds in ("", ":ss"))]
    parsed = F.coalesce(*(F.try_to_timestamp(text, F.lit(form)) for form in forms))
    # Most texts are no dates: those that cannot be are not parsed.
    return F.when(text.isNotNull(), F.when(text.rlike(r"^\d[\dT:/ -]{4,18}$"), parsed.isNotNull()).otherwise(False))
