"""Text cleaning as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text read as a missing value.
NULL_TOKENS = ("", "NA", "N/A", "n/a", "NaN", "nan", "NULL", "null", "None", "<NA>", "#N/A")

# Short gender codes.
GENDER_CODES = {"M": "Male", "F": "Female"}

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def strip(text: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def capitalize(text: Column) -> Column:
    """First character upper case, all others lower case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 2**31 - 1)))


def title_case(text: Column) -> Column:
    """Capitalise every run of letters, also behind a hyphen or an apostrophe."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, capitalize), "")


def null_if_token(text: Column, tokens: tuple[str, ...] = NULL_TOKENS) -> Column:
    """NULL where the stripped text is one of the missing-value tokens."""
    return F.when(~strip(text).isin(*tokens), text)


def to_number(value: Column, is_text: bool) -> Column:
    """DOUBLE, or NULL where the value does not read as a number."""
    if not is_text:
        number = value.cast("double")
        return F.when(~F.isnan(number), number)
    text = strip(value)
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def gender_code(text: Column) -> Column:
    """Expand the one-letter codes; other text is unchanged."""
    out = F.lit(None).cast("string")
    for code, full in GENDER_CODES.items():
        out = F.when(text == code, F.lit(full)).otherwise(out)
    return F.coalesce(out, text)


def cell(text: Column, width: int) -> Column:
    """Pad to ``width``; longer text is kept whole."""
    return F.when(F.length(text) < width, F.rpad(text, width, " ")).otherwise(text)


def shorten(text: Column, longest: int = 19, kept: int = 17) -> Column:
    """Text over ``longest`` characters becomes its first ``kept`` and two dots."""
    return F.when(F.length(text) > longest, F.concat(F.substring(text, 1, kept), F.lit(".."))).otherwise(text)
