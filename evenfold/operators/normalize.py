"""Cleaning of categories and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenfold.functions.text import capitalize, gender_code, strip, title_case, to_number
from evenfold.sources.people import SCORES


def normalize_people(people: DataFrame) -> DataFrame:
    """Clean genders, styles and diversity names; scores become DOUBLE or NULL.

    All other columns pass unchanged, and so does the column order.
    """
    cleaned = {
        "Gender": gender_code(capitalize(strip(F.col("Gender")))),
        "Learning_Style": capitalize(strip(F.col("Learning_Style"))),
        "Diversity": title_case(strip(F.col("Diversity"))),
    }
    for name in SCORES:
        is_text = isinstance(people.schema[name].dataType, T.StringType)
        cleaned[name] = to_number(F.col(name), is_text)
    return people.select(*[
        cleaned[c].alias(c) if c in cleaned else F.col(f"`{c}`") for c in people.columns
    ])
