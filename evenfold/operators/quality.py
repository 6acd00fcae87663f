"""Validation of a people table: rules per cohort, and where values are missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenfold.functions.text import to_number
from evenfold.sources.people import KEYS, SCORES, missing_columns

# The documented score range.
LOWEST, HIGHEST = 1, 4


def _is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def validate_people(people: DataFrame) -> DataFrame:
    """One verdict per cohort: ``cohort_id, is_valid, errors`` with errors in rule order.

    A score column with unreadable text is reported as not numeric and its range is then
    not tested. An absent column is reported and its rules are skipped.
    """
    absent = missing_columns(people)
    failures = [F.lit(f"Missing columns: {absent}" if absent else None).cast("string")]
    aggregates = []
    for name in SCORES:
        if name in absent:
            continue
        number = to_number(F.col(name), _is_text(people, name))
        aggregates += [
            F.bool_or(F.col(name).isNotNull() & number.isNull()).alias(f"_text_{name}"),
            F.bool_and(F.coalesce(number.between(LOWEST, HIGHEST), F.lit(False))).alias(f"_range_{name}"),
        ]
        failures.append(
            F.when(F.col(f"_text_{name}"), F.lit(f"{name} must be numeric."))
            .when(~F.col(f"_range_{name}"), F.lit(f"{name} contains values outside the 1–4 range."))
        )
    any_null = F.lit(False)
    for name in people.columns:
        any_null = any_null | F.col(f"`{name}`").isNull()
    aggregates.append(F.bool_or(any_null).alias("_null"))
    failures.append(F.when(F.col("_null"), F.lit("Data contains missing values.")))
    errors = F.filter(F.array(*failures), lambda message: message.isNotNull())
    return (
        people.groupBy("cohort_id").agg(*aggregates)
        .select("cohort_id", errors.alias("errors"))
        .select("cohort_id", (F.size("errors") == 0).alias("is_valid"), "errors")
    )


def missing_values(people: DataFrame) -> DataFrame:
    """One row per missing value: ``cohort_id, column, row_id``."""
    names = [c for c in people.columns if c not in KEYS]
    flags = F.array(*[F.when(F.col(f"`{n}`").isNull(), F.lit(n)) for n in names])
    found = F.filter(flags, lambda name: name.isNotNull())
    return people.select("cohort_id", F.explode(found).alias("column"), "row_id")


def split_usable(people: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows the pipelines can use, and the others with a ``reason``.

    A person without a score or a learning style has no features, one without ``cohort_id`` or
    ``row_id`` no place, and people who share both cannot be told apart. Gender and diversity may
    be missing. With ``strict`` such a person is an error.
    """
    needed = [*KEYS, *SCORES, "Learning_Style"]
    # Empty where the keys are sound.
    shared = people.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*KEYS, F.lit(True).alias("_shared"))
    marked = people.join(shared, list(KEYS), "left").select(*people.columns, F.coalesce("_shared", F.lit(False)).alias("_shared"))
    reasons = F.filter(
        F.array(*[F.when(F.col(n).isNull(), F.lit(f"{n} is missing")) for n in needed],
                F.when(F.col("_shared"), F.lit("row_id is repeated"))),
        lambda reason: reason.isNotNull(),
    )
    unusable = F.col("_shared")
    for name in needed:
        unusable = unusable | F.col(name).isNull()
    quarantine = marked.where(unusable).withColumn("reason", F.array_join(reasons, "; ")).drop("_shared")
    if strict:
        sample = quarantine.select("cohort_id", "row_id", "reason").take(5)
        if sample:
            raise ValueError(f"people without features, for example {[tuple(r) for r in sample]}")
    return marked.where(~unusable).drop("_shared"), quarantine
