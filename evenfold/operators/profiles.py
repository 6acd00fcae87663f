"""Profiles: people of a cohort who look alike, counted once.

Scores have few values and styles are few, so a cohort of any size has few distinct
profiles. Features, distances and clusterings work on profiles with a ``weight``; the id of a
profile is the smallest ``row_id`` in it. Only sizing, swapping and reports go back to rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenfold.functions.measure import quantise, standardised
from evenfold.operators.joins import join_by_weight
from evenfold.session import checkpoint
from evenfold.sources.people import SCORES

SKILL_KEYS = (*SCORES, "Learning_Style")
FULL_KEYS = (*SKILL_KEYS, "Gender", "Diversity")
SHORT = {"Motivation": "motivation", "Self_Esteem": "esteem", "Work_Ethic": "ethic"}


def count_profiles(people: DataFrame, keys: tuple[str, ...] = SKILL_KEYS) -> DataFrame:
    """Distinct profiles with their number of people; partial counts before the shuffle."""
    return people.groupBy("cohort_id", *keys).agg(
        F.count(F.lit(1)).alias("weight"), F.min("row_id").alias("profile_id"))


def fit_scaling(profiles: DataFrame, fit_scope: str = "cohort") -> DataFrame:
    """Means, deviations, spans and sorted style shares, one row per fit scope.

    Sums run over weighted scores, exact for whole-number scores whatever the row order.
    The deviation is the population one, and exactly 0 for a constant column.
    """
    scoped = profiles.withColumn("_scope", _scope(fit_scope))
    weight = F.col("weight")
    sums = [F.sum(weight).alias("_n")]
    for score in SCORES:
        value = F.col(score)
        sums += [
            F.sum(weight * value).alias(f"_s1_{score}"),
            F.sum(weight * value * value).alias(f"_s2_{score}"),
            F.min(value).alias(f"_lo_{score}"),
            F.max(value).alias(f"_hi_{score}"),
        ]
    n = F.col("_n").cast("double")
    fitted = []
    for score, short in SHORT.items():
        s1, s2 = F.col(f"_s1_{score}"), F.col(f"_s2_{score}")
        lo, hi = F.col(f"_lo_{score}"), F.col(f"_hi_{score}")
        spread = F.greatest(n * s2 - s1 * s1, F.lit(0.0))
        fitted += [
            (s1 / n).alias(f"mean_{short}"),
            F.when(lo == hi, F.lit(0.0)).otherwise(F.sqrt(spread) / n).alias(f"sd_{short}"),
            (hi - lo).alias(f"span_{short}"),
        ]
    scores = scoped.groupBy("_scope").agg(*sums).select("_scope", F.col("_n").alias("fit_rows"), *fitted)
    shares = (
        scoped.groupBy("_scope", "Learning_Style").agg(F.sum("weight").alias("_count"))
        .groupBy("_scope").agg(F.array_sort(F.collect_list(
            F.struct(F.col("Learning_Style").alias("style"), F.col("_count").alias("people")))).alias("styles"))
    )
    return scores.join(shares, "_scope")


def _scope(fit_scope: str) -> Column:
    if fit_scope == "cohort":
        return F.col("cohort_id")
    if fit_scope == "global":
        return F.lit(0).cast("bigint")
    raise ValueError(f"fit_scope must be 'cohort' or 'global', not {fit_scope!r}")


def scale(df: DataFrame) -> DataFrame:
    """Standardised columns for rows or profiles that carry their cohort's fit."""
    n = F.col("fit_rows").cast("double")

    def share(style: Column) -> Column:
        return style["people"].cast("double") / n

    def one_hot(style: Column) -> Column:
        p = share(style)
        hot = (F.col("Learning_Style") == style["style"]).cast("double")
        return standardised(hot, p, F.sqrt(p * (1 - p)))

    zs = {
        short: standardised(F.col(score), F.col(f"mean_{short}"), F.col(f"sd_{short}"))
        for score, short in SHORT.items()
    }
    own = F.filter("styles", lambda s: s["style"] == F.col("Learning_Style"))[0]
    p = share(own)
    deviation = F.sqrt(p * (1 - p))
    hot = standardised(F.lit(1.0), p, deviation)
    cold = standardised(F.lit(0.0), p, deviation)
    return (
        df.withColumns({f"z_{short}": z for short, z in zs.items()})
        .withColumns({
            **{f"q_{short}": quantise(F.col(f"z_{short}")) for short in SHORT.values()},
            "z_gap": hot - cold,
            "q_gap": quantise(hot) - quantise(cold),
            "features": F.concat(F.array(*[F.col(f"z_{s}") for s in SHORT.values()]),
                                 F.transform("styles", one_hot)),
        })
        .withColumn("features_q", F.transform("features", quantise))
        .drop("styles", *[f"{kind}_{s}" for kind in ("mean", "sd") for s in SHORT.values()])
    )


def encode(people: DataFrame, keys: tuple[str, ...] = SKILL_KEYS, fit_scope: str = "cohort") -> DataFrame:
    """Profiles with standardised features.

    Besides its features every profile carries ``cohort_rows`` (people) and ``peers``
    (profiles) of its cohort. The counts are written to the checkpoint folder, so that people
    are read once; all that follows works on the counts.
    """
    profiles = checkpoint(count_profiles(people, keys))
    fit = fit_scaling(profiles, fit_scope)
    sizes = profiles.groupBy("cohort_id").agg(
        F.sum("weight").alias("cohort_rows"), F.count(F.lit(1)).alias("peers"))
    return checkpoint(scale(
        profiles.withColumn("_scope", _scope(fit_scope)).join(fit, "_scope").drop("_scope")
        .join(sizes, "cohort_id")
    ).drop("fit_rows"))


def attach_profiles(people: DataFrame, profiles: DataFrame, keys: tuple[str, ...] = SKILL_KEYS,
                    columns: tuple[str, ...] = ("profile_id",)) -> DataFrame:
    """Give each person columns of their profile."""
    small = profiles.select("cohort_id", *keys, "weight", *[c for c in columns if c != "weight"])
    joined = join_by_weight(people, small, ["cohort_id", *keys], "weight")
    return joined if "weight" in columns else joined.drop("weight")


def features(people: DataFrame, fit_scope: str = "cohort") -> DataFrame:
    """``cohort_id, row_id, features, features_q`` for every person."""
    encoded = encode(people, fit_scope=fit_scope)
    return attach_profiles(people.select("cohort_id", "row_id", *SKILL_KEYS), encoded,
                           columns=("features", "features_q")).select(
        "cohort_id", "row_id", "features", "features_q")


def assemble(people: DataFrame, fit_scope: str = "cohort") -> DataFrame:
    """``cohort_id, row_id, features`` before scaling: three scores, then one 0/1 per known style."""
    profiles = checkpoint(count_profiles(people))
    fit = fit_scaling(profiles, fit_scope).select("_scope", "styles")
    vector = F.concat(F.array(*[F.col(s) for s in SCORES]),
                      F.transform("styles", lambda s: (F.col("Learning_Style") == s["style"]).cast("double")))
    wide = profiles.withColumn("_scope", _scope(fit_scope)).join(fit, "_scope").withColumn("features", vector)
    return attach_profiles(people.select("cohort_id", "row_id", *SKILL_KEYS), wide, columns=("features",)).select(
        "cohort_id", "row_id", "features")
