"""The registered queries on Spark: one callable (spark, sf_dir) -> DataFrame per operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenfold.operators import balance, locking, lloyd, medoids, projection, quality, seeding, separation, sizing, vectors
from evenfold.operators.distances import profile_distances
from evenfold.operators.joins import join_by_weight, pair_within, prefixed
from evenfold.operators.normalize import normalize_people
from evenfold.operators.profiles import FULL_KEYS, assemble, encode, features
from evenfold.operators.ranking import rank_in_cohort
from evenfold.plans import evaluate
from evenfold.plans.balanced import form_balanced_groups
from evenfold.plans.cohorts import Cohorts, clean, label_people, prepare
from evenfold.plans.compare import compare_metrics
from evenfold.plans.generate import generate_groups
from evenfold.plans.report import group_assignments, report_lines
from evenfold.plans.tournament import tournament
from evenfold.session import checkpoint, shared_dir
from evenfold.sources.learners import learners, learners_dirty
from evenfold.sources.people import read_people, read_people_csv, split_people_csv

SIZE = 10
N_GROUPS = 5
VECTOR_GROUPS = 6

Query = Callable[[SparkSession, str], DataFrame]


def r6(value: Column | str) -> Column:
    """Six decimals, and no negative zero."""
    return F.round(value, 6) + F.lit(0.0)


def long_vector(df: DataFrame, keys: list[str], vector: str, name: str) -> DataFrame:
    return df.select(*keys, F.posexplode(vector).alias("pos", name))


# --- labellings that depend on no round loop ------------------------------------------------

def _people(spark: SparkSession, sf: str) -> DataFrame:
    return clean(learners(spark, sf))


def _cohorts(spark: SparkSession, sf: str) -> Cohorts:
    return prepare(learners(spark, sf))


def _fixed(cohorts: Cohorts, kind: str) -> DataFrame:
    """``stripe``: dealt to max(2, n div 10) groups in row order. ``chunk``: every five rows."""
    ranked = rank_in_cohort(cohorts.people, ["row_id"])
    if kind == "chunk":
        return balance.as_run(ranked.withColumn("group_id", F.floor((F.col("rn") - 1) / 5).cast("int")).drop("rn"), kind)
    sizes = cohorts.people.groupBy("cohort_id").agg(F.count(F.lit(1)).alias("_n"))
    k = F.greatest(F.lit(2), F.floor(F.col("_n") / SIZE))
    dealt = join_by_weight(ranked, sizes, ["cohort_id"], "_n")
    return balance.as_run(dealt.withColumn("group_id", F.pmod(F.col("rn") - 1, k).cast("int")).drop("rn", "_n"), kind)


def _stripe(spark: SparkSession, sf: str) -> tuple[DataFrame, Cohorts]:
    cohorts = _cohorts(spark, sf)
    return _fixed(cohorts, "stripe"), cohorts


def _chunk(spark: SparkSession, sf: str) -> tuple[DataFrame, Cohorts]:
    cohorts = _cohorts(spark, sf)
    return _fixed(cohorts, "chunk"), cohorts


def _both(spark: SparkSession, sf: str) -> tuple[DataFrame, Cohorts]:
    cohorts = _cohorts(spark, sf)
    return _fixed(cohorts, "stripe").unionByName(_fixed(cohorts, "chunk")), cohorts


def _slots(cohorts: Cohorts, keys=None) -> DataFrame:
    config = seeding.group_config(cohorts.people, SIZE)
    return checkpoint(seeding.init_medoids(cohorts.people, cohorts.profiles, config, keys or cohorts.keys))


def _row_labels(cohorts: Cohorts, labels: DataFrame, name: str = "label") -> DataFrame:
    return label_people(cohorts, labels).select("cohort_id", "row_id", F.col("label").alias(name))


def _started(spark: SparkSession, sf: str) -> tuple[DataFrame, Cohorts]:
    """People labelled with their nearest first centre."""
    cohorts = _cohorts(spark, sf)
    start = lloyd.start_centroids(cohorts.profiles, _slots(cohorts))
    labels = checkpoint(lloyd.assign(cohorts.profiles, start, "manhattan"))
    return label_people(cohorts, labels), cohorts


# --- sources, quality, cleaning -------------------------------------------------------------

def load_people(spark: SparkSession, sf: str) -> DataFrame:
    """The dirty people written as CSV to the shared folder and read back."""
    path = f"{shared_dir(spark)}/people-{uuid.uuid4().hex}"
    learners_dirty(spark, sf).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(path)
    return read_people_csv(spark, path)


def load_broken(spark: SparkSession, sf: str) -> DataFrame:
    """Hand-made CSV lines with quotes, line ends, bad keys and wrong numbers of fields: kept people and rejected records."""
    names = ("cohort_id", "row_id", "Name", "Gender", "Motivation", "Self_Esteem", "Work_Ethic", "Learning_Style", "Diversity")
    row = F.col("row_id")
    name = F.when(row % 13 == 5, F.concat(F.lit('"Ann ""A"", '), "Name", F.lit('"'))).when(
        row % 23 == 6, F.concat(F.lit('"two\n'), "Name", F.lit('"'))).otherwise(F.col("Name"))
    key = F.when(row % 17 == 3, F.lit("abc")).otherwise(F.col("cohort_id").cast("string"))
    rest = F.concat_ws(",", *[F.coalesce(F.col(c), F.lit("")) for c in names[3:]])
    line = F.when(row % 19 == 4, F.concat_ws(",", key, row.cast("string"), name)).when(
        row % 29 == 7, F.concat_ws(",", key, row.cast("string"), name, rest, F.lit("more"))).otherwise(
        F.concat_ws(",", key, row.cast("string"), name, rest))
    path = f"{shared_dir(spark)}/people-{uuid.uuid4().hex}"
    learners_dirty(spark, sf).select(line.alias("value")).write.text(path)
    people, rejected = split_people_csv(spark, path, columns=names)
    kept = people.select("cohort_id", "row_id", "Name", "Diversity", F.lit(None).cast("string").alias("reason"))
    bad = rejected.select(F.expr("try_cast(cohort_key AS BIGINT)").alias("cohort_id"), F.col("row_key").cast("bigint").alias("row_id"),
                          F.lit(None).cast("string").alias("Name"), F.lit(None).cast("string").alias("Diversity"), "reason")
    return kept.unionByName(bad)


def validate(spark: SparkSession, sf: str) -> DataFrame:
    verdicts = quality.validate_people(read_people(learners_dirty(spark, sf)))
    return verdicts.withColumn("errors", F.array_join("errors", " | "))


def missing(spark: SparkSession, sf: str) -> DataFrame:
    return quality.missing_values(read_people(learners_dirty(spark, sf)))


def quarantined(spark: SparkSession, sf: str) -> DataFrame:
    _, quarantine = quality.split_usable(clean(learners_dirty(spark, sf)))
    return quarantine.select("cohort_id", "row_id", "reason")


def normalize(spark: SparkSession, sf: str) -> DataFrame:
    return normalize_people(learners(spark, sf))


def normalize_dirty(spark: SparkSession, sf: str) -> DataFrame:
    return clean(learners_dirty(spark, sf))


# --- features and distances -----------------------------------------------------------------

def raw_features(spark: SparkSession, sf: str) -> DataFrame:
    return long_vector(assemble(_people(spark, sf)), ["cohort_id", "row_id"], "features", "value")


def standardize(spark: SparkSession, sf: str) -> DataFrame:
    both = features(_people(spark, sf)).select("cohort_id", "row_id", F.arrays_zip("features", "features_q").alias("f"))
    return both.select("cohort_id", "row_id", F.posexplode("f").alias("pos", "f")).select(
        "cohort_id", "row_id", "pos", r6("f.features").alias("z"), F.col("f.features_q").alias("q"))


def pairwise(metric: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        people = _people(spark, sf)
        profiles = encode(people, FULL_KEYS) if metric == "gower" else encode(people)
        return profile_distances(profiles, metric)
    return query


def covariance(spark: SparkSession, sf: str) -> DataFrame:
    return projection.feature_covariance(encode(_people(spark, sf))).select("cohort_id", "i", "j", r6("value").alias("value"))


def pca_2d(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles on their cohort's two principal axes, with the share of variance shown."""
    profiles = encode(_people(spark, sf))
    axes = projection.principal_axes(profiles)
    shown = axes.groupBy("cohort_id").agg(F.sum("explained").alias("explained"))
    return projection.project_2d(profiles, axes).join(shown, "cohort_id").select(
        "cohort_id", "profile_id", "weight", r6("pc1").alias("pc1"), r6("pc2").alias("pc2"), r6("explained").alias("explained"))


def _squares(points: DataFrame, axes: DataFrame, vector: str, *columns: str) -> DataFrame:
    """Squared positions on both axes, which no choice of signs changes."""
    return projection.project_2d(points, axes, vector).select(
        "cohort_id", *columns, *[r6(F.col(pc) * F.col(pc)).alias(f"{pc}_squared") for pc in ("pc1", "pc2")])


def pca_squares(spark: SparkSession, sf: str) -> DataFrame:
    profiles = encode(_people(spark, sf))
    axes = checkpoint(projection.principal_axes(profiles))
    shown = axes.groupBy("cohort_id").agg(r6(F.sum("explained")).alias("explained"))
    return _squares(profiles, axes, "features", "profile_id", "weight").join(shown, "cohort_id")


def pca_centroids(spark: SparkSession, sf: str) -> DataFrame:
    """The centroids of the groups on the axes of their cohort."""
    labelled, cohorts = _stripe(spark, sf)
    centers = separation.label_centroids(separation.group_profiles(labelled), cohorts.profiles)
    return _squares(centers, projection.principal_axes(cohorts.profiles), "centroid", "group_id", "people")


# --- scores of fixed labellings -------------------------------------------------------------

def sizes(spark: SparkSession, sf: str) -> DataFrame:
    return balance.cluster_sizes(_stripe(spark, sf)[0]).drop("run")


def breakdown(column: str) -> Query:
    return lambda spark, sf: balance.breakdown(_stripe(spark, sf)[0], column).drop("run")


def entropy(spark: SparkSession, sf: str) -> DataFrame:
    out = balance.cluster_entropy(_stripe(spark, sf)[0])
    return out.select("cohort_id", "group_id", "size", r6("gender_entropy").alias("gender_entropy"),
                      r6("diversity_entropy").alias("diversity_entropy"))


def summary(spark: SparkSession, sf: str) -> DataFrame:
    labelled, _ = _stripe(spark, sf)
    mean = balance.mean_entropy(balance.cluster_entropy(labelled))
    return separation.run_summary(separation.group_profiles(labelled)).join(mean, ["run", "cohort_id"]).select(
        "cohort_id", "n_samples", "n_clusters", r6("mean_gender_entropy").alias("mean_gender_entropy"))


def silhouette(metric: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        labelled, cohorts = _stripe(spark, sf)
        if metric == "gower":
            cells, profiles = evaluate.gower_cells(labelled)
        else:
            cells, profiles = separation.group_profiles(labelled), cohorts.profiles
        return separation.silhouette(cells, profiles, metric).select("cohort_id", r6("silhouette").alias("silhouette"))
    return query


def cell_score(score: Callable[[DataFrame, DataFrame], DataFrame], name: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        labelled, cohorts = _stripe(spark, sf)
        return score(separation.group_profiles(labelled), cohorts.profiles).select("cohort_id", r6(name).alias(name))
    return query


_SCORES = ("silhouette", "davies_bouldin", "calinski_harabasz", "mean_gender_entropy")


def _rounded_scores(scores: DataFrame) -> DataFrame:
    return scores.select("run", "cohort_id", "n_samples", "n_clusters", *[r6(s).alias(s) for s in _SCORES])


def evaluate_both(spark: SparkSession, sf: str) -> DataFrame:
    labelled, cohorts = _both(spark, sf)
    return _rounded_scores(evaluate.evaluate_runs(labelled, cohorts.profiles))


def best_run(spark: SparkSession, sf: str) -> DataFrame:
    labelled, cohorts = _both(spark, sf)
    scores = separation.silhouette(separation.group_profiles(labelled), cohorts.profiles)
    return evaluate.best_run(scores).withColumn("best_silhouette", r6("best_silhouette"))


def rating_bands(spark: SparkSession, sf: str) -> DataFrame:
    labelled, cohorts = _both(spark, sf)
    variance = balance.skill_variance_overall(labelled).select(
        "run", "cohort_id", F.col("overall_mean_variance_nonsingleton").alias("mean_skill_variance"))
    cells = separation.group_profiles(labelled)
    scores = separation.silhouette(cells, cohorts.profiles).join(
        separation.davies_bouldin(cells, cohorts.profiles), ["run", "cohort_id"]).join(variance, ["run", "cohort_id"])
    return evaluate.rating_bands(scores).select(
        "run", "cohort_id", "silhouette_band", "davies_bouldin_band", "mean_skill_variance_band")


def variance_by_cluster(spark: SparkSession, sf: str) -> DataFrame:
    out = balance.skill_variance_by_cluster(_chunk(spark, sf)[0])
    names = [*balance.SKILLS.values(), "mean_skill_variance"]
    return out.select("cohort_id", "group_id", *[r6(n).alias(n) for n in names])


def variance_overall(spark: SparkSession, sf: str) -> DataFrame:
    out = balance.skill_variance_overall(_both(spark, sf)[0])
    names = ["overall_mean_variance", "overall_std_variance", "overall_mean_variance_nonsingleton"]
    return out.select("run", "cohort_id", *[r6(n).alias(n) for n in names])


def cluster_balance(spark: SparkSession, sf: str) -> DataFrame:
    out = balance.cluster_balance(_both(spark, sf)[0])
    return out.select("run", "cohort_id", "group_id", "size", *[
        r6(n).alias(n) for n in ("gender_entropy", "diversity_entropy", "mean_skill_variance")])


def members(spark: SparkSession, sf: str) -> DataFrame:
    return balance.group_members(_stripe(spark, sf)[0])


def label_centroids(spark: SparkSession, sf: str) -> DataFrame:
    labelled, cohorts = _stripe(spark, sf)
    centers = separation.label_centroids(separation.group_profiles(labelled), cohorts.profiles)
    return long_vector(centers, ["cohort_id", "group_id", "people"], "centroid", "value").withColumn("value", r6("value"))


# --- isolation ------------------------------------------------------------------------------

def gender_isolation(spark: SparkSession, sf: str) -> DataFrame:
    return locking.gender_isolation(_chunk(spark, sf)[0])


def diversity_isolation(spark: SparkSession, sf: str) -> DataFrame:
    return locking.diversity_isolation(_chunk(spark, sf)[0])


def swap_donors(spark: SparkSession, sf: str) -> DataFrame:
    """Groups that can give a woman or a man, and how many of them they hold."""
    cells = locking.donor_cells(_chunk(spark, sf)[0], locking.gender_rule()).where("trait IN ('Female', 'Male')")
    return cells.select("cohort_id", "group_id", F.col("trait").alias("Gender"), "held").distinct()


def best_swaps(spark: SparkSession, sf: str) -> DataFrame:
    labelled, cohorts = _chunk(spark, sf)
    rule = locking.gender_rule()
    pending = rule.flag(labelled).select("cohort_id", F.col("group_id").alias("flagged"), "wanted", "given")
    return locking.best_swaps(labelled, pending, cohorts.profiles, rule).withColumnRenamed("flagged", "group_id")


def _fixed_genders(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    labelled, cohorts = _chunk(spark, sf)
    return locking.fix_gender_isolation(labelled, cohorts.profiles)


def fix_gender_isolation(spark: SparkSession, sf: str) -> DataFrame:
    return _fixed_genders(spark, sf)[0].select("cohort_id", "row_id", "group_id")


def swap_log(spark: SparkSession, sf: str) -> DataFrame:
    return _fixed_genders(spark, sf)[1]


def fix_diversity_isolation(spark: SparkSession, sf: str) -> DataFrame:
    labelled, cohorts = _chunk(spark, sf)
    return locking.fix_diversity_isolation(labelled, cohorts.profiles)[0].select("cohort_id", "row_id", "group_id")


# --- clustering -----------------------------------------------------------------------------

def group_config(spark: SparkSession, sf: str) -> DataFrame:
    people = _people(spark, sf)
    evaluated = seeding.group_config(people, SIZE, "evaluate").select("cohort_id", F.col("k").alias("k_evaluate"))
    return seeding.group_config(people, SIZE).join(evaluated, "cohort_id")


def init_slots(spark: SparkSession, sf: str) -> DataFrame:
    people = _people(spark, sf)
    return seeding.init_slots(people, seeding.group_config(people, SIZE))


def assign(metric: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        cohorts = _cohorts(spark, sf)
        start = lloyd.start_centroids(cohorts.profiles, _slots(cohorts))
        return _row_labels(cohorts, lloyd.assign(cohorts.profiles, start, metric), "slot")
    return query


def centroid_update(spark: SparkSession, sf: str) -> DataFrame:
    cohorts = _cohorts(spark, sf)
    start = lloyd.start_centroids(cohorts.profiles, _slots(cohorts))
    moved = lloyd.update(cohorts.profiles, lloyd.assign(cohorts.profiles, start, "euclidean"), start)
    return long_vector(moved, ["cohort_id", "slot"], "centroid", "centroid_q")


def _embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """All embeddings as one cohort, under the group they are labelled with."""
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(
        F.lit("label").alias("run"), F.lit(0).cast("bigint").alias("cohort_id"), F.col("vec_id").alias("row_id"),
        F.col("label").alias("group_id"), F.col("embedding").alias("vector"))


def kmeans_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.kmeans_vectors(_embeddings(spark, sf), VECTOR_GROUPS)[0]


def separation_vectors(spark: SparkSession, sf: str) -> DataFrame:
    found = vectors.separation_vectors(_embeddings(spark, sf))
    return found.select("run", "cohort_id", "n_samples", "n_clusters", *[r6(s).alias(s) for s in _SCORES[:3]])


def kmeans(metric: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        cohorts = prepare(learners(spark, sf))
        labels, _ = lloyd.kmeans(cohorts.profiles, _slots(cohorts), metric)
        return _row_labels(cohorts, labels)
    return query


def medoid_assign(spark: SparkSession, sf: str) -> DataFrame:
    cohorts = _cohorts(spark, sf)
    near = medoids.medoid_assign(cohorts.profiles, _slots(cohorts), "manhattan")
    small = near.withColumnRenamed("weight", "_w")
    return join_by_weight(cohorts.people, small, ["cohort_id", "profile_id"], "_w").select(
        "cohort_id", "row_id", "slot", "dist")


def medoid_cost(spark: SparkSession, sf: str) -> DataFrame:
    cohorts = _cohorts(spark, sf)
    return medoids.medoid_cost(medoids.medoid_assign(cohorts.profiles, _slots(cohorts), "manhattan"))


def swap_deltas(spark: SparkSession, sf: str) -> DataFrame:
    cohorts = _cohorts(spark, sf)
    return medoids.swap_deltas(cohorts.profiles, _slots(cohorts), "manhattan")


def kmedoids(metric: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        keys = FULL_KEYS if metric == "gower" else None
        cohorts = prepare(learners(spark, sf), keys) if keys else prepare(learners(spark, sf))
        labels, _ = medoids.kmedoids(cohorts.profiles, _slots(cohorts), metric)
        return _row_labels(cohorts, labels)
    return query


def no_improving_swap(spark: SparkSession, sf: str) -> DataFrame:
    """Swaps that would still lower the cost of the final medoids."""
    cohorts = prepare(learners(spark, sf))
    _, final = medoids.kmedoids(cohorts.profiles, _slots(cohorts), "manhattan")
    return medoids.swap_deltas(cohorts.profiles, final, "manhattan").where("delta < 0")


def _given(people: DataFrame) -> DataFrame:
    """A table of distances as it might come from elsewhere: each pair of a cohort's people once."""
    sides = people.select("cohort_id", "row_id", "Motivation", "Gender", "Diversity").join(
        people.groupBy("cohort_id").agg(F.count(F.lit(1)).alias("_n")), "cohort_id")
    # Without the hint a small right side is broadcast, and the pairs are made in as many tasks as people were read in, which may be one.
    left = prefixed(sides, "a_", keep=("cohort_id", "_n")).hint("shuffle_hash")
    pairs = pair_within(left, prefixed(sides, "b_", keep=("cohort_id", "_n")),
                        ["cohort_id"], ["a_row_id"], "_n").where("a_row_id < b_row_id")
    apart = lambda c, cost: F.when(F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), 0).otherwise(cost)
    dist = F.abs(F.col("a_Motivation") - F.col("b_Motivation")).cast("bigint") * 1_000_000 + apart("Gender", 700_000) + apart(
        "Diversity", 300_000) + (F.col("a_row_id") + F.col("b_row_id")) % 97 * 1_000
    return pairs.select("cohort_id", F.col("a_row_id").alias("id_a"), F.col("b_row_id").alias("id_b"), dist.cast("bigint").alias("dist"))


def kmedoids_given(spark: SparkSession, sf: str) -> DataFrame:
    people = checkpoint(_people(spark, sf))
    slots = seeding.init_slots(people, seeding.group_config(people, SIZE))
    labels, _ = medoids.kmedoids_given(_given(people), slots)
    return labels.select("cohort_id", "row_id", F.col("slot").alias("label"))


def silhouette_given(spark: SparkSession, sf: str) -> DataFrame:
    labelled, cohorts = _both(spark, sf)
    found = separation.silhouette_given(labelled, _given(cohorts.people))
    return found.select("run", "cohort_id", r6("silhouette").alias("silhouette"))


# --- sizes ----------------------------------------------------------------------------------

def core_groups(spark: SparkSession, sf: str) -> DataFrame:
    labelled, _ = _started(spark, sf)
    return sizing.core_groups(labelled, SIZE).select("cohort_id", "row_id", "rn", "n_groups", "group_id")


def group_centers(spark: SparkSession, sf: str) -> DataFrame:
    labelled, cohorts = _started(spark, sf)
    centers = sizing.group_centers(sizing.core_groups(labelled, SIZE), cohorts.profiles)
    return long_vector(centers, ["cohort_id", "group_id"], "mean_q", "centroid_q")


def smart_fill(spark: SparkSession, sf: str) -> DataFrame:
    labelled, cohorts = _started(spark, sf)
    return sizing.smart_fill(sizing.core_groups(labelled, SIZE), cohorts.profiles).select("cohort_id", "row_id", "group_id")


def round_robin_fill(spark: SparkSession, sf: str) -> DataFrame:
    labelled, _ = _started(spark, sf)
    return sizing.round_robin_fill(sizing.core_groups(labelled, SIZE), SIZE).select("cohort_id", "row_id", "group_id")


def enforce_group_size(spark: SparkSession, sf: str) -> DataFrame:
    labelled, cohorts = _started(spark, sf)
    return sizing.enforce_group_size(labelled, SIZE, cohorts.profiles).select("cohort_id", "row_id", "group_id")


# --- reports and pipelines ------------------------------------------------------------------

def assignments(spark: SparkSession, sf: str) -> DataFrame:
    return group_assignments(_chunk(spark, sf)[0])


def report(spark: SparkSession, sf: str) -> DataFrame:
    return report_lines(group_assignments(_chunk(spark, sf)[0]))


def generate(spark: SparkSession, sf: str) -> DataFrame:
    return generate_groups(learners(spark, sf), SIZE).assignments


def comparison(spark: SparkSession, sf: str) -> DataFrame:
    return tournament(learners(spark, sf), SIZE).table


def tournament_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded_scores(tournament(learners(spark, sf), SIZE).scores)


def balanced(spark: SparkSession, sf: str) -> DataFrame:
    grouped, _ = form_balanced_groups(learners(spark, sf), N_GROUPS)
    return grouped.select("cohort_id", "row_id", "Name", "Group")


def compare(spark: SparkSession, sf: str) -> DataFrame:
    return compare_metrics(learners(spark, sf), N_GROUPS, group_size=SIZE)


QUERIES: dict[str, Query] = {
    "load_people": load_people,
    "load_people_broken": load_broken,
    "validate_people": validate,
    "missing_values": missing,
    "quarantined_people": quarantined,
    "normalize_people": normalize,
    "normalize_dirty_people": normalize_dirty,
    "features": raw_features,
    "standardize": standardize,
    "pairwise_manhattan": pairwise("manhattan"),
    "pairwise_euclidean": pairwise("euclidean"),
    "pairwise_gower": pairwise("gower"),
    "feature_covariance": covariance,
    "pca_2d": pca_2d,
    "pca_squares": pca_squares,
    "pca_centroids": pca_centroids,
    "cluster_sizes": sizes,
    "gender_breakdown": breakdown("Gender"),
    "diversity_breakdown": breakdown("Diversity"),
    "cluster_entropy": entropy,
    "run_summary": summary,
    "silhouette_euclidean": silhouette("euclidean"),
    "silhouette_gower": silhouette("gower"),
    "davies_bouldin": cell_score(separation.davies_bouldin, "davies_bouldin"),
    "calinski_harabasz": cell_score(separation.calinski_harabasz, "calinski_harabasz"),
    "evaluate_clustering": evaluate_both,
    "best_run": best_run,
    "rating_bands": rating_bands,
    "skill_variance_by_cluster": variance_by_cluster,
    "skill_variance_overall": variance_overall,
    "cluster_balance": cluster_balance,
    "group_members": members,
    "label_centroids": label_centroids,
    "gender_isolation": gender_isolation,
    "diversity_isolation": diversity_isolation,
    "swap_donors": swap_donors,
    "best_swaps": best_swaps,
    "fix_gender_isolation": fix_gender_isolation,
    "swap_log": swap_log,
    "fix_diversity_isolation": fix_diversity_isolation,
    "group_config": group_config,
    "init_slots": init_slots,
    "assign_euclidean": assign("euclidean"),
    "assign_manhattan": assign("manhattan"),
    "centroid_update": centroid_update,
    "kmeans_euclidean": kmeans("euclidean"),
    "kmeans_manhattan": kmeans("manhattan"),
    "kmeans_vectors": kmeans_vectors,
    "separation_vectors": separation_vectors,
    "medoid_assign": medoid_assign,
    "medoid_cost": medoid_cost,
    "medoid_swap_deltas": swap_deltas,
    "kmedoids_manhattan": kmedoids("manhattan"),
    "kmedoids_gower": kmedoids("gower"),
    "kmedoids_no_improving_swap": no_improving_swap,
    "kmedoids_given_distances": kmedoids_given,
    "silhouette_given_distances": silhouette_given,
    "core_groups": core_groups,
    "group_centers": group_centers,
    "smart_fill": smart_fill,
    "round_robin_fill": round_robin_fill,
    "enforce_group_size": enforce_group_size,
    "group_assignments": assignments,
    "group_report_lines": report,
    "generate_groups": generate,
    "comparison_table": comparison,
    "tournament_scores": tournament_scores,
    "form_balanced_groups": balanced,
    "compare_metrics": compare,
}
