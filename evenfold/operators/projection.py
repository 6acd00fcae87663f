"""Two principal components per cohort, from the covariance of the profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A matrix squared so often is its own 2**30th power: only the leading axis is left of it.
SQUARINGS = 30


def feature_covariance(profiles: DataFrame) -> DataFrame:
    """``cohort_id, i, j, value``: sample covariance of the features over people."""
    columns = F.col("features")
    size = F.size("features")
    cells = profiles.select(
        "cohort_id", "weight",
        F.explode(F.flatten(F.transform(
            F.sequence(F.lit(0), size - 1),
            lambda i: F.transform(F.sequence(F.lit(0), size - 1), lambda j: F.struct(
                i.alias("i"), j.alias("j"), F.get(columns, i).alias("x"), F.get(columns, j).alias("y")))))).alias("_c"))
    w, x, y = F.col("weight"), F.col("_c.x"), F.col("_c.y")
    sums = cells.groupBy("cohort_id", F.col("_c.i").alias("i"), F.col("_c.j").alias("j")).agg(
        F.sum(w).alias("_n"), F.sum(w * x).alias("_x"), F.sum(w * y).alias("_y"), F.sum(w * x * y).alias("_xy"))
    n = F.col("_n")
    value = (F.col("_xy") - F.col("_x") * F.col("_y") / n) / F.nullif(n - 1, F.lit(0))
    return sums.select("cohort_id", "i", "j", F.coalesce(value, F.lit(0.0)).alias("value"))


def covariance_matrix(profiles: DataFrame) -> DataFrame:
    """``cohort_id, m``: the covariance as an array of rows; its size depends on the number of learning styles, not on people."""
    rows = feature_covariance(profiles).groupBy("cohort_id", "i").agg(F.array_sort(F.collect_list(F.struct("j", "value"))).alias("_row"))
    rows = rows.select("cohort_id", "i", F.transform("_row", lambda c: c["value"]).alias("_row"))
    return rows.groupBy("cohort_id").agg(F.array_sort(F.collect_list(F.struct("i", "_row"))).alias("_m")).select(
        "cohort_id", F.transform("_m", lambda r: r["_row"]).alias("m"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def _dot(x: Column, y: Column) -> Column:
    return _sum(F.zip_with(x, y, lambda a, b: a * b))


def _trace(m: Column) -> Column:
    return _sum(F.transform(m, lambda row, i: F.get(row, i)))


def _scaled(m: Column) -> Column:
    """The matrix with trace 1; all zero stays so."""
    size = _trace(m)
    return F.transform(m, lambda row: F.transform(row, lambda x: F.coalesce(x / F.nullif(size, F.lit(0.0)), F.lit(0.0))))


def _square(m: Column) -> Column:
    # Of a symmetric matrix: entry (i, j) is the product of rows i and j.
    return F.transform(m, lambda row: F.transform(m, lambda other: _dot(row, other)))


def leading_axis(m: Column) -> Column:
    """The eigenvector of the largest eigenvalue of a symmetric matrix without negative ones, largest loading positive.

    Powers of the matrix, kept at trace 1, tend to the projection on that axis. Its column with the largest diagonal entry,
    scaled to unit length, is the axis. A zero matrix has a zero axis.
    """
    power = F.aggregate(F.sequence(F.lit(1), F.lit(SQUARINGS)), _scaled(m), lambda p, _: _scaled(_square(p)))
    diagonal = F.transform(power, lambda row, i: F.struct(F.get(row, i).alias("x"), (-i).alias("at"), row.alias("row")))
    column = F.array_max(diagonal)["row"]
    return F.transform(column, lambda x: F.coalesce(x / F.nullif(F.sqrt(_dot(column, column)), F.lit(0.0)), F.lit(0.0)))


def principal_axes(profiles: DataFrame) -> DataFrame:
    """``cohort_id, component, axis, explained``: the two axes of largest variance, and their share of it."""
    first = covariance_matrix(profiles).withColumn("a1", leading_axis(F.col("m")))
    value = lambda axis: _dot(F.transform("m", lambda row: _dot(row, F.col(axis))), F.col(axis))
    first = first.withColumn("v1", value("a1"))
    rest = F.transform("m", lambda row, i: F.zip_with(row, F.col("a1"), lambda x, y: x - F.col("v1") * F.get(F.col("a1"), i) * y))
    second = first.withColumn("rest", rest).withColumn("a2", leading_axis(F.col("rest"))).withColumn("v2", value("a2"))
    share = lambda v: F.coalesce(F.col(v) / F.nullif(_trace(F.col("m")), F.lit(0.0)), F.lit(0.0))
    both = second.select("cohort_id", F.posexplode(F.array(
        F.struct(F.col("a1").alias("axis"), share("v1").alias("explained")),
        F.struct(F.col("a2").alias("axis"), share("v2").alias("explained")))).alias("component", "_c"))
    return both.select("cohort_id", "component", "_c.axis", "_c.explained")


def project_2d(points: DataFrame, axes: DataFrame, vector: str = "features") -> DataFrame:
    """``points`` plus ``pc1, pc2``; features are centred already."""
    both = axes.groupBy("cohort_id").agg(
        F.max(F.when(F.col("component") == 0, F.col("axis"))).alias("_a1"),
        F.max(F.when(F.col("component") == 1, F.col("axis"))).alias("_a2"))

    return points.join(both, "cohort_id").withColumns(
        {pc: _dot(F.col(vector), F.col(axis)) for pc, axis in (("pc1", "_a1"), ("pc2", "_a2"))}).drop("_a1", "_a2")
