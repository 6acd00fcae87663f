"""The people table: CSV or table in, required columns checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenfold.functions.text import NULL_TOKENS, null_if_token

# The columns every people table must have.
REQUIRED = ("Name", "Gender", "Motivation", "Self_Esteem", "Work_Ethic", "Learning_Style", "Diversity")
SCORES = ("Motivation", "Self_Esteem", "Work_Ethic")
KEYS = ("cohort_id", "row_id")

_BROKEN, _REASON, _FILE = "_broken_record", "_reason", "_file"


def missing_columns(df: DataFrame) -> list[str]:
    return [name for name in REQUIRED if name not in df.columns]


def require_columns(df: DataFrame) -> DataFrame:
    """Fail at once, naming every required column that is absent; extras may stay."""
    absent = missing_columns(df)
    if absent:
        raise ValueError(f"Missing required columns: {absent}")
    return df


def read_people(df: DataFrame, tokens: tuple[str, ...] = NULL_TOKENS) -> DataFrame:
    """People from any DataFrame: columns checked, missing-value text made NULL."""
    require_columns(df)
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            column = null_if_token(column, tokens).alias(field.name)
        columns.append(column)
    return df.select(*columns)


def split_people_csv(
    spark: SparkSession,
    path: str,
    cohort_column: str = "cohort_id",
    row_column: str = "row_id",
    extra_columns: tuple[str, ...] = (),
    columns: tuple[str, ...] | None = None,
    multi_line: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """People from CSV files, and the records that are none: ``file, cohort_key, row_key, record, reason``.

    Every column is read as text, so one bad cell cannot change a column's type; the
    cleaning step turns scores into numbers. A quote inside quotes is written twice, and quoted text may hold separators and
    line ends. The header names the columns, so only the first line is read before the job itself; ``columns`` names
    those of files without a header. A record with more or fewer fields than columns, or with a key that is no
    whole number, is set aside; nothing ends the job. ``multi_line=False`` lets Spark cut large files into splits,
    where a line end inside quotes then breaks its record (both halves are set aside). A missing path raises FileNotFoundError.
    """
    def reader(header: bool):
        return spark.read.option("header", header).option("inferSchema", False).option("quote", '"').option("escape", '"').option(
            "multiLine", multi_line).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)

    try:
        names = list(columns) if columns is not None else reader(True).csv(path).columns
        schema = T.StructType([T.StructField(c, T.StringType()) for c in (*names, _BROKEN)])
        df = reader(columns is None).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BROKEN).schema(schema).csv(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"no people file at {path}") from error
        raise RuntimeError(f"could not read people from {path}: {error}") from error
    wanted = [cohort_column, row_column, *extra_columns]
    absent = [name for name in wanted if name not in names]
    if absent:
        raise ValueError(f"Missing required columns: {absent}")
    require_columns(df)
    keys = [F.trim(F.col(f"`{c}`")).try_cast("bigint") for c in (cohort_column, row_column)]
    reason = F.when(F.col(_BROKEN).isNotNull(), F.lit("wrong number of fields")).when(
        keys[0].isNull(), F.lit(f"{cohort_column} is no whole number")).when(keys[1].isNull(), F.lit(f"{row_column} is no whole number"))
    judged = df.withColumns({_REASON: reason, _FILE: F.col("_metadata.file_path")})
    good = judged.where(F.col(_REASON).isNull()).select(*[F.col(f"`{c}`") for c in names])
    people = read_people(good).withColumns({"cohort_id": keys[0], "row_id": keys[1]})
    record = F.coalesce(F.col(_BROKEN), F.to_csv(F.struct(*[F.col(f"`{c}`") for c in names])))
    rejected = judged.where(F.col(_REASON).isNotNull()).select(
        F.col(_FILE).alias("file"), F.col(f"`{cohort_column}`").alias("cohort_key"), F.col(f"`{row_column}`").alias("row_key"),
        record.alias("record"), F.col(_REASON).alias("reason"))
    return people, rejected


def read_people_csv(spark: SparkSession, path: str, cohort_column: str = "cohort_id", row_column: str = "row_id",
                    extra_columns: tuple[str, ...] = (), columns: tuple[str, ...] | None = None, multi_line: bool = True) -> DataFrame:
    """People from CSV files; ``split_people_csv`` also gives the records that had to be left out."""
    return split_people_csv(spark, path, cohort_column, row_column, extra_columns, columns, multi_line)[0]
