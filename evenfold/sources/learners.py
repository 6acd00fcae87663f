"""People tables derived from the ``customer`` table, as SQL both engines run.

``LEARNERS`` is the base view. ``LEARNERS_DIRTY`` is the same people with scores as text,
missing-value tokens, unreadable and out-of-range scores spread over the cohorts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LEARNERS = """
SELECT c_nationkey AS cohort_id, c_custkey AS row_id, c_name AS Name,
  CASE (c_custkey * 7 + c_nationkey) % 16
    WHEN 0 THEN 'm' WHEN 1 THEN ' F ' WHEN 2 THEN 'MALE' WHEN 3 THEN 'female' WHEN 4 THEN 'Male'
    WHEN 5 THEN 'M' WHEN 6 THEN 'Female' WHEN 7 THEN 'f' WHEN 8 THEN 'Other' WHEN 9 THEN 'male '
    WHEN 10 THEN 'FEMALE' WHEN 11 THEN 'Male' WHEN 12 THEN 'F' WHEN 13 THEN 'Male' WHEN 14 THEN 'm' ELSE 'Female' END AS Gender,
  CAST(1 + CAST(floor(abs(c_acctbal)) AS BIGINT) % 4 AS INT) AS Motivation,
  CAST(1 + CAST(floor(abs(c_acctbal) / 10) AS BIGINT) % 4 AS INT) AS Self_Esteem,
  CAST(1 + CAST(floor(abs(c_acctbal) / 100) AS BIGINT) % 4 AS INT) AS Work_Ethic,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'visual' WHEN 'BUILDING' THEN ' Auditory'
    WHEN 'FURNITURE' THEN 'KINESTHETIC' WHEN 'HOUSEHOLD' THEN 'Visual' ELSE 'auditory ' END AS Learning_Style,
  CASE (c_custkey + CAST(floor(abs(c_acctbal)) AS BIGINT)) % 5 WHEN 0 THEN 'african-american' WHEN 1 THEN 'White american'
    WHEN 2 THEN 'HISPANIC ' WHEN 3 THEN 'asian American' ELSE 'middle eastern and north african' END AS Diversity
FROM customer
"""

LEARNERS_DIRTY = f"""
SELECT cohort_id, row_id, Name,
  CASE WHEN row_id % 131 = 4 THEN ' N/A' ELSE Gender END AS Gender,
  CASE WHEN row_id % 223 = 5 THEN 'high' WHEN row_id % 89 = 7 THEN '5'
       ELSE CAST(Motivation AS VARCHAR(12)) END AS Motivation,
  CASE WHEN row_id % 307 = 11 THEN 'NaN' ELSE CAST(Self_Esteem AS VARCHAR(12)) END AS Self_Esteem,
  CASE WHEN row_id % 151 = 3 THEN '2.5' WHEN row_id % 409 = 8 THEN '0'
       ELSE CAST(Work_Ethic AS VARCHAR(12)) END AS Work_Ethic,
  Learning_Style,
  CASE WHEN row_id % 193 = 9 THEN CAST(NULL AS VARCHAR(40)) ELSE Diversity END AS Diversity
FROM ({LEARNERS}) AS learners
"""


def _from_customer(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return spark.sql(text.replace("FROM customer", "FROM {customer}"), customer=customer)


def learners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_customer(spark, sf_dir, LEARNERS)


def learners_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_customer(spark, sf_dir, LEARNERS_DIRTY)
