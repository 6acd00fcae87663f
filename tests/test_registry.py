from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import oracle_queries
import query_catalog
from tests.conftest import SMALL

QUERIES, SQL = query_catalog.QUERIES, oracle_queries.oracle_sql()
# A sample over all kinds of queries, to keep the run short.
SAMPLE = ("validate_people", "normalize_dirty_people", "missing_values", "pairwise_gower", "evaluate_clustering",
          "medoid_swap_deltas", "enforce_group_size", "best_swaps", "fix_gender_isolation", "generate_groups",
          "load_people_broken", "pca_squares", "pca_centroids", "kmedoids_gower", "kmedoids_given_distances", "silhouette_given_distances",
          "kmeans_vectors", "separation_vectors")


def test_every_query_has_sql_but_the_projection():
    assert set(QUERIES) - set(SQL) == {"pca_2d"}
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_its_sql(spark, name):
    db = duckdb.connect()
    for file in Path(SMALL).glob("*.parquet"):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    df = QUERIES[name](spark, SMALL)
    result = db.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)

    def comparable(rows):
        return sorted((tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows), key=repr)

    assert comparable(map(tuple, df.select(*columns).collect())) == comparable(result.fetchall())
