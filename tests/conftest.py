from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from evenfold.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.log.level": "ERROR",
    })
    yield session
    session.stop()


@pytest.fixture
def people(spark):
    """Build people from (row_id, gender, three scores, style, diversity) of one cohort."""
    def build(rows, cohort: int = 1):
        data = [(cohort, r[0], f"P{r[0]:03d}", *r[1:]) for r in rows]
        return spark.createDataFrame(
            data, "cohort_id bigint, row_id bigint, Name string, Gender string, Motivation double, "
                  "Self_Esteem double, Work_Ethic double, Learning_Style string, Diversity string")
    return build


def plain(n: int, gender: str = "Male", start: int = 0):
    return [(start + i, gender, 1.0 + i % 4, 1.0 + i // 4 % 4, 2.0, "Visual", "Hispanic") for i in range(n)]
