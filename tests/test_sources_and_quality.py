from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evenfold.functions.text import title_case
from evenfold.operators.normalize import normalize_people
from evenfold.operators.quality import missing_values, split_usable, validate_people
from evenfold.sources.people import read_people, read_people_csv, require_columns, split_people_csv
from evenfold.sources.sinks import write_comparison
from tests.conftest import plain


def test_csv_is_read_as_text_with_missing_tokens(spark, tmp_path):
    file = tmp_path / "people.csv"
    file.write_text(
        "cohort_id,row_id,Name,Gender,Motivation,Self_Esteem,Work_Ethic,Learning_Style,Diversity,Extra\n"
        "1,0,Ann, f ,3,N/A,2,visual,asian american,x\n1,1,Bob,M,high,4,,Auditory,None,y\n")
    rows = {r.row_id: r for r in read_people_csv(spark, str(file)).collect()}
    assert rows[0].Gender == " f " and rows[0].Self_Esteem is None and rows[0].Extra == "x"
    assert rows[1].Motivation == "high" and rows[1].Work_Ethic is None and rows[1].Diversity is None


def test_missing_file_and_columns_fail(spark, people, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_people_csv(spark, str(tmp_path / "nowhere.csv"))
    with pytest.raises(ValueError, match="Gender.*Diversity"):
        require_columns(people(plain(1)).drop("Gender", "Diversity"))


def test_cleaning(spark, people):
    df = people([(0, " m ", 1.0, 1.0, 1.0, " KINESTHETIC", "african-american"),
                 (1, "fEMALE", 1.0, 1.0, 1.0, "vISUAL ", "o'neil  group"),
                 (2, "other", 1.0, 1.0, 1.0, "visual", None)])
    rows = [(r.Gender, r.Learning_Style, r.Diversity) for r in normalize_people(df).orderBy("row_id").collect()]
    assert rows == [("Male", "Kinesthetic", "African-American"), ("Female", "Visual", "O'Neil  Group"),
                    ("Other", "Visual", None)]


def test_title_case_of_empty_text(spark):
    assert spark.range(1).select(title_case(F.lit(""))).first()[0] == ""


def test_range_rule(spark, people):
    def errors(value):
        return validate_people(people([(0, "Male", value, 1.0, 1.0, "Visual", "X")])).first()

    assert errors(2.5).is_valid
    for bad in (0.0, 5.0):
        assert errors(bad).errors == ["Motivation contains values outside the 1–4 range."]
    assert errors(None).errors == ["Motivation contains values outside the 1–4 range.", "Data contains missing values."]


def test_text_score_is_reported_once(spark, people):
    df = people(plain(2)).withColumn("Work_Ethic", F.when(F.col("row_id") == 0, "high").otherwise("9"))
    assert validate_people(df).first().errors == ["Work_Ethic must be numeric."]


def test_absent_column_is_reported_and_skipped(people):
    out = validate_people(people(plain(2)).drop("Work_Ethic")).first()
    assert not out.is_valid and out.errors == ["Missing columns: ['Work_Ethic']"]


def test_missing_values_and_quarantine(people):
    df = read_people(people([(0, None, None, 1.0, 1.0, None, "X"), (1, None, 1.0, 1.0, 1.0, "Visual", None)]))
    found = sorted((r["row_id"], r["column"]) for r in missing_values(df).collect())
    assert found == [(0, "Gender"), (0, "Learning_Style"), (0, "Motivation"), (1, "Diversity"), (1, "Gender")]
    usable, rest = split_usable(df)
    assert [r.row_id for r in usable.collect()] == [1]
    assert rest.first().reason == "Motivation is missing; Learning_Style is missing"
    with pytest.raises(ValueError, match="without features"):
        split_usable(df, strict=True)


def test_nobody_is_lost(people):
    from evenfold.operators.quality import split_usable
    from evenfold.plans.cohorts import clean
    from evenfold.plans.generate import generate_groups

    sound = people(plain(9))
    lost = sound.limit(1).selectExpr("CAST(NULL AS BIGINT) AS cohort_id", *sound.columns[1:])
    everybody = sound.unionByName(lost).unionByName(sound.where("row_id = 3"))
    usable, quarantine = split_usable(clean(everybody))
    assert usable.count() + quarantine.count() == everybody.count() == 11
    assert {r.reason for r in quarantine.collect()} == {"cohort_id is missing", "row_id is repeated"}
    assert generate_groups(everybody, 4).assignments.count() == usable.count() == 8


def test_broken_csv_records_are_set_aside(spark, tmp_path):
    head = "cohort_id,row_id,Name,Gender,Motivation,Self_Esteem,Work_Ethic,Learning_Style,Diversity\n"
    lines = ['1,0,"Ann ""A"" B",F,1,2,3,Visual,X', '1,1,"two\nlines, one name",M,1,2,3,Visual,X', "abc,2,Bad,F,1,2,3,Visual,X", "1,x,Bad,F,1,2,3,Visual,X",
             "1,4,Short,F", "1,5,Long,F,1,2,3,Visual,X,more,more", " 1 , 6 ,Blank keys,F,1,2,3,Visual,X", "1,99999999999999999999,Wide,F,1,2,3,Visual,X"]
    (tmp_path / "people.csv").write_text(head + "\n".join(lines) + "\n")
    people, rejected = split_people_csv(spark, str(tmp_path / "people.csv"))
    assert sorted((r.row_id, r.Name) for r in people.collect()) == [(0, 'Ann "A" B'), (1, "two\nlines, one name"), (6, "Blank keys")]
    # Reading fewer columns finds the same records.
    assert people.select("row_id").count() == 3 and rejected.select("reason").count() == 5
    found = {r.row_key: r for r in rejected.collect()}
    assert {k: r.reason.split(" ")[0] for k, r in found.items()} == {
        "2": "cohort_id", "x": "row_id", "4": "wrong", "5": "wrong", "99999999999999999999": "row_id"}
    assert found["4"].record == "1,4,Short,F" and found["2"].file.endswith("people.csv") and found["2"].record.startswith("abc,2,Bad")
    plain = read_people_csv(spark, str(tmp_path / "people.csv"))
    assert plain.count() == 3 and plain.columns == people.columns


def test_comparison_sink(spark, tmp_path):
    rows = spark.createDataFrame([(1, "K-Means", "0.5000"), (2, "K-Medoids", None)], "cohort_id bigint, Algorithm string, `Silhouette Score` string")
    write_comparison(rows, str(tmp_path / "table"))
    back = spark.read.option("header", True).csv(str(tmp_path / "table"))
    assert back.columns == rows.columns and sorted(r[1] for r in back.collect()) == ["K-Means", "K-Medoids"]
