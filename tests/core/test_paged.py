"""Paged listings: windows, completeness, errors, and the filter that stops a listing early."""

import json
import pathlib

import pytest
from pyspark.sql import functions as F
from tidemill.sources import paged


def put(folder, keyword, department, offset, answer):
    where = pathlib.Path(folder) / f"keyword={keyword}" / f"department={department}" / f"offset={offset}"
    where.mkdir(parents=True)
    (where / "part-0.txt").write_text(answer if isinstance(answer, str) else json.dumps(answer))


def page(*days, total):
    return {"total": total, "results": [{"id": f"i{d}", "dateCreation": f"2024-01-{d:02d}"} for d in days]}


@pytest.fixture
def folder(tmp_path):
    put(tmp_path, "dev", "75", 0, page(20, 19, total=5))
    put(tmp_path, "dev", "75", 2, page(18, 10, total=5))
    put(tmp_path, "dev", "75", 4, page(9, total=5))
    put(tmp_path, "dev", "69", 0, page(9, 8, total=50))
    put(tmp_path, "dev", "69", 2, page(7, 6, total=50))
    put(tmp_path, "dev", "69", 4, page(5, 4, total=50))
    put(tmp_path, "ops", "75", 0, page(3, 2, total=4))
    put(tmp_path, "ops", "75", 2, {"status": 400})
    put(tmp_path, "ops", "13", 0, {"total": 2, "results": [{"dateCreation": "2024-01-01"}, {"id": "x"}]})
    return f"file://{tmp_path}"


def test_report(spark, folder):
    rows = paged.paged(spark, folder, page=2, window=5, report=True).collect()
    got = {(r.keyword, r.department): (r.pages, r.n, r.total, r.complete, r.ended_by) for r in rows}
    assert got == {("dev", "75"): (3, 5, 5, True, "total"), ("dev", "69"): (3, 5, 50, False, "window"), ("ops", "75"): (2, 2, 4, False, "error"), ("ops", "13"): (1, 1, 2, False, "total")}
    asked = paged.paged(spark, folder, page=2, keywords=["ops", "none"], departments=["75", "01"], report=True).collect()
    assert sorted((r.keyword, r.department, r.n, r.complete, r.ended_by) for r in asked) == [("none", "01", 0, True, "nothing"), ("none", "75", 0, True, "nothing"), ("ops", "01", 0, True, "nothing"), ("ops", "75", 2, False, "error")]


def test_one_partition_per_keyword_and_department(spark, folder):
    assert paged.paged(spark, folder, page=2).rdd.getNumPartitions() == 4


def test_since_stops_the_listing(spark, folder, tmp_path):
    """The page after the bound is unreadable, and is not opened; without the filter it is."""
    put(tmp_path, "late", "75", 0, page(20, 19, total=9))
    put(tmp_path, "late", "75", 2, page(12, 11, total=9))
    put(tmp_path, "late", "75", 4, "no json")
    asked = {"page": 2, "keywords": ["late"], "departments": ["75"]}
    got = paged.paged(spark, folder, since="2024-01-12", **asked).collect()
    assert [(r.place, r.published, r.complete) for r in got] == [(0, "2024-01-20", True), (1, "2024-01-19", True), (2, "2024-01-12", True)]
    report = paged.paged(spark, folder, since="2024-01-12", report=True, **asked).first()
    assert (report.pages, report.n, report.complete, report.ended_by) == (2, 4, True, "since")
    with pytest.raises(Exception, match="JSON|Expecting"):
        paged.paged(spark, folder, **asked).collect()


def test_an_empty_folder(spark, tmp_path):
    assert paged.paged(spark, f"file://{tmp_path}/none", keywords=[], departments=[]).collect() == []


def test_an_export_needs_no_folder_a_page(spark, tmp_path):
    """60 pages of two listings lie in two files, and are read as pages."""
    where, n = tmp_path / "answers", 120
    rows = spark.range(n).selectExpr("IF(id % 2 = 0, 'dev', 'ops') AS keyword", "'75' AS department", "format_string('2024-01-01T%04d', id) AS published", "id")
    item = F.to_json(F.struct(F.col("id").cast("string").alias("id"), F.col("published").alias("dateCreation")))
    paged.export_answers(rows, f"file://{where}", item, 2, F.when(F.col("id") == 11, 400))
    assert len(list(where.rglob("part-*.txt"))) == 2
    got = {r.keyword: (r.pages, r.n, r.total, r.complete, r.ended_by) for r in paged.paged(spark, f"file://{where}", page=2, window=200, report=True).collect()}
    assert got == {"dev": (30, 60, 60, True, "total"), "ops": (28, 54, 60, False, "error")}
    read = paged.paged(spark, f"file://{where}", page=2, window=7, keywords=["dev"]).orderBy("place").collect()
    assert [(r.place, r.published) for r in read] == [(k, f"2024-01-01T{118 - 2 * k:04d}") for k in range(7)]
