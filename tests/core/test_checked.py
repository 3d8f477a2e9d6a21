"""Checks of spans and of configuration, and roots where links run in circles."""

from datetime import date

from pyspark.sql import functions as F
from tidemill.operators import relational as R
from tidemill.operators import rules, spans

DAY = date(2024, 6, 1)


def test_chronology(spark):
    rows = [
        ("a", 1, date(2020, 1, 1), date(2021, 1, 1), 3), ("a", 2, date(2020, 12, 1), date(2022, 1, 1), 2), ("a", 3, date(2022, 3, 1), None, 1), ("a", 4, date(2023, 1, 1), date(2022, 12, 1), 4),
        ("b", 5, date(2025, 1, 1), None, 1), ("b", 6, date(2020, 1, 1), date(2020, 1, 1), 2), ("c", 7, date(2020, 1, 1), None, None), ("c", 8, date(2020, 1, 1), None, None),
    ]
    got = spans.chronology(spark.createDataFrame(rows, "owner string, id long, start date, stop date, place int"), F.lit(DAY))
    found = {r.id: (r.errors, r.covered_days, r.gap_days) for r in got.collect()}
    assert found[1] == ([], 0, 0) and found[2] == (["overlap"], 31, 0) and found[3] == ([], 0, 59)
    assert found[4] == (["reversed", "order", "overlap"], 0, 0)
    assert found[5][0] == ["future"] and found[6][0] == []
    assert found[7][0] == [] and found[8][0] == ["overlap"]


def test_tense(spark):
    rows = spark.createDataFrame([(1, "Gère une équipe", True), (2, "A géré une équipe", True), (3, "A géré une équipe", False), (4, "A géré et gère", False), (5, None, True)], "i int, s string, over boolean")
    got = {r.i: r.w for r in rows.select("i", spans.wrong_tense(F.col("s"), F.col("over"), ["gère"], ["a géré"]).alias("w")).collect()}
    assert got == {1: "present", 2: None, 3: "past", 4: None, 5: None}


def test_roots_end_on_cycles(spark):
    links = [(1, None), (2, 1), (3, 2), (10, 11), (11, 12), (12, 10), (13, 12), (20, 20)]
    got = {r.id: r.root for r in R.roots(spark.createDataFrame(links, "id long, parent long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: None, 11: None, 12: None, 13: None, 20: None}


def test_rules(spark):
    rows = spark.createDataFrame([(1, "a", 5, None), (2, "a", 99, 1), (3, " ", None, 7), (4, None, 1, 5), (5, "b", 2, 4)], "id long, name string, size int, parent long")
    found = rules.violations(
        rules.required(rows, "name", "id", "name"), rules.unique(rows, "twice", ["name"]), rules.holds(rows, "size", "id", "size", F.col("size") < 10), rules.one_of(rows, "known", "id", "name", ["a", "b"]),
        rules.refers(rows, "parent", "id", "parent", rows, "id"), rules.acyclic(rows, "cycle", "id", "parent"),
    )
    got = sorted((r.rule, r.subject, r.detail) for r in found.collect())
    assert got == [("cycle", "4", "leads into a cycle"), ("cycle", "5", "leads into a cycle"), ("known", "3", "name:  "), ("name", "3", "name is missing"), ("name", "4", "name is missing"), ("parent", "3", "parent: 7"), ("size", "2", "size: 99"), ("twice", "a", "2 rows")]
    assert rules.violations(rules.required(rows.limit(0), "r", "id", "name")).collect() == []


def test_configuration_that_cannot_be_read_is_told(spark, tmp_path):
    (tmp_path / "one.json").write_text('[{"k": 1, "name": "x"}, {"k": 2, "name": null}]')
    (tmp_path / "two.json").write_text('{\n "k": 3,\n "name": "y"\n}')
    (tmp_path / "bad.json").write_text('[{"k": 1, ')
    entries, broken = rules.read_config(spark, f"file://{tmp_path}", "k bigint, name string")
    assert sorted(tuple(r) for r in entries.collect()) == [(1, "x"), (2, None), (3, "y")]
    assert [(r.rule, r.subject) for r in broken.collect()] == [("readable", "bad.json")]
