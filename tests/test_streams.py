"""Stream plans on small tables, as batches."""

import datetime

from strata.streaming import changes


def test_changes_of_null_and_repeated_rows(spark):
    stored = spark.createDataFrame([("a", "0cc175b9c0f1b6a831c399e269772661"), ("b", "x"), ("gone", "y")], "path string, hash string")
    files = spark.createDataFrame([("a", "a", 1), ("b", None, 1), ("new", "", 1), ("new", "", 1), (None, "z", 1)], "path string, content string, hash int").drop("hash")
    got = sorted(((r.path, r.state) for r in changes.changes(files, stored).collect()), key=str)
    assert got == sorted([("a", "unchanged"), ("b", "modified"), ("new", "added"), ("new", "added"), (None, "added")], key=str)


def test_insights_count_the_last_days_only(spark):
    at = lambda day: datetime.datetime(2024, 1, day)
    rows = [(at(1), "old")] * 5 + [(at(25), "new")] * 3 + [(at(26), "few")] * 2 + [(at(26), None)] * 9
    daily = changes.rejections(spark.createDataFrame(rows, "ts timestamp, reason string"))
    assert [(r.reason, r.n, r.confidence) for r in changes.insights(daily, "2024-01-27", days=10).collect()] == [("new", 3, 0.6)]
