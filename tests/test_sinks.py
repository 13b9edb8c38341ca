"""The daily feed file."""

import json
import os

from pyspark.sql import functions as F

from tidings.sources.sinks import publish_feed


def _payload(spark, rows, partitions=2):
    return spark.createDataFrame(rows, "date string, payload string").repartition(partitions)


def test_one_file_per_day_replaced_on_rerun(spark, tmp_path):
    out = str(tmp_path / "feeds")
    assert publish_feed(_payload(spark, [("2024-01-30", '{"a": 1}'), ("2024-01-31", '{"a":\n "é"}')]), out) == (True, None)
    assert sorted(os.listdir(out)) == ["2024-01-30.json", "2024-01-31.json"]
    assert json.load(open(f"{out}/2024-01-31.json", encoding="utf-8")) == {"a": "é"}
    assert publish_feed(_payload(spark, [("2024-01-31", "{}")]), f"file://{out}") == (True, None)
    assert sorted(os.listdir(out)) == ["2024-01-30.json", "2024-01-31.json"]
    assert open(f"{out}/2024-01-31.json").read() == "{}" and open(f"{out}/2024-01-30.json").read() == '{"a": 1}'


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    out = str(tmp_path / "feeds")
    assert publish_feed(_payload(spark, [("2024-01-30", "old")]), out)[0]
    bad = _payload(spark, [("2024-01-30", "new"), ("2024-01-31", "new"), ("2024-02-01", "new")], 3)
    bad = bad.withColumn("payload", F.when(F.col("date") == "2024-02-01", F.raise_error(F.lit("broken"))).otherwise(F.col("payload")))
    for rows in (bad, _payload(spark, [("2024-01-31", "x"), ("../../etc", "x")]), _payload(spark, [("2024-01-31", "x"), ("2024-01-30", None)]),
                 _payload(spark, [("2024-01-31", "x"), ("2024-01-31", "y")])):
        ok, err = publish_feed(rows, out)
        assert not ok and err is not None
        assert os.listdir(out) == ["2024-01-30.json"] and open(f"{out}/2024-01-30.json").read() == "old"


def test_no_rows(spark, tmp_path):
    assert publish_feed(_payload(spark, [], 1), str(tmp_path / "feeds")) == (True, None)
