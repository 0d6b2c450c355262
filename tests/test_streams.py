"""Streams over many files that are not in time order."""

import pytest
from pyspark.sql import functions as F

from tests.compare import same
from tidewire.plans.catalogue import everything


@pytest.mark.parametrize("name", ["stream_rate_windows", "stream_deduplication", "stream_gap_counts"])
def test_stream_over_unordered_files(spark, sf_dir, tmp_path, name):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    # 24 files in three triggers, the latest rows in the first ones: the late rule starts in the third
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    step = (high - low) / 24
    for k in range(24):
        part = events.filter((F.col("ts") >= high - step * (k + 1)) & (F.col("ts") < high - step * k if k else F.lit(True)))
        part = events.filter(F.col("ts") < high - step * k) if k == 23 else part
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    assert spark.read.parquet(str(tmp_path / "events.parquet")).count() == events.count()
    q = everything()[name]
    same(q.run(spark, str(tmp_path)), sf_dir, q.sql)
