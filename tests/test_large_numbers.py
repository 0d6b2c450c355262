"""Identifiers beyond the digits that the smaller tables need."""

import pytest
from pyspark.sql import functions as F

from tidewire.functions import parsing, wire
from tidewire.plans import catalogue

from .compare import same


@pytest.fixture(scope="module")
def large(spark, sf_dir, tmp_path_factory):
    """Events of streams and numbers around and beyond four, five, six and seven hexadecimal digits."""
    to = tmp_path_factory.mktemp("large")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    moved = [events.withColumns({"user_id": F.col("user_id") + s, "event_id": F.col("event_id") + e}) for s, e in ((0, 0), (65_530, 16_777_000), (1_048_570, 268_435_000), (70_000_000, 5_000_000_000))]
    both = moved[0]
    for m in moved[1:]:
        both = both.unionByName(m)
    both.toPandas().to_parquet(to / "events.parquet", coerce_timestamps="us")
    return str(to)


@pytest.mark.parametrize("name", ["program_tables", "demultiplexed"])
def test_tables_of_large_numbers(spark, large, name):
    same(catalogue.queries()[name](spark, large), large, catalogue.oracle_sql()[name])


def test_whole_bytes(spark):
    values = [0, 0xFFFF, 0x10000, 0xFFFFF, 0x100000, 0xFFFFFF, 0x1000000]
    found = spark.createDataFrame([(v,) for v in values], "v long").select(wire.hexed_whole(F.col("v"), 4)).collect()
    assert [x[0] for x in found] == ["0000", "FFFF", "010000", "0FFFFF", "100000", "FFFFFF", "01000000"]


def test_bits_are_made_once(spark):
    texts = ["1", "10101010", "111100001", "0" * 40 + "1"]
    df = spark.createDataFrame([(t,) for t in texts], "bits string").select(parsing.bits_to_hex(F.col("bits")).alias("h"))
    assert [x.h for x in df.collect()] == [int(t.ljust(-(-len(t) // 8) * 8, "0"), 2).to_bytes(-(-len(t) // 8)).hex().upper() for t in texts]
    body = df._jdf.queryExecution().analyzed().toString().split("lambdafunction(", 1)[1].split("lambda ", 1)[0]
    assert "bits#" not in body  # else the whole string is computed for each of its bytes
