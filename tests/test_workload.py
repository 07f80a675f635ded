"""Registered queries on tables of a few rows."""

from datetime import datetime

from workload import signals  # noqa: F401
from workload.registry import QUERIES

LINEITEM = (
    "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
)


def test_alignments_that_share_a_number_are_all_read(spark, tmp_path):
    row = lambda part: (5, part, 2, 1, 10.0, 99.5, 0.0, 0.0, "A", "O", datetime(2000, 1, 1))
    spark.createDataFrame([row(30), row(31), row(31)], LINEITEM).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = QUERIES["parse_alignments"](spark, str(tmp_path)).collect()
    assert sorted(r["tst"] for r in got) == [3000, 3100, 3100] and len({r["qname"] for r in got}) == 1
