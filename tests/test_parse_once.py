"""Call lines are parsed once, and a fault of a record counts only if the record stays."""

from pyspark.sql import functions as F

from strandloom.params import CallParams
from strandloom.sources.calls import parse_calls


def line(pos, svid, alt, info):
    return "\t".join(["chr1", str(pos), svid, "N", alt, ".", "PASS", info, "GT:DV", "0/1:9"])


def test_lines_are_parsed_once(spark, lines):
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    rows = [line(100, "a", "N[chr2:500[", "SVTYPE=BND;MATEID=b"), line(200, "b", "N[chr2:900[", "SVTYPE=BND;MATEID=a"), line(300, "c", "<DEL>", "SVTYPE=DEL;SVLEN=300")]
    df = lines(rows).withColumn("line", F.udf(count, "string").asNondeterministic()("line"))
    assert sorted(r.svid for r in parse_calls(df, CallParams(min_count=3)).collect()) == ["a", "c"]
    assert seen.value == 3


def test_fault_of_a_later_mate(lines):
    rows = [line(100, "a", "N[chr2:500[", "SVTYPE=BND;MATEID=b"), line(200, "b", "N[chr2:900[", "X=1;MATEID=a")]
    assert [r.svid for r in parse_calls(lines(rows)).collect()] == ["a"]
