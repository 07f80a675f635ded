"""Readers and writers on small hand-written files."""

import gzip

import pytest
from pyspark.sql import functions as F

from strandloom.functions.info import info_first, info_last, strand_count_total
from strandloom.operators.asmfilter import supported_lines
from strandloom.params import CallParams, parse_size, read_level_length
from strandloom.sources import readids
from strandloom.sources.calls import parse_calls, read_calls
from strandloom.sources.regions import hull, padded, read_bed, read_segmental_duplications, read_tandem_repeats
from strandloom.sources.text import read_numbered_lines


def vcf(ident, alt, info, pos=1000, ref="N", flt="PASS", fmt=(), chrom="chr1"):
    return "\t".join([chrom, str(pos), ident, ref, alt, ".", flt, info, *fmt])


def calls(lines, rows, **kw):
    out = parse_calls(lines(rows), CallParams(**kw)).orderBy("line_no", "pos2").collect()
    return [(r.svid, r.ctg, r.pos, r.ori, r.ctg2, r.pos2, r.svtype, r.svlen, r["count"]) for r in out]


def test_sizes():
    assert [parse_size(x) for x in ("100", "1.5k", "2M", "3g")] == [100, 1500, 2_000_000, 3_000_000_000]
    assert read_level_length(100, 0.8) == 80


def test_annotation_values(spark):
    df = spark.createDataFrame([("FLAG;A=1;B=x;A=2;CIPOS=7",)], "info string")
    row = df.select(
        info_first(F.col("info"), "A").alias("first"), info_last(F.col("info"), "A").alias("last"),
        info_first(F.col("info"), "POS").alias("none"), strand_count_total(F.lit("a:3,4|b:1,0")).alias("n"),
    ).first()
    assert tuple(row) == ("1", "2", None, 8)


def test_vcf_record_styles(lines):
    got = calls(
        lines,
        [
            "##header",
            "#CHROM\tPOS",
            vcf("a", "N" + "A" * 120, "X=1;Y"),
            vcf("b", "N,NAA," + "N" * 100, "X=1;Y"),
            vcf("c", "<DEL>", "SVTYPE=DEL;SVLEN=500;END=1500", fmt=("GT:DV", "0/1:7", "0/0:2")),
            vcf("d", "<DUP>", "SVTYPE=DUP;SVLEN=300;SUPPORT=9"),
            vcf("e", "<INV>", "SVTYPE=INV;SVLEN=300;END=1300"),
            vcf("f", "<INS>", "SVTYPE=INS;SVLEN=3;SVINSLEN=90"),
            vcf("g_1", "N[chr2:5000[", "SVTYPE=BND;MATEID=g_2", fmt=("GT:DV", "0/1:7")),
            vcf("g_2", "]chr1:1000]N", "SVTYPE=BND;MATEID=g_1", pos=5000, chrom="chr2", fmt=("GT:DV", "0/1:7")),
            vcf("h", "]chr1:400]N", "SVTYPE=BND;X=1"),
            vcf("i", "[chr1:4000[N", "SVTYPE=BND;X=1"),
            vcf("j", "N[chr1:4000[", "SVTYPE=BND;DETAILED_TYPE=Templated_ins;SVLEN=3000"),
            vcf("k", "N[chr1:4000[", "SVTYPE=BND;X=1"),
            vcf("l", "N.", "SVTYPE=BND;X=1"),
            vcf("m", "<DEL>", "SVTYPE=DEL;SVLEN=-60;END=1060"),
            vcf("n", "<DEL>", "SVTYPE=DEL;SVLEN=-500;END=1500", flt="LowQual"),
        ],
    )
    assert got == [
        ("a", "chr1", 999, ">>", "chr1", 1000, "INS", 120, -1),
        ("b", "chr1", 999, ">>", "chr1", 1000, "INS", 99, -1),
        ("c", "chr1", 999, ">>", "chr1", 1500, "DEL", -500, 9),
        ("d", "chr1", 999, "<<", "chr1", 1299, "DUP", 300, 9),
        ("e", "chr1", 999, "><", "chr1", 1300, "INV", 300, -1),
        ("f", "chr1", 999, ">>", "chr1", 1000, "INS", 90, -1),
        ("g_1", "chr1", 999, ">>", "chr2", 5000, "BND", 0, 7),
        ("h", "chr1", 400, "<<", "chr1", 999, "DUP", 0, -1),
        ("i", "chr1", 999, "<>", "chr1", 4000, "INV", 3001, -1),
        ("j", "chr1", 999, ">>", "chr1", 4000, "BND", 3000, -1),
        ("k", "chr1", 999, ">>", "chr1", 4000, "DEL", 0, -1),
    ]


def test_several_long_alleles_are_several_rows(lines):
    got = calls(lines, [vcf("b", "N" + "A" * 100 + "," + "N" + "A" * 200, "X=1;Y")])
    assert sorted(g[7] for g in got) == [100, 200]


def test_call_filters(lines):
    rows = [
        vcf("a", "<DEL>", "SVTYPE=DEL;SVLEN=-500;END=1500;SUPPORT=2"),
        vcf("b", "<DEL>", "SVTYPE=DEL;SVLEN=-500;END=1500", fmt=("GT", "0/0")),
        vcf("c", "<DEL>", "SVTYPE=DEL;SVLEN=-500;END=1500", flt="LowQual"),
    ]
    names = lambda **kw: [g[0] for g in calls(lines, rows, **kw)]
    assert names() == ["a", "b"]
    assert names(min_count=3) == ["b"]
    assert names(check_gt=True) == ["a"]
    assert names(ignore_filter=True) == ["a", "b", "c"]


def test_repeated_ids_are_read_once(lines):
    rows = [vcf("x", "<DEL>", "SVTYPE=DEL;SVLEN=-500;END=1500")] * 2 + [vcf(".", "<DEL>", "SVTYPE=DEL;SVLEN=-500;END=1500")] * 2
    assert [g[0] for g in calls(lines, rows)] == ["x", ".", "."]


def test_merged_call_rows(lines):
    got = calls(
        lines,
        [
            "chr1\t9000\t9000\t.\t4\t+\tavg_mapq=60;count=a:2,2;SVTYPE=INS;SVLEN=120",
            "chr1\t900\t><\tchr1\t5000\t.\t3\t+\tcount=a:3,0;SVTYPE=INV;SVLEN=4100",
            "chr1\t900\t>>\tchr2\t5000\t.\t3\t+\tcount=a:3,0|b:0,2;SVTYPE=BND;x=1",
        ],
    )
    assert [(g[0], *g[2:]) for g in got] == [
        ("1", 9000, ">>", "chr1", 9000, "INS", 120, 4),
        ("2", 900, "><", "chr1", 5000, "INV", 4100, 3),
        ("3", 900, ">>", "chr2", 5000, "BND", 0, 5),
    ]


def test_unknown_record_is_an_error(lines):
    with pytest.raises(Exception, match="unknown call record"):
        calls(lines, ["chr1\t100\tx\ty"])


def test_line_numbers_across_splits_and_files(spark, tmp_path):
    path = tmp_path / "big.txt"
    path.write_text("".join(f"line {i}\n" for i in range(1, 40_001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        df = read_numbered_lines(spark, str(path))
        assert df.rdd.getNumPartitions() > 3
        assert df.filter(F.col("line") != F.concat(F.lit("line "), F.col("line_no").cast("string"))).count() == 0
        assert df.count() == 40_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_gzip_calls(spark, tmp_path):
    path = tmp_path / "x.vcf.gz"
    with gzip.open(path, "wt") as f:
        f.write("##x\n" + vcf("a", "<DEL>", "SVTYPE=DEL;SVLEN=-500;END=1500") + "\n")
    assert read_calls(spark, [str(path)]).count() == 1


@pytest.mark.parametrize(
    "name, rows, want",
    [
        ("ids.csv", ["#SV_ID,reads", 's1,"a; b"', "s2,c"], {("s1", "a"), ("s1", "b"), ("s2", "c")}),
        ("ids.tsv", ["VARIANT_ID\tREADS", "ID_1\ta,b"], {("ID_1", "a"), ("ID_1", "b")}),
        ("ids.txt", ["chr1\t1\t2\t3\t4\t5\t6\td_1\tr1\t+", "chr1\t1\t2\t3\t4\t5\t6\td_1\tr2\t-"], {("d_1", "r1"), ("d_1", "r2")}),
        ("ids.vcf", ["##x", "chr1\t1\tS.1\tN\t<DEL>\t.\tPASS\tSVTYPE=DEL;RNAMES=a,b"], {("S.1", "a"), ("S.1", "b")}),
        ("ids.calls", ["chr1\t1\t2\t.\t2\t+\tavg_mapq=3;SVTYPE=INS;reads=a,b"], {("1", "a"), ("1", "b")}),
    ],
)
def test_read_id_formats(spark, tmp_path, name, rows, want):
    path = tmp_path / name
    path.write_text("\n".join(rows) + "\n")
    assert {tuple(r) for r in readids.read_read_ids(spark, str(path)).collect()} == want


def test_later_read_table_owns_an_id(spark):
    a = spark.createDataFrame([("s", "a"), ("t", "b")], "svid string, read string")
    b = spark.createDataFrame([("s", "c")], "svid string, read string")
    assert {tuple(r) for r in readids.merge_read_ids([a, b]).collect()} == {("s", "c"), ("t", "b")}


def test_haplotypes_and_id_list(spark, write):
    hp = readids.read_haplotypes(spark, write("hp.tsv", [("a", 1), ("b", "NA"), ("a", 2)]))
    assert {tuple(r) for r in hp.collect()} == {("a", 2)}
    ids = readids.read_id_list(spark, write("ids", [("severus_BND1_1",), ("severus_BND1_2",)]))
    assert [r.svid for r in ids.collect()] == ["severus_BND1"]


def test_region_files(spark, write):
    bed = read_bed(spark, write("a.bed", [("chr1", 10, 20), ("chr1", 50, 60), ("x",)]))
    assert {tuple(r) for r in padded(bed).collect()} == {("chr1", 5, 25), ("chr1", 45, 65)}
    assert [tuple(r) for r in hull(bed).collect()] == [("chr1", 10, 60)]
    tr = read_tandem_repeats(spark, write("tr", [("chr1", 10, "x", "y", 30), ("chr1", 10, "x", "y", 10)]))
    assert sorted((r.st, r.en) for r in tr.collect()) == [(10, 11), (10, 30)]
    sd = read_segmental_duplications(spark, write("sd", [("chr1", 10, 30)]))
    assert [(r.st, r.en, r.data) for r in sd.collect()] == [(10, 31, "chr1#10#30")]


def test_records_pass_through_untouched(spark, lines):
    rows = lines(["##h", vcf("severus_X_1", "N[chr2:5[", "A=1;B"), vcf("other", "<DEL>", "A=1;B")])
    ids = spark.createDataFrame([("severus_X",)], "clean_id string")
    out = supported_lines(rows, ids).orderBy("line_no").collect()
    assert [r.line_no for r in out] == [1, 2]


def test_format_is_told_by_any_line(spark, tmp_path):
    from strandloom.sources.readids import detect_format

    path = tmp_path / "ids"
    path.write_text("".join(f"x\t{i}\n" for i in range(80)) + "VARIANT_ID\treads\n")
    assert detect_format(spark, str(path)) == "savana"
