"""Worked examples of signal extraction."""

from strandloom.operators.extract import extract
from strandloom.params import ExtractParams
from strandloom.sources.alignments import parse_alignments


def aln(name, qlen, qst, qen, strand, path, tlen, tst, ten, cg, *tags, mapq=60, tp="P"):
    head = [name, qlen, qst, qen, strand, path, tlen, tst, ten, ten - tst, qen - qst, mapq]
    return "\t".join(map(str, [*head, f"tp:A:{tp}", f"cg:Z:{cg}", *tags]))


def run(lines, rows, params=ExtractParams(), cen=None):
    return [r.asDict() for r in extract(parse_alignments(lines(rows), params), params, cen).collect()]


def test_insertion(lines):
    out = run(lines, [aln("r1", 10000, 0, 10000, "+", "chr1", 1000000, 5000, 14880, "4000M120I5880M")])
    assert len(out) == 1
    r = out[0]
    assert (r["ctg"], r["pos"], r["en"], r["read"], r["svtype"], r["svlen"]) == ("chr1", 9000, 9000, "r1", "INS", 120)
    assert (r["qoff_l"], r["qoff_r"], r["tsd_len"], r["polya_len"]) == (4000, 4120, 0, 0)
    assert (r["tsd_seq"], r["insert_seq"]) == (".", ".")


def test_indel_density_limit(lines):
    assert run(lines, [aln("r1", 3000, 0, 3000, "+", "chr1", 10**6, 5000, 7880, "1000M120I1880M")]) == []


def test_rejected_rows(lines):
    ok = ("r1", 10000, 0, 10000, "+", "chr1", 1000000, 5000, 14880, "4000M120I5880M")
    rows = [aln(*ok, mapq=4), aln(*ok, tp="S"), "\t".join(map(str, ok)), aln(*ok).replace("\tcg:Z", "\txx:Z")]
    assert run(lines, rows) == []


def test_reverse_strand_deletion(lines):
    (r,) = run(lines, [aln("r1", 9000, 100, 8900, "-", "chr1", 10**6, 5000, 14000, "4000M200D4800M")])
    assert (r["pos"], r["en"], r["svlen"], r["qoff_l"], r["qoff_r"]) == (9000, 9200, -200, 4900, 4900)


def test_flanked_insertion(lines):
    seq = "[" + "g" * 5 + "]" + "c" * 60 + "a" * 40 + "[" + "t" * 7 + "]"
    (r,) = run(
        lines,
        [aln("r1", 10000, 0, 10000, "+", "chr1", 10**6, 5000, 14888, "4000M112I5888M", f"ds:Z::4000+{seq}:5888")],
    )
    assert (r["tsd_len"], r["tsd_seq"], r["polya_len"]) == (12, "t" * 7 + "g" * 5, 40)
    assert r["insert_seq"] == "c" * 60 + "a" * 40
    assert (r["pos"], r["en"]) == (9000 - 7, 9000 - 7)
    assert (r["qoff_l"], r["qoff_r"]) == (4000 - 7, 4112 + 5)


def test_split_read_deletion(lines):
    rows = [
        aln("r2", 10000, 0, 5000, "+", "chr1", 10**6, 1000, 6000, "5000M"),
        aln("r2", 10000, 5000, 10000, "+", "chr1", 10**6, 16000, 21000, "5000M"),
    ]
    (r,) = run(lines, rows)
    assert (r["ctg"], r["pos"], r["ori"], r["ctg2"], r["pos2"]) == ("chr1", 5999, ">>", "chr1", 16000)
    assert (r["svtype"], r["svlen"], r["region_st"], r["region_en"]) == ("DEL", -10002, 5999, 16001)
    assert (r["tsd_len"], r["qoff_l"], r["qoff_r"], r["qgap"]) == (0, 5000, 5000, 0)


def test_translocation_is_put_in_order(lines):
    rows = [
        aln("r3", 10000, 0, 5000, "+", "chr2", 10**6, 1000, 6000, "5000M"),
        aln("r3", 10000, 5000, 10000, "+", "chr1", 10**6, 16000, 21000, "5000M"),
    ]
    (r,) = run(lines, rows)
    assert (r["ctg"], r["pos"], r["ori"], r["ctg2"], r["pos2"], r["strand"]) == ("chr1", 16000, "<<", "chr2", 5999, "-")
    assert (r["svtype"], r["svlen"]) == ("BND", None)


def test_graph_path_ends(lines):
    rows = [
        aln("r4", 18000, 0, 9000, "+", ">chr1:1000-6000<chr2:2000-7000", 10000, 500, 9500, "9000M"),
        aln("r4", 18000, 9000, 18000, "+", "chr5", 10**6, 100, 9100, "9000M"),
    ]
    (r,) = run(lines, rows)
    assert (r["ctg"], r["pos"], r["ori"], r["ctg2"], r["pos2"]) == ("chr2", 2500, "<>", "chr5", 100)


def test_indel_on_reverse_segment(lines):
    (r,) = run(
        lines,
        [aln("r5", 9120, 0, 9120, "+", ">chr1:1000-6000<chr2:2000-7000", 10000, 500, 9500, "6500M120I2500M")],
    )
    assert (r["ctg"], r["pos"], r["en"], r["strand"]) == ("chr2", 5000, 5000, "-")


def test_short_end_alignments_are_trimmed(lines):
    rows = [
        aln("r6", 20000, 0, 1000, "+", "chr3", 10**6, 1000, 2000, "1000M"),
        aln("r6", 20000, 1000, 9000, "+", "chr1", 10**6, 1000, 9000, "8000M"),
        aln("r6", 20000, 9000, 9040, "+", "chr4", 10**6, 1000, 1040, "40M"),
        aln("r6", 20000, 9100, 20000, "+", "chr2", 10**6, 1000, 11900, "10900M"),
    ]
    out = run(lines, rows)
    assert [(r["ctg"], r["ctg2"]) for r in out] == [("chr1", "chr2")]


def test_centromere(spark, lines):
    cen = spark.sql("select 'chr1' ctg, array(named_struct('st', 10000L, 'en', 12000L)) cen")
    rows = [
        aln("r2", 10000, 0, 5000, "+", "chr1", 10**6, 1000, 6000, "5000M"),
        aln("r2", 10000, 5000, 10000, "+", "chr1", 10**6, 16000, 21000, "5000M"),
        aln("r1", 10000, 0, 10000, "+", "chr1", 1000000, 5000, 14880, "4000M120I5880M"),
    ]
    out = {r["read"]: r for r in run(lines, rows, cen=cen)}
    assert (out["r2"]["cen_dist"], out["r2"]["cen_overlap"]) == (4000, 2000)
    assert out["r1"]["cen_dist"] == 1000
