"""Commands from files to files."""

import gzip

import pytest

from strandloom import cli
from strandloom.operators.extract import indel_signals
from strandloom.sources.alignments import read_alignments
from strandloom.streaming.signals import stream_indels
from tests.test_extract import aln


@pytest.fixture
def run(spark, monkeypatch, capsys):
    def go(*args):
        monkeypatch.setattr(cli, "_session", lambda: spark)
        capsys.readouterr()
        cli.main([str(a) for a in args])
        return capsys.readouterr().out.splitlines()

    return go


@pytest.fixture
def paf(tmp_path):
    path = tmp_path / "x.paf.gz"
    rows = [aln(f"r{i}", 10000, 0, 10000, "+-"[i % 2], "chr1", 10**6, 5000, 14880, "4000M120I5880M") for i in range(4)]
    rows += [
        aln("s", 10000, 0, 5000, "+", "chr1", 10**6, 1000, 6000, "5000M"),
        aln("s", 10000, 5000, 10000, "+", "chr2", 10**6, 16000, 21000, "5000M"),
    ]
    with gzip.open(path, "wt") as f:
        f.write("\n".join(rows) + "\n")
    return str(path)


def test_extract_to_vcf(run, paf, tmp_path):
    rows = run("extract", paf)
    assert (
        "chr1\t9000\t9000\tr0\t60\t+\tSVTYPE=INS;SVLEN=120;qoff_l=4000;qoff_r=4120;tsd_len=0;polyA_len=0;source=foo;tsd_seq=.;insert=."
        in rows
    )
    assert (
        "chr1\t5999\t>>\tchr2\t16000\ts\t60\t+\tSVTYPE=BND;qoff_l=5000;qoff_r=5000;qgap=0;mapq=60,60;aln_len=5000,5000;source=foo"
        in rows
    )
    signals = tmp_path / "x.signals"
    signals.write_text("\n".join(rows) + "\n")
    # A signal is always close to itself, so intersecting a file with itself changes nothing.
    assert sorted(run("isec", signals, signals, signals)) == sorted(rows)
    calls = run("merge", signals)
    assert len(calls) == 1
    head, info = calls[0].rsplit("\t", 1)
    assert head in ("chr1\t9000\t9000\t.\t4\t+", "chr1\t9000\t9000\t.\t4\t-")
    assert info.startswith("avg_mapq=60;count=foo:2,2;rt_len=0;SVTYPE=INS;SVLEN=120;") and info.endswith("reads=r0,r1,r2,r3")
    merged = tmp_path / "x.calls"
    merged.write_text("\n".join(calls) + "\n")
    run("genvcf", merged, "-o", tmp_path / "vcf")
    parts = sorted((tmp_path / "vcf").glob("part-*"))
    whole = "".join(x.read_text() for x in parts).splitlines()
    assert whole == run("genvcf", merged)
    vcf = run("genvcf", merged)
    assert vcf[0] == "##fileformat=VCFv4.3"
    assert vcf[-1] == "chr1\t9001\tins_1\tN\t<INS>\t4\tPASS\tSVTYPE=INS;SVLEN=120;END=9000;SEQ=.\tGT\t1/1"
    tags = tmp_path / "hp.tsv"
    tags.write_text("r0\t1\nr1\t2\nr2\tNA\n")
    assert run("annotatehp", tags, merged) == [calls[0] + "\t2,1,1"]
    bare = calls[0].replace(";reads=r0,r1,r2,r3", "")
    merged.write_text(bare + "\n" + calls[0] + "\n")
    assert run("annotatehp", tags, merged) == [bare + "\t0,0,0", calls[0] + "\t2,1,1"]


def test_streamed_indels_equal_the_batch(spark, paf, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.paf.gz").write_bytes(open(paf, "rb").read())
    stream_indels(spark, str(src), out, state).awaitTermination()
    want = indel_signals(read_alignments(spark, paf))
    key = lambda d: sorted(map(str, d.select("ctg", "pos", "read", "svlen").collect()))
    assert key(spark.read.parquet(out)) == key(want) and want.count() == 4


@pytest.fixture
def vcfs(tmp_path):
    def rec(ident, pos, n, dv, flt="PASS"):
        return f"chr1\t{pos}\t{ident}\tN\t<DEL>\t.\t{flt}\tSVTYPE=DEL;SVLEN=-{n};END={pos + n};RNAMES=r{pos},q{pos}\tGT:DV\t0/1:{dv}\t0/0:0\n"

    a, b, c = tmp_path / "a.vcf", tmp_path / "b.vcf", tmp_path / "c.vcf"
    head = "##x\n#CHROM\tPOS\n"
    a.write_text(head + rec("a1", 1000, 500, 6) + rec("a2", 90000, 5000, 7))
    b.write_text(head + rec("b1", 1100, 520, 9) + rec("b2", 500000, 5000, 7))
    c.write_text(head + rec("c1", 1050, 500, 9, "LowQual") + rec("c2", 90010, 5100, 8))
    return a, b, c


def test_eval_union_and_view(run, vcfs):
    a, b, c = vcfs
    assert run("eval", a, b) == ["RN\t2\t1\t0.5", "RP\t2\t1\t0.5"]
    wrong = run("eval", "-e", a, b)[2:]
    assert wrong == ["FN\tchr1\t89999\t>>\tchr1\t95000\tDEL\ta2\t-5000\t0", "FP\tchr1\t499999\t>>\tchr1\t505000\tDEL\tb2\t-5000\t0"]
    assert len(run("eval", "-a", a, b)) == 2 + 4
    matrix = run("eval", a, b, c)
    assert matrix[0] == "0\t0\t2\t2\t2.0" and matrix[1] == "0\t1\t2\t1\t0.5"
    assert run("union", "--unseen", a, b, c) == ["100\t0", "010\t1", "110\t1", "001\t0", "101\t1", "011\t0", "111\t0"]
    assert run("union", a, b, c) == ["010\t1", "110\t1", "101\t1"]
    sizes = run("eval", "-s", a, b)[2:]
    assert len(sizes) == 7 and sizes.count(">100k\t0\t0\t1.0\t0\t0\t1.0") == 1
    assert len(run("union", "-p", a, b, c)) == 5
    assert run("view", a)[0] == "0\tchr1\t999\t>>\tchr1\t1500\tDEL\t-500"
    assert run("view", "-C", a) == ["0\t0\t0\t0\t0"]
    assert len(run("view", "-l", 500, a)) == 2 and len(run("view", "-l", 501, a)) == 1
    assert len(run("eval", "-M", a, b, c)) == 6


def test_filters_by_reads(run, vcfs, tmp_path):
    a, *_ = vcfs
    sig = tmp_path / "asm"
    sig.write_text(
        "".join(f"h1\t10\t510\t{r}\t60\t+\tSVTYPE=DEL;SVLEN=-480;qoff_l=1;qoff_r=1;source=x\n" for r in ("r1000", "q1000"))
    )
    out = run("filterasm", "-c", 2, a, sig, tmp_path / "stat", a)
    assert [x.split("\t")[2] for x in out if not x.startswith("#")] == ["a1"]
    out = run("filtersnf", a, sig, tmp_path / "stat2")
    assert [x.split("\t")[2] for x in out if not x.startswith("#")] == ["a1"]
    assert len([x for x in run("snfpair", a) if not x.startswith("#")]) == 2
    assert any(x.startswith("##FORMAT=<ID=VAF") for x in run("vcf", a))


def test_read_ids_go_from_union_to_break_pairs(run, tmp_path):
    def rec(ident, pos, reads):
        return f"chr1\t{pos}\t{ident}\tN\t<DEL>\t.\tPASS\tSVTYPE=DEL;SVLEN=-500;END={pos + 500};RNAMES={reads}\tGT:DV\t0/1:6\t0/0:0\n"

    a, b, sig = tmp_path / "a.vcf", tmp_path / "b.vcf", tmp_path / "asm"
    a.write_text("#CHROM\tPOS\n" + rec("a1", 1000, "r1,r2,r3") + rec("a2", 9000, "r1,r2"))
    b.write_text("#CHROM\tPOS\n" + rec("b1", 90000, "r9"))
    sig.write_text("".join(f"h1\t10\t510\t{r}\t60\t+\tSVTYPE=DEL;SVLEN=-480;qoff_l=1;qoff_r=1;source=x\n" for r in ("r1", "r2", "r9")))
    rows = run("advunion", "-g", 1, "--calls", a, "--calls", b, "--readids", a, "--readids", b, sig)
    assert sum(";orig_read_ids=r1,r2,r3;asm_read_ids=r1,r2;" in r for r in rows) == 1 and len(rows) == 3
    union = tmp_path / "union"
    union.write_text("\n".join(rows) + "\n")
    out = run("doublestrandbreak", union)
    pairs = [r for r in out if r.endswith("\tcase1")]
    assert pairs and "case1\t" + str(len(pairs)) in out


def test_ensembleunion_repeats_the_middle_line_of_each_run(run, tmp_path):
    def row(pos, group, file, extra):
        return f"chr1\t{pos}\t>>\tchr1\t{pos + 500}\tSVTYPE=DEL;SVLEN=-500;count=3;group_id={group};file_id={file};{extra}"

    rows = [row(300, 7, 0, "tr=abc"), row(100, 7, 2, "orig_read_ids=r1,r2"), row(200, 7, 1, "asm_read_ids=r1;segdup=x"), row(50, 8, 1, "y=1"), row(900, 7, 0, "z=2")]
    union = tmp_path / "union"
    union.write_text("\n".join(rows) + "\n")
    assert sorted(run("ensembleunion", union)) == sorted([rows[2] + "\t0,1,2", rows[3] + "\t1", rows[4] + "\t0"])
    assert sorted(run("ensembleunion", "--drop-last", union)) == sorted([rows[2] + "\t0,1,2", rows[3] + "\t1"])


def test_name_filters_have_a_stat_row_for_every_call(run, tmp_path):
    sig, calls, ids, consensus = (tmp_path / x for x in ("asm", "calls.vcf", "ids.tsv", "consensus"))
    sig.write_text("".join(f"h1\t10\t510\t{r}\t60\t+\tSVTYPE=DEL;SVLEN=-480;qoff_l=1;qoff_r=1;source=x\n" for r in ("r1", "r2")))

    def rec(ident, n, dv):
        return f"chr1\t100\t{ident}\tN\t<DEL>\t.\tPASS\tSVTYPE=DEL;SVLEN={n};END=600\tGT:GQ:VAF:hVAF:DR:DV\t0/1:9:1:1:2:{dv}\n"

    calls.write_text("##x\n" + rec("severus_BND1_1", -500, 7) + rec("severus_BND1_2", -500, 7) + rec("severus_DEL2", -30_000, 3) + rec("severus_DEL3", -50, 3))
    ids.write_text("#VARIANT_ID\tx\treads\n")
    consensus.write_text("severus_BND1_1\n")
    from strandloom import cli
    from strandloom.sources import readids

    listed = readids.read_read_ids
    try:
        readids.read_read_ids = lambda spark, path: spark.createDataFrame([("severus_BND1", r) for r in ("r1", "r2", "r3")], "svid string, read string")
        out = run("filterseverus", "--consensus", consensus, calls, ids, sig, tmp_path / "stat")
    finally:
        readids.read_read_ids = listed
    assert cli and [x.split("\t")[2] for x in out if not x.startswith("#")] == ["severus_BND1_1", "severus_BND1_2"]
    stat = sorted("".join(p.read_text() for p in (tmp_path / "stat").glob("part-*")).splitlines())
    assert stat == ["-30000\t20kb-100kb\tseverus_DEL2\tFalse\t3\t0\t0", "-500\t100bp-20kb\tseverus_BND1\tTrue\t7\t3\t2"]

    snf = tmp_path / "snf.vcf"
    row = "chr1\t100\t{}\tN\t<DEL>\t.\tPASS\tSVTYPE=DEL;SVLEN=-700;{}\tGT:GQ:DR:DV:ID\t0/1:9:2:{}:a\t0/0:9:2:{}:b\n".format
    snf.write_text(row("s1", "SUPPORT=4;RNAMES=r1,r2,r9", 4, 0) + row("s2", "SUPPORT=5", 5, 0) + row("s3", "SUPPORT=5;RNAMES=r1", 5, 1))
    out = run("filtersnf", snf, sig, tmp_path / "stat2")
    assert [x.split("\t")[2] for x in out] == ["s1"]
    stat = sorted("".join(p.read_text() for p in (tmp_path / "stat2").glob("part-*")).splitlines())
    assert stat == ["-700\t100bp-20kb\t4\ts1\t3\t4\t2", "-700\t100bp-20kb\t5\ts2\t0\t5\t0"]
