import json

import pytest
from pyspark.sql import functions as F

from strandloom.sources import readers, writers


@pytest.fixture
def small_blocks(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_fastq_over_files_and_blocks(spark, tmp_path, small_blocks):
    wanted = {}
    for k, n in enumerate((400, 1000, 3)):
        lines = []
        for i in range(n):
            s = "ACGT" * (1 + (i * 7 + k) % 30)
            lines += [f"@f{k}r{i}", s, "+", "@" * len(s)]
            wanted[f"f{k}r{i}"] = (i, s)
        (tmp_path / f"f{k}.fastq").write_text("\n".join(lines) + "\n")
    assert readers.numbered_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 3
    reads = readers.read_fastq(spark, str(tmp_path)).collect()
    assert len(reads) == len(wanted) and not [r for r in reads if r["problem"]]
    assert {r["title"]: (r["read_no"], r["sequence"]) for r in reads} == wanted


def test_fastq_blank_lines_and_clipping(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("@a\n\nACGT\n+\nIII\n\n")
    r = readers.read_fastq(spark, str(tmp_path / "a.fastq"), clip=True).collect()
    assert [(x["title"], x["sequence"], x["quality"], x["problem"]) for x in r] == [("a", "ACG", "III", "length")]
    assert readers.read_fastq(spark, str(tmp_path / "a.fastq"), keep_blank=True).where("read_no = 0").first()["problem"] == "separator"


@pytest.mark.parametrize(("text", "rows"), [
    ([{"a": 1, "b": [1, 2]}, {"a": None, "c": "x"}], {("1", "[1,2]", ""), ("", "", "x")}),
    ({"data": [{"a": "x"}]}, {("x",)}),
    ([[1, "b"], [2]], {("1", "b"), ("2", "")}),
    ([1, "z"], {("1",), ("z",)}),
    ({"a": 1, "b": {"c": 2}}, {("1", '{"c":2}')}),
    ([], set()),
])
def test_json_shapes(spark, tmp_path, text, rows):
    (tmp_path / "t.json").write_text(json.dumps(text, indent=1))
    assert {tuple(r) for r in readers.read_json_table(spark, str(tmp_path / "t.json")).collect()} == rows


def test_json_lines(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"a": 1}\n{"b": [2]}\n')
    assert {tuple(r) for r in readers.read_json_table(spark, str(tmp_path / "t.json")).collect()} == {("1", ""), ("", "[2]")}
    writers.write_json(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "out"))
    assert [tuple(r) for r in readers.read_json_table(spark, str(tmp_path / "out")).collect()] == [("1", "x")]


def test_files_without_line_breaks_in_quotes_are_split(spark, tmp_path, small_blocks):
    (tmp_path / "t.csv").write_text("a,b\n" + "".join(f'{i},"x, ""{i}"""\n' for i in range(5000)))
    df = readers.read_delimited(spark, str(tmp_path / "t.csv"))
    assert df.rdd.getNumPartitions() > 2 and df.count() == 5000 and df.where("a = '17'").first()["b"] == 'x, "17"'


def test_headers_and_formats(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@HD\tVN:1.6\n@SQ\tSN:c1\tLN:99\tSN:c2\n@CO\tfree text\nq\t4\t*\n")
    got = {r["kind"]: r["tags"] for r in readers.read_sam_header(spark, str(tmp_path / "a.sam")).collect()}
    assert got == {"HD": {"VN": "1.6"}, "SQ": {"SN": "c2", "LN": "99"}, "CO": {"CO": "free text"}}
    assert [readers.detect_interval_format(x) for x in (["#CHROM\tPOS"], ["c\t1\t2"], ["# x", "c\ts\tt\t1\t2\t.\t+\t.\tID=1"], ["c\ts\tt\t1\t2\t.\t+\t.\t" + 'gene_id "g";'], [])] == ["vcf", "bed", "gff", "gtf", "bed"]
    (tmp_path / "x.gff").write_text("c\ts\tgene\t3\t9\t.\t-\t.\tID=g1\n")
    assert [tuple(r) for r in readers.read_intervals(spark, str(tmp_path / "x.gff")).collect()] == [("c", 3, 9, "g1", "-")]
    (tmp_path / "x.vcf").write_text("##fileformat=VCFv4\n#CHROM\nc\t3\tv\tAC\tA\t.\t.\tEND=7\n")
    assert [tuple(r) for r in readers.read_intervals(spark, str(tmp_path / "x.vcf")).collect()] == [("c", 3, 7, "v", ".")]


def test_markdown_says_what_it_leaves_out(spark):
    df = spark.range(5).select(F.concat(F.lit("a|"), "id", F.lit("\nb")).alias("x"))
    assert writers.markdown_lines(df).count() == 5
    text = writers.markdown(df, 2)
    assert "only the first 2 rows" in text.lower() and "| a\\|0<br>b |" in text
    assert "only" not in writers.markdown(df, 5).lower()
