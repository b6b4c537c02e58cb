import pytest
from pyspark.sql import functions as F

from strandloom.operators import genomics, reads, variants

LINES = [
    '##INFO=<ID=DP,Number=1,Description="Depth, ""all"" of it">',
    '##INFO=<ID=ANN,Description="a \\"b\\", c">',
    "##source=x",
    "#CHROM\tPOS",
    "chr1\t10\ta\tA\tG\t50\tPASS\tDP=3,9;DB;CSQ=G|missense_variant|moderate|GEN|E1|Transcript|T1|b|1|2|c|p.K2E|K/E\tGT:DP\t0/0:3\t./.\t0|1",
    "chr2\t20\tb\tA\tG,T\t.\tq10\tDP=x;ANN=G|stop_gained|HIGH|ABC,T|intron_variant|LOW|ABC\tGT\t0/0\t0|0\t0",
    "chrX\t30\tc\tA\t.\t.\t.\t.\tDP\t1\t2\t3",
    "chr3\t40\td\tA\tC\t.\t.\tDP=4",
]


def vcf(spark):
    return genomics.parse_vcf(spark.createDataFrame([(x,) for x in LINES], "value string"))


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_header(spark):
    got = {r["id"]: r["fields"] for r in variants.header_fields(spark.createDataFrame([(x,) for x in LINES], "value string")).collect()}
    assert got["ANN"] == {"ID": "ANN", "Description": 'a "b", c'} and got["DP"]["Number"] == "1" and set(got) == {"DP", "ANN"}


@pytest.mark.parametrize(("key", "op", "value", "found"), [("DP", ">", "5", ["a"]), ("DP", "=", "3.0", ["a"]), ("DP", "!=", "3", ["a", "b", "d"]), ("DP", "=", "x", ["b"]), ("DP", "<", "x", []), ("DB", "=", "1", ["a"]), ("DB", "!=", "1", []), ("ZZ", "=", "", [])])
def test_info(spark, key, op, value, found):
    assert ids(vcf(spark).where(variants.info_is(F.col("info"), key, op, value))) == found


def test_sites(spark):
    got = {r["id"]: (r["n_samples"], r["n_missing"], r["n_called"], r["n_reference"], r["n_hom_ref"], r["missing_rate"]) for r in variants.site_figures(vcf(spark)).collect()}
    assert got == {"a": (3, 1, 2, 1, 1, 1 / 3), "b": (3, 0, 3, 3, 2, 0.0), "c": (3, 3, 0, 0, 0, 1.0), "d": (0, 0, 0, 0, 0, None)}
    modes = {m: ids(variants.filter_sites(vcf(spark), m)) for m in ("any", "all-called", "any-missing", "all-hom-ref", "all-reference")}
    assert modes == {"any": ["a", "b", "c"], "all-called": ["b"], "any-missing": ["a", "c"], "all-hom-ref": [], "all-reference": ["b"]}
    assert ids(variants.filter_sites(vcf(spark), most_missing=0.5)) == ["a", "b"]


def test_consequences(spark):
    find = lambda **k: sorted(r["id"] for r in variants.with_consequence(vcf(spark), ["id"], **k).collect())
    assert find(impact="high") == ["b"] and find(terms=["MISSENSE_VARIANT"]) == ["a"] and find(genes=["abc", "e1"]) == ["a", "b"]
    assert find(protein=["k/e"]) == ["a"] and find(transcripts=["t1"]) == ["a"] and find(impact="LOW", terms=["stop_gained"]) == []
    assert variants.consequences(vcf(spark), ["id"]).count() == 3


def test_tables_and_samples(spark):
    lines = spark.createDataFrame([(x,) for x in LINES], "value string")
    assert [r["value"].split("\t")[8:] for r in variants.project_lines(lines, [1]).where("value LIKE '%\\tb\\t%'").collect()] == [["GT", "0|0"]]
    assert all(r["value"].count("\t") == 7 for r in variants.project_lines(lines, []).collect())
    split = {r["id"]: (r["info_DP"], r["info_DB"]) for r in variants.split_info(vcf(spark), ["DP", "DB"]).collect()}
    assert split == {"a": ("3,9", ""), "b": ("x", None), "c": (None, None), "d": ("4", None)}
    assert ids(variants.sample_variants(vcf(spark), 9, ["id"], autosomes=True)) == ["a", "b", "d"]
    assert ids(variants.sample_variants(vcf(spark), 9, ["id"], biallelic=True, most_missing=0.5)) == ["a", "d"]
    assert ids(variants.sample_variants(vcf(spark), 2, ["id"])) == ids(variants.sample_variants(vcf(spark).repartition(3), 2, ["id"]))
    calls = variants.first_variants(genomics.genotypes(vcf(spark)), ["chrom", "pos"], ["chrom", "pos"], 2)
    assert {r["chrom"] for r in calls.collect()} == {"chr1", "chr2"} and calls.count() == 6


def test_ids_and_positions(spark):
    assert ids(genomics.filter_variants(vcf(spark), passed=False, ids=["b", "x"])) == ["b"]
    long_ = genomics.parse_vcf(spark.createDataFrame([("c\t5\tz;y\tACGT\tA\t.\t.\t.",)], "value string"))
    assert genomics.filter_variants(long_, "c", 7, 9, ids=["y"]).count() == 1
    assert genomics.filter_variants(long_, "c", 7, 9, by_position=True).count() == 0


def test_read_tables(spark):
    df = spark.createDataFrame([(0, "ACGT", "IIII"), (1, "ACGT", "!!!!"), (2, "A", "I"), (3, None, None)], "read_no long, sequence string, quality string")
    assert {tuple(r) for r in reads.length_distribution(df).collect()} == {(4, 2, 66.67), (1, 1, 33.33)}
    assert {tuple(r) for r in reads.duplicate_levels(df).collect()} == {(1, 1, 1), (2, 1, 2)}
    assert [tuple(r) for r in reads.overrepresented(df).collect()] == [("ACGT", 2)]
    assert [r[0] for r in df.select(reads.mean_quality(F.col("quality"))).collect()] == [40.0, 0.0, 40.0, None]
    pairs = reads.sample_pairs(df, df.where("read_no > 0"), 2)
    assert pairs.count() == 2 and pairs.columns == ["read_no", "sequence_1", "quality_1", "sequence_2", "quality_2"]
