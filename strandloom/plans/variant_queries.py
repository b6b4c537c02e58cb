"""Queries over variants, reads and features; their lines are derived from the alignment, record and interval tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.seq import count_of
from strandloom.operators import genomics, plotdata, reads, variants
from strandloom.plans.genome_queries import _DNA
from strandloom.plans.registry import Registry
from strandloom.session import table
from strandloom.streaming.folds import run_to_end, stream_parquet

registry = Registry()
query = registry.query

# what each alignment becomes as a variant, by its number
REF_ALT = (("A", "G"), ("AC", "GT"), ("A", "AT"), ("AT", "A"), ("A", "C,G"), ("A", "<DEL>"))
KINDS = ("snv", "mnv", "insertion", "deletion", "multiallelic", "symbolic")
CALLS = ("0/0", "0/1", "1|1", "./.", "0|0", "2/1", ".")
IMPACTS = ("LOW", "MODERATE", "HIGH")
TERMS = ("synonymous_variant", "missense_variant&splice_region_variant", "stop_gained")


def _pick(values, i):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (i + 1).cast("int"))


def _as_variants(alignments: DataFrame) -> DataFrame:
    """Each mapped alignment as a VCF line of three samples."""
    a, n = alignments.where("start >= 1"), F.col("aln_id")
    call = lambda k: F.concat(_pick(CALLS, (n + k) % 7), F.lit(":"), F.col("read_length"))
    info = F.concat(F.lit("DP="), F.col("read_length"), F.when(n % 2 == 0, ";DB").otherwise(""), F.lit(";ANN=G|"), _pick(TERMS, n % 3), F.lit("|"), _pick(IMPACTS, n % 3), F.lit("|gene"), n % 5, F.lit("|ID"), n % 5, F.lit("|transcript|T"), n % 4, F.lit("|protein_coding|1/2|c.1A>G|p.Arg"), n % 9, F.lit("Gly"))
    fields = ["reference", "start", n, _pick([r for r, _ in REF_ALT], n % 6), _pick([x for _, x in REF_ALT], n % 6), F.coalesce(F.col("mapq").cast("string"), F.lit(".")), F.when(F.col("flag").bitwiseAND(F.lit(512)) != 0, "q10").otherwise("PASS"), info, F.lit("GT:DP"), call(0), call(2), call(5)]
    return a.select(F.concat_ws("\t", *(F.col(f).cast("string") if isinstance(f, str) else f.cast("string") for f in fields)).alias("value"))


def _variant_lines(spark: SparkSession, d: str) -> DataFrame:
    return _as_variants(table(spark, d, "sam_alignments"))


def _variants(spark: SparkSession, d: str) -> DataFrame:
    return genomics.parse_vcf(_variant_lines(spark, d))


_V = f"""WITH v AS (SELECT aln_id, reference AS chrom, start AS pos, mapq, flag, read_length AS dp, [{", ".join(f"'{k}'" for k in KINDS)}][CAST(aln_id % 6 + 1 AS INTEGER)] AS kind,
 [{", ".join(f"'{c}'" for c in CALLS)}] AS calls, aln_id % 3 AS k FROM sam_alignments WHERE start >= 1), g AS (SELECT *, [calls[CAST(aln_id % 7 + 1 AS INTEGER)], calls[CAST((aln_id + 2) % 7 + 1 AS INTEGER)], calls[CAST((aln_id + 5) % 7 + 1 AS INTEGER)]] AS gt FROM v)"""


@query(_V + " SELECT kind, count(*) AS n, CAST(count(*) FILTER (flag & 512 = 0) AS BIGINT) AS n_passed FROM v GROUP BY kind")
def vcf_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Variants by kind."""
    return _variants(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("filter") == "PASS").alias("n_passed"))


@query(_V + """ SELECT CAST(aln_id AS VARCHAR) AS id, CAST(3 AS BIGINT) AS n_samples, CAST(len(list_filter(gt, lambda x: x IN ('./.', '.'))) AS BIGINT) AS n_missing, CAST(len(list_filter(gt, lambda x: x NOT IN ('./.', '.'))) AS BIGINT) AS n_called,
 CAST(len(list_filter(gt, lambda x: x IN ('0/0', '0|0'))) AS BIGINT) AS n_reference, CAST(len(list_filter(gt, lambda x: x IN ('0/0', '0|0'))) AS BIGINT) AS n_hom_ref, round(len(list_filter(gt, lambda x: x IN ('./.', '.'))) / 3, 4) AS missing_rate FROM g""")
def vcf_sites(spark: SparkSession, d: str) -> DataFrame:
    """Genotype figures of each site."""
    sites = variants.site_figures(_variants(spark, d))
    return sites.select("id", "n_samples", "n_missing", "n_called", "n_reference", "n_hom_ref", F.round("missing_rate", 4).alias("missing_rate"))


@query(_V + " SELECT CAST(aln_id AS VARCHAR) AS id FROM g WHERE kind IN ('snv', 'deletion') AND flag & 512 = 0 AND mapq >= 20 AND dp >= 100 AND aln_id % 2 = 0 AND len(list_filter(gt, lambda x: x IN ('./.', '.'))) > 0")
def vcf_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Variants by FILTER, quality, kind, INFO and genotypes."""
    info = variants.info_is(F.col("info"), "DP", ">=", "100") & variants.info_is(F.col("info"), "DB", "=", "true")
    kept = genomics.filter_variants(_variants(spark, d), min_qual=20, kinds=["snv", "deletion"], info=info)
    return variants.filter_sites(kept, "any-missing").select("id")


@query(_V + """ SELECT chrom, impact, gene, count(*) AS n FROM (SELECT chrom, ['LOW', 'MODERATE', 'HIGH'][CAST(k + 1 AS INTEGER)] AS impact, 'gene' || (aln_id % 5) AS gene FROM v) GROUP BY ALL""")
def vcf_consequences(spark: SparkSession, d: str) -> DataFrame:
    """Annotations by chromosome, impact and gene."""
    return variants.consequences(_variants(spark, d), ["chrom"]).groupBy("chrom", "impact", "gene").agg(F.count("*").alias("n"))


@query(_V + " SELECT CAST(aln_id AS VARCHAR) AS id FROM v WHERE k = 1 AND aln_id % 5 IN (2, 3)")
def vcf_missense(spark: SparkSession, d: str) -> DataFrame:
    """Variants with a splice-region missense consequence of moderate impact in two genes."""
    return variants.with_consequence(_variants(spark, d), ["id"], impact="moderate", terms=["splice_region_variant"], genes=["GENE2", "id3"], protein=["p.arg"])


@query(_V + " SELECT CAST(aln_id AS VARCHAR) AS id, CAST(dp AS VARCHAR) AS info_DP, CASE WHEN aln_id % 2 = 0 THEN '' END AS info_DB FROM v")
def vcf_info_table(spark: SparkSession, d: str) -> DataFrame:
    """INFO tags as columns."""
    return variants.split_info(_variants(spark, d), ["DP", "DB"]).select("id", "info_DP", "info_DB")


@query(_V + """, s AS (SELECT unnest(['left', 'middle', 'right']) AS sample, unnest(gt) AS x FROM g) SELECT sample, CASE WHEN x IN ('./.', '.') THEN 'missing' WHEN x IN ('0/0', '0|0') THEN 'hom_ref' WHEN x = '1|1' THEN 'hom_alt' ELSE 'het' END AS call, count(*) AS n FROM s GROUP BY ALL""")
def vcf_calls(spark: SparkSession, d: str) -> DataFrame:
    """Genotype classes by sample."""
    rows = genomics.genotypes(_variants(spark, d), ["left", "middle", "right"])
    return rows.groupBy("sample", genomics.genotype_class(F.col("gt")).alias("call")).agg(F.count("*").alias("n"))


@query(_V + """ SELECT count(*) AS n, count(DISTINCT value) AS n_distinct, CAST(sum(length(value)) AS BIGINT) AS n_letters, min(value) AS first_line, max(value) AS last_line FROM (SELECT concat_ws(chr(9), chrom, pos, CAST(aln_id AS VARCHAR), ['A', 'AC', 'A', 'AT', 'A', 'A'][CAST(aln_id % 6 + 1 AS INTEGER)], ['G', 'GT', 'AT', 'A', 'C,G', '<DEL>'][CAST(aln_id % 6 + 1 AS INTEGER)], coalesce(CAST(mapq AS VARCHAR), '.'), CASE WHEN flag & 512 <> 0 THEN 'q10' ELSE 'PASS' END,
 'DP=' || dp || CASE WHEN aln_id % 2 = 0 THEN ';DB' ELSE '' END || ';ANN=G|' || ['synonymous_variant', 'missense_variant&splice_region_variant', 'stop_gained'][CAST(k + 1 AS INTEGER)] || '|' || ['LOW', 'MODERATE', 'HIGH'][CAST(k + 1 AS INTEGER)] || '|gene' || (aln_id % 5) || '|ID' || (aln_id % 5) || '|transcript|T' || (aln_id % 4) || '|protein_coding|1/2|c.1A>G|p.Arg' || (aln_id % 9) || 'Gly', 'GT:DP', gt[3] || ':' || dp, gt[1] || ':' || dp) AS value FROM g)""")
def vcf_projected(spark: SparkSession, d: str) -> DataFrame:
    """Lines written with the third and the first sample only: figures over all of them."""
    lines = variants.project_lines(_variant_lines(spark, d), [2, 0])
    return lines.agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_distinct"), F.sum(F.length("value")).alias("n_letters"), F.min("value").alias("first_line"), F.max("value").alias("last_line"))


@query()
def vcf_sampled(spark: SparkSession, d: str) -> DataFrame:
    """A seeded sample of 200 biallelic variants (a sampling operator)."""
    return variants.sample_variants(_variants(spark, d), 200, ["id"], biallelic=True, most_missing=0.5).select("chrom", "pos", "id", "kind")


_READS = f"""WITH s AS ({_DNA}), r AS (SELECT record_id, regexp_replace(s, '[^ACGTN]', '', 'g') AS s FROM s), q AS (SELECT record_id, s, translate(s, 'ACGTN', 'I?5+#') AS q FROM r WHERE s <> '')"""


def _as_reads(sequences: DataFrame) -> DataFrame:
    """DNA records as reads, with a quality for each letter."""
    letters = F.translate(F.upper(F.regexp_replace("sequence", r"\s+", "")), "U", "T")
    rows = sequences.where("alphabet = 'dna-rna' AND sequence IS NOT NULL").select("record_id", F.regexp_replace(letters, "[^ACGTN]", "").alias("sequence")).where("sequence <> ''")
    return rows.select("record_id", "sequence", F.translate("sequence", "ACGTN", "I?5+#").alias("quality"))


def _reads(spark: SparkSession, d: str) -> DataFrame:
    return _as_reads(table(spark, d, "sequence_records"))


@query(_V + " SELECT kind, count(*) AS n, CAST(count(*) FILTER (dp >= 100) AS BIGINT) AS n_deep FROM v WHERE flag & 512 = 0 GROUP BY kind")
def stream_variants(spark: SparkSession, d: str) -> DataFrame:
    """Variant lines parsed and filtered as a stream, counted by kind."""
    stream = stream_parquet(spark, f"{d}/sam_alignment[s].parquet", table(spark, d, "sam_alignments").schema)
    kept = genomics.filter_variants(genomics.parse_vcf(_as_variants(stream)))
    return run_to_end(kept.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(variants.info_is(F.col("info"), "DP", ">=", "100")).alias("n_deep")), ["kind"])


@query(_READS + """ SELECT length(s) AS length, count(*) AS n, CAST(sum(length(regexp_replace(s, '[^GC]', '', 'g'))) AS BIGINT) AS gc, CAST(sum(length(regexp_replace(s, '[^AC]', '', 'g'))) AS BIGINT) AS q30 FROM q GROUP BY 1""")
def stream_reads(spark: SparkSession, d: str) -> DataFrame:
    """Reads folded by length as a stream: their number, G and C, and letters of quality 30 and more."""
    stream = stream_parquet(spark, f"{d}/sequence_record[s].parquet", table(spark, d, "sequence_records").schema)
    good = F.length(F.regexp_replace("quality", "[!->]", ""))
    folded = _as_reads(stream).groupBy(F.length("sequence").alias("length")).agg(F.count("*").alias("n"), F.sum(count_of(F.col("sequence"), "GC")).alias("gc"), F.sum(good).alias("q30"))
    return run_to_end(folded, ["length"])


@query(_READS + """ SELECT count(*) AS n_reads, CAST(sum(length(s)) AS BIGINT) AS n_bases, min(length(s)) AS min_length, max(length(s)) AS max_length, round(sum(length(regexp_replace(s, '[^GC]', '', 'g'))) * 100 / sum(length(s)), 2) AS gc_percent,
 round(sum(length(regexp_replace(s, '[^N]', '', 'g'))) * 100 / sum(length(s)), 2) AS n_percent, round(sum(length(regexp_replace(s, '[^ACG]', '', 'g'))) * 100 / sum(length(s)), 2) AS q20_percent, round(sum(length(regexp_replace(s, '[^AC]', '', 'g'))) * 100 / sum(length(s)), 2) AS q30_percent FROM q""")
def read_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals over reads."""
    return genomics.read_summary(_reads(spark, d))


@query(_READS + """, p AS (SELECT i AS cycle, ascii(substr(q, CAST(i AS INTEGER), 1)) - 33 AS q FROM (SELECT q, unnest(range(1, length(q) + 1)) AS i FROM q)) SELECT CAST(cycle AS INTEGER) AS cycle, count(*) AS n, round(avg(q), 6) AS mean, quantile_cont(q, 0.25) AS q1, quantile_cont(q, 0.5) AS median, quantile_cont(q, 0.75) AS q3 FROM p GROUP BY cycle""")
def read_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Qualities by cycle."""
    return genomics.position_qualities(_reads(spark, d))


@query(_READS + " SELECT length(s) AS length, count(*) AS n, round(count(*) * 100 / (SELECT count(*) FROM q), 2) AS percent FROM q GROUP BY 1")
def read_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Reads by length."""
    return reads.length_distribution(_reads(spark, d))


@query(_READS + ", c AS (SELECT s, count(*) AS n FROM q GROUP BY s) SELECT n AS copies, count(*) AS n_sequences, CAST(sum(n) AS BIGINT) AS n_reads FROM c GROUP BY n")
def read_copies(spark: SparkSession, d: str) -> DataFrame:
    """Duplicate levels: how many sequences occur how often."""
    return reads.duplicate_levels(_reads(spark, d))


@query(_READS + """, m AS (SELECT list_avg(list_transform(range(1, length(q) + 1), lambda i: ascii(substr(q, CAST(i AS INTEGER), 1)) - 33)) AS m FROM q), b AS (SELECT CAST(least(9, greatest(0, floor(m / 5))) AS INTEGER) AS bin, count(*) AS n FROM m GROUP BY 1)
SELECT CAST(x AS INTEGER) AS bin, CAST(x * 5 AS DOUBLE) AS bin_start, coalesce(n, 0) AS n FROM (SELECT unnest(range(10)) AS x) LEFT JOIN b ON bin = x""")
def read_quality_bins(spark: SparkSession, d: str) -> DataFrame:
    """Mean qualities of reads in bins of 5."""
    return genomics.binned(_reads(spark, d), reads.mean_quality(F.col("quality")), 0.0, 50.0, 5.0)


@query()
def reads_sampled(spark: SparkSession, d: str) -> DataFrame:
    """A seeded sample of 100 read pairs (a sampling operator); the second mates are the reversed records."""
    first = _reads(spark, d).withColumnRenamed("record_id", "read_no")
    second = first.select("read_no", F.reverse("sequence").alias("sequence"), F.reverse("quality").alias("quality"))
    return reads.sample_pairs(first, second, 100)


_FEATURES = """WITH f AS (SELECT interval_id, regexp_replace(record, '^[\\s\\x0B\\x{85}\\p{Z}]+|[\\s\\x0B\\x{85}\\p{Z}]+$', '', 'g') AS record, start, "end", operation, source_set FROM genomic_intervals WHERE start >= 1 AND "end" >= start AND record IS NOT NULL)"""


def _feature_lines(spark: SparkSession, d: str) -> DataFrame:
    """Valid intervals as GFF3 lines whose parent is their set."""
    rows = table(spark, d, "genomic_intervals").where("start >= 1 AND `end` >= start AND record IS NOT NULL")
    fields = [F.regexp_replace("record", r"(?U)^\s+|\s+$", ""), F.lit("table"), F.col("operation"), F.col("start"), F.col("end"), F.lit("."), F.coalesce("strand", F.lit(".")), F.lit("."), F.concat(F.lit("ID=i"), "interval_id", F.lit(";Parent="), "source_set", F.lit(";Note=a%20b"))]
    return rows.select(F.concat_ws("\t", *(x.cast("string") for x in fields)).alias("value"))


@query(_FEATURES + """ SELECT source_set AS parent, operation AS type, count(*) AS n, min(start) AS start, max("end") AS "end", CAST(sum("end" - start + 1) AS BIGINT) AS bp FROM f WHERE lower(operation) IN ('merge', 'nearest') GROUP BY ALL""")
def gff_parts(spark: SparkSession, d: str) -> DataFrame:
    """Features of two types by parent."""
    features = genomics.features_of_type(genomics.parse_features(_feature_lines(spark, d)), ["MERGE", "nearest"])
    return genomics.transcript_parts(features)


@query(_FEATURES + """ SELECT record, count(*) AS n, CAST(sum(start) AS BIGINT) AS starts, CAST(sum("end") AS BIGINT) AS ends FROM f GROUP BY record""")
def bed_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Features written as BED lines and parsed again."""
    from strandloom.sources.writers import bed_lines

    features = genomics.parse_features(_feature_lines(spark, d)).withColumn("name", F.col("type"))
    return genomics.parse_bed(bed_lines(features)).groupBy("record").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"))


@query("""SELECT aln_id FROM sam_alignments WHERE status <> 'unmapped' AND reference = 'ctg02' AND "end" >= 1000000 AND start <= 9000000""")
def sam_region(spark: SparkSession, d: str) -> DataFrame:
    """Mapped alignments that overlap a region."""
    return table(spark, d, "sam_alignments").where(genomics.overlaps_region("ctg02", 1_000_000, 9_000_000)).select("aln_id")


@query("""WITH l AS (SELECT reference, length, CAST(ceil(length / 50) AS BIGINT) AS w FROM sam_references WHERE length > 0), i AS (SELECT reference, start AS a, least("end", length) AS b, w, length FROM sam_alignments JOIN l USING (reference) WHERE start >= 1 AND "end" >= start AND start <= length),
e AS (SELECT reference, a, b, w, length, unnest(range((a - 1) // w, (b - 1) // w + 1)) AS bin FROM i)
SELECT reference, bin, bin * w + 1 AS bin_start, least((bin + 1) * w, length) AS bin_end, count(*) AS n, CAST(sum(least(b, least((bin + 1) * w, length)) - greatest(a, bin * w + 1) + 1) AS BIGINT) AS covered FROM e GROUP BY ALL""")
def track_bins(spark: SparkSession, d: str) -> DataFrame:
    """Alignments in 50 bins of each reference."""
    return plotdata.track_summary(table(spark, d, "sam_alignments"), "reference", "start", "end", table(spark, d, "sam_references").select("reference", "length"), 50)
