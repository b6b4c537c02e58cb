"""Queries over intervals, alignments and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import seq
from strandloom.operators import genomics, intervals, records, scan
from strandloom.operators.periods import valid_intervals
from strandloom.plans.registry import Registry
from strandloom.session import table

registry = Registry()
query = registry.query

_IV = r"""WITH v AS (SELECT interval_id, regexp_replace(record, '^[\s\x0B\x{85}\p{Z}]+|[\s\x0B\x{85}\p{Z}]+$', '', 'g') AS record, start AS s, "end" AS e, operation FROM genomic_intervals WHERE start >= 1 AND "end" >= start),
i AS (SELECT * FROM v WHERE record <> ''), q AS (SELECT interval_id, record, s, e FROM i WHERE operation = 'subtract'), r AS (SELECT interval_id AS ref_interval_id, record, s AS rs, e AS re FROM i WHERE operation = 'merge')"""
_ISLANDS = """, o AS (SELECT record, rs, re, max(re) OVER (PARTITION BY record ORDER BY rs, re ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM r), n AS (SELECT record, rs, re, sum(CASE WHEN b IS NULL OR rs > b + {gap} + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY record ORDER BY rs, re ROWS UNBOUNDED PRECEDING) AS k FROM o),
m AS (SELECT record, min(rs) AS ms, max(re) AS me FROM n GROUP BY record, k)"""


def _intervals(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "genomic_intervals").select("interval_id", F.regexp_replace("record", r"(?U)^\s+|\s+$", "").alias("record"), "start", "end", "operation")
    good = rows.where("record <> '' AND start >= 1 AND `end` >= start")
    return good.where("operation = 'subtract'").drop("operation"), good.where("operation = 'merge'").drop("operation")


@query(_IV + " SELECT interval_id, ref_interval_id, least(e, re) - greatest(s, rs) + 1 AS overlap_bp FROM q JOIN r ON q.record = r.record AND s <= re AND rs <= e WHERE least(e, re) - greatest(s, rs) + 1 >= 10")
def interval_intersect(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that share at least 10 positions."""
    a, b = _intervals(spark, d)
    return intervals.intersect(a, b, 10).select("interval_id", "ref_interval_id", "overlap_bp")


@query(_IV + " SELECT interval_id, ref_interval_id FROM q JOIN r ON q.record = r.record AND s <= re AND rs <= e WHERE least(e, re) - greatest(s, rs) + 1 >= 0.5 * (e - s + 1) AND least(e, re) - greatest(s, rs) + 1 >= 0.5 * (re - rs + 1)")
def interval_reciprocal(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that share half of each."""
    a, b = _intervals(spark, d)
    return intervals.intersect(a, b, 1, 0.5).select("interval_id", "ref_interval_id")


@query(_IV + " SELECT interval_id, min(CASE WHEN rs IS NOT NULL THEN greatest(0, rs - e, s - re) END) AS distance FROM q LEFT JOIN r ON q.record = r.record GROUP BY interval_id")
def interval_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Distance to the nearest reference."""
    a, b = _intervals(spark, d)
    return intervals.nearest(a, b, ["interval_id"])


@query(_IV + _ISLANDS.format(gap=100) + ' SELECT record, ms AS start, me AS "end" FROM m')
def interval_merge(spark: SparkSession, d: str) -> DataFrame:
    """Periods that bridge gaps of up to 100 positions."""
    return intervals.merge(_intervals(spark, d)[1].select("record", "start", "end"), gap=100)


@query(_IV + _ISLANDS.format(gap=0) + """, h AS (SELECT interval_id, record, s, e, ms, me FROM q LEFT JOIN m USING (record) WHERE ms IS NULL OR ms <= e AND me >= s), z AS (SELECT interval_id, record, s, e, ms, me FROM h UNION ALL SELECT interval_id, record, s, e, NULL, s - 1 FROM q UNION ALL SELECT interval_id, record, s, e, e + 1, NULL FROM q),
y AS (SELECT interval_id, record, me, lead(ms) OVER (PARTITION BY interval_id ORDER BY coalesce(ms, me - 1000000000) , me) AS nx FROM z WHERE ms IS NOT NULL OR me IS NOT NULL)
SELECT interval_id, record, me + 1 AS start, nx - 1 AS "end" FROM y WHERE me + 1 <= nx - 1""")
def interval_subtract(spark: SparkSession, d: str) -> DataFrame:
    """Parts that no reference covers."""
    a, b = _intervals(spark, d)
    return intervals.subtract(a, b, ["interval_id"])


_ALL = _IV + ", a AS (SELECT interval_id AS ref_interval_id, record, s AS rs, e AS re FROM i)"


def _every_interval(spark: SparkSession, d: str) -> DataFrame:
    """All valid rows, whatever their operation."""
    return valid_intervals(table(spark, d, "genomic_intervals"), ["record", "interval_id"]).select("interval_id", "record", F.col("seg_start").alias("start"), F.col("seg_end").alias("end"))


@query(_ALL + " SELECT interval_id, ref_interval_id, least(e, re) - greatest(s, rs) + 1 AS overlap_bp FROM i JOIN a ON i.record = a.record AND s <= re AND rs <= e WHERE interval_id < ref_interval_id AND least(e, re) - greatest(s, rs) + 1 >= 10")
def interval_intersect_all(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of any two intervals that share at least 10 positions; each pair once, the smaller id first."""
    rows = _every_interval(spark, d)
    return intervals.intersect(rows, rows, 10).where("interval_id < ref_interval_id").select("interval_id", "ref_interval_id", "overlap_bp")


@query(_ALL + " SELECT interval_id, ref_interval_id FROM i JOIN a ON i.record = a.record AND s <= re AND rs <= e WHERE interval_id < ref_interval_id AND least(e, re) - greatest(s, rs) + 1 >= 0.5 * (e - s + 1) AND least(e, re) - greatest(s, rs) + 1 >= 0.5 * (re - rs + 1)")
def interval_reciprocal_all(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of any two intervals that share half of each; each pair once, the smaller id first."""
    rows = _every_interval(spark, d)
    return intervals.intersect(rows, rows, 1, 0.5).where("interval_id < ref_interval_id").select("interval_id", "ref_interval_id")


@query()
def interval_nearest_all(spark: SparkSession, d: str) -> DataFrame:
    """Distance of every interval to the nearest other one."""
    return intervals.nearest_other(_every_interval(spark, d), "interval_id")


@query(_IV.replace("r AS (SELECT interval_id AS ref_interval_id, record, s AS rs, e AS re FROM i WHERE operation = 'merge')", "r AS (SELECT DISTINCT record, s AS rs, e AS re FROM i)") + _ISLANDS.format(gap=100) + ' SELECT record, ms AS start, me AS "end" FROM m')
def interval_merge_all(spark: SparkSession, d: str) -> DataFrame:
    """Periods of all intervals that bridge gaps of up to 100 positions."""
    return intervals.merge(_every_interval(spark, d).select("record", "start", "end"), gap=100)


@query()
def interval_subtract_all(spark: SparkSession, d: str) -> DataFrame:
    """Parts of every interval that no other one covers."""
    return intervals.subtract_others(_every_interval(spark, d), "interval_id")


_SWEEP = """e AS (SELECT k, p, sum(d) AS d FROM (SELECT {k} AS k, {s} AS p, 1 AS d FROM {f} UNION ALL SELECT {k}, {e} + 1, -1 FROM {f}) GROUP BY k, p), w AS (SELECT k, p, sum(d) OVER (PARTITION BY k ORDER BY p) AS depth, lead(p) OVER (PARTITION BY k ORDER BY p) - 1 AS q FROM e)"""


@query(_IV + ", " + _SWEEP.format(k="record", s="s", e="e", f="i") + ' SELECT k AS record, p AS start, q AS "end", CAST(depth AS BIGINT) AS depth FROM w WHERE depth > 0')
def interval_depth(spark: SparkSession, d: str) -> DataFrame:
    """Runs of equal depth."""
    rows = valid_intervals(table(spark, d, "genomic_intervals"), ["record"])
    return intervals.depth(rows, ["record"], "seg_start", "seg_end")


@query(_IV + ", " + _SWEEP.format(k="record", s="s", e="e", f="i") + " SELECT k AS record, CAST(sum(q - p + 1) AS BIGINT) AS covered, CAST(sum(depth * (q - p + 1)) AS BIGINT) AS total_depth, round(sum(depth * (q - p + 1)) / sum(q - p + 1), 6) AS mean_depth, CAST(max(depth) AS BIGINT) AS max_depth FROM w WHERE depth > 0 GROUP BY k")
def interval_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Covered positions and depth by record."""
    return intervals.depth_summary(interval_depth(spark, d), ["record"])


@query(_IV + """, l AS (SELECT reference AS record, length FROM sam_references WHERE length IS NOT NULL), x AS (SELECT record, s AS rs, e AS re FROM i JOIN l USING (record) UNION ALL SELECT record, 0, 0 FROM l UNION ALL SELECT record, length + 1, length + 1 FROM l),
y AS (SELECT record, re, rs, max(re) OVER (PARTITION BY record ORDER BY rs, re ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM x)
SELECT record, b + 1 AS start, rs - 1 AS "end" FROM y JOIN l USING (record) WHERE rs > b + 1 AND rs - 1 <= length""")
def interval_complement(spark: SparkSession, d: str) -> DataFrame:
    """Uncovered positions of each reference."""
    rows = valid_intervals(table(spark, d, "genomic_intervals"), ["record"]).select("record", F.col("seg_start").alias("start"), F.col("seg_end").alias("end"))
    return intervals.complement(rows, table(spark, d, "sam_references").select(F.col("reference").alias("record"), "length"))


@query("SELECT f AS flag_name, CAST(bit AS INTEGER) AS bit, CAST(count(*) FILTER (flag & bit <> 0) AS BIGINT) AS n FROM sam_alignments, (VALUES ('paired', 1), ('proper_pair', 2), ('unmapped', 4), ('mate_unmapped', 8), ('reverse', 16), ('mate_reverse', 32), ('first_in_pair', 64), ('second_in_pair', 128), ('secondary', 256), ('qc_fail', 512), ('duplicate', 1024), ('supplementary', 2048)) v(f, bit) GROUP BY ALL")
def sam_flags(spark: SparkSession, d: str) -> DataFrame:
    """Alignments by FLAG bit."""
    return genomics.flag_counts(table(spark, d, "sam_alignments"))


_CIGAR = "list_sum(list_transform(regexp_extract_all(cigar, '[0-9]+[{ops}]'), lambda x: CAST(x[:-2] AS BIGINT)))"


@query(f"""SELECT reference, count(*) AS n_rows, CAST(count(*) FILTER (flag & 4 = 0 AND reference <> '*') AS BIGINT) AS n_mapped, CAST(count(*) FILTER (strand = '+') AS BIGINT) AS n_plus, CAST(count(*) FILTER (strand = '-') AS BIGINT) AS n_minus, round(avg(mapq), 6) AS mean_mapq, round(avg(read_length), 6) AS mean_read_length,
 CAST(sum(CASE WHEN flag & 4 = 0 AND reference <> '*' THEN coalesce({_CIGAR.format(ops='MDN=X')}, 0) END) AS BIGINT) AS span_bp FROM sam_alignments GROUP BY reference""")
def sam_references_summary(spark: SparkSession, d: str) -> DataFrame:
    """Figures by reference."""
    return genomics.reference_summary(table(spark, d, "sam_alignments"))


@query(f"SELECT aln_id, CAST(coalesce({_CIGAR.format(ops='MDN=X')}, 0) AS BIGINT) AS span, CAST(coalesce({_CIGAR.format(ops='MIS=X')}, 0) AS BIGINT) AS used FROM sam_alignments")
def cigar_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Reference span and read length of each CIGAR string."""
    c = F.col("cigar")
    return table(spark, d, "sam_alignments").select("aln_id", seq.reference_span(c).alias("span"), seq.query_length(c).alias("used"))


@query("SELECT status, CASE WHEN flag & 4 <> 0 THEN 'unmapped' WHEN flag & 1 = 0 THEN 'single' WHEN flag & 8 <> 0 THEN 'mate_unmapped' WHEN flag & 2 <> 0 THEN 'proper' ELSE 'improper' END AS pair, count(*) AS n FROM sam_alignments GROUP BY ALL")
def sam_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Alignments by status and pair."""
    return table(spark, d, "sam_alignments").groupBy("status", seq.pair_status(F.col("flag")).alias("pair")).agg(F.count("*").alias("n"))


_BLOCK_SWEEP = """WITH c AS (SELECT aln_id, reference, start, unnest(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]')) AS op, generate_subscripts(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]'), 1) AS i FROM sam_alignments WHERE reference <> '*' AND start >= 1 AND flag & 4 = 0),
p AS (SELECT *, start + coalesce(sum(CASE WHEN op[-1:] IN ('M', 'D', 'N', '=', 'X') THEN CAST(op[:-2] AS BIGINT) ELSE 0 END) OVER (PARTITION BY aln_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM c),
b AS (SELECT reference, s, s + CAST(op[:-2] AS BIGINT) - 1 AS t FROM p WHERE op[-1:] IN ('M', '=', 'X') AND CAST(op[:-2] AS BIGINT) > 0), """ + _SWEEP.format(k="reference", s="s", e="t", f="b") + """"""


@query(_BLOCK_SWEEP + """
SELECT k AS reference, CAST(sum(q - p + 1) AS BIGINT) AS covered, CAST(sum(depth * (q - p + 1)) AS BIGINT) AS total_depth, round(sum(depth * (q - p + 1)) / sum(q - p + 1), 6) AS mean_depth, CAST(max(depth) AS BIGINT) AS max_depth FROM w WHERE depth > 0 GROUP BY k""")
def sam_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Coverage by reference from aligned blocks."""
    return intervals.depth_summary(genomics.alignment_depth(table(spark, d, "sam_alignments")), ["reference"])


@query(_BLOCK_SWEEP + """, x AS (SELECT k AS reference, p, q, depth, unnest(range(CAST((p - 1) // 100000 AS BIGINT), CAST((q - 1) // 100000 + 1 AS BIGINT))) AS w FROM w WHERE depth > 0), y AS (SELECT reference, w, depth, least(q, (w + 1) * 100000) - greatest(p, w * 100000 + 1) + 1 AS n FROM x)
SELECT reference, CAST(w * 100000 + 1 AS BIGINT) AS window_start, CAST(sum(n) AS BIGINT) AS covered, round(sum(n * depth) / 100000, 6) AS mean_depth, CAST(max(depth) AS BIGINT) AS max_depth FROM y GROUP BY ALL""")
def sam_window_depth(spark: SparkSession, d: str) -> DataFrame:
    """Depth in windows of 100,000 positions."""
    return genomics.window_depth(genomics.alignment_depth(table(spark, d, "sam_alignments")))


@query("SELECT CAST(b AS INTEGER) AS bin, CAST(b * 10 AS DOUBLE) AS bin_start, coalesce(n, 0) AS n FROM (SELECT unnest(range(10)) AS b) LEFT JOIN (SELECT greatest(0, least(9, mapq // 10)) AS b, count(*) AS n FROM sam_alignments WHERE mapq IS NOT NULL GROUP BY 1) USING (b)")
def mapq_bins(spark: SparkSession, d: str) -> DataFrame:
    """mapq in bins of 10."""
    return genomics.binned(table(spark, d, "sam_alignments"), F.col("mapq"), 0.0, 100.0, 10.0)


_CLEAN = "upper(regexp_replace(sequence, '\\s+', '', 'g'))"


@query(f"""WITH s AS (SELECT record_id, {_CLEAN} AS s FROM sequence_records WHERE sequence IS NOT NULL), c AS (SELECT record_id, s, length(regexp_replace(s, '[^ACGTU]', '', 'g')) AS k FROM s)
SELECT record_id, length(s) AS length, round(length(regexp_replace(s, '[^GC]', '', 'g')) * 100 / CASE WHEN k > 0 THEN k END, 4) AS gc_percent, length(regexp_replace(s, '[^RYSWKMBDHVN]', '', 'g')) AS n_ambiguous, length(regexp_replace(s, '[^-.]', '', 'g')) AS n_gaps FROM c""")
def sequence_stats(spark: SparkSession, d: str) -> DataFrame:
    """Length and composition of each record."""
    rows = table(spark, d, "sequence_records").where("sequence IS NOT NULL")
    return genomics.record_stats(rows, ["record_id"], F.regexp_replace("sequence", r"\s+", ""))


@query("SELECT record_id, reverse(translate(sequence, 'ACGTURYSWKMBDHVNacgturyswkmbdhvn', 'TGCAAYRSWMKVHDBNtgcaayrswmkvhdbn')) AS turned FROM sequence_records WHERE alphabet = 'dna-rna' AND sequence IS NOT NULL")
def reverse_complements(spark: SparkSession, d: str) -> DataFrame:
    """Reverse complement of each record."""
    return table(spark, d, "sequence_records").where("alphabet = 'dna-rna' AND sequence IS NOT NULL").select("record_id", seq.reverse_complement(F.col("sequence")).alias("turned"))


_DNA = f"SELECT record_id, replace({_CLEAN}, 'U', 'T') AS s FROM sequence_records WHERE alphabet = 'dna-rna' AND sequence IS NOT NULL"


def _dna(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sequence_records").where("alphabet = 'dna-rna' AND sequence IS NOT NULL").select("record_id", "source_file", F.translate(F.upper(F.regexp_replace("sequence", r"\s+", "")), "U", "T").alias("sequence"))


_CODE = "MAP {" + ", ".join(f"'{c}': '{a}'" for c, a in zip(seq.CODONS, seq.STANDARD_CODE, strict=True)) + "}"


@query(f"WITH s AS ({_DNA}) SELECT record_id, CASE WHEN length(s) < 3 THEN '' ELSE array_to_string(list_transform(range(0, length(s) // 3), lambda i: coalesce({_CODE}[s[CAST(i * 3 + 1 AS BIGINT):CAST(i * 3 + 3 AS BIGINT)]], 'X')), '') END AS protein FROM s")
def translations(spark: SparkSession, d: str) -> DataFrame:
    """Frame 1 of each record as protein."""
    return _dna(spark, d).select("record_id", seq.translate(F.col("sequence")).alias("protein"))


@query(f"""WITH s AS ({_DNA}), c AS (SELECT unnest(list_transform(range(0, length(s) // 3), lambda i: s[CAST(i * 3 + 1 AS BIGINT):CAST(i * 3 + 3 AS BIGINT)])) AS codon FROM s), n AS (SELECT codon, {_CODE}[codon] AS amino_acid, count(*) AS n FROM c GROUP BY ALL)
SELECT codon, amino_acid, n, round(n * 1000 / sum(n) OVER (), 4) AS per_thousand, round(n / sum(n) OVER (PARTITION BY amino_acid), 4) AS fraction FROM n WHERE amino_acid IS NOT NULL""")
def codon_usage(spark: SparkSession, d: str) -> DataFrame:
    """Codon counts over all records."""
    return scan.codon_usage(_dna(spark, d), [], "sequence")


@query(f"""WITH s AS ({_DNA}), w AS (SELECT record_id, unnest(range(1, length(s) - 98, 50)) AS a, s FROM s WHERE length(s) >= 100), t AS (SELECT record_id, a, s[a:a + 99] AS t FROM w), c AS (SELECT record_id, a, length(regexp_replace(t, '[^G]', '', 'g')) AS g, length(regexp_replace(t, '[^C]', '', 'g')) AS c, length(regexp_replace(t, '[^ACGTU]', '', 'g')) AS k FROM t)
SELECT record_id, CAST(a AS INTEGER) AS start, CAST(a + 99 AS INTEGER) AS "end", round((g + c) * 100 / CASE WHEN k > 0 THEN k END, 4) AS gc_percent, round((g - c) / CASE WHEN g + c > 0 THEN g + c END, 4) AS gc_skew FROM c""")
def composition_windows(spark: SparkSession, d: str) -> DataFrame:
    """Sliding windows of 100 letters, step 50."""
    return scan.windows_of(_dna(spark, d), ["record_id"], "sequence", 100, 50)


_SITES = f"""WITH s AS ({_DNA}), p AS (SELECT record_id, s, length(s) AS n, unnest(range(1, length(s) + 1)) AS a FROM s), t AS (SELECT record_id, n, CASE substr(s, CAST(a AS INTEGER), 6) WHEN 'GAATTC' THEN 'EcoRI' WHEN 'GGATCC' THEN 'BamHI' WHEN 'AAGCTT' THEN 'HindIII' END AS motif, a FROM p)"""
_ENZYMES = {"EcoRI": "GAATTC", "BamHI": "GGATCC", "HindIII": "AAGCTT"}


@query(_SITES + """ SELECT record_id, motif, '+' AS strand, a AS start, a + 5 AS "end" FROM t WHERE motif IS NOT NULL""")
def restriction_sites(spark: SparkSession, d: str) -> DataFrame:
    """Recognition sites of three enzymes."""
    return scan.find_motifs(_dna(spark, d), "record_id", "sequence", _ENZYMES)


@query(_SITES + """, c AS (SELECT record_id, a AS cut FROM t WHERE motif IS NOT NULL AND a < n UNION SELECT record_id, length(s) FROM s WHERE s <> '') SELECT record_id, coalesce(lag(cut) OVER (PARTITION BY record_id ORDER BY cut), 0) + 1 AS start, cut AS "end" FROM c""")
def restriction_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Fragments after cutting one letter into each site."""
    rows = _dna(spark, d)
    return scan.fragments(scan.find_motifs(rows, "record_id", "sequence", _ENZYMES), rows.select("record_id", F.length("sequence").cast("long").alias("length")))


@query(_SITES + """ SELECT f.record_id, f.a AS start, r.a + 5 AS "end", r.a + 5 - f.a + 1 AS length FROM t f JOIN t r USING (record_id) WHERE f.motif = 'EcoRI' AND r.motif = 'HindIII' AND r.a > f.a + 5 AND r.a + 5 - f.a + 1 BETWEEN 50 AND 1000""")
def pcr_products(spark: SparkSession, d: str) -> DataFrame:
    """Products between two primer sites."""
    sites = scan.find_motifs(_dna(spark, d), "record_id", "sequence", _ENZYMES)
    return scan.products(sites.where("motif = 'EcoRI'"), sites.where("motif = 'HindIII'"), 50, 1000)


@query(f"""WITH s AS ({_DNA}), m AS (SELECT record_id, unnest(range(1, length(s) - 14)) AS a, s FROM s WHERE length(s) >= 16), k AS (SELECT record_id, s, a, substr(s, CAST(a AS INTEGER), 16) AS w FROM m),
p AS (SELECT id, upper(pattern) AS p, '+' AS strand FROM technical_sequences UNION ALL SELECT id, reverse(translate(upper(pattern), 'ACGTURYSWKMBDHVN', 'TGCAAYRSWMKVHDBN')), '-' FROM technical_sequences)
SELECT record_id, id, strand, a AS start, a + length(p) - 1 AS "end" FROM k JOIN p ON w = substr(p, 1, 16) WHERE substr(s, CAST(a AS INTEGER), length(p)) = p""")
def technical_hits(spark: SparkSession, d: str) -> DataFrame:
    """Technical sequences in the records, both strands."""
    return scan.find_patterns(_dna(spark, d), "record_id", "sequence", table(spark, d, "technical_sequences"))


_ORFS = f"""WITH s AS (SELECT record_id, regexp_replace(s, '[^ACGTRYSWKMBDHVNX]', '', 'g') AS s FROM ({_DNA})), b AS (SELECT record_id, '+' AS strand, s FROM s UNION ALL SELECT record_id, '-', reverse(translate(s, 'ACGTRYSWKMBDHVN', 'TGCAYRSWMKVHDBN')) FROM s),
c AS (SELECT record_id, strand, length(s) AS n, f, i, substr(s, CAST(i AS INTEGER), 3) AS c FROM (SELECT *, unnest(range(f, length(s) - 1, 3)) AS i FROM (SELECT *, unnest([1, 2, 3]) AS f FROM b))),
k AS (SELECT *, coalesce(sum(CASE WHEN c IN ('TAA', 'TAG', 'TGA') THEN 1 ELSE 0 END) OVER (PARTITION BY record_id, strand, f ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stretch FROM c),
o AS (SELECT record_id, strand, f, stretch, any_value(n) AS n, min(i) FILTER (c = 'ATG') AS a, max(i) FILTER (c IN ('TAA', 'TAG', 'TGA')) AS z FROM k GROUP BY ALL)
SELECT record_id, strand, CAST(f AS INTEGER) AS frame, CASE WHEN strand = '+' THEN a ELSE n - (z + 2) + 1 END AS start, CASE WHEN strand = '+' THEN z + 2 ELSE n - a + 1 END AS "end", (z - a) // 3 AS n_codons FROM o WHERE a IS NOT NULL AND z IS NOT NULL AND (z - a) // 3 >= 20"""


@query(_ORFS)
def open_reading_frames(spark: SparkSession, d: str) -> DataFrame:
    """Open reading frames of 20 codons and more."""
    return scan.find_orfs(_dna(spark, d), "record_id", "sequence", 20)


@query("""WITH p AS (SELECT record_id, upper(sequence) AS s, source_file = 'batch_00000.fasta' AS a FROM sequence_records WHERE alphabet = 'protein' AND sequence IS NOT NULL), o AS (SELECT min(record_id) AS k, s, a FROM p GROUP BY s, a), m AS (SELECT DISTINCT k, a, w FROM (SELECT k, a, s, unnest(range(1, length(s) - 6)) AS i FROM o WHERE length(s) >= 8), LATERAL (SELECT substr(s, CAST(i AS INTEGER), 8) AS w)),
x AS (SELECT l.k AS key_a, r.k AS key_b, count(*) AS shared FROM m l JOIN m r USING (w) WHERE l.a AND NOT r.a GROUP BY ALL HAVING count(*) >= 1)
SELECT key_a, key_b, shared FROM x QUALIFY row_number() OVER (PARTITION BY key_a ORDER BY shared DESC, key_b) = 1 AND row_number() OVER (PARTITION BY key_b ORDER BY shared DESC, key_a) = 1""")
def reciprocal_best(spark: SparkSession, d: str) -> DataFrame:
    """Reciprocal best matches of two sets of proteins by shared 8-mers."""
    rows = table(spark, d, "sequence_records").where("alphabet = 'protein'").select(F.col("record_id").alias("key"), "sequence", (F.col("source_file") == "batch_00000.fasta").alias("first"))
    return scan.reciprocal_best(rows.where("first"), rows.where("NOT first"))


@query(f"SELECT record_id, round(CASE WHEN length(s) < 14 THEN 2.0 * length(regexp_replace(s, '[^AT]', '', 'g')) + 4.0 * length(regexp_replace(s, '[^GC]', '', 'g')) ELSE 64.9 + 41.0 * (length(regexp_replace(s, '[^GC]', '', 'g')) - 16.4) / length(s) END, 4) AS tm FROM ({_DNA}) WHERE s <> ''")
def melting_temperatures(spark: SparkSession, d: str) -> DataFrame:
    """Melting temperature by simple rules."""
    return _dna(spark, d).where("sequence <> ''").select("record_id", F.round(seq.melting_temperature(F.col("sequence")), 4).alias("tm"))


_RESIDUES = "length(regexp_replace(s, '[^{}]', '', 'g'))"
_MASS = " + ".join(["18.015::DOUBLE", *(f"{_RESIDUES.format(aa)} * {m}::DOUBLE" for aa, m in seq.RESIDUE_MASS.items())])
_HYDRO = " + ".join(f"{_RESIDUES.format(aa)} * ({h})" for aa, h in seq.HYDROPATHY.items())


@query(f"""WITH s AS (SELECT record_id, {_CLEAN} AS s FROM sequence_records WHERE alphabet = 'protein' AND sequence IS NOT NULL) SELECT record_id, CASE WHEN s <> '' THEN round({_MASS}, 3) END AS mass, round(CAST({_HYDRO} AS DOUBLE) / nullif({_RESIDUES.format("".join(seq.HYDROPATHY))}, 0), 4) AS hydropathy FROM s""")
def protein_properties(spark: SparkSession, d: str) -> DataFrame:
    """Mass and mean hydropathy of proteins."""
    s = F.regexp_replace("sequence", r"\s+", "")
    rows = table(spark, d, "sequence_records").where("alphabet = 'protein' AND sequence IS NOT NULL")
    return rows.select("record_id", F.round(seq.protein_mass(s), 3).alias("mass"), F.round(seq.mean_hydropathy(s), 4).alias("hydropathy"))


@query("WITH c AS (SELECT sequence, count(*) AS n FROM sequence_records WHERE sequence IS NOT NULL GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct, CAST(sum(n - 1) AS BIGINT) AS n_surplus FROM c")
def exact_copies(spark: SparkSession, d: str) -> DataFrame:
    """Exact copies of sequences."""
    return genomics.exact_duplicates(table(spark, d, "sequence_records"), "sequence")


@query("""SELECT source_set, CAST(max(depth) AS BIGINT) AS n_lanes FROM (SELECT source_set, sum(d) OVER (PARTITION BY source_set ORDER BY p) AS depth FROM (SELECT source_set, p, sum(d) AS d FROM (SELECT source_set, start AS p, 1 AS d FROM genomic_intervals WHERE start <= "end" AND source_set IS NOT NULL UNION ALL SELECT source_set, "end" + 1, -1 FROM genomic_intervals WHERE start <= "end" AND source_set IS NOT NULL) GROUP BY ALL)) GROUP BY source_set""")
def interval_lanes(spark: SparkSession, d: str) -> DataFrame:
    """Lanes in which the intervals of each set are packed without overlaps: as many as its deepest pile."""
    lanes = genomics.assign_lanes(table(spark, d, "genomic_intervals").select("interval_id", "source_set", "start", "end"), "source_set", "start", "end", ["interval_id"])
    return lanes.groupBy("source_set").agg((F.max("lane") + 1).cast("long").alias("n_lanes"))


_NAME = r"nullif(regexp_extract(coalesce(title, ''), '^>?\s*(\S+)', 1), '')"
_LETTERS = "upper(regexp_replace(coalesce(sequence, ''), '\\s+', '', 'g'))"


@query(f"""WITH r AS (SELECT record_id, {_NAME} AS name, {_LETTERS} AS s FROM sequence_records WHERE alphabet = 'dna-rna') SELECT record_id, 'no name' AS problem FROM r WHERE name IS NULL UNION ALL SELECT record_id, 'empty sequence' FROM r WHERE s = ''
UNION ALL SELECT record_id, 'illegal letters' FROM r WHERE regexp_matches(s, '[^ACGTURYSWKMBDHVN.*-]') UNION ALL SELECT record_id, 'repeated name' FROM r WHERE name IN (SELECT name FROM r GROUP BY name HAVING count(*) > 1)""")
def record_problems(spark: SparkSession, d: str) -> DataFrame:
    """Records without name or letters, with a repeated name or illegal letters."""
    return records.validate(table(spark, d, "sequence_records").where("alphabet = 'dna-rna'"), "record_id")


@query(f"""WITH r AS (SELECT record_id, {_LETTERS} AS s FROM sequence_records WHERE alphabet = 'dna-rna'), c AS (SELECT record_id, length(s) AS n, length(regexp_replace(s, '[^GC]', '', 'g')) * 100 / nullif(length(regexp_replace(s, '[^ACGTU]', '', 'g')), 0) AS gc, length(regexp_replace(s, '[^RYSWKMBDHVN]', '', 'g')) AS a FROM r)
SELECT record_id, concat_ws('; ', CASE WHEN n < 100 THEN 'too short' END, CASE WHEN n > 1000 THEN 'too long' END, CASE WHEN gc < 35 THEN 'GC too low' END, CASE WHEN gc > 65 THEN 'GC too high' END, CASE WHEN a > 2 THEN 'too ambiguous' END) AS reasons FROM c""")
def record_filter(spark: SparkSession, d: str) -> DataFrame:
    """Records with the limits they break."""
    return records.with_reasons(table(spark, d, "sequence_records").where("alphabet = 'dna-rna'"), "sequence", 100, 1000, 35, 65, 2).select("record_id", "reasons")


@query(f"SELECT record_id FROM sequence_records WHERE {_NAME} IN (SELECT {_NAME} FROM sequence_records WHERE alphabet = 'protein')")
def records_by_id(spark: SparkSession, d: str) -> DataFrame:
    """Records whose name a protein has."""
    rows = table(spark, d, "sequence_records")
    names = rows.where("alphabet = 'protein'").select(records.record_name(F.col("title")).alias("name"))
    return records.extract_by_id(rows, names).select("record_id")


_WEIGHTS = {"A": [0.1, 1.0, 0.1, 1.0, 0.9, 1.0], "C": [0.1, 0, 0, 0, 0, 0], "G": [0, 0, 0, 0, 0, 0.1], "T": [1.0, 0.1, 1.0, 0.1, 0.5, 0.1]}
_LOWS = [min(column) for column in zip(*_WEIGHTS.values(), strict=True)]
_SCORE = " + ".join("CASE substr(s, CAST(a AS INTEGER) + " + str(j) + ", 1) " + " ".join(f"WHEN '{c}' THEN {w[j]}::DOUBLE" for c, w in _WEIGHTS.items()) + f" ELSE {_LOWS[j]}::DOUBLE END" for j in range(6))
_RANGE = sum(max(column) for column in zip(*_WEIGHTS.values(), strict=True)) - sum(_LOWS)


@query(f"""WITH s AS ({_DNA}), p AS (SELECT record_id, s, unnest(range(1, length(s) - 4)) AS a FROM s), x AS (SELECT record_id, a, {_SCORE} AS score FROM p) SELECT record_id, a AS start, a + 5 AS "end", round(score, 6) AS score, round((score - {sum(_LOWS)}) / {_RANGE}, 6) AS relative FROM x WHERE (score - {sum(_LOWS)}) / {_RANGE} >= 0.95""")
def weight_hits(spark: SparkSession, d: str) -> DataFrame:
    """Places of a TATA-like position weight matrix."""
    return records.scan_weights(_dna(spark, d), "record_id", "sequence", _WEIGHTS, 0.95).withColumns({c: F.round(c, 6) for c in ("score", "relative")})
