"""Queries on coding sequences, guides, alignments and simulated reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import seq
from strandloom.operators import align, coding, design, records, scan, simulate
from strandloom.plans.genome_queries import _CODE, _DNA, _ENZYMES, _SITES, _dna
from strandloom.plans.registry import Registry
from strandloom.session import table

registry = Registry()
query = registry.query

_USAGE = f"""s AS ({_DNA}), c AS (SELECT record_id, unnest(list_transform(range(0, length(s) // 3), lambda i: s[CAST(i * 3 + 1 AS BIGINT):CAST(i * 3 + 3 AS BIGINT)])) AS codon FROM s),
u AS (SELECT codon, {_CODE}[codon] AS amino_acid, count(*) AS n FROM c WHERE {_CODE}[codon] IS NOT NULL GROUP BY ALL)"""
_PROTEIN = "SELECT record_id, source_file, upper(regexp_replace(sequence, '\\s+', '', 'g')) AS p FROM sequence_records WHERE alphabet = 'protein' AND sequence IS NOT NULL"
_HYDROPATHY = "MAP {" + ", ".join(f"'{a}': {h}" for a, h in seq.HYDROPATHY.items()) + "}"


def _proteins(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sequence_records").where("alphabet = 'protein' AND sequence IS NOT NULL").select("record_id", "source_file", F.upper(F.regexp_replace("sequence", r"\s+", "")).alias("sequence"))


@query(f"""WITH {_USAGE}, w AS (SELECT codon, n / max(n) OVER (PARTITION BY amino_acid) AS weight FROM u WHERE amino_acid <> '*')
SELECT s.record_id, count(w.codon) AS n_scored, count(c.codon) - count(w.codon) AS n_ignored, round(exp(avg(ln(weight))), 6) AS cai FROM s LEFT JOIN c USING (record_id) LEFT JOIN w USING (codon) GROUP BY s.record_id""")
def codon_adaptation(spark: SparkSession, d: str) -> DataFrame:
    """Codon adaptation of each record to the usage of all records."""
    rows = _dna(spark, d)
    return coding.adaptation_index(rows, ["record_id"], "sequence", coding.relative_adaptiveness(scan.codon_usage(rows, [], "sequence")))


@query(f"""WITH {_USAGE}, b AS (SELECT amino_acid, arg_min(codon, (-n, codon)) AS codon FROM u GROUP BY 1), p AS ({_PROTEIN})
SELECT record_id, coalesce((SELECT string_agg(coalesce(b.codon, 'NNN'), '' ORDER BY i) FROM (SELECT unnest(range(1, length(p) + 1)) AS i) LEFT JOIN b ON b.amino_acid = substr(p, CAST(i AS INTEGER), 1)), '') AS coding FROM p""")
def back_translations(spark: SparkSession, d: str) -> DataFrame:
    """Proteins as coding sequences of the codons that the records use most."""
    choice = coding.favoured_codons(scan.codon_usage(_dna(spark, d), [], "sequence"))
    return coding.reverse_translate(_proteins(spark, d), "sequence", choice).select("record_id", "coding")


@query(f"""WITH p AS ({_PROTEIN}), w AS (SELECT record_id, p, least(9, length(p)) AS n, unnest(range(1, length(p) - least(9, length(p)) + 2)) AS a FROM p WHERE p <> ''),
v AS (SELECT record_id, a, n, list_filter(list_transform(range(a, a + n), lambda i: {_HYDROPATHY}[substr(p, CAST(i AS INTEGER), 1)]), lambda x: x IS NOT NULL) AS k FROM w)
SELECT record_id, a AS start, a + n - 1 AS "end", (a + a + n - 1) / 2 AS position, len(k) AS n_known, round(CAST(list_sum(k) AS DOUBLE) / nullif(len(k), 0), 4) AS hydropathy FROM v""")
def hydropathy_windows(spark: SparkSession, d: str) -> DataFrame:
    """Moving mean hydropathy of proteins."""
    return coding.hydropathy_profile(_proteins(spark, d), ["record_id"], "sequence")


@query(f"""WITH p AS ({_PROTEIN}), l AS (SELECT source_file, i AS position, substr(p, CAST(i AS INTEGER), 1) AS residue FROM (SELECT source_file, p, unnest(range(1, length(p) + 1)) AS i FROM p)), c AS (SELECT source_file, position, residue, count(*) AS n FROM l WHERE residue NOT IN ('-', '.') GROUP BY ALL)
SELECT source_file, position, CAST(sum(n) AS BIGINT) AS n_rows, arg_min(residue, (-n, residue)) AS residue, round(max(n) / sum(n), 4) AS share FROM c GROUP BY ALL""")
def protein_columns(spark: SparkSession, d: str) -> DataFrame:
    """The prevailing residue at each place of the proteins of a file."""
    return coding.column_conservation(_proteins(spark, d), ["source_file"], "sequence")


@query(_SITES + """, l AS (SELECT record_id, length(s) AS n FROM s WHERE s <> ''), c AS (SELECT DISTINCT record_id, a AS cut, l.n FROM t JOIN l USING (record_id) WHERE motif IS NOT NULL),
x AS (SELECT record_id, n, cut, coalesce(lag(cut) OVER (PARTITION BY record_id ORDER BY cut), max(cut) OVER (PARTITION BY record_id)) AS b FROM c)
SELECT record_id, b % n + 1 AS start, cut AS "end", CASE WHEN cut > b THEN cut - b ELSE cut - b + n END AS length FROM x UNION ALL SELECT record_id, 1, n, n FROM l WHERE record_id NOT IN (SELECT record_id FROM c)""")
def circular_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Fragments of the records taken as circular molecules."""
    rows = _dna(spark, d)
    found = scan.find_motifs(rows, "record_id", "sequence", _ENZYMES)
    return design.circular_fragments(found, rows.select("record_id", F.length("sequence").cast("long").alias("length")))


_FOUND = f"""b AS (SELECT record_id, length(s) AS n, '+' AS strand, s FROM ({_DNA}) UNION ALL SELECT record_id, length(s), '-', reverse(translate(s, 'ACGTRYSWKMBDHVN', 'TGCAYRSWMKVHDBN')) FROM ({_DNA})),
w AS (SELECT record_id, n, strand, a, substr(s, CAST(a AS INTEGER), 23) AS w FROM (SELECT *, unnest(range(1, length(s) - 21)) AS a FROM b)),
f AS (SELECT record_id, strand, CASE WHEN strand = '+' THEN a ELSE n - a - 18 END AS start, w[1:20] AS guide, w[21:23] AS pam_text FROM w WHERE regexp_full_match(w, '[ACGT]{{21}}GG'))"""


@query(f"""WITH {_FOUND}, g AS (SELECT *, length(regexp_replace(guide, '[^GC]', '', 'g')) * 5.0 AS gc, list_max(list_transform(regexp_extract_all(guide, 'A+|C+|G+|T+'), lambda r: length(r))) AS run FROM f)
SELECT record_id, strand, start, start + 19 AS "end", guide, pam_text, CAST(gc AS DOUBLE) AS gc_percent, CAST(run AS INTEGER) AS longest_run, contains(guide, 'TTTT') AS has_tttt,
  round(greatest(0, 100 - CASE WHEN gc BETWEEN 40 AND 60 THEN 0 ELSE least(35, abs(CAST(gc AS DOUBLE) - 50) * 1.2) END - greatest(0, run - 3) * 8 - CASE WHEN contains(guide, 'TTTT') THEN 18 ELSE 0 END), 1) AS score FROM g WHERE gc BETWEEN 35 AND 75""")
def guide_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Guides of 20 letters before NGG with their ratings."""
    return design.rated(design.sites(_dna(spark, d), "record_id", "sequence"))


@query(f"""WITH {_FOUND}, t AS (SELECT guide AS target, count(*) AS n FROM f GROUP BY 1), q AS (SELECT DISTINCT guide FROM f WHERE record_id % 100 = 0)
SELECT guide, n_mismatches, CAST(sum(n) AS BIGINT) AS n_sites FROM (SELECT guide, CAST(hamming(guide, target) AS INTEGER) AS n_mismatches, n FROM q, t) WHERE n_mismatches <= 2 GROUP BY ALL""")
def guide_off_targets(spark: SparkSession, d: str) -> DataFrame:
    """Sites within two mismatches of the guides of every hundredth record, among the sites of all records."""
    rows = _dna(spark, d)
    return design.off_targets(design.sites(rows.where("record_id % 100 = 0"), "record_id", "sequence"), design.sites(rows, "record_id", "sequence"))


@query(f"""WITH a AS (SELECT record_id AS key_a, at_a, substr(s, CAST(at_a AS INTEGER), 16) AS w FROM (SELECT *, unnest(range(1, length(s) - 14)) AS at_a FROM ({_DNA}))),
b AS (SELECT id AS key_b, at_b, substr(s, CAST(at_b AS INTEGER), 16) AS w FROM (SELECT id, s, unnest(range(1, length(s) - 14)) AS at_b FROM (SELECT id, upper(pattern) AS s FROM technical_sequences))),
h AS (SELECT key_a, key_b, at_a, at_a - at_b AS shift, at_a - row_number() OVER (PARTITION BY key_a, key_b, at_a - at_b ORDER BY at_a) AS run FROM a JOIN b USING (w))
SELECT key_a, key_b, min(at_a) AS start_a, min(at_a) - shift AS start_b, count(*) + 15 AS length FROM h GROUP BY key_a, key_b, shift, run""")
def dot_diagonals(spark: SparkSession, d: str) -> DataFrame:
    """Runs of at least 16 equal letters of records and technical sequences."""
    a = _dna(spark, d).select(F.col("record_id").alias("key"), "sequence")
    return align.diagonals(a, table(spark, d, "technical_sequences").select(F.col("id").alias("key"), F.col("pattern").alias("sequence")), 16)


@query()
def aligned_best_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Global alignment figures of the reciprocal best pairs of proteins."""
    rows = _proteins(spark, d).select(F.col("record_id").alias("key"), "sequence", (F.col("source_file") == "batch_00000.fasta").alias("first"))
    pairs = scan.reciprocal_best(rows.where("first"), rows.where("NOT first"))
    with_a = pairs.join(rows.select(F.col("key").alias("key_a"), F.col("sequence").alias("a")), "key_a")
    both = with_a.join(rows.select(F.col("key").alias("key_b"), F.col("sequence").alias("b")), "key_b")
    return align.align_pairs(both.select("key_a", "key_b", "a", "b"), "a", "b").drop("a", "b")


_TURNED = "reverse(translate(upper(pattern), 'ACGTURYSWKMBDHVN', 'TGCAAYRSWMKVHDBN'))"


@query(f"""WITH s AS ({_DNA}), m AS (SELECT record_id, s, a, substr(s, CAST(a AS INTEGER), 16) AS w FROM (SELECT *, unnest(range(1, length(s) - 14)) AS a FROM s)), p AS (SELECT id, upper(pattern) AS p, '+' AS strand FROM technical_sequences UNION ALL SELECT id, {_TURNED}, '-' FROM technical_sequences)
SELECT record_id, id, strand, a AS start, lower(substr(s, greatest(CAST(a AS INTEGER) - 10, 1), CAST(a AS INTEGER) - greatest(CAST(a AS INTEGER) - 10, 1))) || p || lower(substr(s, CAST(a AS INTEGER) + CAST(length(p) AS INTEGER), 10)) AS context
FROM m JOIN p ON w = substr(p, 1, 16) WHERE substr(s, CAST(a AS INTEGER), length(p)) = p""")
def hit_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Technical sequences in the records with ten letters on each side."""
    rows = _dna(spark, d)
    hits = scan.find_patterns(rows, "record_id", "sequence", table(spark, d, "technical_sequences"))
    joined = hits.join(rows.select("record_id", "sequence"), "record_id")
    return joined.select("record_id", "id", "strand", "start", seq.in_context(F.col("sequence"), F.col("start"), F.col("end")).alias("context"))


@query()
def simulated_reads(spark: SparkSession, d: str) -> DataFrame:
    """Paired reads of all DNA records, two letters read for each letter."""
    return simulate.paired_reads(_dna(spark, d), "record_id", "sequence", length=50, insert=120, depth=2)


@query()
def shuffled_records(spark: SparkSession, d: str) -> DataFrame:
    """Each DNA record with its letters in another order, and once mutated."""
    s, key = F.col("sequence"), F.col("record_id")
    return _dna(spark, d).select("record_id", simulate.shuffle_letters(s, key).alias("shuffled"), simulate.mutate(s, key, 0.02, 0.005, 0.005).alias("mutated"))


_FIRST = r"nullif(regexp_extract(coalesce(title, ''), '^>?\s*(\S+)', 1), '')"


@query(f"""WITH h AS (SELECT record_id, {_FIRST} AS name, regexp_replace(sequence, '\\s+', '', 'g') AS s FROM sequence_records WHERE alphabet = 'dna-rna' AND sequence IS NOT NULL), r AS (SELECT DISTINCT name FROM h WHERE name IS NOT NULL AND record_id % 100 = 0)
SELECT name, 11 AS region_start, least(length(s), 60) AS region_end, substr(s, 11, 50) AS letters FROM h JOIN r USING (name) WHERE length(s) >= 11""")
def fetched_regions(spark: SparkSession, d: str) -> DataFrame:
    """Letters 11 to 60 of all records that carry the name of every hundredth one."""
    rows = table(spark, d, "sequence_records").where("alphabet = 'dna-rna'").withColumn("name", records.record_name(F.col("title")))
    wanted = rows.where("record_id % 100 = 0 AND name IS NOT NULL").select(F.concat("name", F.lit(":11-60")).alias("region")).distinct()
    return records.fetch_regions(rows, records.parse_regions(wanted))


@query(f"""WITH h AS (SELECT {_FIRST} AS name, source_file = 'batch_00000.fasta' AS first, min(upper(sequence)) AS s, count(*) AS n FROM sequence_records GROUP BY ALL), a AS (SELECT * FROM h WHERE first), b AS (SELECT * FROM h WHERE NOT first)
SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' WHEN a.s IS DISTINCT FROM b.s OR a.n <> b.n THEN 'changed' ELSE 'same' END AS change,
  CASE WHEN a.n IS NULL OR b.n IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.s IS DISTINCT FROM b.s THEN 'letters' END, CASE WHEN a.n <> b.n THEN 'n' END) END AS changed FROM a FULL JOIN b ON a.name IS NOT DISTINCT FROM b.name""")
def record_changes(spark: SparkSession, d: str) -> DataFrame:
    """Names of the first file against those of all others: added, removed, with other letters or another number of records."""
    rows = table(spark, d, "sequence_records").groupBy(records.record_name(F.col("title")).alias("name"), (F.col("source_file") == "batch_00000.fasta").alias("first")).agg(F.min(F.upper("sequence")).alias("letters"), F.count("*").alias("n"))
    return records.changes(rows.where("first"), rows.where("NOT first"), ["name"], ["letters", "n"])
