"""Queries of sequence figures, alignment blocks, plot points and tests whose p has a closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import seq
from strandloom.operators import align, blocks, genomics, plotdata, profile, records, scan, sets_text, stats, tables
from strandloom.plans import workflow
from strandloom.plans.design_queries import _PROTEIN, _proteins
from strandloom.plans.genome_queries import _DNA, _dna
from strandloom.plans.registry import Registry
from strandloom.plans.variant_queries import _V, _variants
from strandloom.session import table

registry = Registry()
query = registry.query


def _groups(sign: str) -> str:
    """SQL sum of the charges of the groups at pH x: positive or negative ones."""
    pka, terminus = (seq.PKA_POSITIVE, seq.PKA_N_TERMINUS) if sign == "+" else (seq.PKA_NEGATIVE, seq.PKA_C_TERMINUS)
    part = lambda p: f"1 / (1 + pow(10.0, x - {p}))" if sign == "+" else f"1 / (1 + pow(10.0, {p} - x))"
    return " + ".join([part(terminus), *(f"n_{aa} * {part(p)}" for aa, p in pka.items())])


_COUNTED = ", ".join(f"length(regexp_replace(p, '[^{aa}]', '', 'g')) AS n_{aa}" for aa in (*seq.PKA_POSITIVE, *seq.PKA_NEGATIVE))
_CHARGE = f"({_groups('+')}) - ({_groups('-')})"


@query(f"""WITH RECURSIVE p AS ({_PROTEIN}), c AS (SELECT record_id, p, length(regexp_replace(p, '[^{"".join(seq.RESIDUE_MASS)}]', '', 'g')) AS n, {_COUNTED} FROM p),
h AS (SELECT *, 0.0::DOUBLE AS low, 14.0::DOUBLE AS high, 0 AS i FROM c UNION ALL SELECT * EXCLUDE (low, high, i, q, x), CASE WHEN q > 0 THEN x ELSE low END, CASE WHEN q > 0 THEN high ELSE x END, i + 1 FROM (SELECT *, {_CHARGE} AS q FROM (SELECT *, (low + high) / 2 AS x FROM h WHERE i < 80)))
SELECT record_id, round({_CHARGE.replace('x -', '7.0 -').replace('- x', '- 7.0')}, 6) AS charge, CASE WHEN n > 0 THEN round((low + high) / 2, 4) END AS isoelectric_point FROM h WHERE i = 80""")
def protein_charges(spark: SparkSession, d: str) -> DataFrame:
    """Charge at pH 7 and isoelectric point of proteins."""
    s = F.col("sequence")
    return _proteins(spark, d).select("record_id", F.round(seq.protein_charge(s, F.lit(7.0)), 6).alias("charge"), F.round(seq.isoelectric_point(s), 4).alias("isoelectric_point"))


_MITO = "MAP {" + ", ".join(f"'{c}': '{a}'" for c, a, _, _ in seq.genetic_code("2")) + "}"


@query(f"WITH s AS ({_DNA}) SELECT record_id, CASE WHEN length(s) < 3 THEN '' ELSE array_to_string(list_transform(range(0, length(s) // 3), lambda i: coalesce({_MITO}[s[CAST(i * 3 + 1 AS BIGINT):CAST(i * 3 + 3 AS BIGINT)]], 'X')), '') END AS protein FROM s")
def mitochondrial_proteins(spark: SparkSession, d: str) -> DataFrame:
    """Frame 1 of each record by the vertebrate mitochondrial code."""
    return _dna(spark, d).select("record_id", seq.translate(F.col("sequence"), code=seq.CODES["2"][0]).alias("protein"))


@query(f"WITH p AS ({_PROTEIN}), l AS (SELECT record_id, regexp_extract_all(p, '.{{1,60}}') AS l FROM p) SELECT record_id, array_to_string(list_transform(l, lambda x: rtrim(regexp_replace(x, '(.{{10}})', '\\1 ', 'g'))), chr(10)) AS grouped FROM l")
def grouped_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Proteins in groups of ten, six in a line."""
    return _proteins(spark, d).select("record_id", seq.grouped(F.col("sequence")).alias("grouped"))


@query(f"WITH s AS ({_DNA}) SELECT record_id, regexp_replace(s[1:CAST(length(s) // 3 * 3 AS BIGINT)], '(.{{15}})', '\\1---', 'g') AS spaced FROM s WHERE length(s) >= 3")
def codon_alignments(spark: SparkSession, d: str) -> DataFrame:
    """Coding letters spaced as their protein, which has a gap behind every fifth residue."""
    rows = _dna(spark, d).where("length(sequence) >= 3")
    aligned = F.regexp_replace(seq.translate(F.col("sequence")), "(.{5})", "$1-")
    return rows.select("record_id", seq.codon_alignment(aligned, F.col("sequence")).alias("spaced"))


@query(f"""WITH s AS ({_DNA}), z AS (SELECT record_id, s, length(s) AS n, CASE WHEN length(s) <= 120 THEN greatest(6, CAST(ceil(length(s) / 8) AS INTEGER)) ELSE 25 END AS w FROM s WHERE s <> ''), w AS (SELECT record_id, unnest(range(1, n + 1, w)) AS a, s, w FROM z), t AS (SELECT record_id, a, substr(s, CAST(a AS INTEGER), w) AS t FROM w),
c AS (SELECT record_id, a, length(t) AS l, length(regexp_replace(t, '[^G]', '', 'g')) AS g, length(regexp_replace(t, '[^C]', '', 'g')) AS c, length(regexp_replace(t, '[^ACGTU]', '', 'g')) AS k FROM t)
SELECT record_id, CAST(a AS INTEGER) AS start, CAST(a + l - 1 AS INTEGER) AS "end", round((g + c) * 100 / CASE WHEN k > 0 THEN k END, 4) AS gc_percent, round((g - c) / CASE WHEN g + c > 0 THEN g + c END, 4) AS gc_skew FROM c""")
def composition_auto(spark: SparkSession, d: str) -> DataFrame:
    """Composition in windows of a size chosen per record."""
    return scan.auto_windows(_dna(spark, d), ["record_id"], "sequence")


@query("SELECT record_id, length(coalesce(sequence, '')) AS length FROM sequence_records ORDER BY length DESC, record_id LIMIT 25")
def longest_records(spark: SparkSession, d: str) -> DataFrame:
    """The 25 longest records (a top-k report)."""
    rows = table(spark, d, "sequence_records").withColumn("title", F.lpad(F.col("record_id").cast("string"), 12, "0"))
    return records.sort_records(rows, "length-desc").limit(25).select("record_id", F.length(F.coalesce("sequence", F.lit(""))).alias("length"))


@query(f"""WITH s AS ({_DNA}), p AS (SELECT id, upper(pattern) AS p, false AS turned FROM technical_sequences UNION ALL SELECT id, reverse(translate(upper(pattern), 'ACGTURYSWKMBDHVN', 'TGCAAYRSWMKVHDBN')), true FROM technical_sequences),
h AS (SELECT id, record_id, turned, strpos(s, p) AS a, length(p) AS n FROM p JOIN s ON contains(s, p)), b AS (SELECT id, min(struct_pack(record_id := record_id, turned := turned, a := a, n := n)) AS h FROM h GROUP BY id)
SELECT id, h.record_id AS record_id, CASE WHEN h.turned THEN '-' ELSE '+' END AS strand, CAST(h.a AS BIGINT) AS start, CAST(h.a + h.n - 1 AS BIGINT) AS "end" FROM b""")
def first_read_hits(spark: SparkSession, d: str) -> DataFrame:
    """The first record in which each technical sequence stands."""
    return scan.first_hits(table(spark, d, "technical_sequences"), _dna(spark, d))


@query()
def contaminations(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of records that resemble a technical sequence."""
    rows = _dna(spark, d).select(F.col("record_id").alias("key"), "sequence")
    return align.similar_stretches(rows, table(spark, d, "technical_sequences").select(F.col("id").alias("key"), F.col("pattern").alias("sequence")), least=20)


@query()
def near_hits(spark: SparkSession, d: str) -> DataFrame:
    """Technical sequences in the records with at most two other letters, both strands."""
    return scan.find_near_patterns(_dna(spark, d), "record_id", "sequence", table(spark, d, "technical_sequences"), 2)


@query()
def partial_ends(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of technical sequences at the ends of records."""
    return scan.find_partial_ends(_dna(spark, d), "record_id", "sequence", table(spark, d, "technical_sequences"))


@query(_V + " SELECT CAST(aln_id AS VARCHAR) AS id, kind FROM v WHERE chrom = 'ctg02' AND pos + CASE kind WHEN 'mnv' THEN 1 WHEN 'deletion' THEN 1 ELSE 0 END >= 1000000 AND pos <= 20000000")
def vcf_region(spark: SparkSession, d: str) -> DataFrame:
    """Variants whose span meets a region."""
    return genomics.filter_variants(_variants(spark, d), "ctg02", 1_000_000, 20_000_000, passed=False).select("id", "kind")


_BLOCKS = """WITH b AS (SELECT source_set AS comparison, trim(record, ' ') AS reference, coalesce(strand, '+') AS strand, start, "end", partner_start AS query_start, partner_end AS query_end, 100.0 * overlap_bp / ("end" - start + 1) AS identity, "end" - start + 1 AS block_length FROM genomic_intervals WHERE start >= 1 AND "end" >= start AND record IS NOT NULL AND source_set IS NOT NULL)"""


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    """Intervals and their partners as alignment blocks."""
    rows = table(spark, d, "genomic_intervals").where("start >= 1 AND `end` >= start AND record IS NOT NULL AND source_set IS NOT NULL")
    size = F.col("end") - F.col("start") + 1
    return rows.select(F.col("source_set").alias("comparison"), F.trim("record").alias("reference"), F.coalesce("strand", F.lit("+")).alias("strand"), "start", "end", F.col("partner_start").alias("query_start"), F.col("partner_end").alias("query_end"), (100.0 * F.col("overlap_bp") / size).alias("identity"), size.alias("block_length"), F.lit(None).cast("int").alias("mapq"))


@query(_BLOCKS + """, r AS (SELECT DISTINCT comparison, reference, start AS rs, "end" AS re FROM b WHERE identity >= 10 AND block_length >= 20 AND strand <> '-'), o AS (SELECT *, max(re) OVER (PARTITION BY comparison, reference ORDER BY rs, re ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r)
SELECT comparison, reference, CAST(sum(re - greatest(rs, coalesce(before, 0) + 1) + 1) FILTER (before IS NULL OR re > before) AS BIGINT) AS covered FROM o GROUP BY ALL""")
def block_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Positions covered by forward blocks of some length and identity."""
    return blocks.reference_coverage(blocks.filter_blocks(_blocks(spark, d), 10, 20, both_strands=False))


@query(_BLOCKS + """ SELECT comparison, reference, strand, start, "end", query_start, query_end, round(max(identity), 6) AS identity, count(*) AS n_copies FROM b GROUP BY comparison, reference, strand, start, "end", query_start, query_end""")
def block_copies(spark: SparkSession, d: str) -> DataFrame:
    """Blocks without their copies."""
    return blocks.exact_block_copies(_blocks(spark, d)).drop("block_length", "mapq").withColumn("identity", F.round("identity", 6))


@query("""WITH k AS (SELECT 'r' || record_id AS name, length(sequence) AS n FROM sequence_records WHERE sequence IS NOT NULL AND record_id % 2 = 0), f AS (SELECT 'r' || interval_id AS record FROM genomic_intervals WHERE start >= 1 AND "end" >= start)
SELECT 0 AS part, CAST(1 AS BIGINT) AS n UNION ALL SELECT 1, count(*) FROM f SEMI JOIN k ON record = name UNION ALL SELECT 2, 1 UNION ALL SELECT 3, count(*) FROM k""")
def bundle_parts(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a GFF3 bundle by part: features without their record drop out, records without features stay."""
    seqs = table(spark, d, "sequence_records").where("record_id % 2 = 0").select(F.concat(F.lit("r"), "record_id").alias("name"), "sequence")
    rows = table(spark, d, "genomic_intervals").where("start >= 1 AND `end` >= start")
    features = rows.select(F.concat(F.lit("r"), "interval_id").alias("record"), F.lit("t").alias("source"), F.lit("x").alias("type"), "start", "end", F.lit(None).cast("double").alias("score"), "strand", F.lit(None).cast("string").alias("phase"), F.create_map(F.lit("ID"), F.col("name")).alias("attributes"))
    return records.gff3_bundle(seqs, features).groupBy("part").agg(F.count("*").alias("n"))


_PAIRS = [(a, b) for a in ("l_quantity", "l_extendedprice", "l_discount") for b in ("l_quantity", "l_extendedprice", "l_discount")]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS pearson FROM lineitem" for a, b in _PAIRS))
def correlation_cells(spark: SparkSession, d: str) -> DataFrame:
    """All cells of a correlation heat map, both halves."""
    return profile.correlation_cells(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query("SELECT event_type AS series, CAST(user_id AS DOUBLE) AS x, value AS y FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL")
def line_plot(spark: SparkSession, d: str) -> DataFrame:
    """Points of a line plot."""
    return plotdata.line_points(table(spark, d, "events"), "user_id", "value", "event_type")


@query("SELECT c_mktsegment AS \"group\", CAST(c_custkey AS DOUBLE) AS x, c_acctbal AS y FROM customer WHERE c_acctbal IS NOT NULL")
def scatter_plot(spark: SparkSession, d: str) -> DataFrame:
    """Points of a scatter plot."""
    return plotdata.scatter_points(table(spark, d, "customer"), "c_custkey", "c_acctbal", "c_mktsegment")


@query("SELECT trim(treatment, ' ') AS category, '' AS \"group\", CAST(concentration_ng_ul AS DOUBLE) AS value FROM sample_sheet WHERE trim(treatment) <> '' AND regexp_full_match(trim(concentration_ng_ul), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)')")
def bar_plot(spark: SparkSession, d: str) -> DataFrame:
    """Bars of a dirty sheet."""
    return plotdata.bar_values(table(spark, d, "sample_sheet"), "treatment", "concentration_ng_ul")


@query("""WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM events), w AS (SELECT DISTINCT CAST(floor(k * ((SELECT max(n) FROM r) - 1) / 199 + 0.5) AS BIGINT) AS i FROM (SELECT unnest(range(200)) AS k)) SELECT event_id FROM r SEMI JOIN w USING (i)""")
def even_events(spark: SparkSession, d: str) -> DataFrame:
    """200 events at even distances (a drawing limit)."""
    return plotdata.evenly_spaced(table(spark, d, "events"), "event_id", 200).select("event_id")


_HALF = " + ".join(f"pow(x / 2, {k}) / {f}" for k, f in ((0, 1), (1, 1), (2, 2), (3, 6), (4, 24), (5, 120)))


@query(f"""WITH c AS (SELECT l_returnflag AS r, l_linenumber AS c, count(*) AS o FROM lineitem GROUP BY ALL), g AS (SELECT r, c FROM (SELECT DISTINCT r FROM c) CROSS JOIN (SELECT DISTINCT c FROM c)),
e AS (SELECT coalesce(o, 0) AS o, sum(coalesce(o, 0)) OVER (PARTITION BY r) * sum(coalesce(o, 0)) OVER (PARTITION BY c) / sum(coalesce(o, 0)) OVER () AS e FROM g LEFT JOIN c USING (r, c)), t AS (SELECT sum(pow(o - e, 2) / e) AS x FROM e) SELECT round(x, 4) AS chi2, 12 AS df, round(exp(-x / 2) * ({_HALF}), 8) AS p FROM t""")
def chi2_p(spark: SparkSession, d: str) -> DataFrame:
    """p of a chi-square test; with 12 degrees of freedom it is a finite sum."""
    cells = stats.chi_square(table(spark, d, "lineitem"), "l_returnflag", "l_linenumber")
    return cells.select("chi2", "df", F.round("p", 8).alias("p")).distinct()


@query("""WITH r AS (SELECT event_type AS g, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2 AS r, count(*) OVER (PARTITION BY value) AS t FROM events WHERE value IS NOT NULL), g AS (SELECT g, count(*) AS n, sum(r) AS s, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM r GROUP BY g),
a AS (SELECT CAST(sum(n) AS DOUBLE) AS n, count(*) AS k, sum(s * s / n) AS q, sum(ties) AS ties FROM g), h AS (SELECT k, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS x FROM a) SELECT k AS n_groups, round(exp(-x / 2) * (1 + x / 2), 8) AS p FROM h""")
def kruskal_p(spark: SparkSession, d: str) -> DataFrame:
    """p of a Kruskal-Wallis test of five groups."""
    return stats.kruskal_wallis(table(spark, d, "events"), "event_type", "value").select("n_groups", F.round("p", 8).alias("p"))


@query("""WITH g AS (SELECT o_orderpriority AS g, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1), a AS (SELECT sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS grand FROM g), s AS (SELECT any_value(a.n) AS n, any_value(k) AS k, sum(g.n * pow(m - grand, 2)) AS b, sum(v * (g.n - 1)) AS w FROM g, a),
f AS (SELECT k, CAST(n - k AS DOUBLE) AS d2, b / (k - 1) / (w / (n - k)) AS f FROM s), x AS (SELECT k, d2 / 2 AS a, d2 / (d2 + 4 * f) AS x FROM f) SELECT k AS n_groups, round(exp(a * ln(x)) * (1 + a * (1 - x)), 6) AS p FROM x""")
def anova_p(spark: SparkSession, d: str) -> DataFrame:
    """p of a one-way analysis of five groups, which has a closed form."""
    return stats.anova(table(spark, d, "orders"), "o_orderpriority", "o_totalprice").select("n_groups", F.round("p", 6).alias("p"))


@query("""WITH c AS (SELECT count(*) FILTER (event_type = 'click' AND user_id % 2 = 0) AS a, count(*) FILTER (event_type = 'click' AND user_id % 2 = 1) AS b, count(*) FILTER (event_type <> 'click' AND user_id % 2 = 0) AS c, count(*) FILTER (event_type <> 'click' AND user_id % 2 = 1) AS d FROM events),
k AS (SELECT *, unnest(range(greatest(0, a + b + a + c - (a + b + c + d)), least(a + b, a + c) + 1)) AS k FROM c), l AS (SELECT a, k, lgamma(a + b + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) + lgamma(c + d + 1) - lgamma(a + c - k + 1) - lgamma(c + d - (a + c) + k + 1) - (lgamma(a + b + c + d + 1) - lgamma(a + c + 1) - lgamma(b + d + 1)) AS v FROM k)
SELECT round(least(1.0, sum(exp(v)) FILTER (v <= (SELECT max(v) FROM l WHERE k = a) + 1e-7)), 6) AS p FROM l""")
def fisher_p(spark: SparkSession, d: str) -> DataFrame:
    """p of Fisher's exact test of clicks and even users."""
    return stats.fisher_exact(table(spark, d, "events").where("event_type IS NOT NULL AND user_id IS NOT NULL"), F.col("event_type") == "click", F.col("user_id") % 2 == 0).select(F.round("p", 6).alias("p"))


def _cofactor(i: int, j: int) -> str:
    rows, cols = [r for r in "abc" if r != "abc"[i]], [c for c in "abc" if c != "abc"[j]]
    at = lambda r, c: "s" + "".join(sorted(r + c))
    return f"({'-' if (i + j) % 2 else ''}({at(rows[0], cols[0])} * {at(rows[1], cols[1])} - {at(rows[0], cols[1])} * {at(rows[1], cols[0])}))"


_XS = {"a": "l_quantity", "b": "l_discount", "c": "l_tax"}
_CENTRED = ", ".join(f"sum(({x} - m{x}) * ({y} - m{y})) AS s{x}{y}" for k, x in enumerate("abcy") for y in "abcy"[k:])
_BETA = ", ".join(f"({' + '.join(f'{_cofactor(i, j)} * s{c}y' for j, c in enumerate('abc'))}) / det AS b{x}" for i, x in enumerate("abc"))


@query(f"""WITH t AS (SELECT l_quantity AS a, l_discount AS b, l_tax AS c, l_extendedprice AS y FROM lineitem), m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, avg(y) AS my, count(*) AS n FROM t), s AS (SELECT any_value(ma) AS ma, any_value(mb) AS mb, any_value(mc) AS mc, any_value(my) AS my, any_value(n) AS n, {_CENTRED} FROM t, m),
d AS (SELECT *, saa * {_cofactor(0, 0)} + sab * {_cofactor(0, 1)} + sac * {_cofactor(0, 2)} AS det FROM s), b AS (SELECT *, {_BETA} FROM d), r AS (SELECT *, (ba * say + bb * sby + bc * scy) / syy AS r2 FROM b)
{" UNION ALL ".join(f"SELECT '{name}' AS term, n, round(b{x}, 2) AS coefficient, round(r2, 6) AS r_squared FROM r" for x, name in _XS.items())} UNION ALL SELECT 'intercept', n, round(my - ba * ma - bb * mb - bc * mc, 2), round(r2, 6) FROM r""")
def ols_multiple_fit(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients of a regression on three predictors, by the normal equations."""
    fit = stats.multiple_regression(table(spark, d, "lineitem"), "l_extendedprice", list(_XS.values()))
    return fit.select("term", "n", F.round("coefficient", 2).alias("coefficient"), "r_squared")


@query(r"SELECT doc_id, array_to_string(regexp_extract_all(text, '[A-Z]{3,}'), ' ') AS found FROM documents WHERE text IS NOT NULL")
def extracted_matches(spark: SparkSession, d: str) -> DataFrame:
    """Runs of capitals in texts, joined."""
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", sets_text.only_matches(F.col("text"), "[A-Z]{3,}", " ").alias("found"))


@query("SELECT 3 AS n_columns, count(*) AS n_rows, 'l_orderkey, l_quantity, l_tax' AS names FROM lineitem")
def table_overview(spark: SparkSession, d: str) -> DataFrame:
    """Columns and rows of a table."""
    return tables.overview(table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_tax"))


@query("""WITH s AS (SELECT record_id, upper(regexp_replace(sequence, '\\s+', '', 'g')) AS s FROM sequence_records WHERE alphabet = 'dna-rna' AND sequence IS NOT NULL) SELECT record_id, regexp_replace(s, '[^ACGTURYSWKMBDHVN]', '', 'g') AS letters, CAST(length(regexp_replace(s, '[ACGTURYSWKMBDHVN]', '', 'g')) AS INTEGER) AS removed FROM s""")
def cleaned_records(spark: SparkSession, d: str) -> DataFrame:
    """Nucleotide letters of the records, and how many other letters they lost."""
    rows = table(spark, d, "sequence_records").where("alphabet = 'dna-rna' AND sequence IS NOT NULL")
    return rows.select("record_id", seq.clean_letters(F.col("sequence"), "ACGTURYSWKMBDHVN").alias("c")).select("record_id", F.col("c.sequence").alias("letters"), "c.removed")


@query("SELECT record_id, title, sequence FROM sequence_records WHERE length(sequence) > 200 AND regexp_matches(coalesce(title, ''), '^[A-Z]')")
def workflow_records(spark: SparkSession, d: str) -> DataFrame:
    """A workflow of two filters of records."""
    plan = [{"op": "to_records"}, {"op": "filter_records", "field": "length", "rule": "gt", "value": "200"}, {"op": "map", "steps": [{"op": "filter_records", "field": "title", "rule": "matches", "value": "^[A-Z]"}]}]
    return workflow.run(table(spark, d, "sequence_records").select("record_id", "title", "sequence"), plan)
