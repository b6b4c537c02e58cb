"""Filters, site figures and tables of parsed variants (see ``genomics.parse_vcf``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.exprs import to_num

# The order of fields in the two common annotation formats.
ANN_FIELDS = ("Allele", "Annotation", "Annotation_Impact", "Gene_Name", "Gene_ID", "Feature_Type", "Feature_ID", "Transcript_BioType", "Rank", "HGVS.c", "HGVS.p")
CSQ_FIELDS = ("Allele", "Consequence", "IMPACT", "SYMBOL", "Gene", "Feature_type", "Feature", "BIOTYPE", "EXON", "INTRON", "HGVSc", "HGVSp", "Amino_acids")


def header_fields(lines: DataFrame, line: str = "value") -> DataFrame:
    """Structured header lines ``##KIND=<ID=..,Description="a, b">``: kind, id, ``fields`` (map; quotes are taken off, of a repeated key the last counts)."""
    body = F.regexp_extract(F.col(line), r"^##[^=]+=<(.*)>\s*$", 1)
    parts = F.regexp_extract_all(body, F.lit(r'[^=,]+=(?:"(?:\\.|[^"\\])*"|[^,"]*)'), F.lit(0))
    rows = lines.where(F.col(line).rlike(r"^##[^=]+=<.*>\s*$")).select(F.regexp_extract(F.col(line), r"^##([^=]+)=<", 1).alias("kind"), parts.alias("p"))
    key = lambda x: F.substring_index(x, "=", 1)
    text = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^[^=]+=", ""), r'^"|"$', ""), r'\\"', '"')
    keys = F.array_distinct(F.transform("p", key))
    fields = F.map_from_arrays(keys, F.transform(keys, lambda k: text(F.element_at(F.filter("p", lambda x: key(x) == k), -1))))
    return rows.select("kind", fields.alias("fields")).select("kind", F.try_element_at("fields", F.lit("ID")).alias("id"), "fields")


def info_is(info: Column, key: str, op: str, expected: str) -> Column:
    """Whether any value of an INFO key (a comma list) meets a comparison: =, !=, <, <=, >, >=.

    Two numbers compare by value, other texts only by = and !=. A key without value is a flag, which
    equals true, 1 and the empty text. A missing key meets nothing.
    """
    values, bound = F.split(F.try_element_at(info, F.lit(key)), ","), to_num(F.lit(expected))
    tests = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    if op not in tests:
        raise ValueError(f"unknown comparison {op!r}")
    flag = F.lit(op == "=" and expected.lower() in ("true", "1", ""))
    words = (lambda v: tests[op](v, F.lit(expected))) if op in ("=", "!=") else (lambda v: F.lit(False))
    one = lambda v: F.when(v == "", flag).when(to_num(v).isNotNull() & bound.isNotNull(), tests[op](to_num(v), bound)).otherwise(words(v))
    return F.coalesce(F.exists(values, one), F.lit(False))


def consequences(vcf: DataFrame, keep: Sequence[str] = ("chrom", "pos", "ref", "alt")) -> DataFrame:
    """One row per annotation of INFO ANN or CSQ: keep, field, terms (array, lower case), impact (upper case), gene, gene_id, transcript, protein, amino_acids; missing parts are blank."""
    made = []
    for field, names, wanted in (("ANN", ANN_FIELDS, ("Annotation", "Annotation_Impact", "Gene_Name", "Gene_ID", "Feature_ID", "HGVS.p", "")), ("CSQ", CSQ_FIELDS, ("Consequence", "IMPACT", "SYMBOL", "Gene", "Feature", "HGVSp", "Amino_acids"))):
        entries = F.split(F.try_element_at("info", F.lit(field)), ",")
        rows = vcf.select(*keep, F.explode(entries).alias("entry")).withColumn("p", F.split("entry", r"\|"))
        at = [F.coalesce(F.get("p", F.lit(names.index(w))), F.lit("")) if w else F.lit("") for w in wanted]
        terms = F.filter(F.transform(F.split(at[0], "[&,+]"), lambda t: F.lower(F.trim(t))), lambda t: t != "")
        made.append(rows.select(*keep, F.lit(field).alias("field"), terms.alias("terms"), F.upper(at[1]).alias("impact"), *(c.alias(n) for c, n in zip(at[2:], ("gene", "gene_id", "transcript", "protein", "amino_acids"), strict=True))))
    return made[0].unionByName(made[1])


def with_consequence(vcf: DataFrame, keep: Sequence[str], impact: str | None = None, terms: Sequence[str] = (), genes: Sequence[str] = (), transcripts: Sequence[str] = (), protein: Sequence[str] = ()) -> DataFrame:
    """Variants with an annotation that meets every given test; names compare without case, ``protein`` is contained in the protein change or the amino acids. ``keep`` names the columns of the result."""
    low = lambda names: [n.lower() for n in names]
    rows = consequences(vcf, keep)
    if impact:
        rows = rows.where(F.col("impact") == impact.upper())
    if terms:
        rows = rows.where(F.arrays_overlap("terms", F.array(*(F.lit(t) for t in low(terms)))))
    if genes:
        rows = rows.where(F.lower("gene").isin(*low(genes)) | F.lower("gene_id").isin(*low(genes)))
    if transcripts:
        rows = rows.where(F.lower("transcript").isin(*low(transcripts)))
    if protein:
        rows = rows.where(F.exists(F.array(*(F.lit(p) for p in low(protein))), lambda p: F.contains(F.lower("protein"), p) | F.contains(F.lower("amino_acids"), p)))
    return rows.select(*keep).distinct()


def _alleles(samples: Column, format_: Column) -> Column:
    """Per sample, the called alleles of its GT; an empty array if it is missing."""
    place = F.array_position(format_, "GT").cast("int") - 1
    gt = lambda s: F.coalesce(F.get(F.split(s, ":"), place), F.lit(""))
    return F.transform(samples, lambda s: F.filter(F.split(gt(s), r"[/|]"), lambda a: (a != ".") & (a != "")))


def site_figures(vcf: DataFrame) -> DataFrame:
    """Adds, over a site's samples: n_samples, n_missing, n_called, n_reference (only allele 0), n_hom_ref (of two alleles and more), missing_rate (null without samples)."""
    calls = _alleles(F.col("samples"), F.coalesce("format", F.array().cast("array<string>")))
    count = lambda test: F.size(F.filter("_calls", test)).cast("long")
    reference = lambda a: (F.size(a) > 0) & F.forall(a, lambda x: x == "0")
    out = vcf.withColumn("_calls", calls).withColumns(
        {"n_samples": F.size("samples").cast("long"), "n_missing": count(lambda a: F.size(a) == 0), "n_reference": count(reference), "n_hom_ref": count(lambda a: reference(a) & (F.size(a) >= 2))}
    )
    return out.withColumns({"n_called": F.col("n_samples") - F.col("n_missing"), "missing_rate": F.col("n_missing") / F.when(F.col("n_samples") > 0, F.col("n_samples"))}).drop("_calls")


def filter_sites(vcf: DataFrame, mode: str = "any", most_missing: float | None = None) -> DataFrame:
    """Sites with samples by genotype: any, all-called, any-missing, all-hom-ref, all-reference; ``most_missing`` bounds the share of missing genotypes."""
    tests = {"any": F.lit(True), "all-called": F.col("n_missing") == 0, "any-missing": F.col("n_missing") > 0, "all-hom-ref": F.col("n_hom_ref") == F.col("n_samples"), "all-reference": F.col("n_reference") == F.col("n_samples")}
    out = site_figures(vcf).where("n_samples > 0").where(tests[mode])
    return out if most_missing is None else out.where(F.col("missing_rate") <= most_missing)


def split_info(vcf: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Adds a column ``info_<tag>`` per INFO tag: its text, blank for a flag that is set, null if it is missing."""
    return vcf.withColumns({f"info_{t}": F.try_element_at("info", F.lit(t)) for t in tags})


def project_lines(lines: DataFrame, samples: Sequence[int], line: str = "value") -> DataFrame:
    """VCF data lines with the fixed fields and the given samples (from 0) only; without samples, FORMAT drops out too. Header lines drop out."""
    f = F.split(F.col(line), "\t")
    rows = lines.where(~F.startswith(F.col(line), F.lit("#"))).select(f.alias("f")).where(F.size("f") >= 8)
    kept = [F.coalesce(F.get("f", F.lit(i)), F.lit(".")) for i in ([8, *(9 + s for s in samples)] if samples else [])]
    return rows.select(F.concat_ws("\t", F.array_join(F.slice("f", 1, 8), "\t"), *kept).alias("value"))


def sample_variants(vcf: DataFrame, n: int, key: Sequence[str], seed: int = 1, autosomes: bool = False, biallelic: bool = False, kinds: Sequence[str] = (), most_missing: float | None = None) -> DataFrame:
    """A seeded sample of ``n`` variants that pass the filters (autosomes 1 to 22 with or without ``chr``, one alternative allele, kinds, share of missing genotypes), by a hash of ``key``: the same ones on every run."""
    out = site_figures(vcf)
    if autosomes:
        number = F.regexp_replace(F.lower("chrom"), "^chr", "").try_cast("int")
        out = out.where(number.between(1, 22))
    if biallelic:
        out = out.where(~F.contains(F.col("alt"), F.lit(",")) & (F.col("alt") != "."))
    if kinds:
        out = out.where(F.col("kind").isin(*kinds))
    if most_missing is not None:
        out = out.where(F.col("missing_rate").isNull() | (F.col("missing_rate") <= most_missing))
    return out.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(n)


def first_variants(rows: DataFrame, key: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """All rows (genotypes, annotations) of the first ``n`` variants in an order: a report's limit counts variants, not rows."""
    first = rows.select(*key, *(o for o in order if o not in key)).groupBy(*key).agg(F.min(F.struct(*order)).alias("_o")).orderBy("_o").limit(n).select(*key)
    return rows.join(F.broadcast(first), list(key), "left_semi")  # n rows
