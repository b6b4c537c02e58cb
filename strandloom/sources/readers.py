"""Readers of delimited, JSON and sequence-data text."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.operators.genomics import parse_bed, parse_features, parse_vcf
from strandloom.operators.grouping import ordered_totals

DELIMITERS = {"tab": "\t", "comma": ",", "semicolon": ";", "pipe": "|"}


def detect_delimiter(lines: Sequence[str]) -> tuple[str, float]:
    """The delimiter of the first 25 non-empty lines and a confidence: consistency x coverage x mean number of fields; tab and 0 if none fits."""
    sample = [line for line in lines if line.strip()][:25]
    best = ("tab", 0.0)
    for name, d in DELIMITERS.items():
        sizes = [len(re.sub(r'"[^"]*"', "", line).split(d)) for line in sample]
        split = [n for n in sizes if n > 1]
        if split:
            common = max(split.count(n) for n in split)
            score = common / len(split) * len(split) / len(sample) * sum(split) / len(split)
            best = max(best, (name, score), key=lambda x: x[1])
    return best


def slug(labels: Sequence[str]) -> list[str]:
    """Column ids of header labels: lower case, other characters as ``_``, repeated ids numbered from ``_2``."""
    out: list[str] = []
    for i, label in enumerate(labels):
        base = re.sub(r"[^a-z0-9]+", "_", (label or "").lower()).strip("_") or f"column_{i + 1}"
        name, k = base, 1
        while name in out:
            k += 1
            name = f"{base}_{k}"
        out.append(name)
    return out


def breaks_in_quotes(spark: SparkSession, path: str) -> bool:
    """Whether some line of the files has an odd number of double quotes, so that a quoted field may go on in the next one."""
    quotes = F.length("value") - F.length(F.translate("value", '"', ""))
    return bool(spark.read.text(path).where(quotes % 2 == 1).take(1))


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None, header: bool = True, multi_line: bool | None = None) -> DataFrame:
    """A delimited file as text columns, blank cells as ``""``.

    Quoted fields may hold delimiters, line breaks and doubled quotes. Ids are made
    from the header, the label stays in the column's metadata; short rows are
    padded, blank rows drop out. Without ``delimiter`` the first lines decide.
    ``multi_line`` says whether quoted fields hold line breaks: such a file is read by
    one task, others are split. Unless given, one look over the lines decides.
    """
    head = [r["value"] for r in spark.read.text(path).limit(25).collect()]
    sep = DELIMITERS.get(delimiter, delimiter) if delimiter else DELIMITERS[detect_delimiter(head)[0]]
    whole = breaks_in_quotes(spark, path) if multi_line is None else multi_line
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": whole, "mode": "PERMISSIVE", "nullValue": "\u0000"}
    labels = list(spark.read.options(header=False, **options).csv(path).limit(1).first() or [])
    names = slug([str(x or "") for x in labels]) if header else [f"column_{i + 1}" for i in range(len(labels))]
    schema = T.StructType([T.StructField(n, T.StringType(), True, {"label": str(x or "")}) for n, x in zip(names, labels, strict=True)])
    rows = spark.read.options(header=header, enforceSchema=True, **options).schema(schema).csv(path)
    filled = rows.select(*(F.coalesce(F.col(f.name), F.lit("")).alias(f.name, metadata=f.metadata) for f in schema.fields))
    return filled.where(F.length(F.trim(F.concat_ws("", *names))) > 0) if names else filled


#: Keys under which a JSON object may hold its table.
JSON_WRAPPERS = ("rows", "data", "records", "items")


def read_json_table(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """JSON as a table of text: the union of keys, missing keys as ``""``, nested values as JSON text.

    A file may be one array of objects, one of arrays (columns ``column_1`` …), an object
    that holds such an array under rows, data, records or items, one other value (column
    ``value``), or an object per line. ``multi_line`` says that values go over several
    lines, which one task reads then; unless given, the first line decides: if it is an
    object by itself, files hold one per line and are split.
    """
    if multi_line is None:
        head = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
        multi_line = not (head and _is_json_object(head[0]["value"]) and not any(k in json.loads(head[0]["value"]) for k in JSON_WRAPPERS))
    if not multi_line:
        return _cells(spark.read.json(path))
    # the values of each file, one row each, of whatever shape
    texts = spark.read.text(path, wholetext=True).where("trim(value) <> ''")
    inner = F.coalesce(*(F.get_json_object("value", f"$.{k}") for k in JSON_WRAPPERS), F.col("value"))
    listed = F.when(F.startswith(F.trim(inner), F.lit("[")), inner).otherwise(F.concat(F.lit("["), inner, F.lit("]")))
    values = texts.select(F.explode(F.from_json(listed, "array<string>")).alias("v"))
    lists = values.agg(F.coalesce(F.bool_and(F.startswith(F.coalesce(F.col("v"), F.lit("")), F.lit("["))), F.lit(False)).alias("lists"), F.max(F.size(F.from_json("v", "array<string>"))).alias("width")).first()
    if lists["lists"]:
        cells = F.from_json("v", "array<string>")
        return values.select(*(F.coalesce(F.get(cells, F.lit(i)), F.lit("")).alias(f"column_{i + 1}") for i in range(max(1, lists["width"]))))
    objects = values.select(F.when(F.startswith(F.trim("v"), F.lit("{")), F.col("v")).otherwise(F.to_json(F.struct(F.col("v").alias("value")))).alias("v"))
    if not objects.take(1):
        return spark.createDataFrame([], "value string")
    keys = sorted(r[0] for r in objects.select(F.explode(F.json_object_keys("v"))).distinct().collect())  # columns of the table
    fields = F.from_json("v", "map<string,string>")
    return objects.select(fields.alias("m")).select(*(F.coalesce(F.try_element_at("m", F.lit(k)), F.lit("")).alias(k) for k in keys))


def _is_json_object(text: str) -> bool:
    try:
        return isinstance(json.loads(text), dict)
    except ValueError:
        return False


def _cells(rows: DataFrame) -> DataFrame:
    nested = (T.StructType, T.ArrayType, T.MapType)
    cell = lambda f: F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`").cast("string")
    return rows.select(*(F.coalesce(cell(f), F.lit("")).alias(f.name) for f in rows.schema.fields))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """FASTA records as (title, sequence): white space is dropped from sequences; text before the first ``>`` is a record without title."""
    rows = spark.read.option("lineSep", "\n>").text(path).where("trim(value) <> ''").withColumn("value", F.regexp_replace("value", r"^>", ""))
    return rows.select(F.trim(F.regexp_extract("value", r"^([^\r\n]*)", 1)).alias("title"), F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s+", "").alias("sequence"))


def fasta_index(spark: SparkSession, path: str) -> DataFrame:
    """The index of FASTA files: file, name, length, offset (of the first letter, in bytes), line_bases, line_width, uniform.

    ``uniform`` is false if a line before a record's last letters has another size, so that
    places cannot be computed from the index. Records without letters have length 0.
    """
    text = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"))
    head = F.startswith(F.col("value"), F.lit(">"))
    lines = text.withColumns({"width": (F.octet_length("value") + 1).cast("long"), "heads": F.when(head, 1).otherwise(0).cast("long")})
    placed = ordered_totals(lines, ["file", "block", "i"], ["width", "heads"])
    starts = placed.groupBy("file").agg(F.min(F.col("width_upto") - F.col("width")).alias("base"))
    placed = placed.join(starts, "file").withColumns({"at": F.col("width_upto") - F.col("width") - F.col("base"), "bases": F.length(F.regexp_replace("value", r"\s+$", "")).cast("long")})
    letters = placed.where((F.col("heads") == 0) & (F.col("heads_upto") > 0) & (F.col("bases") > 0)).groupBy("file", "heads_upto").agg(
        F.sum("bases").alias("length"), F.min("at").alias("offset"), F.min_by("bases", "at").alias("line_bases"), F.min_by("width", "at").alias("line_width"),
        F.count("*").alias("lines"), F.max_by("bases", "at").alias("rest"), F.max("bases").alias("most"),
    )
    full = (F.col("lines") - 1) * F.col("line_bases") == F.col("length") - F.col("rest")
    even = full & (F.col("most") == F.col("line_bases")) & (F.col("rest") <= F.col("line_bases"))
    names = placed.where("heads = 1").select("file", "heads_upto", F.regexp_extract("value", r"^>\s*(\S*)", 1).alias("name"), (F.col("at") + F.col("width")).alias("_behind"))
    zero = F.lit(0).cast("long")
    return names.join(letters, ["file", "heads_upto"], "left").select("file", "name", F.coalesce("length", zero).alias("length"), F.coalesce("offset", "_behind").alias("offset"), F.coalesce("line_bases", zero).alias("line_bases"), F.coalesce("line_width", zero).alias("line_width"), F.coalesce(even, F.lit(True)).alias("uniform"))


def numbered_lines(spark: SparkSession, path: str, keep_blank: bool = False) -> DataFrame:
    """(file, line_no, value) over the non-blank lines of each file, numbered from 0 in the order of the file; ``keep_blank`` counts blank ones too.

    Spark reads a file in blocks and puts blocks in any order into partitions. Lines are
    numbered inside their block, and the blocks' sizes, one row each, give the offsets.
    """
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = (text if keep_blank else text.where("trim(value) <> ''")).withColumn("i", F.monotonically_increasing_id())
    sizes = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    before = sizes.select("file", "block", "first", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    # a block's lines stand in one partition, one behind the other
    return lines.join(before, ["file", "block"]).select("file", (F.col("before") + F.col("i") - F.col("first")).alias("line_no"), F.regexp_replace("value", "\r$", "").alias("value"))


def read_fastq(spark: SparkSession, path: str, keep_blank: bool = False, clip: bool = False) -> DataFrame:
    """Four-line FASTQ records: file, read_no (from 0 in each file), title, sequence, quality, and ``problem`` (null if none: header, separator or length).

    Blank lines are dropped unless ``keep_blank``, as in a stream; ``clip`` cuts sequence and quality to the shorter one of them.
    """
    lines = numbered_lines(spark, path, keep_blank)
    part = lambda k: F.max(F.when(F.col("line_no") % 4 == k, F.col("value")))
    reads = lines.groupBy("file", F.floor(F.col("line_no") / 4).alias("read_no")).agg(part(0).alias("head"), part(1).alias("sequence"), part(2).alias("plus"), part(3).alias("quality"))
    problem = F.when(~F.startswith(F.col("head"), F.lit("@")), "header").when(F.col("plus").isNull() | ~F.startswith(F.col("plus"), F.lit("+")), "separator").when(F.coalesce(F.length("sequence") != F.length("quality"), F.lit(True)), "length")
    short = F.least(F.length("sequence"), F.coalesce(F.length("quality"), F.lit(0)))
    cut = lambda c: F.substring(F.col(c), F.lit(1), short).alias(c) if clip else F.col(c)
    return reads.select("file", "read_no", F.regexp_replace("head", "^@", "").alias("title"), cut("sequence"), cut("quality"), problem.alias("problem"))


def read_sam_header(spark: SparkSession, path: str) -> DataFrame:
    """Header lines of SAM files: kind (HD, SQ, RG, PG, CO) and ``tags`` (map; of a repeated tag the last counts); comment lines have their text under ``CO``."""
    lines = spark.read.text(path).where(F.startswith(F.col("value"), F.lit("@")))
    kind, fields = F.substring(F.split("value", "\t")[0], 2, 2), F.filter(F.slice(F.split("value", "\t"), 2, 1000), lambda x: x.rlike("^[^:]+:.+$"))
    keys = F.array_distinct(F.transform(fields, lambda x: F.substring_index(x, ":", 1)))
    last = lambda k: F.regexp_replace(F.element_at(F.filter(fields, lambda x: F.substring_index(x, ":", 1) == k), -1), "^[^:]+:", "")
    tags = F.when(kind == "CO", F.create_map(F.lit("CO"), F.regexp_replace("value", "^@CO\t?", ""))).otherwise(F.map_from_arrays(keys, F.transform(keys, last)))
    return lines.select(kind.alias("kind"), tags.alias("tags"))


def detect_interval_format(lines: Sequence[str]) -> str:
    """vcf, gtf, gff or bed, from the first lines of a file."""
    if any(line.startswith(("##fileformat=VCF", "#CHROM")) for line in lines):
        return "vcf"
    data = next((line.split("\t") for line in lines if line.strip() and not line.startswith("#")), [])
    if len(data) < 9:
        return "bed"
    return "gtf" if re.search(r'gene_id\s+"|transcript_id\s+"', data[8]) else "gff"


def read_intervals(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Intervals of a BED, GFF3, GTF or VCF file in one form: record, start, end, name, strand; without ``kind`` the first lines decide."""
    kind = kind or detect_interval_format([r["value"] for r in spark.read.text(path).limit(200).collect()])
    if kind == "bed":
        return read_bed(spark, path).select("record", "start", "end", "name", "strand")
    if kind == "vcf":
        return read_vcf(spark, path).select(F.col("chrom").alias("record"), F.col("pos").alias("start"), "end", F.col("id").alias("name"), F.lit(".").alias("strand"))
    name = F.coalesce(*(F.try_element_at("attributes", F.lit(k)) for k in ("ID", "Name", "gene_id", "transcript_id")), F.col("type"))
    return read_features(spark, path, gtf=kind == "gtf").select("record", "start", "end", name.alias("name"), "strand")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """SAM alignment rows with typed fields and ``tags`` (map); header lines drop out."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.startswith(F.col("value"), F.lit("@"))).select(f.alias("f")).where(F.size("f") >= 11)
    names = ["qname", "flag", "reference", "start", "mapq", "cigar", "mate_reference", "mate_start", "template_length", "sequence", "quality"]
    types = {"flag": "int", "start": "bigint", "mapq": "int", "mate_start": "bigint", "template_length": "bigint"}
    tags = F.filter(F.slice("f", 12, F.greatest(F.size("f") - 11, F.lit(1))), lambda x: x.rlike("^[A-Za-z][A-Za-z0-9]:[A-Za-z]:"))
    keys = F.transform(tags, lambda x: F.substring(x, 1, 2))
    tag_map = F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.map_from_arrays(keys, F.transform(tags, lambda x: F.substring(x, 6, 1_000_000))))
    return rows.select(*((F.get("f", F.lit(i)).try_cast(types[n]) if n in types else F.get("f", F.lit(i))).alias(n) for i, n in enumerate(names)), tag_map.alias("tags"))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """VCF data lines; see ``parse_vcf``."""
    return parse_vcf(spark.read.text(path))


def read_features(spark: SparkSession, path: str, gtf: bool = False) -> DataFrame:
    """GFF3 or GTF features; see ``parse_features``."""
    return parse_features(spark.read.text(path), gtf=gtf)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """BED intervals, 1-based; see ``parse_bed``."""
    return parse_bed(spark.read.text(path))


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    """PAF alignment blocks with 1-based closed coordinates and identity."""
    f = F.split("value", "\t")
    at = lambda i: F.get("f", F.lit(i)).try_cast("bigint")
    rows = spark.read.text(path).select(f.alias("f")).where(F.size("f") >= 12)
    return rows.select(F.get("f", F.lit(0)).alias("query"), at(1).alias("query_length"), (at(2) + 1).alias("query_start"), at(3).alias("query_end"), F.get("f", F.lit(4)).alias("strand"), F.get("f", F.lit(5)).alias("reference"), at(6).alias("reference_length"), (at(7) + 1).alias("start"), at(8).alias("end"), at(9).alias("matches"), at(10).alias("block_length"), at(11).alias("mapq"),
                       F.round(at(9) / F.when(at(10) > 0, at(10)), 6).alias("identity"))
