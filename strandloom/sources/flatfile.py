"""GenBank and EMBL flat files as records with nested features, by Spark expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.seq import reverse_complement


def location_ranges(location: Column) -> Column:
    """Array of (start, end, strand) of a feature location, in the order written.

    Ranges, single places and places between two letters, joined or ordered; a range is on
    the minus strand if an odd number of ``complement(`` is open before it. Other forms give no range.
    """
    compact = F.regexp_replace(location, r"\s+", "")
    pieces = F.regexp_extract_all(compact, F.lit(r"complement\(|join\(|order\(|\)|(?<![\w.:])<?\d+(?:(?:\.\.|\^)>?\d+)?(?![\w.:])"), F.lit(0))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,strand:string>>")

    def step(state: Column, p: Column) -> Column:
        opened = p.endswith("(")
        numbers = F.regexp_extract_all(p, F.lit(r"\d+"), F.lit(0))
        minus = F.size(F.filter(state["open"], lambda o: o == "complement(")) % 2 == 1
        place = F.struct(F.get(numbers, F.lit(0)).cast("long").alias("start"), F.coalesce(F.get(numbers, F.lit(1)), F.get(numbers, F.lit(0))).cast("long").alias("end"), F.when(minus, "-").otherwise("+").alias("strand"))
        return F.struct(
            F.when(opened, F.concat(state["open"], F.array(p))).when(p == ")", F.slice(state["open"], F.lit(1), F.greatest(F.size(state["open"]) - 1, F.lit(0)))).otherwise(state["open"]).alias("open"),
            F.when(opened | (p == ")"), state["ranges"]).otherwise(F.concat(state["ranges"], F.array(place))).alias("ranges"),
        )

    return F.aggregate(pieces, F.struct(F.array().cast("array<string>").alias("open"), empty.alias("ranges")), step, lambda s: s["ranges"])


def spliced(sequence: Column, ranges: Column) -> Column:
    """The letters of the ranges as read: forward ranges in their order; if all are on the minus strand, the whole in reverse; mixed ones each on its strand."""
    text = lambda r: F.substring(sequence, r["start"].cast("int"), (r["end"] - r["start"] + 1).cast("int"))
    minus = F.forall(ranges, lambda r: r["strand"] == "-") & (F.size(ranges) > 0)
    in_order = F.array_sort(ranges, lambda x, y: F.when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1).otherwise(0))
    each = F.array_join(F.transform(ranges, lambda r: F.when(r["strand"] == "-", reverse_complement(text(r))).otherwise(text(r))), "")
    return F.when(minus, reverse_complement(F.array_join(F.transform(in_order, text), ""))).otherwise(each)


def parse_flatfiles(records: DataFrame, text: str = "value") -> DataFrame:
    """Records out of texts of one flat-file entry each: accession, definition, organism, sequence, features.

    GenBank and EMBL layouts are told apart by their first tag. ``features`` is an array of
    (type, location, qualifiers), qualifiers an array of (name, value). Missing parts are
    null or empty; a blank text gives no row.
    """
    raw = F.regexp_replace(F.col(text), "\r\n?", "\n")
    rows = records.where(F.length(F.trim(F.col(text))) > 0).select(F.regexp_replace(raw, r"\A\n+", "").alias("_t")).where(F.length(F.trim("_t")) > 0)
    embl = F.col("_t").rlike(r"\AID ")
    got = lambda p, c="_t": F.nullif(F.trim(F.regexp_extract(c, p, 1)), F.lit(""))
    joined = lambda c, p: F.trim(F.regexp_replace(c, p, " "))
    block = F.when(embl, F.regexp_replace(F.array_join(F.regexp_extract_all("_t", F.lit(r"(?m)^FT[^\n]*"), F.lit(0)), "\n"), r"(?m)^FT", "  ")).otherwise(F.regexp_extract("_t", r"(?s)\nFEATURES[^\n]*\n(.*?)(?=\n\S|\z)", 1))
    letters = F.when(embl, F.regexp_extract("_t", r"(?s)\nSQ [^\n]*\n(.*)\z", 1)).otherwise(F.regexp_extract("_t", r"(?s)\nORIGIN[^\n]*\n(.*)\z", 1))
    parts = F.regexp_extract_all("_b", F.lit(r"(?m)^ {5}\S[^\n]*(?:\n {6,}[^\n]*)*"), F.lit(0))

    def feature(f: Column) -> Column:
        unfolded = F.regexp_replace(f, r"\n {6,}", "\n")
        head = F.regexp_replace(F.regexp_extract(unfolded, r"(?s)\A {5}(.*?)(?=\n/|\z)", 1), r"\n", "")
        notes = F.regexp_extract_all(unfolded, F.lit(r'(?s)\n/(?:[\w-]+="(?:[^"]|"")*"|[^\n]*)'), F.lit(0))
        return F.struct(
            F.regexp_extract(head, r"^(\S+)", 1).alias("type"),
            F.regexp_replace(F.regexp_extract(head, r"^\S+\s+(.*)$", 1), r"\s+", "").alias("location"),
            F.transform(
                notes,
                lambda q: F.struct(
                    F.regexp_extract(q, r"/([^=\n]+)", 1).alias("name"),
                    F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_extract(q, r"(?s)=(.*)\z", 1), r'\A"|"\z', ""), '""', '"'), r"\n", " ").alias("value"),
                ),
            ).alias("qualifiers"),
        )

    with_parts = rows.select("_t", block.alias("_b"), letters.alias("_s"), embl.alias("_embl"))
    return with_parts.select(
        F.when(F.col("_embl"), got(r"\AID\s+([^;\s]+)")).otherwise(F.coalesce(got(r"\nACCESSION[ \t]+(\S+)"), got(r"\ALOCUS\s+(\S+)"))).alias("accession"),
        F.when(F.col("_embl"), joined(F.array_join(F.regexp_extract_all("_t", F.lit(r"(?m)^DE\s+([^\n]*)"), F.lit(1)), " "), r"\s+")).otherwise(joined(F.regexp_extract("_t", r"(?s)\nDEFINITION\s+(.*?)(?=\n\S|\z)", 1), r"\s+")).alias("definition"),
        F.when(F.col("_embl"), got(r"\nOS\s+([^\n]+)")).otherwise(got(r"\n  ORGANISM\s+([^\n]+)")).alias("organism"),
        F.upper(F.regexp_replace("_s", r"[^A-Za-z*-]", "")).alias("sequence"),
        F.transform(parts, feature).alias("features"),
    )


def read_flatfiles(spark: SparkSession, path: str) -> DataFrame:
    """Entries of GenBank or EMBL files; a file is split at ``//`` lines, so entries spread over tasks."""
    return parse_flatfiles(spark.read.text(path, lineSep="\n//"))


def feature_rows(records: DataFrame) -> DataFrame:
    """One row per feature: accession, no, type, location, start, end, strand, letters (spliced), qualifiers."""
    rows = records.select("accession", "sequence", F.posexplode("features").alias("_i", "f")).withColumn("_r", location_ranges(F.col("f.location")))
    low = F.array_min(F.transform("_r", lambda r: r["start"]))
    high = F.array_max(F.transform("_r", lambda r: r["end"]))
    strand = F.when(F.exists("_r", lambda r: r["strand"] == "-"), "-").otherwise("+")
    return rows.select("accession", (F.col("_i") + 1).alias("no"), F.col("f.type").alias("type"), F.col("f.location").alias("location"), low.alias("start"), high.alias("end"), strand.alias("strand"), spliced(F.col("sequence"), F.col("_r")).alias("letters"), F.col("f.qualifiers").alias("qualifiers"))
