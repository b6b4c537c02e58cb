"""Writers: each task writes its own part; nothing passes through the driver but short Markdown tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.seq import wrapped


def write_delimited(df: DataFrame, path: str, delimiter: str = "\t") -> None:
    """Delimited files with a header, quoted where needed."""
    df.write.options(header=True, sep=delimiter, quote='"', escape='"', emptyValue="").csv(path)


def fasta_text(title: Column, sequence: Column, width: int = 60) -> Column:
    """One FASTA record."""
    return F.concat(F.lit(">"), title, F.lit("\n"), wrapped(sequence, width))


def write_fasta(df: DataFrame, path: str, title: str = "title", sequence: str = "sequence", width: int = 60) -> None:
    """FASTA files; null titles are blank, null sequences drop out."""
    df.where(F.col(sequence).isNotNull()).select(fasta_text(F.coalesce(title, F.lit("")), F.col(sequence), width).alias("value")).write.text(path)


def write_fastq(df: DataFrame, path: str) -> None:
    """FASTQ files from (title, sequence, quality)."""
    df.select(F.concat(F.lit("@"), "title", F.lit("\n"), "sequence", F.lit("\n+\n"), "quality").alias("value")).write.text(path)


def gff3_lines(df: DataFrame) -> DataFrame:
    """GFF3 lines from (record, source, type, start, end, score, strand, phase, attributes)."""
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    attributes = F.array_join(F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit("="), F.url_encode(e["value"]))), ";")
    return df.select(F.concat_ws("\t", *(dot(c) for c in ("record", "source", "type", "start", "end", "score", "strand", "phase")), F.coalesce(attributes, F.lit("."))).alias("value"))


def bed_lines(df: DataFrame) -> DataFrame:
    """BED lines (0-based, half open) from 1-based (record, start, end, name, score, strand)."""
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    return df.select(F.concat_ws("\t", F.col("record"), (F.col("start") - 1).cast("string"), F.col("end").cast("string"), dot("name"), F.coalesce(F.col("score").cast("string"), F.lit("0")), dot("strand")).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    """JSON files, an object per line."""
    df.write.json(path)


def markdown_lines(df: DataFrame) -> DataFrame:
    """Every row as a line of a GitHub table (one column, ``value``); ``markdown_head`` goes before them."""
    cell = lambda c: F.regexp_replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), "\r\n|\r|\n", "<br>")
    parts = [x for c in df.columns for x in (F.lit("| "), cell(c), F.lit(" "))]
    return df.select(F.concat(*parts, F.lit("|")).alias("value"))


def markdown_head(df: DataFrame) -> str:
    """The first two lines of a GitHub table of the columns."""
    names = [c.replace("|", "\\|") for c in df.columns]
    return "| " + " | ".join(names) + " |\n|" + " --- |" * len(names)


def markdown(df: DataFrame, limit: int = 100) -> str:
    """A GitHub table of the first ``limit`` rows, for reading; a last line says if there are more. ``markdown_lines`` writes all rows."""
    rows = [r["value"] for r in markdown_lines(df).limit(limit + 1).collect()]
    more = [f"\nOnly the first {limit} rows are shown."] if len(rows) > limit else []
    return "\n".join([markdown_head(df), *rows[:limit], *more])
