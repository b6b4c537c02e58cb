"""Declarative workflows: a list of steps becomes one lazy plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import seq
from strandloom.operators import scan, tables

#: Kinds of streams between steps; records are tables with (record_id, title, sequence).
TABLE, RECORDS = "table", "records"


def _records(df: DataFrame) -> DataFrame:
    missing = {"record_id", "sequence"} - set(df.columns)
    if missing:
        raise ValueError(f"records need the columns {sorted(missing)}")
    return df


def _filtered(df: DataFrame, field: str, rule: str, value: str) -> DataFrame:
    """Records by a rule on a column or on ``length``, the number of their letters."""
    with_length = df.withColumn("length", F.length("sequence")) if field == "length" else df
    return with_length.where(tables.row_rule(with_length, field, rule, value)).select(*df.columns)


#: Step name: (kind in, kind out, function of a DataFrame and the step's options).
STEPS: dict[str, tuple[str, str, Callable[..., DataFrame]]] = {
    "filter": (TABLE, TABLE, lambda df, column, rule, value="": df.where(tables.row_rule(df, column, rule, value))),
    "clean": (TABLE, TABLE, lambda df, **o: tables.clean_table(df, **o)),
    "calculate": (TABLE, TABLE, lambda df, name, operation, left, right=None: tables.calculate(df, name, operation, left, right)),
    "summarize": (TABLE, TABLE, lambda df, **o: tables.summarize_groups(df, **o)),
    "select": (TABLE, TABLE, lambda df, columns: df.select(*tables.column_list(columns))),
    "sort": (TABLE, TABLE, lambda df, rules, ties=(): tables.sort_by(df, rules, *ties)),
    "take": (TABLE, TABLE, lambda df, n: df.limit(n)),
    "to_records": (TABLE, RECORDS, _records),
    "filter_records": (RECORDS, RECORDS, lambda df, field, rule, value="": _filtered(df, field, rule, value)),
    "min_length": (RECORDS, RECORDS, lambda df, n: df.where(F.length("sequence") >= n)),
    "reverse_complement": (RECORDS, RECORDS, lambda df: df.withColumn("sequence", seq.reverse_complement(F.col("sequence")))),
    "translate": (RECORDS, RECORDS, lambda df: df.withColumn("sequence", seq.translate(F.col("sequence")))),
    "split": (RECORDS, RECORDS, lambda df: df.withColumn("item", F.col("record_id"))),
    "to_table": (RECORDS, TABLE, lambda df: df),
    "find_motifs": (RECORDS, TABLE, lambda df, motifs: scan.find_motifs(df, "record_id", "sequence", motifs)),
    "find_orfs": (RECORDS, TABLE, lambda df, min_codons=30: scan.find_orfs(df, "record_id", "sequence", min_codons)),
}


def check(steps: Sequence[dict[str, Any]], kind: str = TABLE) -> str:
    """The kind of the last step's rows; an unknown step or a kind that does not fit is an error, before anything runs."""
    for i, step in enumerate(steps, 1):
        if step.get("op") == "map":
            if kind != RECORDS:
                raise ValueError(f"step {i}: map takes {RECORDS}, not {kind}")
            kind = check(step.get("steps", ()), kind)
            continue
        if step.get("op") not in STEPS:
            raise ValueError(f"step {i}: unknown operation {step.get('op')!r}")
        takes, gives, _ = STEPS[step["op"]]
        if takes != kind:
            raise ValueError(f"step {i}: {step['op']} takes {takes}, not {kind}")
        kind = gives
    return kind


def run(df: DataFrame, steps: Sequence[dict[str, Any]], kind: str = TABLE) -> DataFrame:
    """Applies the steps in turn; each is ``{"op": name, **options}``.

    ``{"op": "map", "steps": [...]}`` applies steps to every record by itself. A record is
    a row, so these run over all of them at once; results keep the record's id.
    """
    check(steps, kind)
    for step in steps:
        if step["op"] == "map":
            df = run(df, step["steps"], RECORDS)
            continue
        df = STEPS[step["op"]][2](df, **{k: v for k, v in step.items() if k != "op"})
    return df


def gather(parts: Sequence[DataFrame]) -> DataFrame:
    """Tables under each other by column name; absent columns are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
