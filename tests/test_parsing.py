import csv
import random

from strandloom.operators.parsing import loaded, parse_lines, rejected
from strandloom.plans.problem_queries import SAM_LINE_FIELDS, SAM_LINE_RULES

GOOD = 'q1,99,ctg1,10,20,+,60,10M,10,10,5,rg,S1,ok'


def reasons(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "line_id long, raw_line string")
    out = {}
    for r in rejected(parse_lines(df, "raw_line", SAM_LINE_FIELDS, SAM_LINE_RULES), ["line_id"]).collect():
        out.setdefault(r["line_id"], set()).add(r["reason"])
    return [out.get(i, set()) for i in range(len(lines))]


def with_field(i, v):
    parts = GOOD.split(",")
    parts[i] = v
    return ",".join(parts)


def test_reasons(spark):
    cases = [
        (GOOD, set()), (None, {"columns"}), ("", {"columns"}), (GOOD + ",x", {"columns"}), (with_field(11, '"a,b"'), set()), (with_field(11, '"a""b"'), set()), (with_field(11, '"a\nb"'), set()),
        (with_field(11, '"'), {"quoting"}), (with_field(11, 'a"b'), {"quoting"}), (with_field(11, '"a"b'), {"quoting"}), (with_field(11, '"a" '), {"quoting"}), (with_field(11, '""'), set()), (with_field(11, '""""'), set()),
        (with_field(1, ""), {"flag"}), (with_field(1, "65536"), {"flag"}), (with_field(1, "0065535"), set()), (with_field(1, "-1"), {"flag"}), (with_field(1, "9" * 40), {"flag"}), (with_field(1, "12\n"), {"flag"}), (with_field(1, "٣"), {"flag"}),
        (with_field(3, "2147483647"), set()), (with_field(3, "2147483648"), {"start"}), (with_field(7, "*"), set()), (with_field(7, ""), {"cigar"}), (with_field(7, "10M5"), {"cigar"}), (with_field(7, "M"), {"cigar"}), (with_field(7, "1M" * 50_000), set()),
        ('q,x,c,y,,,,z,,,,,,', {"flag", "start", "cigar"}), (with_field(11, "\u0001f\u0001"), set()), (with_field(1, '"99"'), set()), ('"' + "a" * 200_000 + '"' + GOOD[2:], set()),
    ]
    assert reasons(spark, [c[0] for c in cases]) == [c[1] for c in cases]


def test_fields_as_the_csv_module_reads_them(spark):
    rng = random.Random(3)
    lines = [",".join('"' + "".join(rng.choice('ab,\n') for _ in range(4)) + '""x"' if rng.random() < 0.4 else rng.choice(["", "v", "\u0001", "\u0001e"]) for _ in range(5)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(lines)), "i long, raw string")
    got = {r["i"]: list(r["fields"]) for r in parse_lines(df, "raw", list("abcde"), {}).collect()}
    assert got == {i: next(csv.reader([line])) if "\n" not in line else list(csv.reader(line.splitlines(keepends=True)))[0] for i, line in enumerate(lines)}


def test_loaded_types_and_extra_columns(spark):
    df = spark.createDataFrame([(1, GOOD, "clash"), (2, "bad", "x")], "line_id long, raw_line string, flag string")
    parsed = parse_lines(df, "raw_line", SAM_LINE_FIELDS, SAM_LINE_RULES)
    out = loaded(parsed, ["line_id"], SAM_LINE_FIELDS, {"flag": "int", "start": "bigint", "mapq": "int"}).collect()
    assert [(r["line_id"], r["flag"], r["start"], r["mapq"], r["status"]) for r in out] == [(1, 99, 10, 60, "ok")]


def test_empty(spark):
    df = spark.createDataFrame([], "line_id long, raw_line string")
    assert rejected(parse_lines(df, "raw_line", SAM_LINE_FIELDS, SAM_LINE_RULES), ["line_id"]).count() == 0
