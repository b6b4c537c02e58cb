import pytest

from strandloom.operators import scan

BEFORE, FRAME = "ATGGCA", "TAA" + "ATG" + "GCA" * 5 + "TGA"


@pytest.mark.parametrize("filler", ["", "-", "---", "..", "*/", " ", "\n  61 ", "1 2"])
def test_frames_behind_gaps_and_digits(spark, filler):
    rows = spark.createDataFrame([(1, BEFORE + filler + FRAME)], "record_id long, s string")
    found = [tuple(r) for r in scan.find_orfs(rows, "record_id", "s", 6).collect()]
    assert found == [(1, "+", 1, 10, 30, 6)]


def test_digits_inside_a_frame_of_the_other_strand(spark):
    turned = (FRAME[:8] + "10 " + FRAME[8:])[::-1].translate(str.maketrans("ACGT", "TGCA"))
    rows = spark.createDataFrame([(1, turned)], "record_id long, s string")
    assert [tuple(r) for r in scan.find_orfs(rows, "record_id", "s", 6).collect()] == [(1, "-", 1, 1, 21, 6)]
