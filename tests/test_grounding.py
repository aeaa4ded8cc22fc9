"""Notes with one wrong claim each, and notes that only look wrong."""

import pytest

from reviewlane.operators import grounding

VALUES = {"offset_hz": 6903.7166, "downlink_hz": 436_490_000.0, "probability": 0.999999, "elevation": 37.5, "duration_s": 284.0, "closest": 0.0}
PRINTED = "offset 6,903.7 Hz, ratio -0.25, flagged STALE_CATALOGUE_FREQ and DEAD_CAPTURE"


def check(spark, text, values=VALUES):
    notes = spark.createDataFrame([(1, text, PRINTED, values)], "id int, text string, printed string, values map<string,double>")
    out = grounding.violations(notes, "id", "text", "printed", "values", ["probability"], "duration_s", "closest")
    return {(r.code, r.literal, r.unit) for r in out.collect()}


@pytest.mark.parametrize("text", [
    "An offset of 6904 Hz, or 6.90 kHz, on 436.490 MHz.", "The ratio is -0.25 and the probability 100%.", "The probability is 100.0 percent.",
    "Offset 6,903.7 Hz; the pass lasted 284 seconds.", "Peak 38 degrees, flagged DEAD_CAPTURE.", "Nothing to see.",
])
def test_grounded(spark, text):
    assert check(spark, text) == set()


@pytest.mark.parametrize("text, want", [
    ("An offset of 6.9 MHz.", {("UNGROUNDED_NUMBER", "6.9", "mhz")}),
    ("An offset of 9,603.7 Hz.", {("UNGROUNDED_NUMBER", "9,603.7", "hz")}),
    ("A frequency of 6490 Hz.", {("UNGROUNDED_NUMBER", "6490", "hz")}),
    ("Peak at 37 degrees.", {("UNGROUNDED_NUMBER", "37", "")}),  # 37.5 rounds to 38
    ("A ratio of 100%.", set()),
    ("Look around the 284-second mark.", {("MISLOCATED_TIME_CLAIM", "284", "s")}),
    ("Look 284 seconds into the pass, at t = 284 s.", {("MISLOCATED_TIME_CLAIM", "284", "s")}),
    ("It peaks near 0.25 of the pass.", {("UNGROUNDED_NUMBER", "0.25", ""), ("MISLOCATED_TIME_CLAIM", "0.25", "fraction")}),
    ("Flagged NO_SUCH_REASON.", {("UNGROUNDED_ENTITY", "NO_SUCH_REASON", "")}),
    ("  ", {("EMPTY", "", "")}), (None, {("EMPTY", "", "")}),
])
def test_violations(spark, text, want):
    assert check(spark, text) == want


def test_without_geometry_no_place_is_wrong(spark):
    assert check(spark, "Look around the 284-second mark.", {"x": 284.0}) == set()
