"""Faults of coverages, lists of ranges and records, each made on purpose."""

import pytest
from chaptermill.operators import validation
from pyspark.sql import functions as F

SEGMENTS = "book_id string, pos long, start_byte long, end_byte long, classification string, chapter_id string, reason string"
RANGES = "book_id string, pos long, start_byte long, end_byte long"
GOOD = [("b", 0, 0, 4, "unknown", None, None), ("b", 1, 4, 9, "chapter", "c1", "uncovered-to-next"), ("b", 2, 9, 10, "unknown", None, None), ("b", 3, 10, 12, "noise", None, None)]
LIST, REPORT = [("b", 0, 0, 4), ("b", 1, 9, 10)], ("b", 12, 7, 5, False)


def faults(spark, segments, listed=LIST, report=REPORT):
    frames = spark.createDataFrame(segments, SEGMENTS), spark.createDataFrame(listed, RANGES), spark.createDataFrame([report], "book_id string, total long, classified long, unclassified long, complete boolean")
    found = validation.coverage_faults(*frames, spark.createDataFrame([("b", "c1")], "book_id string, chapter_id string"))
    return sorted((r.at if r.at is not None else -1, r.fault) for r in found.collect())


def changed(i, **columns):
    names = ["book_id", "pos", "start_byte", "end_byte", "classification", "chapter_id", "reason"]
    return [tuple(columns.get(n, v) for n, v in zip(names, row, strict=True)) if k == i else row for k, row in enumerate(GOOD)]


@pytest.mark.parametrize("segments, listed, report, want", [
    (GOOD, LIST, REPORT, []),
    (changed(1, classification="prose"), LIST, REPORT, [(1, "chapter"), (1, "classification")]),
    (changed(1, chapter_id="c2"), LIST, REPORT, [(1, "chapter")]), (changed(1, chapter_id=None), LIST, REPORT, [(1, "chapter")]),
    (changed(1, reason="because"), LIST, REPORT, [(1, "reason")]), (changed(3, reason="uncovered-to-last"), LIST, REPORT, [(3, "chapter")]),
    (changed(3, start_byte=12), LIST, REPORT, [(-1, "classified"), (3, "contiguity"), (3, "range")]),
    (changed(3, end_byte=13), LIST, REPORT, [(-1, "classified"), (-1, "end"), (3, "range")]),
    (changed(2, start_byte=8), LIST, REPORT, [(-1, "unclassified"), (2, "contiguity"), (2, "uncovered")]),
    (GOOD, [("b", 0, 0, 4)], REPORT, [(2, "uncovered")]), (GOOD, [*LIST, ("b", 9, 11, 12)], REPORT, [(3, "uncovered")]), (GOOD, [("b", 0, 9, 10), ("b", 1, 0, 4)], REPORT, [(1, "uncovered"), (2, "uncovered")]),
    (GOOD, LIST, ("b", 12, 7, 5, True), [(-1, "complete")]), (GOOD, LIST, ("b", 12, None, 4, False), [(-1, "classified"), (-1, "unclassified")]),
    ([], [], ("b", 12, 0, 0, False), [(-1, "end")]), ([], [], ("b", 0, 0, 0, True), []),
])
def test_coverage_faults(spark, segments, listed, report, want):
    assert faults(spark, segments, listed, report) == want


def test_unassigned_faults(spark):
    ranges = [("a", 0, 0, 5), ("a", 1, 5, 9), ("b", 0, 0, 5), ("b", 1, 6, 9), ("c", 0, 3, 5), ("c", 1, 4, 4), ("c", 2, 8, 20)]
    books = spark.createDataFrame([("a", 9), ("b", 10), ("c", 10), ("d", 4), ("e", 0)], "book_id string, total long")
    found = validation.unassigned_faults(spark.createDataFrame(ranges, RANGES), spark.createDataFrame([("c",)], "book_id string"), books).collect()
    assert sorted((r.book_id, r.at if r.at is not None else -1, r.fault) for r in found) == [("b", -1, "coverage"), ("b", 1, "coverage"), ("c", 1, "order"), ("c", 1, "range"), ("c", 2, "range"), ("d", -1, "coverage")]


def test_record_faults_and_counts(spark, tmp_path):
    schema = "id string, name string, size long"
    manifests = spark.createDataFrame([("1", "a", 1), ("2", "b", None), ("3", "c", 3), ("4", "d", 4), ("4", "d", 4)], schema)
    records = spark.createDataFrame([("1", "a", 1), ("2", "x", 2), ("4", "d", 4), ("5", "e", 5)], schema)
    found = validation.record_faults(manifests, records, "id", ["name", "size"])
    assert sorted((r.id, r.fault) for r in found.collect()) == [("2", "name"), ("2", "size"), ("3", "missing"), ("4", "repeated"), ("5", "orphan")]
    rows, seen = validation.counted(manifests, {"unnamed": F.col("name").isNull(), "large": F.col("size") > 2, "sizeless": F.col("size").isNull()})
    rows.write.parquet(str(tmp_path / "out"))
    assert seen.get == {"n": 5, "unnamed": 0, "large": 3, "sizeless": 1}


def test_segments_are_placed_once(spark):
    """What is derived of lists of segments is stored, so their faults don't place them again."""
    segments = spark.createDataFrame([("b", 0, 0, 3, "chapter", "c", None)], "book_id string, pos long, start_byte long, end_byte long, classification string, chapter_id string, reason string")
    reports = spark.createDataFrame([("b", 3, 3, 0, True)], "book_id string, total long, classified long, unclassified long, complete boolean")
    found = validation.coverage_faults(segments, segments.filter("pos < 0").select("book_id", "pos", "start_byte", "end_byte"), reports, segments.select("book_id", "chapter_id"))
    assert any("/segments-" in f for f in found.inputFiles()) and found.isEmpty()
