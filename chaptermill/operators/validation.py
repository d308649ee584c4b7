"""Results and stored records checked against rules: every fault is a row, and faults are counted in the pass that writes.

Lists are frames with their place in the list as ``pos``; they are compared place by place along stretches,
so no list has to fit in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from chaptermill.operators.ordered import along
from chaptermill.operators.stored import stored

# What a segment of a text can be, and why bytes may belong to a chapter that doesn't hold them.
CLASSES = ["front-matter", "chapter", "appendix", "noise", "unknown"]
REASONS = ["uncovered-to-last", "uncovered-to-next"]


def _told(rows: DataFrame, key: list[str], tests: dict[str, Column]) -> DataFrame:
    """``key`` and fault of each test of a row that holds."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in tests.items()]))
    return rows.select(*key, F.explode(found).alias("fault"))


def coverage_faults(segments: DataFrame, uncovered: DataFrame, reports: DataFrame, chapters: DataFrame) -> DataFrame:
    """book_id, at (a place in the list; null for the whole) and fault of coverages that don't hold.

    ``segments`` (book_id, pos, start_byte, end_byte, classification, chapter_id, reason): ``range`` (empty, or outside the
    text), ``contiguity`` (doesn't start where the one before ends), ``classification``, ``reason``, ``chapter`` (of a chapter
    that isn't there, or no chapter's but with its columns). ``uncovered`` (book_id, pos, start_byte, end_byte) has to be the
    list of unknown segments, place by place: ``uncovered``. ``reports`` (book_id, total, classified, unclassified,
    complete) have to say what the segments add up to: ``end``, ``classified``, ``unclassified``, ``complete``."""
    known = chapters.select("book_id", "chapter_id").distinct().withColumn("_known", F.lit(True))
    unknown = F.col("classification") == "unknown"
    placed = stored(along(segments, ["book_id"], "pos", totals={"_unknowns": unknown.cast("int")}, before={"_reach": "end_byte"}), "segments")
    rows = placed.join(reports.select("book_id", "total"), "book_id").join(known, ["book_id", "chapter_id"], "left")
    chapter = F.col("classification") == "chapter"
    tests = {
        "range": ~F.coalesce((F.col("start_byte") >= 0) & (F.col("start_byte") < F.col("end_byte")) & (F.col("end_byte") <= F.col("total")), F.lit(False)),
        "contiguity": ~F.col("start_byte").eqNullSafe(F.coalesce("_reach", F.lit(0))),
        "classification": ~F.coalesce(F.col("classification").isin(CLASSES), F.lit(False)),
        "reason": ~F.col("reason").isin(REASONS),
        "chapter": F.when(chapter, F.col("_known").isNull()).otherwise(F.col("chapter_id").isNotNull() | F.col("reason").isNotNull()),
    }
    own = _told(rows, ["book_id", F.col("pos").alias("at")], tests)
    # The k-th unknown segment against the k-th uncovered range.
    listed = along(uncovered, ["book_id"], "pos", totals={"_k": F.lit(1)}).select("book_id", (F.col("_k") + 1).alias("at"), F.struct("start_byte", "end_byte").alias("_listed"))
    found = placed.filter(unknown).select("book_id", (F.col("_unknowns") + 1).alias("at"), F.struct("start_byte", "end_byte").alias("_found"))
    lists = found.join(listed, ["book_id", "at"], "full").filter(~F.col("_found").eqNullSafe(F.col("_listed"))).select("book_id", "at", F.lit("uncovered").alias("fault"))
    size = F.col("end_byte") - F.col("start_byte")
    sums = segments.groupBy("book_id").agg(F.sum(F.when(unknown, 0).otherwise(size)).alias("_classified"), F.sum(F.when(unknown, size).otherwise(0)).alias("_unclassified"), F.max_by("end_byte", "pos").alias("_end"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    whole = {
        "end": zero("_end") != F.col("total"),
        "classified": ~zero("_classified").eqNullSafe(F.col("classified")),
        "unclassified": ~zero("_unclassified").eqNullSafe(F.col("unclassified")),
        "complete": ~F.col("complete").eqNullSafe((zero("_unclassified") == 0) & (zero("_classified") == F.col("total"))),
    }
    reported = _told(reports.join(sums, "book_id", "left"), ["book_id", F.lit(None).cast("long").alias("at")], whole)
    return own.unionByName(lists).unionByName(reported)


def unassigned_faults(unassigned: DataFrame, chapters: DataFrame, books: DataFrame) -> DataFrame:
    """book_id, at and fault of lists of unassigned ranges (book_id, pos, start_byte, end_byte): ``range`` (empty or outside the text),
    ``order`` (starts before the end of the one before), and of books without chapters, whose ranges have to tile the text,
    ``coverage`` (of a range that starts elsewhere than the one before ends, or of the whole)."""
    bare = books.join(chapters.select("book_id").distinct(), "book_id", "left_anti").select("book_id", F.lit(True).alias("_bare"))
    rows = along(unassigned, ["book_id"], "pos", before={"_reach": "end_byte"}).join(books.select("book_id", "total"), "book_id").join(bare, "book_id", "left")
    reach = F.coalesce("_reach", F.lit(0))
    tests = {
        "range": ~F.coalesce((F.col("start_byte") >= 0) & (F.col("start_byte") < F.col("end_byte")) & (F.col("end_byte") <= F.col("total")), F.lit(False)),
        "order": F.col("start_byte") < reach,
        "coverage": F.col("_bare") & (F.col("start_byte") > reach),
    }
    ends = books.join(bare, "book_id").join(unassigned.groupBy("book_id").agg(F.max_by("end_byte", "pos").alias("_end")), "book_id", "left")
    short = ends.filter(F.coalesce("_end", F.lit(0)) != F.col("total")).select("book_id", F.lit(None).cast("long").alias("at"), F.lit("coverage").alias("fault"))
    return _told(rows, ["book_id", F.col("pos").alias("at")], tests).unionByName(short)


def record_faults(manifests: DataFrame, records: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``key`` and fault of manifests and stored records that don't agree: ``missing`` (no record), ``orphan`` (no manifest),
    ``repeated`` (several of either), or the name of a field that differs, nulls counting as a value."""
    packed = lambda df, name: df.groupBy(key).agg(F.count("*").alias(f"{name}_n"), F.min(F.struct(*fields)).alias(name))
    both = packed(manifests, "_m").join(packed(records, "_r"), key, "full")
    tests = {"missing": F.col("_r").isNull(), "orphan": F.col("_m").isNull(), "repeated": (F.col("_m_n") > 1) | (F.col("_r_n") > 1)}
    there = F.col("_m").isNotNull() & F.col("_r").isNotNull()
    tests |= {f: there & ~F.col("_m")[f].eqNullSafe(F.col("_r")[f]) for f in fields}
    return _told(both, [key], tests)


def counted(rows: DataFrame, tests: dict[str, Column], name: str = "faults") -> tuple[DataFrame, Observation]:
    """``rows`` as they are, and an observation of how many of them break each rule: filled by the action that reads or writes
    them, so a check costs no pass of its own. ``n`` counts all rows."""
    seen = Observation(name)
    counts = [F.count(F.when(F.coalesce(bad, F.lit(False)), 1)).alias(rule) for rule, bad in tests.items()]
    return rows.observe(seen, F.count(F.lit(1)).alias("n"), *counts), seen
