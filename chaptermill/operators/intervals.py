"""Interval algebra over half-open ranges, keyed by book (or any other columns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chaptermill.operators.ordered import along


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def islands(ranges: DataFrame, by: list[str], width: int = 1 << 22) -> DataFrame:
    """Non-empty ranges (start_byte, end_byte) merged where they touch or overlap. A key is swept in stretches
    of ``width``; how far earlier stretches reach, and where their last island starts, is carried over."""
    cut = ranges.filter("start_byte < end_byte").select(*by, "start_byte", "end_byte", F.floor(F.col("start_byte") / width).alias("_stretch"))
    key = [*by, "_stretch"]
    own = Window.partitionBy(*key).orderBy("start_byte", "end_byte")
    earlier = Window.partitionBy(*by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    reached = cut.groupBy(*key).agg(F.max("end_byte").alias("_end")).select(*key, F.max("_end").over(earlier).alias("_far"))
    near = F.max("end_byte").over(own.rowsBetween(Window.unboundedPreceding, -1))
    opened = cut.withColumn("_near", near).join(reached, key)
    reach = F.greatest("_near", "_far")  # nulls don't count
    opened = opened.withColumn("_opens", F.when(reach.isNull() | (F.col("start_byte") > reach), F.col("start_byte"))).drop("_near", "_far")
    last = opened.groupBy(*key).agg(F.max("_opens").alias("_open")).select(*key, F.max("_open").over(earlier).alias("_carried"))
    placed = opened.withColumn("_island", F.max("_opens").over(own.rowsBetween(Window.unboundedPreceding, 0))).join(last, key)
    return placed.groupBy(*by, F.coalesce("_island", "_carried").alias("start_byte")).agg(F.max("end_byte").alias("end_byte"))


# A range of so many bins or fewer is held by its bins; wider blocks are dealt into so many parts, so that the starts in one
# meet in more tasks than one.
SALTS = 16


def nodes(first: str, last: str) -> str:
    """SQL for the bins first..last as the fewest aligned blocks of 2^level bins, two a level at most: an array of (level,
    node), where a block of that level begins at bin node * 2^level."""
    rise, fall = f"(-shiftright(-{first}, k))", f"shiftright({last} + 1, k)"
    ends = f"IF({rise} % 2 <> 0, struct(k AS level, {rise} AS node), NULL), IF({fall} % 2 <> 0, struct(k AS level, {fall} - 1 AS node), NULL)"
    return f"array_compact(flatten(transform(sequence(0, int(floor(log2({last} - {first} + 1)))), k -> IF({rise} < {fall}, array({ends}), array()))))"


def overlap_join(left: DataFrame, right: DataFrame, by: list[str], bin_size: int) -> DataFrame:
    """Pairs of overlapping non-empty ranges of one key, with the columns of ``left`` after ``l_`` and those of ``right`` after
    ``r_``. Of two that overlap one starts within the other, so each pair is met once: where the later start, which
    has a row for every level in use, meets the bin or the one of the other's :func:`nodes` that holds it. A range
    makes rows in proportion to the logarithm of its bins."""

    def named(df: DataFrame, prefix: str) -> DataFrame:
        bins = F.floor(F.col("start_byte") / bin_size).alias("_first"), F.floor((F.col("end_byte") - 1) / bin_size).alias("_last")
        return df.filter("start_byte < end_byte").select(*by, *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c not in by], *bins)

    wide, blocks = f"_last - _first >= {SALTS}", nodes("_first", "_last")

    def levels(df: DataFrame) -> Column:
        """The levels in use, as bits of one number; 0 always is."""
        bits = df.filter(wide).selectExpr(f"explode({blocks}) AS n").agg(F.expr("coalesce(bit_or(shiftleft(1L, n.level)), 0L) | 1L"))
        return bits.scalar()

    def keyed(df: DataFrame, used: Column, covers: int) -> DataFrame:
        """Rows of a side: one a node and salt for where it covers, one a level for where its start is covered. One side covers
        with kind 0 and is covered with kind 1, the other the other way round. Level 0 has no salts."""
        key = lambda kind, level, node, salt: f"struct(({level} * {SALTS} + {salt}) * 2 + {kind} AS _slot, {node} AS _node)"
        salted = f"flatten(transform({blocks}, n -> transform(sequence(0, IF(n.level > 0, {SALTS - 1}, 0)), s -> {key(covers, 'n.level', 'n.node', 's')})))"
        held = f"IF({wide}, {salted}, transform(sequence(_first, _last), b -> {key(covers, 0, 'b', 0)}))"
        told = key(1 - covers, "k", "shiftright(_first, k)", f"IF(k > 0, int(pmod(_first, {SALTS})), 0)")
        starts = f"IF(_used = 1, array({key(1 - covers, 0, '_first', 0)}), transform(filter(sequence(0, 62), k -> getbit(_used, k) = 1), k -> {told}))"
        return df.withColumn("_used", used).selectExpr("*", f"inline(concat({held}, {starts}))").drop("_used", "_first", "_last")

    one, two = named(left, "l"), named(right, "r")
    met = keyed(one, levels(two), 0).join(keyed(two, levels(one), 1), [*by, "_slot", "_node"])
    within = "IF(_slot % 2 = 0, l_start_byte <= r_start_byte AND r_start_byte < l_end_byte, r_start_byte < l_start_byte AND l_start_byte < r_end_byte)"
    return met.filter(within).drop("_slot", "_node")


def any_overlap(ranges: DataFrame, others: DataFrame, by: list[str], width: int = 1 << 22) -> DataFrame:
    """``ranges`` that overlap one of ``others`` or more, in the sense of :func:`overlaps`, so empty and reversed ranges
    count where it says so. One does if the ranges of ``others`` that start before its end reach beyond its start;
    a key is swept in stretches of ``width``, each of which is told how far earlier ones reach. No pairs are made."""
    own = [c for c in ranges.columns if c not in by]
    known = " AND ".join(f"{c} IS NOT NULL" for c in (*by, "start_byte", "end_byte"))
    asked = ranges.filter(known).select(*by, F.col("end_byte").alias("_at"), F.lit(0).alias("_kind"), F.struct(*own).alias("_range"))
    opened = others.filter(known).select(*by, F.col("start_byte").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(asked.schema["_range"].dataType).alias("_range"), F.col("end_byte").alias("_reach"))
    events = opened.unionByName(asked.withColumn("_reach", F.lit(None).cast("long"))).withColumn("_stretch", F.floor(F.col("_at") / width))
    key = [*by, "_stretch"]
    # At one place ends come before starts: a range that starts where another ends doesn't overlap it.
    near = F.max("_reach").over(Window.partitionBy(*key).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    earlier = Window.partitionBy(*by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    reached = events.groupBy(*key).agg(F.max("_reach").alias("_end")).select(*key, F.max("_end").over(earlier).alias("_far"))
    swept = events.withColumn("_near", near).filter("_kind = 0").join(reached, key)
    return swept.filter(F.greatest("_near", "_far") > F.col("_range.start_byte")).select(*by, "_range.*")


def subtract(ranges: DataFrame, holes: DataFrame, by: list[str], bin_size: int = 1 << 16, width: int = 1 << 22) -> DataFrame:
    """``ranges`` cut by the islands of ``holes``: one row a fragment, with the other columns of its range. Each hole
    knows its neighbours, so a pair of a range and a hole tells by itself the fragments at the hole's sides and
    no range gathers its holes."""
    own = [c for c in ranges.columns if c not in (*by, "start_byte", "end_byte")]
    solid = along(islands(holes, by, width), by, "start_byte", width, before={"before": "end_byte"}, after={"after": "start_byte"})
    met = overlap_join(ranges, solid, by, bin_size)
    first = F.col("r_before").isNull() | (F.col("r_before") <= F.col("l_start_byte"))
    sides = F.array(
        F.struct(F.when(first, F.col("l_start_byte")).alias("start_byte"), F.col("r_start_byte").alias("end_byte")),
        F.struct(F.col("r_end_byte").alias("start_byte"), F.least("r_after", "l_end_byte").alias("end_byte")),
    )
    cut = met.withColumn("p", F.explode(sides)).filter("p.start_byte < p.end_byte").select(*by, "p.start_byte", "p.end_byte", *[F.col(f"l_{c}").alias(c) for c in own])
    cuts = met.select(*by, *[F.col(f"l_{c}") for c in ("start_byte", "end_byte", *own)]).distinct()
    same = [F.col(f"u.{c}").eqNullSafe(F.col(f"c.{'l_' + c if c not in by else c}")) for c in (*by, "start_byte", "end_byte", *own)]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    whole_ones = ranges.filter("start_byte < end_byte").alias("u").join(cuts.alias("c"), condition, "left_anti")
    return cut.unionByName(whole_ones.select(*by, "start_byte", "end_byte", *own))


def implicit_coverage(chapters: DataFrame, books: DataFrame) -> DataFrame:
    """Segments that tile each book: a gap goes to the chapter after it, trailing bytes to the last; a book
    without chapters is one unknown segment. Chapters: book_id, ord, chapter_id, heading_start, content_start,
    content_end; books: book_id, total."""
    start = F.coalesce("heading_start", "content_start")
    placed = chapters.select("book_id", "ord", "chapter_id", start.alias("start"), F.col("content_end").alias("end"))
    placed = along(placed, ["book_id"], "ord", before={"cursor": "end"}, after={"next": "ord"})
    placed = placed.join(books.select("book_id", "total"), "book_id").withColumn("cursor", F.coalesce("cursor", F.lit(0)))
    segment = lambda s, e, reason: F.struct(s.alias("start_byte"), e.alias("end_byte"), F.lit(reason).cast("string").alias("reason"))
    pieces = F.array(
        segment(F.col("cursor"), F.col("start"), "uncovered-to-next"),
        segment(F.col("start"), F.col("end"), None),
        segment(F.when(F.col("next").isNull(), F.col("end")), F.when(F.col("next").isNull(), F.col("total")), "uncovered-to-last"),
    )
    covered = placed.withColumn("s", F.explode(pieces)).filter("s.start_byte < s.end_byte")
    covered = covered.select("book_id", F.lit("chapter").alias("classification"), "s.start_byte", "s.end_byte", "chapter_id", "s.reason")
    bare = books.join(chapters.select("book_id"), "book_id", "left_anti")
    return covered.unionByName(bare.select("book_id", F.lit("unknown").alias("classification"), F.lit(0).cast("long").alias("start_byte"), F.col("total").alias("end_byte"), F.lit(None).cast("string").alias("chapter_id"), F.lit(None).cast("string").alias("reason")))


def explicit_coverage(chapters: DataFrame, books: DataFrame, unassigned: DataFrame) -> DataFrame:
    """Implicit chapter segments less the unassigned ranges, and these as unknown, not merged."""
    kept = implicit_coverage(chapters, books).filter("classification = 'chapter'")
    cut = subtract(kept, unassigned, ["book_id"])
    unknown = unassigned.select("book_id", F.lit("unknown").alias("classification"), "start_byte", "end_byte", F.lit(None).cast("string").alias("chapter_id"), F.lit(None).cast("string").alias("reason"))
    return cut.select("book_id", "classification", "start_byte", "end_byte", "chapter_id", "reason").unionByName(unknown)


def draft_coverage(chapters: DataFrame, books: DataFrame, unassigned: DataFrame) -> DataFrame:
    """A chapter owns from the end of the one before it to its own, the last to the end of the book; less
    the merged unassigned ranges, which are unknown. An empty book without chapters has no segment."""
    placed = along(chapters.select("book_id", "ord", "chapter_id", F.col("content_end").alias("end")), ["book_id"], "ord", before={"start": "end"}, after={"next": "ord"})
    owned = placed.join(books, "book_id").select("book_id", F.coalesce("start", F.lit(0)).cast("long").alias("start_byte"), F.when(F.col("next").isNull(), F.col("total")).otherwise(F.col("end")).alias("end_byte"), "chapter_id")
    holes = islands(unassigned, ["book_id"]).join(chapters.select("book_id").distinct(), "book_id", "left_semi")
    segments = subtract(owned, holes, ["book_id"]).select("book_id", F.lit("chapter").alias("classification"), "start_byte", "end_byte", "chapter_id")
    none = F.lit(None).cast("string").alias("chapter_id")
    bare = books.filter("total > 0").join(chapters.select("book_id"), "book_id", "left_anti").select("book_id", F.lit("unknown").alias("classification"), F.lit(0).cast("long").alias("start_byte"), F.col("total").alias("end_byte"), none)
    return segments.unionByName(holes.select("book_id", F.lit("unknown").alias("classification"), "start_byte", "end_byte", none)).unionByName(bare)


def coverage_report(segments: DataFrame, books: DataFrame) -> DataFrame:
    """total, classified and unclassified bytes and whether all is assigned to chapters."""
    size = F.col("end_byte") - F.col("start_byte")
    sums = segments.groupBy("book_id").agg(
        F.sum(F.when(F.col("classification") == "chapter", size).otherwise(0)).alias("classified"),
        F.sum(F.when(F.col("classification") == "unknown", size).otherwise(0)).alias("unclassified"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    report = books.join(sums, "book_id", "left").select("book_id", "total", zero("classified"), zero("unclassified"))
    return report.withColumn("complete", (F.col("classified") == F.col("total")) & (F.col("unclassified") == 0))


def tiling_faults(segments: DataFrame, books: DataFrame) -> DataFrame:
    """Where segments don't tile [0, total): gaps, overlaps and a wrong end."""
    joined = along(segments, ["book_id"], "start_byte", 1 << 22, before={"reach": "end_byte"})
    gaps = joined.filter(F.col("start_byte") != F.coalesce("reach", F.lit(0))).select("book_id", F.col("start_byte").alias("at"), F.lit("not-contiguous").alias("fault"))
    ends = books.join(segments.groupBy("book_id").agg(F.max("end_byte").alias("reach")), "book_id", "left")
    return gaps.unionByName(ends.filter(F.coalesce("reach", F.lit(0)) != F.col("total")).select("book_id", F.coalesce("reach", F.lit(0)).cast("long").alias("at"), F.lit("wrong-end").alias("fault")))


def owner_of(points: DataFrame, ranges: DataFrame, by: list[str], width: int = 1 << 22) -> DataFrame:
    """As-of join: each point (at) with the last range that starts at or before it, and whether it is inside.
    ``ranges``: start_byte, end_byte, owner; ``points``: any columns besides. A key is swept in stretches of
    ``width``, each of which is told the last range that opened before it."""
    own = [c for c in points.columns if c not in by]
    opened = ranges.select(*by, F.col("start_byte").alias("_at"), F.lit(0).alias("_kind"), F.struct("start_byte", "end_byte", "owner").alias("_range"))
    point_type = points.select(F.struct(*own).alias("p")).schema["p"].dataType
    asked = points.select(*by, F.col("at").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(opened.schema["_range"].dataType).alias("_range"), F.struct(*own).alias("_point"))
    events = opened.withColumn("_point", F.lit(None).cast(point_type)).unionByName(asked).withColumn("_stretch", F.floor(F.col("_at") / width))
    key = [*by, "_stretch"]
    before = Window.partitionBy(*by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = events.groupBy(*key).agg(F.max("_range").alias("_end")).withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    sweep = Window.partitionBy(*key).orderBy("_at", "_kind", "_range").rowsBetween(Window.unboundedPreceding, 0)
    found = events.withColumn("_open", F.last("_range", ignorenulls=True).over(sweep)).filter("_kind = 1").join(carried, key)
    last = F.coalesce("_open", "_carried")
    return found.withColumn("_last", last).select(*by, "_point.*", F.col("_last.owner").alias("owner"), F.coalesce(F.col("_at") < F.col("_last.end_byte"), F.lit(False)).alias("inside"))
