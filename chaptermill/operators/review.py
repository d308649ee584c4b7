"""Review edits as transforms of chapters (book_id, ord, chapter_id, title, heading_kind, heading_start, heading_end,
content_start, content_end, accepted) and unassigned ranges (book_id, start_byte, end_byte)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chaptermill.operators.intervals import any_overlap, islands, subtract
from chaptermill.operators.ordered import along, running_total
from chaptermill.operators.structure import line_at, start_of

# Fixed value: the title of chapters without one.
UNNAMED = "未命名章节"


def renumbered(chapters: DataFrame) -> DataFrame:
    """Chapters numbered from 1 in their order."""
    counted = running_total(chapters, ["book_id"], "ord", F.lit(1), "_before")
    return counted.withColumn("ord", (F.col("_before") + 1).cast("int")).drop("_before")


def merge_into_previous(chapters: DataFrame, which: DataFrame) -> DataFrame:
    """Chapters of ``which`` (book_id, ord) joined to the one before them, runs of them to the one before the run.
    The first chapter of a book stays."""
    asked = chapters.join(which.select("book_id", "ord").distinct().withColumn("_merge", F.lit(1)), ["book_id", "ord"], "left")
    kept = asked.withColumn("_merge", F.when(F.col("ord") > 1, F.coalesce("_merge", F.lit(0))).otherwise(0))
    run = running_total(kept, ["book_id"], "ord", 1 - F.col("_merge"), "_before").withColumn("_run", F.col("_before") + 1 - F.col("_merge"))
    ends = run.groupBy("book_id", "_run").agg(F.max("content_end").alias("_end"), F.min("ord").alias("ord"))
    return renumbered(chapters.join(ends.drop("_run"), ["book_id", "ord"]).withColumn("content_end", F.col("_end")).select(*chapters.columns))


def delete_recognition(chapters: DataFrame, unassigned: DataFrame, books: DataFrame, which: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chapters, unassigned) without the chapters of ``which``; what they owned is unassigned and merged in."""
    owned = along(chapters.drop("total"), ["book_id"], "ord", before={"_start": "content_end"}, after={"_next": "ord"}).join(books.select("book_id", "total"), "book_id")
    gone = owned.join(which.select("book_id", "ord").distinct(), ["book_id", "ord"], "left_semi")
    freed = gone.select("book_id", F.coalesce("_start", F.lit(0)).alias("start_byte"), F.when(F.col("_next").isNull(), F.col("total")).otherwise(F.col("content_end")).alias("end_byte"))
    rest = renumbered(chapters.join(which.select("book_id", "ord"), ["book_id", "ord"], "left_anti").select(*chapters.columns))
    return rest, islands(unassigned.unionByName(freed), ["book_id"])


def accept(chapters: DataFrame, which: DataFrame) -> DataFrame:
    """Chapters with the length anomalies of ``which`` accepted."""
    asked = chapters.join(which.select("book_id", "ord").distinct().withColumn("_ok", F.lit(True)), ["book_id", "ord"], "left")
    return asked.withColumn("accepted", F.col("accepted") | F.coalesce("_ok", F.lit(False))).select(*chapters.columns)


def adjust(chapters: DataFrame, adjustments: DataFrame) -> DataFrame:
    """Chapters with the ranges of ``adjustments`` (chapter_id and new_ columns) in place of their own; all are
    to be reviewed again."""
    joined = chapters.join(adjustments, "chapter_id", "left")
    ranges = ["heading_start", "heading_end", "content_start", "content_end"]
    return joined.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in ranges else F.col(c) for c in chapters.columns], F.lit("pending").alias("review_status"))


def range_faults(chapters: DataFrame, unassigned: DataFrame, books: DataFrame) -> DataFrame:
    """What makes chapters and unassigned ranges invalid: bounds, order, a heading that isn't before its content,
    overlap with unassigned ranges."""
    start = F.coalesce("heading_start", "content_start")
    placed = along(chapters.drop("total").withColumn("_at", start), ["book_id"], "ord", before={"_before": "content_end"}).join(books.select("book_id", "total"), "book_id")
    tests = {
        "bounds": (F.col("_at") < 0) | (F.col("content_end") > F.col("total")) | (F.col("content_start") > F.col("content_end")),
        "heading": F.col("heading_start").isNotNull() & ((F.col("heading_start") >= F.col("heading_end")) | (F.col("heading_end") > F.col("content_start"))),
        "order": F.coalesce(F.col("_at") < F.col("_before"), F.lit(False)),
    }
    own = placed.select("book_id", "ord", F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(k)) for k, bad in tests.items()]))).alias("fault"))
    asked = F.array(*[F.struct(F.col(f"{k}_start").alias("start_byte"), F.col(f"{k}_end").alias("end_byte")) for k in ("content", "heading")])
    met = any_overlap(chapters.select("book_id", "ord", F.inline(asked)), unassigned, ["book_id"])
    return own.unionByName(met.select("book_id", "ord", F.lit("unassigned").alias("fault")).distinct())


def after_insertions(at: Column, points: Column) -> Column:
    """Where a byte offset lies once a line break is put in at each of the sorted offsets ``points``."""
    return at + F.size(F.filter(points, lambda p: p < at))


def mapped_range(start: Column, end: Column, at: Column, with_end: bool) -> Column:
    """A range after a line break is put in at ``at``. ``with_end`` tells whether one that ends there takes the
    break in, as contents do and headings don't; an empty range moves as a point."""
    moved = (start >= at).cast("int")
    grown = ((end > at) | (F.lit(with_end) & (end == at))).cast("int")
    return F.struct((start + moved).alias("start_byte"), F.when(start == end, end + moved).otherwise(end + grown).alias("end_byte"))


def before_insertions(at: Column, points: Column) -> Column:
    """The offset before the insertions of an edited offset."""
    shifted = F.transform(F.sort_array(points), lambda p, i: p + i)
    return at - F.size(F.filter(shifted, lambda p: p < at))


def with_breaks(data: Column, points: Column) -> Column:
    """UTF-8 text with a line break at each of the byte offsets ``points``."""
    ordered = F.array_sort(F.array_distinct(points))
    starts, ends = F.concat(F.array(F.lit(0)), ordered), F.concat(ordered, F.array(F.octet_length(data)))
    return F.array_join(F.zip_with(starts, ends, lambda s, e: F.substring(data, s + 1, e - s).cast("string")), "\n")


def receives_gaps(chapters: DataFrame, books: DataFrame) -> DataFrame:
    """book_id, ord and whether the chapter is given bytes that lie before it, or after the last one."""
    start = F.coalesce("heading_start", "content_start")
    placed = along(chapters.drop("total").withColumn("_at", start), ["book_id"], "ord", before={"_before": "content_end"}, after={"_next": "ord"}).join(books.select("book_id", "total"), "book_id")
    gap = (F.coalesce("_before", F.lit(0)) < F.col("_at")) | (F.col("_next").isNull() & (F.col("content_end") < F.col("total")))
    return placed.select("book_id", "ord", gap.alias("receives"))


def add_recognition(chapters: DataFrame, unassigned: DataFrame, books: DataFrame, clicks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chapters, unassigned) with one more chapter in each book of ``clicks`` (book_id, at, line_start, line_body_end,
    line_end, title; one click a book). A click on a heading line (title not null) makes a chapter from that line
    on, one elsewhere an unnamed chapter from the click on. It ends where the unassigned range around the click
    does, else where the chapter that owned the place did, else at the next one. Clicks where a chapter starts
    or that leave no room change nothing."""
    start = F.coalesce("heading_start", "content_start")
    headed = F.col("title").isNotNull()
    c = clicks.select("book_id", "at", F.when(headed, F.col("line_start")).otherwise(F.col("at")).alias("split"), F.when(headed, F.col("line_end")).otherwise(F.col("at")).alias("from"), "line_start", "line_body_end", F.col("title").alias("new_title"))
    placed = chapters.withColumn("_at", start).join(c, "book_id").join(books.select("book_id", F.col("total").alias("_total")), "book_id")
    facts = placed.groupBy("book_id").agg(
        F.max_by(F.struct("ord", "content_start", "content_end"), F.when(F.col("_at") < F.col("split"), F.col("ord"))).alias("prev"),
        F.min(F.when(F.col("_at") > F.col("split"), F.col("_at"))).alias("next_at"),
        F.max((F.col("_at") == F.col("split")).cast("int")).alias("taken"),
    )
    around = unassigned.join(c, "book_id").filter((F.col("start_byte") <= F.col("at")) & (F.col("at") < F.col("end_byte"))).groupBy("book_id").agg(F.max("end_byte").alias("hole_end"))
    known = c.join(books.select("book_id", F.col("total").alias("_total")), "book_id").join(facts, "book_id", "left").join(around, "book_id", "left")
    reach = F.when(F.col("next_at").isNull(), F.col("_total")).otherwise(F.col("prev.content_end"))
    owns = F.coalesce(F.col("hole_end").isNull() & (F.col("split") >= F.col("prev.content_start")) & (F.col("split") <= reach), F.lit(False))
    to = F.coalesce("hole_end", F.when(owns, reach), "next_at", "_total")
    made = known.withColumn("owns", owns).withColumn("to", to).filter((F.coalesce("taken", F.lit(0)) == 0) & (F.col("from") <= F.col("to")))
    cut = chapters.join(made.filter("owns").select("book_id", F.col("prev.ord").alias("ord"), F.col("split").alias("_split")), ["book_id", "ord"], "left").withColumn("content_end", F.coalesce("_split", "content_end"))
    heading = lambda name: F.when(F.col("new_title").isNotNull(), F.col(name)).cast("long")
    values = {"ord": F.coalesce("prev.ord", F.lit(0)) + 0.5, "title": F.coalesce("new_title", F.lit(UNNAMED)), "heading_kind": F.when(F.col("new_title").isNotNull(), "source").otherwise("missing"), "heading_start": heading("line_start"), "heading_end": heading("line_body_end"), "content_start": F.col("from"), "content_end": F.col("to"), "accepted": F.lit(False), "book_id": F.col("book_id"), "total": F.col("_total"), "chapter_id": F.concat(F.lit("draft-"), F.col("split").cast("string"))}
    new = made.select(*[values.get(k, F.lit(None)).alias(k) for k in chapters.columns])
    both = cut.select(*chapters.columns).withColumn("ord", F.col("ord") + F.lit(0.0)).unionByName(new)
    numbered = along(both, ["book_id"], "ord", totals={"_place": F.lit(1)})
    holes = made.select("book_id", F.col("split").alias("start_byte"), F.col("to").alias("end_byte"))
    return numbered.withColumn("ord", (F.col("_place") + 1).cast("int")).select(*chapters.columns), subtract(unassigned, holes, ["book_id"])


def layouts(chapters: DataFrame, index: DataFrame) -> DataFrame:
    """book_id, ord, anchor_line (where the chapter starts), heading_last_line (null without a heading) and
    content_line, from 0. ``index`` is :func:`chaptermill.operators.structure.line_index`."""
    asked = F.array(
        F.struct(F.lit("anchor_line").alias("what"), F.coalesce("heading_start", "content_start").alias("at")),
        F.struct(F.lit("heading_last_line").alias("what"), (F.col("heading_end") - 1).alias("at")),
        F.struct(F.lit("content_line").alias("what"), F.col("content_start").alias("at")),
    )
    points = chapters.select("book_id", "ord", F.explode(asked).alias("a")).select("book_id", "ord", "a.what", "a.at").filter("at IS NOT NULL")
    line = F.col("before") - 1 + F.col("opens").cast("int")
    return line_at(index, points).groupBy("book_id", "ord").agg(*[F.max(F.when(F.col("what") == k, line)).alias(k) for k in ("anchor_line", "heading_last_line", "content_line")])


def display_titles(chapters: DataFrame) -> DataFrame:
    """Chapters with the title to show: unnamed ones are counted."""
    counted = running_total(chapters, ["book_id"], "ord", (F.col("heading_kind") == "missing").cast("int"), "_before")
    number = F.greatest(F.col("_before") + 1, F.lit(1)).cast("string")
    return counted.withColumn("display_title", F.when(F.col("heading_kind") == "source", F.col("title")).otherwise(F.concat(F.lit(f"{UNNAMED} "), number))).drop("_before")


def hidden_folds(chapters: DataFrame, index: DataFrame, context: int = 5) -> DataFrame:
    """book_id, ord, start_line, end_line (from 1) and line_count of the content lines folded away: all but the first and
    last ``context`` of chapters with more than twice as many. ``index`` is that of lines."""
    ends = F.array(F.struct(F.lit("first").alias("what"), F.col("content_start").alias("at")), F.struct(F.lit("last").alias("what"), F.col("content_end").alias("at")))
    points = chapters.select("book_id", "ord", F.explode(ends).alias("a")).select("book_id", "ord", "a.what", "a.at")
    ranked = line_at(index, points).groupBy("book_id", "ord").agg(F.max(F.when(F.col("what") == "first", F.col("before") + 1)).alias("first"), F.max(F.when(F.col("what") == "last", F.col("before"))).alias("last"))
    size = F.col("last") - F.col("first") + 1
    return ranked.filter(size > 2 * context).select("book_id", "ord", (F.col("first") + context).alias("start_line"), (F.col("last") - context).alias("end_line"), (size - 2 * context).alias("line_count"))


def shifted_boundaries(chapters: DataFrame, index: DataFrame, steps: int) -> DataFrame:
    """book_id, ord and new_end: the content end of each chapter moved by ``steps`` lines, where it stays inside
    the chapter and doesn't pass the next heading. ``index`` is that of lines."""
    ends = along(chapters, ["book_id"], "ord", after={"_guard": "heading_start", "_next": "ord"}).filter("_next IS NOT NULL")
    at = line_at(index, ends.select("book_id", "ord", "content_start", "_guard", F.col("content_end").alias("at"))).filter("opens")
    moved = start_of(index, at.select("book_id", "ord", "content_start", "_guard", (F.col("before") + steps).alias("line"))).withColumnRenamed("start_byte", "new_end")
    return moved.filter((F.col("new_end") >= F.col("content_start")) & (F.col("new_end") <= F.coalesce("_guard", "new_end"))).select("book_id", "ord", "new_end")


def boundary_edits(chapters: DataFrame, edits: DataFrame) -> DataFrame:
    """Chapters after a sequence of boundary edits (book_id, seq, ord, side, at), in order of seq.

    A chapter remembers the range the user asked for; its neighbours' later edits clamp it, and it gets back to
    what was asked for once they make room. An edit of ``start`` moves the end of the chapter before it, one of
    ``end`` the start of the chapter after it, so the side edited last wins. Only the last edit of a side counts
    and a boundary is clamped by its two chapters alone, so no book is gathered in one task.
    """
    starts = F.col("side").eqNullSafe("start")
    book = F.struct("book_id").alias("_book")  # joins as a struct, so chapters without a book_id stay
    last = lambda side, what: F.max_by(what, F.when(side, F.col("seq")))
    asked = edits.groupBy(book, "ord").agg(
        last(starts, "at").alias("_to_start"), F.max(F.when(starts, F.col("seq"))).alias("_start_seq"),
        last(~starts, "at").alias("_to_end"), F.max(F.when(~starts, F.col("seq"))).alias("_end_seq"),
    )
    own = chapters.select(book, "ord", *[F.col(c).cast("long").alias(c) for c in ("heading_start", "heading_end", "content_start", "content_end")])
    wanted = own.join(asked, ["_book", "ord"], "left").withColumns({"_start": F.coalesce("_to_start", "heading_start", "content_start"), "_end": F.coalesce("_to_end", "content_end")})
    placed = along(wanted, ["_book"], "ord", before={"_before": "_end", "_before_seq": "_end_seq"}, after={"_after": "_start", "_after_seq": "_start_seq"})
    # Of two edits of a boundary the later one wins; without any, the chapter after it does.
    later = lambda end, start: F.coalesce(end > start, end.isNotNull())
    start = F.when((F.col("_before") > F.col("_start")) & later(F.col("_before_seq"), F.col("_start_seq")), F.col("_before")).otherwise(F.col("_start"))
    end = F.when((F.col("_end") > F.col("_after")) & ~later(F.col("_end_seq"), F.col("_after_seq")), F.col("_after")).otherwise(F.col("_end"))
    clamped = placed.withColumns({"_start": start, "_end": end})
    headed = F.col("heading_start").isNotNull()
    heading_end = F.when(headed, F.greatest("heading_end", "_start"))
    return clamped.select(
        "_book.book_id", F.col("ord").cast("int").alias("ord"), F.when(headed, F.col("_start")).alias("heading_start"), heading_end.alias("heading_end"),
        F.when(headed, F.greatest(F.col("content_start"), heading_end)).otherwise(F.col("_start")).alias("content_start"), F.greatest(F.col("_end"), F.col("_start"), heading_end).alias("content_end"),
    )


def unused_draft_id(ids: DataFrame) -> DataFrame:
    """book_id and the smallest k for which ``draft-chapter-k`` isn't taken. ``ids``: book_id, chapter_id."""
    number = F.regexp_extract("chapter_id", r"^draft-chapter-([1-9][0-9]{0,8})\z", 1)
    taken = ids.select("book_id", F.explode(F.array(F.lit(0).cast("long"), F.when(number != "", number.cast("long")).otherwise(0))).alias("k")).distinct()
    order = Window.partitionBy("book_id").orderBy("k")
    return taken.withColumn("next", F.lead("k").over(order)).filter(F.col("next").isNull() | (F.col("next") > F.col("k") + 1)).groupBy("book_id").agg((F.min("k") + 1).alias("k"))
