"""Lines, headings and chapters of books.

A book is a sequence of parts (book_id, part, text), read as one text. A part is a row, so no
book has to fit in one; parts end with a line end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chaptermill.functions import text as T
from chaptermill.functions.hashing import stable_id
from chaptermill.operators.intervals import owner_of
from chaptermill.operators.ordered import WIDTH, along, running_total
from chaptermill.operators.stored import stored

#: Bytes of a book in one stretch of its order.
BYTES = 1 << 22


def _closed(text):
    """Bytes of a part with its last line ended."""
    return (F.octet_length(text) + F.when((text == "") | text.endswith("\n"), 0).otherwise(1)).cast("long")


def normalized(parts: DataFrame) -> DataFrame:
    """Parts with normalized text, its bytes and where it starts in the book."""
    clean = parts.select("book_id", "part", T.normalize(F.coalesce("text", F.lit(""))).alias("text"))
    starts = part_starts(clean.select("book_id", "part", _closed(F.col("text")).alias("bytes")))
    return clean.join(starts, ["book_id", "part"])


def part_starts(sizes: DataFrame) -> DataFrame:
    return running_total(sizes, ["book_id"], "part", F.col("bytes"), "base")


def book_sizes(parts: DataFrame) -> DataFrame:
    return parts.groupBy("book_id").agg(F.sum(_closed(T.normalize(F.coalesce("text", F.lit(""))))).alias("total"))


def line_index(parts: DataFrame) -> DataFrame:
    """One row a part: base (where it starts in the book), first_line (lines before it), sizes (bytes of its lines without
    their ends) and starts (where they start in the part). A part's lines move as arrays, never as rows. Texts are read
    once; the index is stored, as it is used several times."""
    clean = parts.select("book_id", "part", T.normalize(F.coalesce("text", F.lit(""))).alias("text"))
    whole = lambda n: F.when(F.element_at(n, -1) == 0, F.slice(n, 1, F.size(n) - 1)).otherwise(n)
    sizes = T.let(F.transform(F.split("text", "\n"), lambda x: F.octet_length(x)), whole).alias("sizes")
    sized = stored(clean.select("book_id", "part", _closed(F.col("text")).alias("bytes"), sizes), "sizes")
    placed = along(sized, ["book_id"], "part", totals={"base": F.col("bytes"), "first_line": F.size("sizes")}).filter("size(sizes) > 0")
    return stored(placed.select("book_id", "part", "base", "bytes", "first_line", "sizes", T.running_starts(F.transform("sizes", lambda n: (n + 1).cast("bigint"))).alias("starts")), "lines")


def lines(parts: DataFrame) -> DataFrame:
    """book_id, part, pos, line (from 0 in the book), start_byte, body_end_byte and end_byte of every line of the normalized
    text; rows are made after the last shuffle."""
    placed = line_index(parts).select("book_id", "part", "base", "first_line", F.posexplode(F.arrays_zip("sizes", "starts")).alias("pos", "x"))
    start = F.col("base") + F.col("x.starts")
    return placed.select("book_id", "part", "pos", (F.col("first_line") + F.col("pos")).alias("line"), start.alias("start_byte"), (start + F.col("x.sizes")).alias("body_end_byte"), (start + F.col("x.sizes") + 1).alias("end_byte"))


def line_at(index: DataFrame, points: DataFrame) -> DataFrame:
    """``points`` (book_id, at: a byte, and more) with before (how many lines of the book start before it) and opens
    (whether one starts at it). A point meets the part that holds it, and is ranked in that part's row."""
    ranges = index.select("book_id", F.col("base").alias("start_byte"), (F.col("base") + F.col("bytes")).alias("end_byte"), F.col("part").alias("owner"))
    placed = owner_of(points.withColumn("_at", F.col("at")), ranges, ["book_id"]).withColumnRenamed("owner", "part").drop("inside")
    met = placed.join(index.select("book_id", "part", "base", "first_line", "starts"), ["book_id", "part"], "left")
    near = F.col("_at") - F.col("base")
    before = F.coalesce(F.col("first_line") + F.size(F.filter("starts", lambda s: s < near)), F.lit(0)).cast("long")
    return met.select("book_id", *[c for c in points.columns if c not in ("book_id", "at")], F.col("_at").alias("at"), before.alias("before"), F.coalesce(F.array_contains("starts", near), F.lit(False)).alias("opens"))


def start_of(index: DataFrame, points: DataFrame) -> DataFrame:
    """``points`` (book_id, line, and more) with start_byte, where that line of the book starts; without those of no line."""
    ranges = index.select("book_id", F.col("first_line").alias("start_byte"), (F.col("first_line") + F.size("starts")).alias("end_byte"), F.col("part").alias("owner"))
    placed = owner_of(points.withColumn("at", F.col("line")), ranges, ["book_id"], WIDTH).filter("inside").withColumnRenamed("owner", "part")
    met = placed.join(index.select("book_id", "part", "base", "first_line", "starts"), ["book_id", "part"])
    return met.select("book_id", *[c for c in points.columns if c != "book_id"], (F.col("base") + F.get("starts", (F.col("line") - F.col("first_line")).cast("int"))).alias("start_byte"))


def layout(parts: DataFrame, measure: bool = False) -> DataFrame:
    """One row a part: base (where it starts in the book), bytes, before (headings before it), found (its
    headings: title, line_start, heading_start, heading_end, line_end, counted from the part's start),
    next_start (the first heading after it) and total (the book's bytes); where asked to ``measure``, also visible,
    (k, n) for the n visible code points that follow k of its headings and are no heading.

    Texts are read once and cut at headings; what moves, and what is stored, is a row a heading and a part."""
    clean = parts.select("book_id", "part", T.normalize(F.coalesce("text", F.lit(""))).alias("text"))
    pieces = clean.select("book_id", "part", _closed(F.col("text")).alias("bytes"), F.posexplode(T.around_headings(F.col("text"))).alias("i", "x"))
    line = F.rtrim(F.col("x.line"), F.lit("\n"))
    heads = F.coalesce(T.is_heading(line), F.lit(False))
    counted = F.coalesce(T.visible_length(F.col("x.piece")), F.lit(0)) + F.when(heads | F.col("x.line").isNull(), 0).otherwise(T.visible_length(line))
    rows = pieces.select(
        "book_id", "part", "bytes", "i", F.coalesce(F.octet_length("x.piece"), F.lit(0)).cast("long").alias("gap"), F.coalesce(F.octet_length(line), F.lit(0)).cast("long").alias("size"),
        F.coalesce(F.octet_length("x.line"), F.lit(0)).alias("taken"), F.when(heads, line).alias("body"), *([counted.cast("long").alias("n")] if measure else []),
    )
    within = Window.partitionBy("book_id", "part").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("at", F.col("gap") + F.coalesce(F.sum(F.col("gap") + F.col("taken")).over(within), F.lit(0)))
    if measure:
        placed = placed.withColumn("k", F.count("body").over(within))
    start = F.col("at") + F.octet_length(T.leading(F.col("body")))
    heading = F.struct(
        F.col("at").alias("line_start"), start.alias("heading_start"), (start + F.octet_length(T.trim(F.col("body")))).alias("heading_end"),
        (F.col("at") + F.col("size") + 1).alias("line_end"), T.heading_title(F.col("body")).alias("title"),
    )
    visible = [F.collect_list(F.struct("k", "n")).alias("visible")] if measure else []
    sized = placed.groupBy("book_id", "part").agg(F.max("bytes").alias("bytes"), F.sort_array(F.collect_list(F.when(F.col("body").isNotNull(), heading))).alias("found"), *visible)
    sized = stored(sized, "layout")

    # Bases, counts and the next heading, in stretches of parts: only one row a stretch meets the whole book's.
    cut = sized.withColumn("stretch", F.floor(F.col("part") / WIDTH))
    own = Window.partitionBy("book_id", "stretch").orderBy("part")
    upto, onward = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(1, Window.unboundedFollowing)
    first = F.get("found", F.lit(0))["line_start"]
    inner = cut.withColumn("base", F.coalesce(F.sum("bytes").over(upto), F.lit(0))).withColumn("before", F.coalesce(F.sum(F.size("found")).over(upto), F.lit(0)))
    inner = inner.withColumn("opens", F.col("base") + first).withColumn("near", F.first("opens", ignorenulls=True).over(onward))
    whole = Window.partitionBy("book_id").orderBy("stretch")
    ahead, behind = whole.rowsBetween(1, Window.unboundedFollowing), whole.rowsBetween(Window.unboundedPreceding, -1)
    stretches = inner.groupBy("book_id", "stretch").agg(F.sum("bytes").alias("all_bytes"), F.sum(F.size("found")).alias("all_found"), F.min("opens").alias("all_opens"))
    stretches = stretches.withColumn("offset", F.coalesce(F.sum("all_bytes").over(behind), F.lit(0))).withColumn("counted", F.coalesce(F.sum("all_found").over(behind), F.lit(0)))
    stretches = stretches.withColumn("far", F.first(F.col("offset") + F.col("all_opens"), ignorenulls=True).over(ahead)).withColumn("total", F.sum("all_bytes").over(Window.partitionBy("book_id")))
    joined = inner.join(stretches.select("book_id", "stretch", "offset", "counted", "far", "total"), ["book_id", "stretch"])
    return joined.select(
        "book_id", "part", (F.col("base") + F.col("offset")).alias("base"), "bytes", (F.col("before") + F.col("counted")).alias("before"), "found",
        F.coalesce(F.col("near") + F.col("offset"), F.col("far")).alias("next_start"), "total", *(["visible"] if measure else []),
    )


def chapters(parts: DataFrame) -> DataFrame:
    """book_id, ord, title, heading and content ranges and the book's total bytes; one row a heading."""
    return chapters_of(layout(parts))


def chapters_of(laid: DataFrame) -> DataFrame:
    """As :func:`chapters`, of what :func:`layout` gave."""
    rows = laid.select("*", F.posexplode("found").alias("i", "h"))
    following = F.coalesce(F.col("base") + F.get("found", F.col("i") + 1)["line_start"], F.col("next_start"), F.col("total"))
    at = lambda name: F.col("base") + F.col(f"h.{name}")
    return rows.select(
        "book_id", (F.col("before") + F.col("i") + 1).cast("int").alias("ord"), "h.title", at("heading_start").alias("heading_start"),
        at("heading_end").alias("heading_end"), at("line_end").alias("content_start"), following.alias("content_end"), "total",
    )


def with_ids(chaptered: DataFrame, source_hash: str = "source_hash") -> DataFrame:
    """Chapters with their stable chapter_id."""
    return chaptered.withColumn("chapter_id", stable_id("chapter", F.col(source_hash), F.col("heading_start"), F.col("heading_end"), F.col("title")))
