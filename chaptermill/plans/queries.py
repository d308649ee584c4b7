"""The registered queries over the supplied tables.

Books are constructed from ``documents`` (see :mod:`chaptermill.sources.books`). Revisions stand on
``orders`` with ``lineitem`` as their dependents, ranges and tasks on ``events``, the catalog on
``customer``. All ranges are half-open.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chaptermill.functions import encoding, hashing, stored_json
from chaptermill.functions import text as T
from chaptermill.operators import catalog, commands, drafts, intervals, lengths, lineage, ordered, review, search, structure, tasks, validation
from chaptermill.operators.ordered import cyclic
from chaptermill.operators.stored import shared_folder, stored
from chaptermill.sources import books, windows
from chaptermill.sources import text_files as files
from chaptermill.streaming import sequences

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _long(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


# Texts, lines and chapters


@query
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.normalize(F.col("text"))
    return books.parts(spark, sf_dir).select("book_id", "part", *[c.cast("long").alias(n) for n, c in (("n_bytes", F.octet_length(text)), ("n_code_points", F.char_length(text)), ("n_line_ends", T.line_ends(F.col("text"))))], F.sha2(text, 256).alias("sha256"))


@query
def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.lines(books.parts(spark, sf_dir)).select("book_id", *_long("part", "pos", "start_byte", "body_end_byte", "end_byte"))


def _chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.chapters(books.parts(spark, sf_dir))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters for queries that use them more than once."""
    return stored(_chapters(spark, sf_dir), "chapters")


@query
def chapter_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chapters(spark, sf_dir).select("book_id", "title", *_long("ord", "heading_start", "heading_end", "content_start", "content_end"))


def _identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.with_ids(_chapters(spark, sf_dir).withColumn("source_hash", F.sha2(F.col("book_id").cast("binary"), 256)))


@query
def chapter_stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _identified(spark, sf_dir).select("book_id", *_long("ord"), "chapter_id")


@query
def processor_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return _table(spark, sf_dir, "documents").select("doc_id", hashing.processor_fingerprint(source, F.lit("utf-8")).alias("fingerprint"), hashing.review_fingerprint(F.concat(F.lit("r"), F.col("doc_id").cast("string")), source).alias("review_fingerprint"))


@query
def display_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    unnamed = _chapters(spark, sf_dir).withColumn("heading_kind", F.when(F.col("ord") % 3 == 0, "missing").otherwise("source"))
    return review.display_titles(unnamed).select("book_id", *_long("ord"), "display_title")


@query
def body_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = books.parts(spark, sf_dir)
    return lengths.body_lengths(parts).select("book_id", *_long("ord", "length"))


@query
def length_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = books.parts(spark, sf_dir)
    found = lengths.body_lengths(parts).select("book_id", "ord", "length", (F.col("ord") % 7 == 0).alias("accepted"))
    found = stored(found, "lengths")
    return lengths.anomalies(found, "book_id", "ord").select("book_id", *_long("ord", "length"), "kind", lengths.reason(F.col("kind"), F.col("length")).alias("reason"))


def _turn_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", T.visible_length(F.coalesce("text", F.lit(""))).cast("long").alias("length"))


@query
def length_quantile_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lengths.fences(_turn_lengths(spark, sf_dir), "conv_id")
    return found.select("conv_id", *_long("n"), *[F.round(c, 6).alias(c) for c in ("q1", "q3", "low", "high")])


@query
def length_hampel(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lengths.local_spread(_turn_lengths(spark, sf_dir), "conv_id", "turn")
    return found.select("conv_id", "turn", *_long("n_near"), F.round("center", 6).alias("center"), F.round("spread", 6).alias("spread"))


@query
def text_slice_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in pages of 1,000 bytes or a little less, cut between characters."""
    data = F.coalesce("text", F.lit("")).cast("binary")
    rows = _table(spark, sf_dir, "documents").select("doc_id", data.alias("data")).filter("octet_length(data) > 0")
    pages = rows.select("doc_id", "data", F.posexplode(F.sequence(F.lit(0), F.octet_length("data") - 1, F.lit(1000))).alias("page", "at"))
    cut = lambda c: T.snap_back(F.col("data"), F.least(c, F.octet_length("data")))
    ends = pages.select("doc_id", "page", "data", cut(F.col("at")).alias("start_byte"), cut(F.col("at") + 1000).alias("end_byte"))
    piece = T.slice_bytes(F.col("data"), F.col("start_byte"), F.col("end_byte"))
    return ends.withColumn("s", piece).select("doc_id", *_long("page", "start_byte", "end_byte"), F.sha2(F.col("s.text").cast("binary"), 256).alias("sha256"), F.col("s.done").alias("done"))


@query
def line_preview_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books in pages of 200 lines: which bytes each page has."""
    return structure.lines(books.parts(spark, sf_dir)).groupBy("book_id", F.floor(F.col("line") / 200).alias("page")).agg(F.min("start_byte").alias("start_byte"), F.max("end_byte").alias("end_byte"), F.count("*").alias("n_lines")).select("book_id", *_long("page", "start_byte", "end_byte", "n_lines"))


@query
def windowed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books written as text files and read in windows of 256 KiB: their bytes, lines and chapters, and whether each
    file is tiled by windows no larger, that end with lines, and was hashed."""
    path = f"{shared_folder(spark)}/books-{uuid.uuid4().hex}"
    text = F.regexp_replace(T.normalize(F.col("text")), r"\n\z", "")
    books.parts(spark, sf_dir).select("book_id", text.alias("value")).write.partitionBy("book_id").text(path)
    book = F.url_decode(F.replace(F.regexp_extract("path", "/book_id=([^/]*)/", 1), F.lit("+"), F.lit("%2B"))).alias("book_id")
    found = stored(windows.windows(spark, path, 1 << 18, 3 << 16), "windows")
    parts = windows.parts(found)
    sizes = found.groupBy("path").agg(
        F.max("byte_length").alias("byte_length"), F.sum(F.octet_length("bytes")).alias("n_bytes"), F.max(F.octet_length("bytes")).alias("widest"),
        (F.min("start_byte") == 0).alias("opens"), F.max("end_byte").alias("reaches"), F.bool_and("closed").alias("closed"),
    )
    last_end = F.col("base") + F.element_at("starts", -1) + F.element_at("sizes", -1) + 1
    lines = structure.line_index(parts).groupBy(F.col("book_id").alias("path")).agg(F.sum(F.size("sizes")).alias("n_lines"), F.max(last_end).alias("last_byte"))
    chapters = structure.chapters(parts).groupBy(F.col("book_id").alias("path")).agg(F.count("*").alias("n_chapters"))
    hashed = windows.hashes(spark, path).select("path", F.col("byte_length").alias("hashed_bytes"), "stable")
    joined = sizes.join(lines, "path", "left").join(chapters, "path", "left").join(hashed, "path", "left")
    n = F.col("byte_length")
    tiled = F.col("opens") & F.col("closed") & (F.col("widest") <= 1 << 18) & (F.col("n_bytes") == n) & (F.col("reaches") == n) & (F.col("last_byte") == n) & F.col("stable") & (F.col("hashed_bytes") == n)
    return joined.groupBy(book).agg(*[F.sum(c).cast("long").alias(c) for c in ("n_bytes", "n_lines", "n_chapters")], F.bool_and(F.coalesce(tiled, F.lit(False))).alias("tiled"))


SEARCHES = {"plain": T.match_pattern("the"), "case": T.match_pattern("The", case=True), "word": T.match_pattern("on", whole_word=True), "regexp": T.match_pattern("[aeiou]n[dt]", regexp=True)}


@query
def search_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    counted = {k: T.match_count(text, p, 99) for k, p in SEARCHES.items()}
    shown = F.greatest(F.least(counted["plain"][0], F.lit(1)), F.lit(0))
    return _table(spark, sf_dir, "documents").select("doc_id", *[c.cast("long").alias(f"n_{k}") for k, (c, _) in counted.items()], *[m.alias(f"more_{k}") for k, (_, m) in counted.items()], T.count_text(shown, *counted["plain"]).alias("shown"))


@query
def search_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a word stands in the books, and the way to the next and to the previous match, around the end."""
    found = search.matches(books.parts(spark, sf_dir), T.match_pattern("the", whole_word=True))
    near = search.neighbours(stored(found, "matches"))
    return near.select("book_id", "number", "start_byte", "end_byte", "start_utf16", "end_utf16", "total", "next_start", "previous_start", search.status(F.col("total"), F.col("number"), limit=99).alias("shown"))


@query
def search_over_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches that begin in one part of a book and end in the next: a line end and the start of a heading."""
    found = search.matches(books.parts(spark, sf_dir), T.match_pattern("\nchapter "), 9)
    return found.select("book_id", "number", "start_byte", "end_byte", "start_utf16", "end_utf16", "total")


@query
def search_from_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every heading, the next and the previous match of a regular expression that its book has."""
    found = stored(search.matches(books.parts(spark, sf_dir), T.match_pattern("[aeiou]nd[ ,.]", regexp=True)), "matches")
    places = _chapters(spark, sf_dir).select("book_id", "ord", F.col("heading_start").alias("at"))
    return search.from_places(found, places).select("book_id", *_long("ord", "at"), "next_start", "previous_start")


@query
def heading_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every form near the rule's edges."""
    forms = ["第{}章 x", "第{}章x", "　第{}回　\tx  ", "Chapter {} - x", "chapter {}x", "CHAPTER XIV: {}", "番外 三：{}", "番外 三丑 {}", "序章", "序章{}", "第{}", "尾声—{}", "第{}章 " + "甲" * 120]
    line = F.replace(F.element_at(F.array(*[F.lit(f) for f in forms]), (F.col("doc_id") % len(forms) + 1).cast("int")), F.lit("{}"), F.col("doc_id").cast("string"))
    rows = _table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL").select("doc_id", line.alias("line"))
    return rows.select("doc_id", "line", T.is_heading(F.col("line")).alias("heading"), F.when(T.is_heading(F.col("line")), T.heading_title(F.col("line"))).alias("title"))


# Coverage


def _unassigned(chapters: DataFrame) -> DataFrame:
    """The second half of the content of every fifth chapter, and its first ten bytes."""
    some = chapters.filter("ord % 5 = 0 AND content_end - content_start > 40")
    half = F.expr("content_start + (content_end - content_start) div 2")
    return some.select("book_id", half.alias("start_byte"), F.col("content_end").alias("end_byte")).unionByName(some.select("book_id", F.col("content_start").alias("start_byte"), (F.col("content_start") + 10).alias("end_byte")))


def _loose(chapters: DataFrame) -> DataFrame:
    """Chapters whose headings start later and contents end earlier than found, so that gaps remain."""
    end = F.when((F.col("ord") % 4 == 0) & (F.col("content_end") - F.col("content_start") > 30), F.col("content_end") - 7).otherwise(F.col("content_end"))
    return chapters.withColumn("content_end", end).withColumn("chapter_id", F.concat_ws("-", "book_id", F.col("ord").cast("string")))


def _books(chapters: DataFrame) -> DataFrame:
    return chapters.select("book_id", "total").distinct()


def _segments(df: DataFrame) -> DataFrame:
    return df.select("book_id", "classification", *_long("start_byte", "end_byte"), *[c for c in ("chapter_id", "reason") if c in df.columns])


@query
def coverage_implicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _loose(_stored(spark, sf_dir))
    return _segments(intervals.implicit_coverage(found, _books(found)))


@query
def coverage_explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _loose(_stored(spark, sf_dir))
    return _segments(intervals.explicit_coverage(found, _books(found), _unassigned(found)))


@query
def coverage_draft(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _loose(_stored(spark, sf_dir))
    return _segments(intervals.draft_coverage(found, _books(found), _unassigned(found)))


@query
def coverage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _loose(_stored(spark, sf_dir))
    report = intervals.coverage_report(intervals.explicit_coverage(found, _books(found), _unassigned(found)), _books(found))
    return report.select("book_id", *_long("total", "classified", "unclassified"), "complete")


@query
def coverage_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters' own ranges alone don't tile a book that has gaps."""
    found = _loose(_stored(spark, sf_dir))
    own = found.select("book_id", F.col("heading_start").alias("start_byte"), F.col("content_end").alias("end_byte"))
    return intervals.tiling_faults(own, _books(found)).select("book_id", *_long("at"), "fault")


def _order_coverage(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(segments, uncovered ranges, reports, chapters) of orders, their line items as segments; many are broken, each in one way."""
    items = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").cast("long").alias("pos"))
    rows = items.agg(F.max("l_quantity").cast("long").alias("size"), F.min("l_returnflag").alias("flag"))
    placed = ordered.along(rows, ["book_id"], "pos", totals={"start_byte": F.col("size")}).withColumn("end_byte", F.col("start_byte") + F.col("size"))
    placed = stored(placed, "placed")  # segments, ranges, reports and chapters are all made of it
    kind = F.when(F.col("flag") == "R", "unknown").when(F.col("flag") == "A", "chapter").otherwise("noise")
    placed = placed.withColumns({"classification": kind, "m": F.col("book_id") % 11})
    name = F.when(F.col("classification") == "chapter", F.concat(F.lit("c"), F.col("pos").cast("string")))
    first = F.col("start_byte") == 0
    segments = placed.filter(~((F.col("m") == 1) & first)).select(
        "book_id", "pos", "start_byte", "end_byte", F.when((F.col("m") == 2) & first, "prose").otherwise(F.col("classification")).alias("classification"),
        F.when(F.col("m") == 3, F.concat(name, F.lit("x"))).otherwise(name).alias("chapter_id"), F.when((F.col("m") == 7) & (F.col("classification") == "noise"), "uncovered-to-last").alias("reason"),
    )
    unknown = placed.filter("classification = 'unknown'").select("book_id", "pos", (F.col("start_byte") + (F.col("m") == 5).cast("long")).alias("start_byte"), "end_byte")
    extra = placed.filter((F.col("m") == 6) & first).select("book_id", F.lit(1000).cast("long").alias("pos"), F.lit(0).cast("long").alias("start_byte"), F.lit(1).cast("long").alias("end_byte"))
    size = lambda c: F.sum(F.when(c, F.col("size")).otherwise(0))
    sums = placed.groupBy("book_id").agg(F.sum("size").alias("all"), size(F.col("classification") != "unknown").alias("classified"), size(F.col("classification") == "unknown").alias("unclassified"))
    m = F.col("book_id") % 11
    reports = sums.select("book_id", (F.col("all") + (m == 8).cast("long")).alias("total"), "classified", "unclassified", ((F.col("unclassified") == 0) != (m == 4)).alias("complete"))
    chapters = placed.select("book_id", F.concat(F.lit("c"), F.col("pos").cast("string")).alias("chapter_id"))
    return segments, unknown.unionByName(extra), reports, chapters


@query
def coverage_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with reported coverages, segment by segment and as a whole."""
    return validation.coverage_faults(*_order_coverage(spark, sf_dir)).select("book_id", *_long("at"), "fault")


@query
def unassigned_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncovered ranges as unassigned ones, of orders with chapters and without."""
    segments, uncovered, reports, _ = _order_coverage(spark, sf_dir)
    chapters = segments.filter("classification = 'chapter'").select("book_id")
    return validation.unassigned_faults(uncovered, chapters, reports).select("book_id", *_long("at"), "fault")


@query
def record_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as manifests against records of them, of which some are gone, changed, or of nobody."""
    fields = ["name", "nation", "balance"]
    key = F.col("c_custkey")
    manifests = _table(spark, sf_dir, "customer").select(key.alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("nation"), F.when(key % 6 != 0, F.col("c_acctbal")).alias("balance"))
    records = manifests.filter("id % 7 <> 1").select(
        F.when(F.col("id") % 7 == 2, -F.col("id")).otherwise(F.col("id")).alias("id"), F.when(F.col("id") % 7 == 3, F.upper("name")).otherwise(F.col("name")).alias("name"),
        F.when(F.col("id") % 7 == 4, F.col("nation") + 1).otherwise(F.col("nation")).alias("nation"), F.when(F.col("id") % 7 != 5, F.col("balance")).alias("balance"),
    )
    return validation.record_faults(manifests, records, "id", fields)


# Ranges


def _seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without a zone."""
    return (F.unix_date(F.to_date(ts)) * F.lit(86_400).cast("long") + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("long")


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range for each event: a minute for each unit of its value, in seconds."""
    start = _seconds(F.col("ts"))
    return _table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", start.alias("start_byte"), (start + F.floor(F.col("value") * 60).cast("long")).alias("end_byte"))


@query
def range_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.islands(_ranges(spark, sf_dir), ["user_id"], 86_400).select("user_id", *_long("start_byte", "end_byte"))


@query
def range_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ranges(spark, sf_dir)
    own = rows.filter("event_type = 'click'").drop("event_type")
    return intervals.subtract(own, rows.filter("event_type = 'error'"), ["user_id"], 3600, 86_400).select("user_id", "event_id", *_long("start_byte", "end_byte"))


@query
def range_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ranges(spark, sf_dir)
    side = lambda kind: rows.filter(F.col("event_type") == kind).drop("event_type")
    return intervals.overlap_join(side("purchase"), side("signup"), ["user_id"], 3600).select("user_id", F.col("l_event_id").alias("left_id"), F.col("r_event_id").alias("right_id"))


@query
def range_asof_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ranges(spark, sf_dir)
    points = rows.filter("event_type = 'view'").select("user_id", "event_id", F.col("start_byte").alias("at"))
    spans = rows.filter("event_type = 'click'").select("user_id", "start_byte", "end_byte", F.col("event_id").alias("owner"))
    return intervals.owner_of(points, spans, ["user_id"], 86_400).select("user_id", "event_id", "owner", "inside")


# Review


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _loose(_stored(spark, sf_dir))
    return found.select("book_id", "ord", "chapter_id", "title", F.lit("source").alias("heading_kind"), "heading_start", "heading_end", "content_start", "content_end", F.lit(False).alias("accepted"), "total")


@query
def merge_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _reviewed(spark, sf_dir)
    merged = review.merge_into_previous(found, found.filter("ord % 3 <> 1"))
    return merged.select("book_id", "chapter_id", *_long("ord", "content_start", "content_end"))


@query
def delete_recognition(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _reviewed(spark, sf_dir)
    _, freed = review.delete_recognition(found, _unassigned(found), _books(found), found.filter("ord % 4 IN (1, 2)"))
    return freed.select("book_id", *_long("start_byte", "end_byte"))


@query
def accept_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _reviewed(spark, sf_dir)
    return review.accept(found, found.filter("ord % 2 = 0")).select("book_id", *_long("ord"), "accepted")


@query
def adjust_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _reviewed(spark, sf_dir)
    moves = found.filter("ord % 6 = 0").select("chapter_id", *[F.lit(None).cast("long").alias(f"new_{c}") for c in ("heading_start", "heading_end", "content_start")], (F.col("content_end") - 1).alias("new_content_end"))
    return review.adjust(found, moves).select("book_id", *_long("ord", "heading_start", "content_end"), "review_status")


@query
def range_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _reviewed(spark, sf_dir)
    return review.range_faults(found, _unassigned(found), _books(found)).select("book_id", *_long("ord"), "fault")


@query
def insert_linebreaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line breaks put in after 10, 20 and 30 characters, in every fourth text also at byte 5: what is wrong with the places,
    the text with the breaks if nothing is, and where its last byte goes and comes from."""
    text = F.coalesce("text", F.lit(""))
    after = [F.octet_length(F.left(text, F.lit(n))) for n in (30, 10, 20)]
    points = F.when(F.col("doc_id") % 4 == 0, F.array(*after, F.lit(5))).otherwise(F.array(*after))
    rows = _table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL").select("doc_id", text.cast("binary").alias("data"), points.alias("points"))
    checked = rows.withColumn("faults", commands.insertion_faults(F.col("data"), F.col("points")))
    end, ordered = F.octet_length("data"), F.sort_array("points")
    return checked.select(
        "doc_id", F.array_join("faults", ",").alias("faults"), F.when(F.size("faults") == 0, F.sha2(review.with_breaks(F.col("data"), F.col("points")).cast("binary"), 256)).alias("sha256"),
        review.after_insertions(end, ordered).cast("long").alias("after"), review.before_insertions(end + 1, F.col("points")).cast("long").alias("before"),
    )


def _proposals(found: DataFrame) -> DataFrame:
    """Chapters proposed anew: every fifth a new one without a heading, some under another chapter's or an unknown id."""
    number = F.col("ord")
    own = F.when(number % 7 == 0, F.concat("book_id", F.lit("-1"))).when(number % 11 == 0, "nobody").otherwise(F.col("chapter_id"))
    asked = found.select("book_id", "ord", F.when(number % 5 != 0, own).alias("existing_id"), "title", F.when(number % 5 == 0, "missing").otherwise("source").alias("heading_kind"), ((number % 2 == 0) & (number % 3 != 0)).alias("accepted"))
    return asked.withColumn("revision_id", F.col("book_id"))


@query
def structure_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _reviewed(spark, sf_dir).withColumn("accepted", F.col("ord") % 2 == 0)
    return commands.structure_faults(found, _proposals(found)).select("book_id", *_long("ord"), "fault")


@query
def adjustment_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjustments of every third chapter, of every sixth twice, and of one after the last."""
    found = _reviewed(spark, sf_dir)
    asked = found.filter("ord % 3 = 0").select("book_id", "chapter_id")
    beyond = found.groupBy("book_id").agg(F.max("ord").alias("last")).select("book_id", F.concat_ws("-", "book_id", (F.col("last") + 1).cast("string")).alias("chapter_id"))
    return commands.adjustment_faults(found, asked.unionByName(found.filter("ord % 6 = 0").select("book_id", "chapter_id")).unionByName(beyond))


@query
def structure_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.restructured(_proposals(_reviewed(spark, sf_dir))).select("book_id", *_long("ord"), "chapter_id", "title", "review_status")


@query
def confirm_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books confirmed, by their chapters but for the first; those of one chapter are refused."""
    found = _reviewed(spark, sf_dir)
    approved, refused = commands.confirmed(found.filter("ord > 1 AND book_id <> 'src2'"), _books(found))
    counts = approved.groupBy("book_id", "review_status").agg(F.count("*").alias("n_chapters"))
    return counts.unionByName(refused.select("book_id", F.lit("refused").alias("review_status"), F.lit(0).cast("long").alias("n_chapters")))


@query
def leading_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books whose first chapter isn't recognized: what is unassigned once the heading of the second has moved."""
    found = _reviewed(spark, sf_dir)
    facts = found.groupBy("book_id").agg(F.max(F.when(F.col("ord") == 2, F.col("heading_start"))).alias("old_start"), F.count("*").alias("n")).filter("old_start IS NOT NULL")
    moved = facts.select("book_id", "old_start", F.when(F.col("n") % 2 == 0, F.col("old_start") + 3).otherwise(F.greatest(F.col("old_start") - 20, F.lit(0))).alias("new_start"))
    leading = facts.select("book_id", F.lit(0).cast("long").alias("start_byte"), F.col("old_start").alias("end_byte"))
    return commands.reconcile_leading(moved, _unassigned(found).unionByName(leading)).select("book_id", *_long("start_byte", "end_byte"))


@query
def fold_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = books.parts(spark, sf_dir)
    return review.hidden_folds(structure.chapters(parts), structure.line_index(parts)).select("book_id", *_long("ord", "start_line", "end_line", "line_count"))


@query
def boundary_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content ends moved back by one line."""
    parts = books.parts(spark, sf_dir)
    return review.shifted_boundaries(structure.chapters(parts), structure.line_index(parts), -1).select("book_id", *_long("ord", "new_end"))


@query
def add_recognition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One more chapter in each book, 20 bytes into the content of its third."""
    found = _reviewed(spark, sf_dir)
    place = found.filter("ord = 3 AND content_end - content_start > 40")
    none = F.lit(None).cast("long")
    clicks = place.select("book_id", (F.col("content_start") + 20).alias("at"), none.alias("line_start"), none.alias("line_body_end"), none.alias("line_end"), F.lit(None).cast("string").alias("title"))
    return review.add_recognition(found, _unassigned(found), _books(found), clicks)[0].select("book_id", *_long("ord", "content_start", "content_end"), "heading_kind")


@query
def gap_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _reviewed(spark, sf_dir)
    return review.receives_gaps(found, _books(found)).select("book_id", *_long("ord"), "receives")


@query
def chapter_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = books.parts(spark, sf_dir)
    return review.layouts(structure.chapters(parts), structure.line_index(parts)).select("book_id", *_long("ord", "anchor_line", "heading_last_line", "content_line"))


@query
def range_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapter ranges after a line break at the end of each heading."""
    found = _chapters(spark, sf_dir)
    heading = review.mapped_range(F.col("heading_start"), F.col("heading_end"), F.col("heading_end"), False)
    content = review.mapped_range(F.col("content_start"), F.col("content_end"), F.col("content_end"), True)
    return found.select("book_id", *_long("ord"), heading["end_byte"].cast("long").alias("heading_end"), content["start_byte"].cast("long").alias("content_start"), content["end_byte"].cast("long").alias("content_end"))


@query
def source_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three lines of each text in UTF-16, or what fits in 500 bytes."""
    from chaptermill.functions.preview import source_page

    rows = _table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-16LE").alias("data"))
    page = rows.select("doc_id", source_page(F.col("data"), F.lit("utf-16le"), F.lit(0), F.lit(3), 500).alias("p"))
    return page.select("doc_id", F.col("p.text").alias("text"), F.col("p.end_byte").alias("end_byte"), F.col("p.done").alias("done"))


@query
def boundary_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third chapter asked to end a little into the next one."""
    found = _reviewed(spark, sf_dir)
    edits = found.filter("ord % 3 = 0").select("book_id", F.col("ord").alias("seq"), "ord", F.lit("end").alias("side"), (F.col("content_end") + 3).alias("at"))
    return review.boundary_edits(found, edits).select("book_id", *_long("ord", "heading_start", "content_end"))


def _gaps(chapters: DataFrame) -> DataFrame:
    """What lies between the chapters, as ranges that belong to none."""
    near = ordered.along(chapters, ["book_id"], "ord", after={"_next": "heading_start"})
    return near.filter("content_end < _next").select("book_id", F.col("content_end").alias("start_byte"), F.col("_next").alias("end_byte"))


def _edits(chapters: DataFrame) -> DataFrame:
    """Edits of both sides of every chapter, of which some may not be applied."""
    edit = lambda j, side, at, of=F.col("ord"): F.struct((F.col("ord") * 10 + j).alias("seq"), of.alias("ord"), F.lit(side).alias("side"), at.cast("long").alias("at"))
    start, end = F.col("heading_start"), F.col("content_end")
    asked = [edit(0, "start", start - 5), edit(1, "end", end + 3), edit(2, "start", start + 2), edit(3, "end", end - 4)]
    asked += [F.when(F.col("ord") % 7 == 0, edit(4, "start", F.lit(-1))), F.when(F.col("ord") % 7 == 1, edit(4, "end", end, F.col("ord") + 1_000_000))]
    return chapters.select("book_id", F.inline(F.array_compact(F.array(*asked))))


def _judged(found: DataFrame) -> DataFrame:
    return drafts.edit_faults(found, _gaps(found), _books(found), _edits(found))


@query
def edit_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which edits of chapter boundaries are refused, and why."""
    return _judged(_reviewed(spark, sf_dir)).select("book_id", *_long("seq", "ord"), "side", "at", "fault")


@query
def protected_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters after the edits of both sides that may be applied."""
    found = _reviewed(spark, sf_dir)
    return review.boundary_edits(found, _judged(found).filter("fault IS NULL")).select("book_id", *_long("ord", "heading_start", "content_end"))


@query
def kept_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which side was edited last at each boundary, of chapters that are still neighbours once some are merged."""
    found = _reviewed(spark, sf_dir)
    held = drafts.priorities(found, _books(found), _judged(found).filter("fault IS NULL").drop("fault"))
    return drafts.retained(held, review.merge_into_previous(found, found.filter("ord % 5 = 2"))).select("book_id", "previous_id", "next_id", "side")


@query
def merge_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _reviewed(spark, sf_dir)
    which = found.select("book_id", "ord", F.explode(F.array(F.lit("previous"), F.lit("next"))).alias("direction"))
    return drafts.merge_faults(found, _gaps(found), which).select("book_id", *_long("ord"), "direction", "fault")


@query
def merge_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _reviewed(spark, sf_dir)
    return drafts.merge_into_next(found, found.filter("ord % 3 = 1")).select("book_id", "chapter_id", *_long("ord", "content_end"))


@query
def draft_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a command has to say of a draft in which some chapters ended earlier, and some were merged."""
    found = _reviewed(spark, sf_dir)
    moved = found.withColumn("content_end", F.when(F.col("ord") % 6 == 0, F.col("content_end") - 1).otherwise(F.col("content_end")))
    later = drafts.merge_into_next(moved, moved.filter("ord % 3 = 1"))
    return drafts.changes(found, later).select("book_id", "chapter_id", "change", "heading_start", "content_end")


# Stored JSON


@query
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nested JSON, written with their keys in another order and other forms of their numbers."""
    inner = F.concat(F.lit('{"z" : [1.50, {"price": '), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(', "date": "'), F.col("o_orderdate").cast("date").cast("string"), F.lit('"}, -0.0, 1e3], "A": null}'))
    text = F.concat(F.lit('{"status": "'), F.col("o_orderstatus"), F.lit('",\n "key" :'), F.col("o_orderkey").cast("string"), F.lit(', "items":'), inner, F.lit(', "10": true, "9": false}'))
    found = _table(spark, sf_dir, "orders").select("o_orderkey", stored_json.canonical(text).alias("canonical"))
    return found.withColumn("hash", F.sha2(F.col("canonical").cast("binary"), 256))


def _stored_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A preview of each order as it should be and as it was stored: as it is, in another order, broken, of another kind, or of
    another revision."""
    key = F.col("o_orderkey").cast("string")
    good = F.concat(F.lit('{"baselineRevision":'), key, F.lit(',"commandType":"confirm-review","affected":[{"artifactId":"a'), key, F.lit('","selector":{"b":1,"a":2}}],"requiresConfirmation":true}'))
    turned = F.concat(F.lit('{"requiresConfirmation": true, "affected": [{"selector": {"a": 2, "b": 1.0}, "artifactId": "a'), key, F.lit('"}], "commandType": "confirm-review", "baselineRevision": '), key, F.lit("}"))
    n = F.col("o_orderkey") % 7
    stored_as = (
        F.when(n == 0, turned).when(n == 1, F.substring(good, F.lit(1), F.length(good) - 1)).when(n == 2, F.replace(good, F.lit("true"), F.lit('"true"')))
        .when(n == 3, F.replace(good, F.lit('"a":2'), F.lit('"a":3'))).when(n == 4, F.concat(F.substring(good, F.lit(1), F.length(good) - 1), F.lit(',"extra":0}'))).when(n == 5, F.concat(F.lit("["), good, F.lit("]"))).otherwise(good)
    )
    return _table(spark, sf_dir, "orders").select("o_orderkey", good.alias("expected"), stored_as.alias("stored"))


@query
def stored_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, expected = F.col("stored"), F.col("expected")
    unknown = F.array_join(stored_json.unknown_keys(kept, stored_json.PREVIEW), ",")
    return _stored_previews(spark, sf_dir).select("o_orderkey", stored_json.preview_fault(kept).alias("fault"), unknown.alias("unknown"), stored_json.same_preview(kept, expected).alias("same"))


@query
def stored_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of orders, their line items as chapters, of which some are not valid."""
    unit = F.lit("utf8-byte").alias("offsetUnit")
    number = F.col("l_linenumber").cast("long")
    start = (number - 1) * 10
    chapter = F.struct(
        number.alias("order"),
        F.struct(
            F.concat(F.lit("c"), number.cast("string")).alias("chapterId"), number.alias("order"), F.when(F.col("l_partkey") % 50 == 0, "").otherwise("title").alias("title"), F.when(F.col("l_partkey") % 3 == 0, "missing").alias("headingKind"),
            F.when(F.col("l_suppkey") % 40 == 0, "open").otherwise("pending").alias("reviewStatus"), F.struct(unit, start.alias("startByte"), (start + F.when(F.col("l_orderkey") % 23 == 0, 90).otherwise(10)).alias("endByte")).alias("contentRange"),
        ).alias("chapter"),
    )
    items = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    rows = items.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(chapter)).alias("c"))
    text = F.to_json(F.struct(
        F.lit("r").alias("revisionId"), F.col("l_orderkey").alias("baselineRevision"), F.struct(F.lit(1).alias("id")).alias("source"), F.lit("utf-8").alias("encoding"), F.lit("bom").alias("encodingMethod"), F.lit(75).alias("textByteLength"),
        F.col("c.chapter").alias("chapters"), F.struct(F.lit(1).alias("total")).alias("coverage"), F.array(F.lit(1)).alias("revisionHistory"), F.when(F.col("l_orderkey") % 11 != 0, "pending").alias("reviewStatus"), F.lit("2024").alias("createdAt"),
    ))
    return rows.select(F.col("l_orderkey").alias("o_orderkey"), stored_json.snapshot_fault(text).alias("fault"))


# Revisions


def _dependencies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, revisions, replaced): line items of an order depend on it; orders of one day in ten are replaced."""
    items = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.min("l_linestatus").alias("status"), F.min("l_returnflag").alias("flag"))
    consumer = F.concat_ws("-", F.lit("c"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    revisions = items.select(consumer.alias("revision_id"), F.concat(F.lit("a"), F.col("part").cast("string")).alias("artifact_id"), F.col("flag").alias("artifact_type"), F.when(F.col("status") == "O", "current").otherwise("superseded").alias("validity_status"))
    edges = items.select(consumer.alias("consumer_revision_id"), F.col("l_orderkey").alias("producer_revision_id"), F.lit("text").alias("dependency_type"))
    replaced = _table(spark, sf_dir, "orders").filter("o_orderkey % 10 = 3").select(F.col("o_orderkey").alias("producer_revision_id"), (-F.col("o_orderkey")).alias("current_revision_id"))
    return edges, revisions, replaced


@query
def affected_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, revisions, replaced = _dependencies(spark, sf_dir)
    return lineage.in_order(lineage.affected(edges, revisions, replaced))


@query
def stale_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.propagate(*_dependencies(spark, sf_dir))[0].select("revision_id", "artifact_id", "validity_status")


@query
def stale_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.propagate(*_dependencies(spark, sf_dir))[1]


def _revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders are its revisions, numbered by date and key."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(order).cast("long").alias("baseline_revision"))


@query
def next_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _revisions(spark, sf_dir)
    every = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")).join(held, "o_custkey", "left")
    return lineage.next_baseline(every, ["o_custkey"])


@query
def active_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.activate(_revisions(spark, sf_dir), ["o_custkey"]).filter("active").select("o_custkey", "o_orderkey", "baseline_revision")


@query
def without_one_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose urgent orders, taken as active, aren't exactly one."""
    held = _table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderpriority") == "1-URGENT").alias("active"))
    return lineage.without_one_active(held, ["o_custkey"]).select("o_custkey", *_long("n_active"))


@query
def revision_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's history as JSON once one more revision is made."""
    held = _revisions(spark, sf_dir)
    entry = F.struct(F.col("o_orderkey").alias("revision_id"), "baseline_revision", F.lit(True).alias("active"))
    history = held.groupBy(F.col("o_custkey").alias("key")).agg(F.sort_array(F.collect_list(F.struct("baseline_revision", entry.alias("e")))).alias("h")).select("key", F.col("h.e").alias("history"))
    new = lineage.next_baseline(held, ["o_custkey"]).select(F.col("o_custkey").alias("key"), F.lit(-1).cast("long").alias("revision_id"), F.col("next_baseline").alias("baseline_revision"))
    done = lineage.snapshot_history(history, new)
    return done.select(F.col("key").alias("o_custkey"), *[c.cast("long").alias(n) for n, c in (("n", F.size("history")), ("n_active", F.size(F.filter("history", lambda h: h["active"]))), ("last", F.element_at("history", -1)["baseline_revision"]))])


def _commands(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(commands with what they affect, active revisions, previews held): a customer commands its last order to be replaced, one
    in four on an old baseline; two in three have looked at a preview, some of them long ago, used it, or saw something else."""
    edges, revisions, _ = _dependencies(spark, sf_dir)
    active = lineage.activate(_revisions(spark, sf_dir), ["o_custkey"]).filter("active").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("revision_id"), "baseline_revision")
    number = F.col("key")
    asked = active.select("key", "revision_id", (F.col("baseline_revision") - (number % 4 == 1).cast("int")).alias("baseline_revision"), F.concat(F.lit("command-"), number.cast("string")).alias("command_hash"))
    hit = lineage.affected(edges, revisions, asked.select(F.col("revision_id").alias("producer_revision_id")))
    told = stored(commands.previews(asked, hit), "commands")
    nothing = commands.no_impact()
    seen = told.filter("key % 3 <> 0").select(
        number.alias("preview_id"), "baseline_revision", "command_hash", F.when(number % 5 != 2, F.col("affected")).otherwise(nothing).alias("affected"),
        (number % 50).alias("created_at"), (number % 50 + 300).alias("expires_at"), F.when(number % 7 == 0, number % 50).alias("consumed_at"),
    )
    older = seen.select((-F.col("preview_id")).alias("preview_id"), "baseline_revision", "command_hash", nothing.alias("affected"), F.lit(-1).cast("long").alias("created_at"), F.lit(400).cast("long").alias("expires_at"), F.lit(None).cast("long").alias("consumed_at"))
    return told, active, seen.unionByName(older)


@query
def review_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    told, active, held = _commands(spark, sf_dir)
    done = commands.outcomes(told, active, held, F.lit(310))
    following = F.when(F.col("outcome") == "applied", F.col("baseline_revision") + 1)
    return done.select("key", "outcome", "preview_id", "requires_confirmation", F.col("affected.n").alias("n_affected"), following.alias("next_baseline"))


@query
def review_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions that became stale by the commands that were applied."""
    told, active, held = _commands(spark, sf_dir)
    applied = commands.outcomes(told, active, held, F.lit(310)).filter("outcome = 'applied'")
    edges, revisions, _ = _dependencies(spark, sf_dir)
    replaced = applied.select(F.col("revision_id").alias("producer_revision_id"), (-F.col("revision_id")).alias("current_revision_id"))
    return lineage.propagate(edges, revisions, replaced)[1].select("consumer_revision_id", "previous_producer_revision_id", "status")


# Tasks

_STATES = {"signup": "pending", "view": "running", "click": "running", "purchase": "succeeded", "error": "failed"}


def _task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events are its task's; progress is the share of the value in 500."""
    kind = F.lit(None).cast("string")
    for k, v in _STATES.items():
        kind = F.when(F.col("event_type") == k, v).otherwise(kind)
    seconds = _seconds(F.col("ts"))
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), (F.col("user_id") % 10).alias("project_id"), (F.col("event_id") + 1).alias("sequence"), kind.alias("state"), F.floor("value").cast("long").alias("completed"), F.lit(300).cast("long").alias("total"), seconds.alias("occurred_at"), seconds.alias("updated_at"))


@query
def event_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a project numbered without gaps: late ones dropped, tokens that nothing consumes expired. Clicks open a
    token and views consume one."""
    n = F.col("event_id")
    kind = F.when(F.col("event_type") == "click", sequences.OPENED).when(F.col("event_type") == "view", sequences.CONSUMED).otherwise(F.col("event_type"))
    generation = F.expr("event_id div 50") - F.when(n % 13 == 0, 2).otherwise(0)
    events = _table(spark, sf_dir, "events").select(
        F.expr("event_id div 30 % 10").cast("long").alias("project_id"), F.lpad(n.cast("string"), 12, "0").alias("event_id"), F.col("ts").cast("timestamp").alias("occurred_at"), kind.alias("event_type"),
        generation.cast("long").alias("generation"), F.concat(F.lit("t"), F.expr("event_id div 3").cast("string")).alias("token"),
    )
    return sequences.numbered(events).select("project_id", "sequence", "event_id", F.unix_millis("occurred_at").alias("at_ms"), "event_type", "generation")


@query
def task_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.latest_state(tasks.valid_events(_task_events(spark, sf_dir))).select("task_id", "state", *_long("attempt", "sequence", "occurred_at"))


@query
def task_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = tasks.summary(tasks.latest_state(_task_events(spark, sf_dir)))
    return done.select("task_id", "state", *_long("completed", "total", "percent"), "can_cancel", "can_retry")


@query
def task_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.recover(tasks.latest_state(_task_events(spark, sf_dir))).select("task_id", "state", "recovery")


@query
def task_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = tasks.latest_state(_task_events(spark, sf_dir))
    asked = held.filter("task_id % 2 = 0").select("task_id")
    return tasks.cancel(tasks.retry(held, asked), held.filter("task_id % 3 = 0").select("task_id")).select("task_id", "state", *_long("attempt"))


@query
def task_idempotent_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that ask for a task of their segment, where the project has none in hand or done."""
    held = _task_events(spark, sf_dir).groupBy("task_id", "project_id").agg(F.max_by("state", "sequence").alias("state")).withColumn("input_fingerprint", (F.col("task_id") % 50).cast("string"))
    asked = _table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 10).alias("project_id"), (F.col("c_custkey") % 130).cast("string").alias("input_fingerprint"))
    return tasks.to_start(asked, held).select("c_custkey", "project_id", "input_fingerprint")


@query
def preview_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previews made at an event, open for five minutes; a purchase is a consumed one. What can still be used at
    the end of the table, had all clocks stopped a day before."""
    rows = _task_events(spark, sf_dir)
    made = rows.select(F.col("sequence").alias("preview_id"), F.col("task_id").cast("string").alias("command_hash"), F.col("occurred_at").alias("created_at"), (F.col("occurred_at") + 300).alias("expires_at"), F.when(F.col("state") == "succeeded", F.col("occurred_at")).alias("consumed_at"))
    clock = rows.agg((F.max("occurred_at") - 86_400).alias("now"))
    timed = made.join(F.broadcast(clock))  # one row
    return lineage.usable_previews(timed, F.col("now")).select("preview_id", "command_hash", *_long("expires_at"))


@query
def stage_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.stages(_flags(spark, sf_dir))


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("c_custkey")
    return _table(spark, sf_dir, "customer").select(number.alias("project_id"), (number % 5 == 0).alias("has_task"), (number % 3 == 0).alias("completed"), (number % 3 == 1).alias("reviewable"))


@query
def capability_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.capabilities(_flags(spark, sf_dir))


@query
def entry_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = _flags(spark, sf_dir)
    last = F.when(F.col("project_id") % 7 == 0, "timeline-alignment")
    return flags.select("project_id", tasks.entry_page(F.col("has_task"), F.lit(False), last, F.col("reviewable"), F.col("completed")).alias("page"))


@query
def stage_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each stage of each project."""
    found = tasks.stages(_flags(spark, sf_dir))
    return found.select("project_id", "stage_id", tasks.first_pages(F.col("stage_id")).alias("page"))


@query
def status_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as items of a status bar."""
    region = F.element_at(F.array(F.lit("application"), F.lit("project"), F.lit("other")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return tasks.status_groups(_table(spark, sf_dir, "supplier").select(region.alias("region"), F.col("s_nationkey").alias("order"), F.col("s_name").alias("key")))


@query
def late_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as responses to requests of a day, each day a new generation; the last day's count."""
    asked = _table(spark, sf_dir, "events").select("user_id", "event_id", F.dayofmonth("ts").alias("generation"))
    return tasks.newest(asked, ["user_id"], "generation").select("user_id", "event_id", *_long("generation"))


@query
def stored_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = ["{bad", '{"sourceEncoding":null}', "{}", '{"sourceEncoding":"gbk"}', '{"sourceEncoding":"latin"}', "[1]"]
    json = F.element_at(F.array(*[F.lit(f) for f in forms]), (F.col("event_id") % 6 + 1).cast("int"))
    rows = _table(spark, sf_dir, "events").select("event_id", json.alias("json"))
    return rows.select("event_id", tasks.stored_input(F.col("json")).alias("x")).select("event_id", "x.*")


@query
def probe_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's active revision and the last of its tasks that isn't done."""
    held = tasks.latest_state(_task_events(spark, sf_dir)).filter("state <> 'succeeded'").withColumn("project_id", F.col("task_id") % 300)
    task = catalog.latest(held, ["project_id"], [F.desc("occurred_at"), F.asc("task_id")]).select("project_id", "task_id", "state")
    active = lineage.activate(_revisions(spark, sf_dir), ["o_custkey"]).filter("active").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("revision_id"))
    projects = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id"))
    return projects.join(task, "project_id", "left").join(active, "project_id", "left")


@query
def cyclic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next and previous supplier of a nation, around the end."""
    found = cyclic(_table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey"), ["s_nationkey"], "s_suppkey", "s_suppkey")
    return found.select("s_nationkey", "s_suppkey", "next_value", "previous_value")


# Catalog and facets


def _projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("last_opened_at"))
    return _table(spark, sf_dir, "customer").join(opened, "c_custkey").select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("display_name"), F.concat(F.lit("dir/"), (F.col("c_custkey") % 1000).cast("string"), F.lit("/"), "c_name").alias("directory_path"), "last_opened_at")


@query
def catalog_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.recent(_projects(spark, sf_dir))


@query
def catalog_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One project in ten opened again, one in ten moved into the directory of the next."""
    held = _projects(spark, sf_dir)
    again = held.filter("project_id % 10 = 0").withColumn("last_opened_at", F.col("last_opened_at") + 1_000_000)
    moved = held.filter("project_id % 10 = 5").select((-F.col("project_id") - 1).alias("project_id"), "display_name", "directory_path", "last_opened_at")
    return catalog.upsert_project(held, again.unionByName(moved))


@query
def catalog_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _projects(spark, sf_dir)
    facts = held.filter("project_id % 4 <> 0").select("directory_path", (F.col("project_id") % 4 != 1).alias("manifest_valid"), (F.col("project_id") + (F.col("project_id") % 8 == 3).cast("int")).alias("manifest_project_id"))
    return catalog.inspected(held, facts).select("project_id", "availability")


@query
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each type, with a row for types nobody has."""
    known = spark.sql("SELECT explode(array('ECONOMY', 'SMALL', 'LARGE', 'PROMO', 'STANDARD', 'MEDIUM', 'NONE')) AS p_type")
    counts = _table(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("n"))
    return known.join(counts, "p_type", "left").select("p_type", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query
def facet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search in several fields, an enumeration, a membership, and an id left out."""
    found = F.lower(F.concat_ws(" ", "p_name", "p_brand")).contains("bolt") & F.col("p_type").isin("SMALL", "ECONOMY") & F.array_contains(F.split("p_name", " "), "blue") & (F.col("p_partkey") != 2)
    return _table(spark, sf_dir, "part").filter(found).select("p_partkey", "p_name", F.char_length("p_name").cast("long").alias("n_chars"))


@query
def closed_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers whose range of balances meets [2000, 4000], ends included."""
    low, high = F.least(F.col("s_acctbal"), F.lit(3000.0)), F.greatest(F.col("s_acctbal"), F.lit(3500.0))
    return _table(spark, sf_dir, "supplier").filter((low <= 4000) & (high >= 2000) & (F.col("s_acctbal") > 0)).select("s_suppkey")


# Sources and validation


@query
def encoding_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as bytes of eight kinds, by doc_id, and what the probe says."""
    text, kind = F.coalesce("text", F.lit("")), F.col("doc_id") % 8
    data = F.when(kind == 0, text.cast("binary")).when(kind == 1, F.concat(F.lit(bytearray(b"\xef\xbb\xbf")), text.cast("binary"))).when(kind == 2, F.concat(F.lit(bytearray(b"\xff\xfe")), F.encode(text, "UTF-16LE")))
    data = data.when(kind == 3, F.concat(F.lit(bytearray(b"\xfe\xff")), F.encode(text, "UTF-16BE"))).when(kind == 4, F.lit(bytearray(b""))).when(kind == 5, F.concat(F.lit(bytearray(b"\xff\xfe\x00\x00")), text.cast("binary")))
    data = data.when(kind == 6, F.concat(F.lit(bytearray(b"a\xff")), text.cast("binary"))).otherwise(F.concat(text.cast("binary"), F.lit(bytearray(b"\x00\x00"))))
    rows = _table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL").select("doc_id", data.alias("data"))
    return rows.select("doc_id", encoding.probe(F.col("data")).alias("p")).select("doc_id", "p.*")


@query
def decode_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTF-16 texts without a mark, decoded as their reader chose; a choice for other bytes isn't taken."""
    text = F.coalesce("text", F.lit(""))
    data = F.encode(text, "UTF-16LE")
    hashed = F.when(F.col("doc_id") % 5 == 0, F.lit("0" * 64)).otherwise(F.sha2(F.col("data"), 256))
    rows = _table(spark, sf_dir, "documents").select("doc_id", data.alias("data"), F.sha2(text.cast("binary"), 256).alias("expected"))
    done = rows.select("doc_id", "expected", encoding.decode_choice(F.col("data"), F.lit("utf-16le"), hashed).alias("d"))
    return done.select("doc_id", F.col("d.method").alias("method"), F.col("d.error").alias("error"), (F.sha2(F.col("d.text").cast("binary"), 256) == F.col("expected")).alias("exact"))


@query
def utf16_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte of the tenth UTF-16 unit and back again."""
    rows = _table(spark, sf_dir, "documents").select("doc_id", "text", T.utf16_to_byte(F.col("text"), F.lit(10)).alias("at"))
    return rows.select("doc_id", "at", T.byte_to_utf16(F.col("text"), F.col("at")).alias("back"))


@query
def editor_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fiftieth character of texts with CRLF for every second one's line ends, in an editor and back."""
    text = F.when(F.col("doc_id") % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text"))
    rows = _table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    moved = rows.withColumn("editor", T.to_editor(F.col("text"), F.lit(50)))
    return moved.select("doc_id", "editor", T.from_editor(F.col("text"), F.col("editor")).cast("long").alias("back"))


@query
def minimal_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with some characters in their middle replaced: the least change that makes the new text of the old one, and where
    positions lie after it."""
    old = F.coalesce("text", F.lit(""))
    half = F.expr("char_length(coalesce(text, '')) div 2")
    new = F.concat(F.substring(old, F.lit(1), half), F.when(F.col("doc_id") % 3 == 0, "\U0001f600").when(F.col("doc_id") % 3 == 1, F.repeat(F.substring(old, half, F.lit(2)), F.lit(2))).otherwise(""), F.substring(old, half + 4, F.char_length(old)))
    rows = _table(spark, sf_dir, "documents").select("doc_id", half.cast("long").alias("half"), T.minimal_change(old, new).alias("c"))
    places = [T.map_position(F.col("half") + i, F.col("c"), after).alias(f"{n}_{i}") for i in (0, 2, 9) for n, after in (("before", False), ("after", True))]
    return rows.select("doc_id", F.col("c.start").alias("start_unit"), F.col("c.end").alias("end_unit"), F.col("c.insert").alias("inserted"), *places)


@query
def search_prefill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What characters 20 to 60 of a text put into the search field."""
    return _table(spark, sf_dir, "documents").select("doc_id", T.prefill(F.coalesce("text", F.lit("")), F.lit(20), F.lit(60)).alias("prefill"))


# Bytes in legacy encodings, the text they stand for, and what can't be decoded.
LEGACY = [
    ("gb2312", "C6F4B3CC", "启程", None), ("gbk", "B5DAD2BBD5C2", "第一章", None), ("gbk", "814081", None, "decode-failed"), ("gb18030", "9439FC36", "😀", None),
    ("gb18030", "B5DAD2BBD5C20A", "第一章\n", None), ("big5", "B2C4A440B3B9", "第一章", None), ("big5", "A4", None, "decode-failed"), ("gb2312", "B5DAFF", None, "decode-failed"),
    ("shift_jis", "91E688EA", None, "encoding-not-allowed"), ("gbk", "B5DA00B5DA", None, "binary-nul"), ("utf-16le", "2C7B004E", "第一", None), ("utf-16be", "7B2C4E00", "第一", None),
]


@query
def legacy_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sample, by doc_id, decoded as its reader chose."""
    sample = F.element_at(F.array(*[F.struct(F.lit(n).alias("choice"), F.lit(x).alias("hex")) for n, x, _, _ in LEGACY]), (F.col("doc_id") % len(LEGACY) + 1).cast("int"))
    rows = _table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL").select("doc_id", sample.alias("s")).select("doc_id", "s.choice", F.unhex("s.hex").alias("data"))
    done = rows.select("doc_id", "choice", encoding.decode_choice(F.col("data"), F.col("choice"), F.sha2("data", 256)).alias("d"))
    return done.select("doc_id", "choice", F.col("d.text").alias("text"), F.col("d.error").alias("error"))


@query
def source_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which made-up file names and paths are accepted."""
    forms = ["a{}.txt", "b{}.TXT", ".txt", "c{}.text", "d/{}.txt", "e\\{}.txt", "..", "f {}.Txt"]
    name = F.replace(F.element_at(F.array(*[F.lit(f) for f in forms]), (F.col("doc_id") % len(forms) + 1).cast("int")), F.lit("{}"), F.col("doc_id").cast("string"))
    rows = _table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL").select("doc_id", name.alias("name"))
    return rows.select("doc_id", files.is_text_name(F.col("name")).alias("text"), files.safe_name(F.col("name")).alias("safe"), files.inside(F.concat(F.lit("in/"), "name")).alias("inside"))


@query
def json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties that aren't JSON objects of known keys."""
    rows = _table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 9 == 0, F.lit("{bad")).when(F.col("event_id") % 9 == 1, F.lit('{"k": 1, "z": 2}')).otherwise(F.col("props")).alias("props"))
    valid = F.try_parse_json("props").isNotNull()
    unknown = F.array_except(F.json_object_keys("props"), F.array(F.lit("k")))
    return rows.select("event_id", valid.alias("valid"), F.when(valid, F.array_join(unknown, ",")).alias("unknown")).filter("NOT valid OR unknown <> ''")


@query
def duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.duplicates(_table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_size"]).select("p_name", "p_brand", "p_size", F.col("count").alias("n"))
