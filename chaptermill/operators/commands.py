"""Review commands from their checks to the revision they make, for many books at once.

Chapters are as in :mod:`chaptermill.operators.review`; a book has one command at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chaptermill.functions import text as T
from chaptermill.operators import lineage
from chaptermill.operators.intervals import islands, subtract
from chaptermill.operators.review import UNNAMED


def adjustment_faults(chapters: DataFrame, adjustments: DataFrame) -> DataFrame:
    """book_id, chapter_id and fault of adjustments of unknown chapters, or of one chapter twice."""
    unknown = adjustments.join(chapters.select("book_id", "chapter_id"), ["book_id", "chapter_id"], "left_anti").select("book_id", "chapter_id", F.lit("unknown").alias("fault"))
    repeated = adjustments.groupBy("book_id", "chapter_id").count().filter("count > 1")
    return unknown.distinct().unionByName(repeated.select("book_id", "chapter_id", F.lit("repeated").alias("fault")))


def structure_faults(chapters: DataFrame, proposals: DataFrame) -> DataFrame:
    """book_id, ord and fault of proposed chapters (book_id, ord, existing_id, accepted): an id that the book doesn't have,
    one that an earlier proposal has, or an accepted anomaly that is no longer."""
    named = proposals.filter("existing_id IS NOT NULL")
    first = F.min("ord").over(Window.partitionBy("book_id", "existing_id"))
    known = chapters.select("book_id", F.col("chapter_id").alias("existing_id"), F.col("accepted").alias("was"))
    held = named.withColumn("first", first).join(known, ["book_id", "existing_id"], "left")
    tests = {"unknown": F.col("was").isNull(), "repeated": F.col("was").isNotNull() & (F.col("ord") > F.col("first")), "acceptance": F.coalesce(F.col("was") & ~F.col("accepted"), F.lit(False))}
    return held.select("book_id", "ord", F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(k)) for k, bad in tests.items()]))).alias("fault"))


def insertion_faults(data: Column, points: Column) -> Column:
    """What is wrong with line breaks at the byte offsets ``points`` of UTF-8 ``data``, of: bounds, repeated, inside (a
    character) and newline (beside a line end)."""
    within = F.filter(points, lambda p: (p >= 0) & (p <= F.octet_length(data)))
    ends = lambda at: F.coalesce(F.hex(F.substring(data, at, F.lit(1))).isin("0A", "0D"), F.lit(False))
    tests = {
        "bounds": F.size(within) < F.size(points),
        "repeated": F.size(F.array_distinct(points)) < F.size(points),
        "inside": F.exists(within, lambda p: ~T.is_boundary(data, p)),
        "newline": F.exists(within, lambda p: ((p > 0) & ends(p)) | ends(p + 1)),
    }
    return F.array_compact(F.array(*[F.when(bad, F.lit(k)) for k, bad in tests.items()]))


def restructured(proposals: DataFrame, revision: str = "revision_id") -> DataFrame:
    """The chapters that proposals (book_id, ord, existing_id, title, heading_kind and any more) make: new ones get an id from
    the revision and their place, those without a heading the fixed title, and all are to be reviewed."""
    new = F.concat(F.lit("chapter-"), F.substring(F.sha2(F.concat_ws(":", F.col(revision).cast("string"), F.col("ord").cast("string")), 256), 1, 32))
    title = F.when(F.col("heading_kind") == "missing", UNNAMED).otherwise(F.col("title"))
    rest = [c for c in proposals.columns if c not in ("existing_id", "title", "chapter_id", "review_status")]
    return proposals.select(*rest, F.coalesce("existing_id", new).alias("chapter_id"), title.alias("title"), F.lit("pending").alias("review_status"))


def confirmed(chapters: DataFrame, books: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chapters approved, books refused): a book without chapters has nothing to confirm."""
    refused = books.join(chapters.select("book_id").distinct(), "book_id", "left_anti")
    return chapters.withColumn("review_status", F.lit("approved")), refused


def reconcile_leading(moved: DataFrame, unassigned: DataFrame) -> DataFrame:
    """Unassigned ranges after the first heading of each book of ``moved`` (book_id, old_start, new_start) has moved: what it
    takes in is no longer unassigned, what it gives up is."""
    taken = moved.filter("new_start < old_start").select("book_id", F.col("new_start").alias("start_byte"), F.col("old_start").alias("end_byte"))
    given = moved.filter("new_start > old_start").select("book_id", F.col("old_start").alias("start_byte"), F.col("new_start").alias("end_byte"))
    return islands(subtract(unassigned, taken, ["book_id"]).select("book_id", "start_byte", "end_byte").unionByName(given), ["book_id"])


def impact(affected: DataFrame) -> DataFrame:
    """For each producer_revision_id, as ``affected``, what :func:`lineage.affected` found of it: how many distinct consumers, and
    the sum and the exclusive or of their hashes, equal for equal sets. The rows stay the list; no set is gathered."""
    hashed = affected.select("producer_revision_id", "consumer_revision_id").distinct().withColumn("h", F.xxhash64("consumer_revision_id"))
    digest = F.struct(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(20,0)")).cast("decimal(38,0)").alias("total"), F.bit_xor("h").alias("mixed"))
    return hashed.groupBy("producer_revision_id").agg(digest.alias("affected"))


def no_impact() -> Column:
    return F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("decimal(38,0)").alias("total"), F.lit(0).cast("long").alias("mixed"))


def previews(commands: DataFrame, affected: DataFrame) -> DataFrame:
    """``commands`` (key, revision_id and more) with affected, the :func:`impact` of their revision's replacement, and
    requires_confirmation."""
    by = impact(affected).withColumnRenamed("producer_revision_id", "revision_id")
    joined = commands.join(by, "revision_id", "left").withColumn("affected", F.coalesce("affected", no_impact()))
    return joined.withColumn("requires_confirmation", F.col("affected.n") > 0)


def outcomes(commands: DataFrame, active: DataFrame, held: DataFrame, now: Column) -> DataFrame:
    """What becomes of each command (key, baseline_revision, command_hash, affected): ``conflict`` where it wasn't made on the
    active baseline, ``preview-required`` where the last preview of it (of ``held``: preview_id, baseline_revision, command_hash,
    affected, created_at, expires_at, consumed_at) that is neither expired nor consumed doesn't say exactly what it
    would affect, else ``applied`` with the preview consumed."""
    late = lineage.conflicts(commands, active).select("key").withColumn("_late", F.lit(True))
    usable = lineage.usable_previews(held, now, ("command_hash", "baseline_revision")).select("command_hash", "baseline_revision", "preview_id", F.col("affected").alias("_seen"))
    joined = commands.join(late, "key", "left").join(usable, ["command_hash", "baseline_revision"], "left")
    outcome = F.when(F.col("_late"), "conflict").when(F.coalesce(F.col("_seen") == F.col("affected"), F.lit(False)), "applied").otherwise("preview-required")
    done = joined.withColumn("outcome", outcome)
    return done.withColumn("preview_id", F.when(F.col("outcome") == "applied", F.col("preview_id"))).drop("_late", "_seen")
