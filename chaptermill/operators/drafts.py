"""What of a sequence of review edits may be applied, and what of it outlives later changes.

Chapters are those of :mod:`chaptermill.operators.review`: in order, without overlaps among themselves and with
unassigned ranges. A boundary lies between two neighbours, P and N, and belongs to both: an edit of N's
``start`` or of P's ``end``. Where a chapter has a heading of the source, that and its content's start stay, so
whether an edit may be applied depends on the edit alone. A chapter without one is as long as the edits
applied so far have left it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chaptermill.operators.commands import reconcile_leading
from chaptermill.operators.intervals import any_overlap
from chaptermill.operators.ordered import along
from chaptermill.operators.review import adjust, renumbered
from chaptermill.operators.stored import stored


def _boundaries(chapters: DataFrame, books: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits with the chapters on both sides of their boundary, ``p`` and ``n`` (null where there is none)."""
    facts = {"ord": "ord", "id": "chapter_id", "headed": "headed", "opens": "opens", "heading_end": "heading_end", "content_start": "content_start", "closes": "content_end"}
    known = chapters.drop("total").withColumns({"headed": F.col("heading_start").isNotNull(), "opens": F.coalesce("heading_start", "content_start")})
    near = along(known, ["book_id"], "ord", before={f"_p_{k}": c for k, c in facts.items()}, after={f"_n_{k}": c for k, c in facts.items()})
    struct = lambda prefix: F.when(F.col(f"{prefix}ord").isNotNull(), F.struct(*[F.col(f"{prefix}{k}").alias(k) for k in facts]))
    own = F.struct(*[F.col(c).alias(k) for k, c in facts.items()])
    placed = near.select("book_id", "ord", struct("_p_").alias("_before"), own.alias("_own"), struct("_n_").alias("_after")).join(books.select("book_id", "total"), "book_id")
    starts = F.col("side") == "start"
    joined = edits.join(placed, ["book_id", "ord"], "left")
    return joined.withColumns({"p": F.when(starts, F.col("_before")).otherwise(F.col("_own")), "n": F.when(starts, F.col("_own")).otherwise(F.col("_after"))}).drop("_before", "_after")


def edit_faults(chapters: DataFrame, unassigned: DataFrame, books: DataFrame, edits: DataFrame) -> DataFrame:
    """``edits`` (book_id, seq, ord, side: start or end, at), applied in order of seq, which is unique in a book, with
    ``fault``: ``chapter`` (there is none of that ord), ``bounds`` (outside the text), ``unassigned`` (into a range that
    belongs to no chapter), ``order`` (P would end before its content starts), ``heading`` (past the protected start of
    N's heading), ``chapter-end`` (past the end of N, which has no heading); null where it may be applied. An edit that
    is refused changes nothing for later ones."""
    met = _boundaries(chapters, books, edits)
    inside = (F.col("at") >= 0) & (F.col("at") <= F.col("total"))
    # What an edit newly takes in, before N's start or after P's end as they were.
    grows = F.when(F.col("side") == "start", F.struct(F.col("at").alias("start_byte"), F.col("n.opens").alias("end_byte"))).otherwise(F.struct(F.col("p.closes").alias("start_byte"), F.col("at").alias("end_byte")))
    taken = met.filter(inside).select("book_id", "seq", grows.alias("r")).filter("r.start_byte < r.end_byte").select("book_id", "seq", "r.*")
    blocked = any_overlap(taken, unassigned, ["book_id"]).select("book_id", "seq", F.lit(True).alias("_blocked"))
    p_headed, n_headed = F.col("p.headed"), F.col("n.headed")
    fixed = (
        F.when(F.col("_own").isNull(), "chapter").when(~F.coalesce(inside, F.lit(False)), "bounds")
        .when(n_headed & ((F.col("at") > F.col("n.opens")) | (F.col("at") >= F.col("n.heading_end"))), "heading")
        .when(p_headed & (F.col("at") < F.col("p.content_start")), "order").when(F.col("_blocked"), "unassigned")
    )
    judged = met.join(blocked, ["book_id", "seq"], "left").withColumn("fault", fixed).select(*edits.columns, "p", "n", "fault")
    if chapters.filter("heading_start IS NULL").isEmpty():
        return judged.select(*edits.columns, "fault")
    judged = stored(judged.withColumn("_fixed", F.col("fault").isNotNull()), "edits")
    while True:
        again = stored(_by_what_is_left(judged), "edits")
        if again.filter("NOT fault <=> _was").isEmpty():
            return again.select(*edits.columns, "fault")
        judged = again.drop("_was")


def _by_what_is_left(judged: DataFrame) -> DataFrame:
    """Faults anew by the ranges that the edits before each leave, of those so far without a fault; the ones before as _was.
    As an edit depends on earlier ones only, repeating this settles it from the first on."""
    starts = F.col("side") == "start"
    past = Window.partitionBy("book_id", "p.ord", "n.ord").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    asked_end = F.coalesce(F.last(F.when(~starts, F.col("at")), ignorenulls=True).over(past), F.col("p.closes"))
    asked_start = F.coalesce(F.last(F.when(starts, F.col("at")), ignorenulls=True).over(past), F.col("n.opens"))
    moved = judged.filter("fault IS NULL").withColumns({"_end": F.when(starts, F.least(asked_end, F.col("at"))).otherwise(F.col("at")), "_start": F.when(starts, F.col("at")).otherwise(F.greatest(asked_start, F.col("at")))})
    event = lambda of, side, value, asks: F.struct(F.col(f"{of}.ord").alias("of"), F.lit(side).alias("what"), value.alias("value"), F.lit(asks).alias("asks"))
    nothing = F.lit(None).cast("long")
    told = moved.select("book_id", "seq", F.inline(F.array(event("n", "start", F.col("_start"), False), event("p", "end", F.col("_end"), False))))
    asks = judged.select("book_id", "seq", F.inline(F.array(event("p", "start", nothing, True), event("n", "end", nothing, True))))
    before = Window.partitionBy("book_id", "of", "what").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = told.unionByName(asks).filter("of IS NOT NULL").withColumn("seen", F.last("value", ignorenulls=True).over(before)).filter("asks")
    known = seen.groupBy("book_id", "seq").agg(F.max(F.when(F.col("what") == "start", F.col("seen"))).alias("_p_opens"), F.max(F.when(F.col("what") == "end", F.col("seen"))).alias("_n_closes"))
    at = F.col("at")
    moving = F.when(F.col("_fixed"), F.col("fault")).when(~F.col("n.headed") & (at > F.coalesce("_n_closes", "n.closes")), "chapter-end").when(~F.col("p.headed") & (at < F.coalesce("_p_opens", "p.opens")), "order")
    joined = judged.withColumn("_was", F.col("fault")).join(known, ["book_id", "seq"], "left")
    return joined.withColumn("fault", moving).drop("_p_opens", "_n_closes")


def priorities(chapters: DataFrame, books: DataFrame, applied: DataFrame) -> DataFrame:
    """book_id, previous_id, next_id and side of the last edit of ``applied`` at each boundary between two chapters."""
    met = _boundaries(chapters, books, applied).filter("p IS NOT NULL AND n IS NOT NULL")
    side = F.when(F.col("side") == "start", "next-chapter-start").otherwise("previous-content-end")
    return met.groupBy("book_id", F.col("p.id").alias("previous_id"), F.col("n.id").alias("next_id")).agg(F.max_by(side, "seq").alias("side"))


def retained(held: DataFrame, chapters: DataFrame) -> DataFrame:
    """Priorities whose two chapters are still there and neighbours."""
    pairs = along(chapters.select("book_id", "ord", "chapter_id"), ["book_id"], "ord", after={"_next": "chapter_id"})
    return held.join(pairs.select("book_id", F.col("chapter_id").alias("previous_id"), F.col("_next").alias("next_id")), ["book_id", "previous_id", "next_id"], "left_semi")


def merge_faults(chapters: DataFrame, unassigned: DataFrame, which: DataFrame) -> DataFrame:
    """``which`` (book_id, ord, direction: previous or next) with ``fault``: ``chapter`` (there is none), ``edge`` (the first has no
    previous, the last no next one), ``unassigned`` (a range that belongs to no chapter lies between); null where it may be."""
    near = along(chapters.select("book_id", "ord", "content_start", "content_end"), ["book_id"], "ord", before={"_p_start": "content_start"}, after={"_n_ord": "ord"})
    asked = which.join(near, ["book_id", "ord"], "left")
    back = F.col("direction") == "previous"
    spans = asked.filter(back).select("book_id", "ord", "direction", F.col("_p_start").alias("start_byte"), F.col("content_end").alias("end_byte"))
    blocked = any_overlap(spans, unassigned, ["book_id"]).select("book_id", "ord", "direction", F.lit(True).alias("_blocked")).distinct()
    edge = F.when(back, F.col("_p_start").isNull()).otherwise(F.col("_n_ord").isNull())
    fault = F.when(F.col("content_end").isNull(), "chapter").when(edge, "edge").when(F.col("_blocked"), "unassigned")
    return asked.join(blocked, ["book_id", "ord", "direction"], "left").withColumn("fault", fault).select(*which.columns, "fault")


def merge_into_next(chapters: DataFrame, which: DataFrame) -> DataFrame:
    """Chapters without those of ``which`` (book_id, ord), whose text falls to what comes next. The last of a book stays."""
    last = chapters.groupBy("book_id").agg(F.max("ord").alias("_last"))
    gone = which.select("book_id", "ord").join(last, "book_id").filter("ord < _last")
    return renumbered(chapters.join(gone, ["book_id", "ord"], "left_anti").select(*chapters.columns))


def update_faults(chapters: DataFrame, unassigned: DataFrame, updates: DataFrame) -> DataFrame:
    """book_id and fault of the books whose ``updates`` (book_id, chapter_id and new_ columns as for
    :func:`chaptermill.operators.review.adjust`) can't be applied: ``repeated`` or ``unknown`` chapters, or chapters that would meet an
    unassigned range, after the leading one has followed the first heading (``unassigned``)."""
    key = ["book_id", "chapter_id"]
    repeated = updates.groupBy(*key).count().filter("count > 1").select("book_id", F.lit("repeated").alias("fault"))
    unknown = updates.join(chapters.select(*key), key, "left_anti").select("book_id", F.lit("unknown").alias("fault"))
    single = updates.dropDuplicates(key).drop("book_id")
    moved = adjust(chapters, single)
    first = lambda df, name: df.groupBy("book_id").agg(F.min_by("heading_start", "ord").alias(name))
    leading = first(chapters, "old_start").join(first(moved, "new_start"), "book_id").filter("old_start <> new_start")
    asked = F.array(*[F.struct(F.col(f"{k}_start").alias("start_byte"), F.col(f"{k}_end").alias("end_byte")) for k in ("content", "heading")])
    met = any_overlap(moved.select("book_id", F.inline(asked)), reconcile_leading(leading, unassigned), ["book_id"])
    changed = met.join(updates.select("book_id").distinct(), "book_id", "left_semi")
    return repeated.unionByName(unknown).unionByName(changed.select("book_id", F.lit("unassigned").alias("fault"))).distinct()


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """book_id, chapter_id and change (added, removed or moved) of the chapters whose ranges differ between two versions of
    a draft, with the later ranges: what a command has to say."""
    ranges = ["heading_start", "heading_end", "content_start", "content_end"]
    packed = lambda df, name: df.select("book_id", "chapter_id", F.struct(*[F.col(c).cast("long").alias(c) for c in ranges]).alias(name))
    both = packed(before, "_b").join(packed(after, "_a"), ["book_id", "chapter_id"], "full")
    change: Column = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "moved")
    return both.withColumn("change", change).filter("change IS NOT NULL").select("book_id", "chapter_id", "change", "_a.*")
