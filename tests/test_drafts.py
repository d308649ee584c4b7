"""Refused edits, retained priorities and merges against a draft that is edited step by step."""

import random

import pytest
from chaptermill.operators import drafts, review
from pyspark.sql import functions as F

CHAPTERS = "book_id string, ord int, chapter_id string, heading_start long, heading_end long, content_start long, content_end long"
RANGES = "book_id string, start_byte long, end_byte long"
EDITS = "book_id string, seq int, ord int, side string, at long"
TOTAL = 400


def one_by_one(chapters, holes, edits):
    """Faults of the edits of a book, and its chapters' effective ranges, by a draft in memory."""
    state = [dict(ord=o, headed=hs is not None, opens=cs if hs is None else hs, protected=hs, heading_end=he, content=cs, closes=ce) for _, o, _, hs, he, cs, ce in chapters]
    for c in state:
        c.update(want_opens=c["opens"], want_closes=c["closes"])
    place = {c["ord"]: i for i, c in enumerate(state)}
    clear = lambda low, high: all(not (s < high and low < e) for s, e in holes)
    faults = {}
    for _, seq, ord_, side, at in sorted(edits, key=lambda e: e[1]):
        if ord_ not in place:
            faults[seq] = "chapter"
            continue
        i = place[ord_]
        p, n = (i - 1, i) if side == "start" else (i, i + 1)
        before, after = (state[p] if p >= 0 else None), (state[n] if n < len(state) else None)
        fault = None
        if not 0 <= at <= TOTAL:
            fault = "bounds"
        elif after and after["headed"] and (at > after["protected"] or at >= after["heading_end"]):
            fault = "heading"
        elif before and before["headed"] and at < before["content"]:
            fault = "order"
        elif not (clear(at, after["opens"]) if side == "start" else clear(before["closes"], at)):
            fault = "unassigned"
        elif after and not after["headed"] and at > after["closes"]:
            fault = "chapter-end"
        elif before and not before["headed"] and at < before["opens"]:
            fault = "order"
        faults[seq] = fault
        if fault:
            continue
        if side == "start":
            after["want_opens"] = after["opens"] = at
            if before:
                before["closes"] = min(before["want_closes"], at)
        else:
            before["want_closes"] = before["closes"] = at
            if after:
                after["opens"] = max(after["want_opens"], at)
    return faults, {c["ord"]: (c["opens"], c["closes"]) for c in state}


def made_up(rng, book, headed):
    chapters, holes, at = [], [], 0
    for i in range(12):
        at += rng.choice([0, 0, 3, 8])
        start = at
        if rng.random() < headed:
            heading = (start, start + 3)
            content = start + 3 + rng.choice([0, 1])
        else:
            heading, content = (None, None), start
        at = content + rng.randrange(3, 20)
        chapters.append((book, 3 * i + 1, f"{book}{i}", *heading, content, at))
        if rng.random() < 0.3:
            holes.append((at + 1, at + 3))
            at += 4
    return chapters, holes


@pytest.mark.parametrize("headed", [1.0, 0.5, 0.0])
def test_edits_are_judged_as_one_by_one(spark, headed):
    rng = random.Random(int(headed * 10))
    chapters, holes, edits, want, ranges = [], [], [], {}, {}
    for book in "abcd":
        own, gaps = made_up(rng, book, headed)
        asked = [(book, seq, rng.choice([c[1] for c in own] * 9 + [2]), rng.choice(["start", "end"]), 0) for seq in range(60)]
        near = {c[1]: c for c in own}
        asked = [(b, q, o, s, -1 if rng.random() < 0.03 else (near[o][4 if s == "start" else 6] or near[o][5]) + rng.randrange(-9, 7) if o in near else 5) for b, q, o, s, _ in asked]
        faults, effective = one_by_one(own, gaps, asked)
        want |= {(book, seq): f for seq, f in faults.items()}
        ranges |= {(book, o): r for o, r in effective.items()}
        chapters += own
        holes += [(book, s, e) for s, e in gaps]
        edits += asked
    rng.shuffle(edits)
    frames = spark.createDataFrame(chapters, CHAPTERS), spark.createDataFrame(holes, RANGES), spark.createDataFrame([(b, TOTAL) for b in "abcd"], "book_id string, total long")
    judged = drafts.edit_faults(*frames, spark.createDataFrame(edits, EDITS)).cache()
    got = {(r.book_id, r.seq): r.fault for r in judged.collect()}
    assert got == want and {"heading", "chapter-end"} & set(want.values()) and {"order", "chapter", None} <= set(want.values())
    applied = judged.filter("fault IS NULL").drop("fault")
    after = review.boundary_edits(frames[0], applied).collect()
    assert {(r.book_id, r.ord): (r.content_start if r.heading_start is None else r.heading_start, r.content_end) for r in after} == ranges


def test_priorities_outlive_only_while_neighbours(spark):
    chapters = spark.createDataFrame([("b", i, f"c{i}", 10 * i, 10 * i + 2, 10 * i + 2, 10 * i + 10) for i in range(1, 6)], CHAPTERS)
    books = spark.createDataFrame([("b", 100)], "book_id string, total long")
    edits = spark.createDataFrame([("b", 1, 2, "start", 19), ("b", 2, 1, "end", 18), ("b", 3, 3, "end", 37), ("b", 4, 4, "start", 38), ("b", 5, 1, "start", 9), ("b", 6, 5, "end", 70)], EDITS)
    held = drafts.priorities(chapters, books, edits)
    assert {(r.previous_id, r.next_id): r.side for r in held.collect()} == {("c1", "c2"): "previous-content-end", ("c3", "c4"): "next-chapter-start"}
    merged = review.merge_into_previous(chapters, spark.createDataFrame([("b", 3)], "book_id string, ord int"))
    assert [(r.previous_id, r.next_id) for r in drafts.retained(held, merged).collect()] == [("c1", "c2")]
    dropped = drafts.merge_into_next(chapters, spark.createDataFrame([("b", 1), ("b", 5)], "book_id string, ord int"))
    assert [r.chapter_id for r in dropped.orderBy("ord").collect()] == ["c2", "c3", "c4", "c5"]
    assert [(r.previous_id, r.next_id) for r in drafts.retained(held, dropped).collect()] == [("c3", "c4")]


def test_merge_and_update_faults(spark):
    chapters = spark.createDataFrame([("b", i, f"c{i}", 10 * i, 10 * i + 2, 10 * i + 2, 10 * i + 7) for i in range(1, 5)] + [("d", 1, "d1", 5, 7, 7, 9)], CHAPTERS)
    holes = spark.createDataFrame([("b", 28, 29), ("d", 0, 5)], RANGES)
    which = spark.createDataFrame([("b", o, d) for o in (1, 2, 3, 4, 9) for d in ("previous", "next")], "book_id string, ord int, direction string")
    got = {(r.ord, r.direction): r.fault for r in drafts.merge_faults(chapters, holes, which).collect()}
    assert got == {(1, "previous"): "edge", (1, "next"): None, (2, "previous"): None, (2, "next"): None, (3, "previous"): "unassigned", (3, "next"): None, (4, "previous"): None, (4, "next"): "edge", (9, "previous"): "chapter", (9, "next"): "chapter"}
    columns = "book_id string, chapter_id string, new_heading_start long, new_heading_end long, new_content_start long, new_content_end long"
    faults = lambda rows: sorted((r.book_id, r.fault) for r in drafts.update_faults(chapters, holes, spark.createDataFrame(rows, columns)).collect())
    assert faults([("b", "c2", None, None, None, 28), ("d", "d1", 3, None, None, None)]) == []
    assert faults([("b", "c2", None, None, None, 29), ("d", "d1", 3, None, None, None), ("d", "d1", 3, None, None, None), ("b", "x", 1, 2, 3, 4)]) == [("b", "unassigned"), ("b", "unknown"), ("d", "repeated")]


def test_changes_of_a_draft(spark):
    before = spark.createDataFrame([("b", 1, "a", 0, 2, 2, 9), ("b", 2, "c", None, None, 9, 12), ("b", 3, "d", 12, 14, 14, 20)], CHAPTERS)
    after = spark.createDataFrame([("b", 1, "a", 0, 2, 2, 9), ("b", 2, "c", 9, 10, 10, 12), ("b", 3, "e", 12, 14, 14, 20)], CHAPTERS)
    rows = drafts.changes(before, after).collect()
    assert sorted((r.chapter_id, r.change, r.heading_start or -1) for r in rows) == [("c", "moved", 9), ("d", "removed", -1), ("e", "added", 12)]
    assert drafts.changes(before, before.withColumn("content_end", F.col("content_end").cast("int"))).count() == 0
