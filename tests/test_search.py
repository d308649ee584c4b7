"""Places of matches against Python's on whole books, and the way from match to match."""

import random
import re

import pytest
from chaptermill.functions import text as T
from chaptermill.operators import search
from pyspark.sql import functions as F

SCHEMA = "book_id string, part long, text string"


def places(text, pattern, flags=re.I):
    """(start_byte, end_byte, start_utf16, end_utf16) of all matches of a Python pattern."""
    units = lambda t: len(t.encode("utf-16-le")) // 2
    return [(len(text[: m.start()].encode()), len(text[: m.end()].encode()), units(text[: m.start()]), units(text[: m.end()])) for m in re.finditer(pattern, text, flags)]


def found(spark, parts, pattern, reach=1):
    rows = search.matches(spark.createDataFrame([("b", i, t) for i, t in enumerate(parts)], SCHEMA).repartition(3), pattern, reach).orderBy("number").collect()
    assert [r.number for r in rows] == list(range(1, len(rows) + 1)) and all(r.total == len(rows) for r in rows)
    return [(r.start_byte, r.end_byte, r.start_utf16, r.end_utf16) for r in rows]


@pytest.mark.parametrize("query, regexp, word", [("ab", False, False), ("a.b", False, False), ("[ab]+é?", True, False), ("ab", False, True), ("😀", False, False)])
def test_matches_within_parts(spark, query, regexp, word):
    rng = random.Random(4)
    parts = ["".join(rng.choices(["a", "b", "ab", " ", "é", "😀", "\r\n", "a.b"], k=rng.randrange(0, 60))) + "\n" for _ in range(12)] + ["", "last ab"]
    core = query if regexp else re.escape(query)
    text = "".join(p if p.endswith("\n") or not p else p + "\n" for p in (re.sub("\r\n?", "\n", p) for p in parts))
    want = places(text, rf"(?<!\w)(?:{core})(?!\w)" if word else core)
    assert found(spark, parts, T.match_pattern(query, whole_word=word, regexp=regexp)) == want and want


@pytest.mark.parametrize("query", ["a\na", "\n\n", "a\n\na\n", "x\na", "\n" * 5])
def test_matches_over_part_ends(spark, query):
    rng = random.Random(len(query))
    parts = [rng.choice(["a\n", "\n", "\n\n", "a\n", "x\na\n", "😀a\n"]) for _ in range(200)]
    assert search.reach_of(query) == len(query)
    got = found(spark, parts, T.match_pattern(query), search.reach_of(query))
    assert got == places("".join(parts), re.escape(query)) and got


def test_whole_words_over_part_ends(spark):
    parts = ["a\n", "aa\n", "a\n", "a\n", "a\n", "xa\n", "a b\n"]
    want = places("".join(parts), r"(?<!\w)(?:a\na)(?!\w)")
    assert found(spark, parts, T.match_pattern("a\na", whole_word=True), 4) == want == [(5, 8, 5, 8)]


def test_the_way_around_the_end(spark):
    frame = spark.createDataFrame([("b", 0, "one\n"), ("b", 1, "two one"), ("c", 0, "one"), ("d", 0, "none at all, but o n e")], SCHEMA)
    all_found = search.matches(frame, T.match_pattern("one", whole_word=True))
    near = {(r.book_id, r.start_byte): (r.next_start, r.previous_start) for r in search.neighbours(all_found).collect()}
    assert near == {("b", 0): (8, 8), ("b", 8): (0, 0), ("c", 0): (0, 0)}
    asked = spark.createDataFrame([("b", 0), ("b", 1), ("b", 8), ("b", 11), ("b", 12), ("c", 3), ("d", 2)], "book_id string, at long")
    got = {(r.book_id, r.at): (r.next_start, r.previous_start) for r in search.from_places(all_found, asked).collect()}
    assert got == {("b", 0): (0, 8), ("b", 1): (8, 8), ("b", 8): (8, 0), ("b", 11): (0, 8), ("b", 12): (0, 8), ("c", 3): (0, 0), ("d", 2): (None, None)}


def test_states_of_a_search(spark):
    assert [search.state(spark, *a) for a in [("",), ("[",), ("[", True), ("a*", True), ("a+", True)]] == ["empty", "ready", "invalid", "blank", "ready"]
    shown = spark.range(1).select(search.status(F.lit(20_001), F.lit(1)), search.status(F.lit(0), F.lit(0)), search.status(F.lit(0), F.lit(0), "invalid"), search.status(F.lit(2), F.lit(2)), search.status(F.lit(0), F.lit(0), "empty")).first()
    assert tuple(shown) == ("1 / 19,999+", "无结果", "无效正则", "2 / 2", "")


def test_texts_are_searched_twice_and_stay_where_they_are(spark):
    """However many matches there are: once for what lies between them and once for what they are."""
    frame = spark.createDataFrame([("b", 0, "ab " * 300), ("b", 1, "ab")], SCHEMA)
    plan = frame.select(search._found(F.col("text"), "ab").alias("found"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") == plan.count("regexp_extract_all(") == 1
    files = search.matches(frame, T.match_pattern("ab")).inputFiles()
    assert files and "text" not in spark.read.parquet(*files).columns


@pytest.mark.parametrize("query, regexp", [("b\na", False), ("a\nba", False)])
def test_ends_of_long_parts_are_searched_with_what_follows(spark, query, regexp):
    rng = random.Random(7)
    parts = ["".join(rng.choices("aab😀\n", k=rng.randrange(80, 200))) + rng.choice(["\n", "b\n", "a\nb\n", "😀b\n"]) for _ in range(30)]
    core = query if regexp else re.escape(query)
    assert found(spark, parts, T.match_pattern(query, regexp=regexp), 4) == places("".join(parts), core)
