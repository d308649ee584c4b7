"""Places of all matches of a search in books kept as parts, and the way from match to match.

Matches are taken from left to right and don't overlap, as if a book were one text. A part is searched
in the scan; only its end is searched again, together with the ``reach`` code points that follow it. It gives
the matches that start in it; what its last match takes of the next part is left out there. As parts end with a line end, only a search that
can match a line end needs a ``reach`` of more than 1: then it is the most code points of a match.
"""

from __future__ import annotations

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chaptermill.functions import text as T
from chaptermill.operators.intervals import owner_of
from chaptermill.operators.ordered import along, cyclic
from chaptermill.operators.stored import stored

# What is shown for a pattern that isn't one, and where nothing is found.
INVALID, NO_RESULTS = "无效正则", "无结果"
#: Code points before the end of a part that stay in sight of what looks behind.
CONTEXT = 64


def state(spark: SparkSession, query: str, regexp: bool = False) -> str:
    """Of a search: empty, invalid (no regular expression), blank (it matches the empty text) or ready."""
    if not query:
        return "empty"
    if regexp:
        try:
            pattern = spark._jvm.java.util.regex.Pattern.compile(query)
        except IllegalArgumentException:  # of which the syntax exception of patterns is one
            return "invalid"
        if pattern.matcher("").find():
            return "blank"
    return "ready"


def reach_of(query: str, regexp: bool = False) -> int:
    """The ``reach`` of a literal search; a regular expression that can match line ends has to be given its own."""
    return 1 if regexp or not ("\n" in query or "\r" in query) else len(query)


def _units(text: Column) -> Column:
    """UTF-16 length; of ASCII without encoding it."""
    return F.when(F.octet_length(text) == F.char_length(text), F.octet_length(text).cast("long")).otherwise(T.utf16_length(text))


def _found(text: Column, pattern: str | Column) -> Column:
    """Matches as an array of struct(start, size, start16, size16), in bytes and UTF-16 units. The text is searched twice,
    whatever the number of its matches: for what lies between them and for what they are."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    size = lambda x: F.octet_length(x).cast("long")

    def measured(x: Column) -> Column:
        sizes = lambda p, h: F.struct(size(p).alias("p"), size(h).alias("h"), _units(p).alias("p16"), _units(h).alias("h16"))
        return F.zip_with(F.slice(x["pieces"], 1, F.size(x["hits"])), x["hits"], sizes)

    def placed(sizes: Column) -> Column:
        starts = T.running_starts(F.transform(sizes, lambda m: m["p"] + m["h"]))
        starts16 = T.running_starts(F.transform(sizes, lambda m: m["p16"] + m["h16"]))
        same = F.forall(sizes, lambda m: (m["p"] == m["p16"]) & (m["h"] == m["h16"]))
        match = lambda at, m: F.struct((at["b"] + m["p"]).alias("start"), m["h"].alias("size"), (at["u"] + m["p16"]).alias("start16"), m["h16"].alias("size16"))
        both = T.let(starts, lambda b: F.arrays_zip(b.alias("b"), F.when(same, b).otherwise(starts16).alias("u")))
        return F.zip_with(both, sizes, match)

    searched = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hits"))
    return T.let(T.let(searched, measured), placed)


def _moved(found: Column, by: Column, by16: Column) -> Column:
    return F.transform(found, lambda m: F.struct((m["start"] + by).alias("start"), m["size"].alias("size"), (m["start16"] + by16).alias("start16"), m["size16"].alias("size16")))


def _pieces(clean: DataFrame, pattern: str, reach: int) -> DataFrame:
    """One row a part, without its text: bytes, units, length (code points), own (its first ``reach`` code points) and
    sure, the matches that what follows the part can't change; with the ``rest`` of the text after them (from the byte
    rest_at on), where what follows counts, and the ``context`` before it, for what looks behind."""
    sized = clean.select("book_id", "part", "text", F.octet_length("text").cast("long").alias("bytes"), _units(F.col("text")).alias("units"), _found(F.col("text"), pattern).alias("all"))
    if reach == 1:
        return sized.drop("text").withColumnRenamed("all", "found")
    tail_at = F.col("bytes") - F.octet_length(F.substring("text", -2 * reach, 2 * reach))
    sure = sized.withColumn("_tail", tail_at).withColumn("sure", F.filter("all", lambda m: m["start"] < F.col("_tail")))
    last = F.try_element_at("sure", F.lit(-1))
    cut = sure.withColumn("rest_at", F.greatest(F.col("_tail"), F.coalesce(last["start"] + last["size"], F.lit(0))))
    data, at = F.col("text").cast("binary"), F.col("rest_at").cast("int")
    return cut.select(
        "book_id", "part", "bytes", "units", F.char_length("text").alias("length"), F.substring("text", 1, reach).alias("own"), "sure", "rest_at",
        F.substring(data, at + 1, F.octet_length("text")).cast("string").alias("rest"), F.substring(F.substring(data, F.lit(1), at).cast("string"), -CONTEXT, CONTEXT).alias("context"),
    )


def _with_heads(pieces: DataFrame, reach: int) -> DataFrame:
    """Parts with ``head``: the code points that follow them."""
    headed = along(pieces, ["book_id"], "part", after={"head": "own"})
    shortest = pieces.agg(F.min("length")).first()[0] or reach
    for _ in range(-(-reach // shortest) - 1):  # parts shorter than the reach hand on what follows them
        handed = headed.withColumn("full", F.substring(F.concat("own", F.coalesce("head", F.lit(""))), 1, reach)).drop("head")
        headed = along(handed, ["book_id"], "part", after={"head": "full"}).drop("full")
    return headed.withColumn("head", F.coalesce("head", F.lit("")))


def _own(found: Column) -> Column:
    """Those that start in the part."""
    return F.filter(found, lambda m: m["start"] < F.col("bytes"))


def _with_rests(headed: DataFrame, pattern: str) -> DataFrame:
    """Parts with ``first``, their matches if the part before takes nothing of them: the rest is searched with the head."""
    n = F.char_length("context")
    # Looking back to the start comes last, so it is done where the pattern matches only.
    behind = F.when(n == 0, F.lit(pattern)).otherwise(F.concat(F.lit(rf"(?={pattern})(?<=[\s\S]{{"), n.cast("string"), F.lit(","), (2 * n).cast("string"), F.lit(rf"}})(?:{pattern})")))
    onward = _found(F.concat("context", "rest", "head"), behind)
    ends = _moved(onward, F.col("rest_at") - F.octet_length("context"), F.col("units") - _units(F.concat("context", "rest")))
    return headed.withColumn("first", F.concat("sure", _own(ends))).drop("sure", "rest", "rest_at", "context")


def _resumed(again: DataFrame, clean: DataFrame, pattern: str) -> DataFrame:
    """``again`` with its matches as ``found``, as ``carry`` code points are taken by the match before. Where no match lies over
    the end of what is taken, they are those after it; else the part is searched anew."""
    upto = F.octet_length(F.substring(F.col("own"), F.lit(1), F.col("carry"))).cast("long")
    placed = again.withColumn("_upto", upto)
    over = (F.col("carry") < F.col("length")) & F.exists("first", lambda m: (m["start"] < F.col("_upto")) & (m["start"] + m["size"] > F.col("_upto")))
    onward = placed.withColumn("found", F.filter("first", lambda m: m["start"] >= F.col("_upto"))).withColumn("_over", over).drop("_upto")
    tangled = onward.filter("_over").drop("_over", "found")
    if tangled.isEmpty():
        return onward.drop("_over")
    return onward.filter("NOT _over").drop("_over").unionByName(_searched(tangled.join(clean, ["book_id", "part"]), pattern).drop("text"))


def _searched(placed: DataFrame, pattern: str) -> DataFrame:
    """``placed`` (with text and carry, the code points that the match before has taken) with its matches as ``found``."""
    whole = F.concat("text", "head")
    # One taken code point stays in sight of what looks behind, but no match starts with it.
    skipped = F.substring(whole, F.lit(1), F.col("carry") - 1)
    onward = _found(F.substring(whole, F.col("carry"), F.char_length(whole)), rf"(?<=[\s\S])(?:{pattern})")
    return placed.withColumn("found", _own(_moved(onward, F.octet_length(skipped).cast("long"), _units(skipped))))


def matches(parts: DataFrame, pattern: str, reach: int = 1) -> DataFrame:
    """book_id, number (from 1), start_byte, end_byte, start_utf16, end_utf16 and total of all matches of ``pattern`` (see
    :func:`chaptermill.functions.text.match_pattern`) in the normalized texts of ``parts``. Texts are searched in the scan
    and don't move; what is stored is a part's matches, and what lies at its ends."""
    text = T.normalize(F.coalesce("text", F.lit("")))
    clean = parts.select("book_id", "part", text.alias("text")).filter("text <> '' AND part IS NOT NULL")
    clean = clean.withColumn("text", F.when(F.col("text").endswith("\n"), F.col("text")).otherwise(F.concat("text", F.lit("\n"))))
    pieces = stored(_pieces(clean, pattern, reach), "search")
    if reach == 1:
        return _numbered(pieces)
    placed = stored(_with_rests(_with_heads(pieces, reach), pattern), "search")
    searched = placed.withColumns({"found": F.col("first"), "carry": F.lit(0)})
    while True:
        last = F.try_element_at("found", F.lit(-1))
        beyond = F.greatest(F.lit(0).cast("long"), last["start"] + last["size"] - F.col("bytes"))
        out = F.when(F.size("found") > 0, F.char_length(F.substring(F.col("head").cast("binary"), F.lit(1), beyond.cast("int")).cast("string"))).otherwise(0)
        # A match may reach over several short parts: what is left of it after a part is handed on.
        taken = F.greatest(out, F.col("carry") - F.col("length"))
        handed = along(searched.select("book_id", "part", taken.alias("out")), ["book_id"], "part", before={"now": "out"}).select("book_id", "part", F.coalesce("now", F.lit(0)).alias("now"))
        again = searched.join(handed, ["book_id", "part"])
        if again.filter("now <> carry").isEmpty():
            break
        searched = stored(_resumed(again.withColumn("carry", F.col("now")).drop("now", "found"), clean, pattern), "search")
    return _numbered(searched)


def _numbered(searched: DataFrame) -> DataFrame:
    sums = {"base": F.col("bytes"), "base16": F.col("units"), "before": F.size("found")}
    counted = along(searched.select("book_id", "part", "bytes", "units", "found"), ["book_id"], "part", totals=sums)
    totals = searched.groupBy("book_id").agg(F.sum(F.size("found")).cast("long").alias("total"))
    rows = counted.select("book_id", "base", "base16", "before", F.posexplode("found").alias("i", "m"))
    start, start16 = F.col("base") + F.col("m.start"), F.col("base16") + F.col("m.start16")
    placed = rows.select(
        "book_id", (F.col("before") + F.col("i") + 1).cast("long").alias("number"), start.alias("start_byte"), (start + F.col("m.size")).alias("end_byte"),
        start16.alias("start_utf16"), (start16 + F.col("m.size16")).alias("end_utf16"),
    )
    return placed.join(totals, "book_id")


def neighbours(found: DataFrame) -> DataFrame:
    """Matches with next_start and previous_start, bytes where the next and the previous one starts; around the end."""
    near = cyclic(found, ["book_id"], "number", "start_byte")
    return near.withColumnsRenamed({"next_value": "next_start", "previous_value": "previous_start"})


def from_places(found: DataFrame, places: DataFrame) -> DataFrame:
    """``places`` (book_id, at: a byte of the book) with next_start, the first match from there on, and previous_start,
    the last that ends up to there; around the ends, and null where a book has no match."""
    near = neighbours(found).withColumn("owner", F.struct("start_byte", "end_byte", "next_start", "previous_start"))
    ranges = stored(near.select("book_id", "start_byte", "end_byte", "owner"), "ranges")
    ends = found.groupBy("book_id").agg(F.min("start_byte").alias("_first"), F.max("start_byte").alias("_last"))
    asked = places.withColumn("_at", F.col("at"))
    ahead = owner_of(asked.withColumn("at", F.col("_at") - 1), ranges, ["book_id"]).withColumn("next_start", F.col("owner.next_start")).drop("owner", "inside")
    ahead = stored(ahead, "ahead")
    both = owner_of(ahead.withColumn("at", F.col("_at")), ranges, ["book_id"])
    behind = F.when(F.col("owner.end_byte") <= F.col("_at"), F.col("owner.start_byte")).otherwise(F.col("owner.previous_start"))
    joined = both.withColumn("previous_start", behind).drop("owner", "inside", "_at").join(ends, "book_id", "left")
    return joined.select(*places.columns, F.coalesce("next_start", "_first").alias("next_start"), F.coalesce("previous_start", "_last").alias("previous_start"))


def status(total: Column, current: Column, kind: str = "ready", limit: int = T.MATCH_LIMIT) -> Column:
    """What is shown beside a search: nothing, that it is invalid or has no results, or `current / total`."""
    if kind != "ready":
        return F.lit(INVALID if kind == "invalid" else "")
    return F.when(total == 0, NO_RESULTS).otherwise(T.count_text(current, F.least(total, F.lit(limit)), total > limit))
