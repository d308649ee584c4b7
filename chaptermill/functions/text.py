"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that a line is trimmed of, as a character class.
JS_SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
# The start of a heading line, and what may follow it. Longest code point count of a heading.
HEADING_START = (
    rf"第[^{JS_SPACE}，。！？!?]{{1,24}}[章回节卷部篇集]|序章|序言|楔子|前言|引子|终章|尾声|后记"
    rf"|番外(?:[{JS_SPACE}]*[0-9〇零一二三四五六七八九十百千万两]+)?|chapter[{JS_SPACE}]+(?:[0-9]+|[ivxlcdm]+)"
)
HEADING_SUFFIX = rf"[{JS_SPACE}:：.．·\-—]"
# A line of normalized text that starts as a heading, with its end; spaces in it don't reach over the line end.
_IN_LINE = lambda pattern: pattern.replace(f"[{JS_SPACE}", "[" + JS_SPACE.replace(r"\n", ""))
HEADING_LINE = rf"(?idm)^{_IN_LINE(f'[{JS_SPACE}]*+(?>{HEADING_START})')}(?=\n|\z|{_IN_LINE(HEADING_SUFFIX)})[^\n]*+(?:\n|\z)"
HEADING_MAX = 120
# Limits of slices, of previews and of counted matches.
SLICE_BYTES = 262_144
PREVIEW_BYTES, PREVIEW_LINES = 262_144, 1_000
MATCH_LIMIT = 19_999


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and give it to ``body``."""
    return F.transform(F.array(value), body)[0]


def normalize(text: Column) -> Column:
    """Line ends to \\n, no-break spaces to spaces."""
    clean = F.make_valid_utf8(text)
    for old, new in (("\r\n", "\n"), ("\r", "\n"), ("\u00a0", " ")):
        clean = F.replace(clean, F.lit(old), F.lit(new))
    return clean


def trim(line: Column) -> Column:
    return F.regexp_replace(line, rf"^[{JS_SPACE}]+|[{JS_SPACE}]+\z", "")


def leading(line: Column) -> Column:
    """The white space before a line's text."""
    return F.regexp_extract(line, rf"^[{JS_SPACE}]*", 0)


def is_heading(line: Column) -> Column:
    """A heading start, taken greedily, followed by nothing or by a separator."""
    t = trim(line)
    return (F.char_length(t) <= HEADING_MAX) & t.rlike(rf"(?i)^(?>{HEADING_START})(?=\z|{HEADING_SUFFIX})")


def heading_title(line: Column) -> Column:
    return F.regexp_replace(trim(line), "[\t \u3000]+", " ")


def around_headings(text: Column) -> Column:
    """Normalized text as an array of struct(piece, line): the text up to a line that starts as a heading, and that line
    with its end; null after the last piece."""
    return F.arrays_zip(F.split(text, HEADING_LINE).alias("piece"), F.regexp_extract_all(text, F.lit(HEADING_LINE), F.lit(0)).alias("line"))


def running_starts(sizes: Column, block: int = 64) -> Column:
    """The sum of the numbers before each in an array. Sums are made by blocks and then carried on, so the array
    under way stays short; ``sizes`` is evaluated once."""
    nothing, zero = F.array().cast("array<bigint>"), F.lit(0).cast("bigint")
    start = lambda at: F.struct(at.alias("at"), nothing.alias("out"))
    step = lambda a, x: F.struct((a["at"] + x).alias("at"), F.array_append(a["out"], a["at"]).alias("out"))

    def by_blocks(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / block).cast("int")), lambda b: F.slice(x, b * block + 1, block))

    def carried(blocks: Column) -> Column:
        sums = F.aggregate(blocks, start(zero), lambda a, b: step(a, F.aggregate(b, zero, lambda t, x: t + x)), lambda a: a["out"])
        return F.flatten(F.zip_with(blocks, sums, lambda b, at: F.aggregate(b, start(at), step, lambda a: a["out"])))

    return let(sizes, lambda x: F.when(F.size(x) == 0, nothing).otherwise(let(by_blocks(x), carried)))


def scan_lines(text: Column) -> Column:
    """Lines ended by CRLF, CR or LF; nothing after the last end is no line."""
    pieces = F.split(text, "\r\n?|\n")
    return F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)


def line_ends(text: Column) -> Column:
    """How many lines are complete; CR, LF and CRLF end one each."""
    return F.regexp_count(text, F.lit("\r\n?|\n"))


def visible_length(text: Column) -> Column:
    """Code points that aren't Unicode white space."""
    return F.char_length(F.regexp_replace(text, r"\p{IsWhite_Space}+", ""))


def is_boundary(data: Column, at: Column) -> Column:
    """Whether a byte offset of UTF-8 data lies between characters."""
    byte = F.conv(F.hex(F.substring(data, at + 1, F.lit(1))), 16, 10).cast("int")
    return (at == 0) | (at == F.octet_length(data)) | ((at > 0) & (at < F.octet_length(data)) & (byte.bitwiseAND(F.lit(192)) != 128))


def snap_back(data: Column, at: Column) -> Column:
    """The largest boundary up to ``at``; characters have four bytes at most."""
    return F.when(is_boundary(data, at), at).when(is_boundary(data, at - 1), at - 1).when(is_boundary(data, at - 2), at - 2).otherwise(at - 3)


def slice_bytes(data: Column, start: Column, end: Column, cap: int = SLICE_BYTES) -> Column:
    """struct(valid, text, end_byte, done) of a slice of UTF-8 data, at most ``cap`` bytes, cut back to a boundary.
    Ranges that are out of order, out of bounds or not between characters aren't valid."""
    total = F.octet_length(data)
    valid = F.coalesce((start >= 0) & (start <= end) & (end <= total) & is_boundary(data, start) & is_boundary(data, end), F.lit(False))
    stop = F.when(end - start > cap, snap_back(data, start + cap)).otherwise(end)
    return F.struct(
        valid.alias("valid"),
        F.when(valid, F.substring(data, start + 1, stop - start).cast("string")).alias("text"),
        F.when(valid, stop).alias("end_byte"),
        F.when(valid, stop == end).alias("done"),
    )


def match_pattern(query: str, case: bool = False, whole_word: bool = False, regexp: bool = False) -> str:
    """A search as a regular expression."""
    core = query if regexp else "\\Q" + query.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    if whole_word:
        core = rf"(?<![\p{{L}}\p{{N}}_])(?:{core})(?![\p{{L}}\p{{N}}_])"
    return core if case else "(?iu)" + core


def match_count(text: Column, pattern: str, limit: int = MATCH_LIMIT) -> tuple[Column, Column]:
    """Matches up to the limit, and whether there are more."""
    n = F.regexp_count(text, F.lit(pattern))
    return F.least(n, F.lit(limit)), n > limit


def count_text(current: Column, total: Column, limited: Column) -> Column:
    """``current / total``, with a plus where counting stopped."""
    return F.concat(F.format_number(current, 0), F.lit(" / "), F.format_number(total, 0), F.when(limited, "+").otherwise(""))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def utf16_prefix(text: Column, at: Column) -> Column:
    """The text up to a UTF-16 offset; null inside a surrogate pair or out of range."""
    data = F.encode(text, "UTF-16BE")
    pair = F.coalesce(F.hex(F.substring(data, 2 * at + 1, F.lit(1))).between("DC", "DF"), F.lit(False))
    return F.when((at >= 0) & (2 * at <= F.octet_length(data)) & ~pair, F.decode(F.substring(data, F.lit(1), (2 * at).cast("int")), "UTF-16BE"))


def utf16_to_byte(text: Column, at: Column) -> Column:
    """UTF-8 byte offset of a UTF-16 offset; null inside a surrogate pair or out of range."""
    return F.octet_length(utf16_prefix(text, at)).cast("long")


def byte_to_utf16(text: Column, at: Column) -> Column:
    """UTF-16 offset of a UTF-8 byte offset; null inside a character or out of range."""
    data = text.cast("binary")
    return F.when((at >= 0) & (at <= F.octet_length(data)) & is_boundary(data, at), utf16_length(F.substring(data, F.lit(1), at.cast("int")).cast("string")))


def to_editor(text: Column, at: Column) -> Column:
    """The UTF-16 offset in the text with \\n for every CRLF, of an offset in the text itself; one inside a CRLF is the
    place after it. Null inside a surrogate pair or out of range."""
    before = utf16_prefix(text, at)
    return at - F.regexp_count(before, F.lit("\r\n")).cast("long")


def from_editor(text: Column, at: Column) -> Column:
    """The UTF-16 offset in the text of an offset in the text with \\n for every CRLF; null out of range."""
    pieces = F.split(text, "\r\n")
    ends = F.slice(running_starts(F.transform(pieces, lambda p: utf16_length(p) + 1)), 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.when((at >= 0) & (at <= utf16_length(text) - F.size(pieces) + 1), at + F.size(F.filter(ends, lambda e: e <= at)))


def prefill(text: Column, start: Column, end: Column) -> Column:
    """What a selection of code points puts into the search field: its text, if it isn't empty and lies in one line."""
    found = F.substring(text, start + 1, end - start)
    return F.when((end > start) & (found != "") & ~found.rlike("[\r\n]"), found)


def _bisected(most: Column, same) -> Column:
    """The largest n up to ``most`` for which ``same(k, n)``, that what lies between the first k and n is equal, holds all along."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(most + 1)).cast("int"))

    def step(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"] + 1) / 2).cast("int")
        equal = same(acc["low"], middle)
        return F.struct(F.when(equal, middle).otherwise(acc["low"]).alias("low"), F.when(equal, acc["high"]).otherwise(F.greatest(acc["low"], middle - 1)).alias("high"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), most.alias("high")), step)["low"]


def _half(char: Column, last: bool) -> Column:
    """One of the two UTF-16 units of a character that has two; null of any other."""
    data = F.encode(char, "UTF-16BE")
    return F.when(F.octet_length(data) == 4, F.substring(data, 3 if last else 1, 2))


def common_ends(old: Column, new: Column) -> Column:
    """struct(prefix, suffix): UTF-16 lengths of the common ends of two texts (null counts as empty). They don't overlap, where
    also halves of surrogate pairs count as common, and neither splits a pair of the old text."""

    def ends(t: Column) -> Column:
        a, b = t["a"], t["b"]
        most = F.least(F.char_length(a), F.char_length(b))
        front = _bisected(most, lambda k, n: F.substring(a, k + 1, n - k) == F.substring(b, k + 1, n - k))
        back = _bisected(most, lambda k, n: F.substring(a, F.char_length(a) - n + 1, n - k) == F.substring(b, F.char_length(b) - n + 1, n - k))
        return let(F.struct(a.alias("a"), b.alias("b"), front.alias("front"), back.alias("back")), halves)

    def halves(t: Column) -> Column:
        a, b, front, back = t["a"], t["b"], t["front"], t["back"]
        at = lambda x, i: F.when(i > 0, F.substring(x, i, F.lit(1)))
        share = lambda x, y, last: F.coalesce((_half(x, last) == _half(y, last)).cast("int"), F.lit(0))
        prefix = utf16_length(F.substring(a, F.lit(1), front))
        raw = prefix + share(at(a, front + 1), at(b, front + 1), False)
        behind = utf16_length(F.substring(a, F.char_length(a) - back + 1, back)) + share(at(a, F.char_length(a) - back), at(b, F.char_length(b) - back), True)
        suffix = F.least(behind, F.least(utf16_length(a), utf16_length(b)) - raw)
        return let(F.struct(a.alias("a"), prefix.alias("prefix"), suffix.alias("suffix")), guarded)

    def guarded(t: Column) -> Column:
        data = F.encode(t["a"], "UTF-16BE")
        first = F.hex(F.substring(data, (F.octet_length(data) - 2 * t["suffix"] + 1).cast("int"), F.lit(1)))
        split = (t["suffix"] > 0) & F.coalesce(first.between("DC", "DF"), F.lit(False))
        return F.struct(t["prefix"].alias("prefix"), (t["suffix"] - split.cast("int")).alias("suffix"))

    return let(F.struct(F.coalesce(old, F.lit("")).alias("a"), F.coalesce(new, F.lit("")).alias("b")), ends)


def minimal_change(old: Column, new: Column) -> Column:
    """struct(start, end, insert): the UTF-16 range of the old text that has to be replaced, and by what, to give the new one."""
    length = utf16_length(F.coalesce(old, F.lit("")))
    data = F.encode(F.coalesce(new, F.lit("")), "UTF-16BE")
    inserted = lambda e: F.decode(F.substring(data, (2 * e["prefix"] + 1).cast("int"), (F.octet_length(data) - 2 * (e["prefix"] + e["suffix"])).cast("int")), "UTF-16BE")
    return let(common_ends(old, new), lambda e: F.struct(e["prefix"].alias("start"), (length - e["suffix"]).alias("end"), inserted(e).alias("insert")))


def map_position(at: Column, change: Column, after: bool) -> Column:
    """Where a UTF-16 position lies once ``change`` is made; inside what was replaced, before the insertion or ``after`` it."""
    start, end, grown = change["start"], change["end"], utf16_length(change["insert"])
    moved = at + grown - (end - start)
    inside = start + grown if after else start
    return F.when(at < start, at).when((start == end) & (at == start), inside).when(at == start, start).when(at < end, inside).otherwise(moved)
