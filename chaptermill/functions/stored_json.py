"""Stored JSON: its canonical form at any depth, and what is wrong with stored previews and snapshots.

A text is parsed into a VARIANT, whose objects keep their keys sorted by UTF-16 units at every depth; written out
again its strings and numbers are put as JavaScript writes them. All of it is built-in functions. Objects
that repeat a key are taken for broken.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The largest integer that a double holds exactly, the unit of stored ranges.
SAFE, UNIT = 2**53 - 1, "utf8-byte"
# Fields of stored previews and snapshots and their kinds.
PREVIEW = {"baselineRevision": "integer", "commandType": "string", "affected": "array", "requiresConfirmation": "boolean"}
SNAPSHOT = {
    "revisionId": "string", "baselineRevision": "integer", "source": "object", "encoding": "string", "encodingMethod": "string", "textByteLength": "integer",
    "chapters": "array", "coverage": "object", "revisionHistory": "array", "reviewStatus": ("pending", "approved"), "createdAt": "string",
}
# A number of up to 15 digits that JavaScript writes the same way; runs of text with nothing to put otherwise; what may have.
_PLAIN = r"-?(?:[0-9]{1,15}|(?=[0-9.]{3,16}(?![0-9.]))(?:[1-9][0-9]*|0(?=\.0{0,5}[1-9]))\.[0-9]*[1-9])(?![-+.0-9eE])"
_RUN = rf'(?:[^"0-9-]++|"(?:[^"\\]++|\\(?!u00).)*+"|{_PLAIN}){{1,200}}+'
_TOKEN = rf'{_RUN}|"(?:[^"\\]++|\\.)*+"|-?[0-9][-+.0-9eE]*'
_END = "\u0001end of text\u0001"


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and give it to ``body``."""
    return F.transform(F.array(value), body)[0]


def parsed(text: Column) -> Column:
    """The text as a VARIANT; null where it is no JSON, or JSON with more behind it."""
    whole = F.try_parse_json(F.concat(F.lit("["), text, F.lit("," + '"' + _END.replace("\u0001", "\\u0001") + '"]')))

    def first(w: Column) -> Column:
        alone = F.coalesce(F.try_variant_get(w, "$[1]", "string") == _END, F.lit(False)) & F.try_variant_get(w, "$[2]", "variant").isNull()
        return F.when(alone, F.try_variant_get(w, "$[0]", "variant"))

    return _let(whole, first)


def number_text(value: Column) -> Column:
    """A double as JavaScript writes it: its shortest digits, plain from 1e-6 up to 1e21."""
    size = F.abs(value)

    def shortest(given: Column) -> Column:
        # Where many digits are given, or for the smallest doubles, fewer may do for the same double.
        fewer = [F.format_string(f"%.{p}e", size) for p in (0, 14, 15, 16)]
        long = F.length(F.regexp_replace(F.regexp_extract(given, r"^[0-9.]*", 0), r"\.|^0\.0*", "")) > 15
        long = long | (size < 1e-307)
        chosen = given
        for text in reversed(fewer):
            chosen = F.when(long & (text.cast("double") == size), text).otherwise(chosen)
        return chosen

    def written(text: Column) -> Column:
        mantissa, power = F.regexp_extract(text, r"^[0-9.]*", 0), F.coalesce(F.try_to_number(F.nullif(F.regexp_replace(F.regexp_extract(text, r"[eE]\+?(-?[0-9]+)", 1), "^(-?)0+(?=[0-9])", "$1"), F.lit("")), F.lit("S999")).cast("int"), F.lit(0))
        whole, part = F.regexp_extract(mantissa, r"^[0-9]*", 0), F.regexp_extract(mantissa, r"\.([0-9]*)", 1)
        all_digits = F.concat(whole, part)
        zeros = F.length(F.regexp_extract(all_digits, "^0*", 0))
        digits = F.regexp_replace(F.regexp_replace(all_digits, "^0+", ""), "0+$", "")
        return _let(F.struct(digits.alias("d"), F.length(digits).alias("k"), (F.length(whole) + power - zeros).alias("n")), laid_out)

    def laid_out(x: Column) -> Column:
        d, k, n = x["d"], x["k"], x["n"]
        e = n - 1
        exponent = F.concat(F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.abs(e).cast("string"))
        return (
            F.when(k == 0, F.lit("0")).when((n >= k) & (n <= 21), F.rpad(d, n, "0"))
            .when((n > 0) & (n <= 21), F.concat(F.substring(d, F.lit(1), n), F.lit("."), F.substring(d, n + 1, k)))
            .when((n > -6) & (n <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), -n), d))
            .otherwise(F.concat(F.substring(d, 1, 1), F.when(k > 1, F.concat(F.lit("."), F.substring(d, F.lit(2), k))).otherwise(""), exponent))
        )

    plain = _let(_let(size.cast("string"), shortest), written)
    return F.when((value < 0) & (plain != "0"), F.concat(F.lit("-"), plain)).otherwise(plain)


def _token(token: Column) -> Column:
    escapes = token
    for code in [0x0B, 0x0E, 0x0F, *range(0x1A, 0x20)]:
        escapes = F.regexp_replace(escapes, rf"(?<!\\)((?:\\\\)*)\\u{code:04X}", rf"$1\\u{code:04x}")
    number = F.when(token.rlike(r"^-?[1-9][0-9]{0,14}\.0$"), F.substring_index(token, ".", 1)).otherwise(number_text(token.try_cast("double")))
    odd = token.rlike(r"^-?[0-9][-+.0-9eE]*$") & ~token.rlike(f"^{_PLAIN}$")
    return F.when(odd, number).when(token.contains("\\u00"), escapes).otherwise(token)


def canonical(text: Column) -> Column:
    """The JSON with the keys of all objects sorted and no space; null where it is no JSON."""
    return F.array_join(F.transform(F.regexp_extract_all(F.to_json(parsed(text)), F.lit(_TOKEN), F.lit(0)), _token), "")


def canonical_hash(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def kind(value: Column) -> Column:
    """absent (a null column), null, boolean, number, string, array or object, of a VARIANT."""
    kinds = {"": "absent", "VOID": "null", "BOOLEAN": "boolean", "STRING": "string", "ARRAY": "array", "OBJECT": "object"}
    known = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.regexp_extract(F.coalesce(F.schema_of_variant(value), F.lit("")), "^[A-Z]*", 0)), F.lit("number"))


def _is_kind(value: Column, want: str) -> Column:
    """Whether :func:`kind` says ``want``, of which a schema is made of simple values only: that of an array or an object would
    be made of all that lies in it."""
    inside = {"array": "array<variant>", "object": "map<string,variant>"}
    if want in inside:
        return F.try_variant_get(value, "$", inside[want]).isNotNull()
    return F.coalesce(F.schema_of_variant(value) == want.upper(), F.lit(False))


def field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def safe_integer(value: Column) -> Column:
    """A VARIANT as a long, if it is a number that JavaScript holds exactly as an integer."""
    number = F.when(~F.schema_of_variant(value).isin("VOID", "BOOLEAN", "STRING"), F.try_variant_get(value, "$", "double"))
    return _let(number, lambda n: F.when((n == F.floor(n)) & (F.abs(n) <= SAFE), n.cast("long")))


def _is(value: Column, want) -> Column:
    if isinstance(want, tuple):
        return F.coalesce(F.when(_is_kind(value, "string"), F.try_variant_get(value, "$", "string")).isin(*want), F.lit(False))
    return safe_integer(value).isNotNull() if want == "integer" else _is_kind(value, want)


def fault(text: Column, rules: dict) -> Column:
    """``broken`` (no JSON), ``no-object``, or the first field of ``rules`` that isn't there or is of another kind; null where
    all are as they should be."""
    return F.when(text.isNull(), "broken").otherwise(_let(parsed(text), lambda value: _fault_of(value, rules)))


def _fault_of(value: Column, rules: dict) -> Column:
    found = F.when(value.isNull(), "broken").when(~_is_kind(value, "object"), "no-object")
    for name, want in rules.items():
        found = found.when(~_is(field(value, name), want), name)
    return found


def unknown_keys(text: Column, rules: dict) -> Column:
    """Keys of an object that ``rules`` don't name, sorted."""
    keys = F.json_object_keys(F.to_json(parsed(text)))
    return F.coalesce(F.array_sort(F.array_except(keys, F.array(*[F.lit(k) for k in rules]))), F.array().cast("array<string>"))


def _range_fits(value: Column, most: Column, empty: bool) -> Column:
    ordered = lambda r: (r["start"] >= 0) & (r["end"] >= r["start"] if empty else r["end"] > r["start"]) & (r["end"] <= most)

    def of(v: Column) -> Column:
        ends = F.struct(safe_integer(field(v, "startByte")).alias("start"), safe_integer(field(v, "endByte")).alias("end"))
        return _is(field(v, "offsetUnit"), (UNIT,)) & _let(ends, ordered)

    return F.coalesce(_let(value, of), F.lit(False))


def _chapter_fits(chapter: Column, most: Column) -> Column:
    named = lambda name: _is_kind(field(chapter, name), "string") & ~F.coalesce(F.try_variant_get(chapter, f"$.{name}", "string").rlike(r"^[\s 　﻿]*\z"), F.lit(False))
    absent = lambda name: field(chapter, name).isNull()
    return (
        _is_kind(chapter, "object") & named("chapterId") & named("title") & safe_integer(field(chapter, "order")).isNotNull()
        & _is(field(chapter, "reviewStatus"), ("pending", "approved", "rejected"))
        & (absent("headingKind") | _is(field(chapter, "headingKind"), ("source", "missing")))
        & (absent("lengthAnomalyAccepted") | _is_kind(field(chapter, "lengthAnomalyAccepted"), "boolean"))
        & (absent("headingRange") | _range_fits(field(chapter, "headingRange"), most, False)) & _range_fits(field(chapter, "contentRange"), most, True)
    )


def preview_fault(text: Column) -> Column:
    return fault(text, PREVIEW)


def same_preview(stored: Column, expected: Column) -> Column:
    """Whether a stored preview says exactly what is expected, whatever the order of its keys."""
    return F.coalesce(preview_fault(stored).isNull() & (canonical(stored) == canonical(expected)), F.lit(False))


def snapshot_fault(text: Column) -> Column:
    """As :func:`fault`, and ``chapter-N`` for the first chapter (from 0) that isn't valid in a snapshot that else is."""

    def of(value: Column) -> Column:
        fit = lambda c, most: F.coalesce(_chapter_fits(c, most), F.lit(False))
        chapters = F.try_variant_get(value, "$.chapters", "array<variant>")
        bad = _let(safe_integer(field(value, "textByteLength")), lambda most: F.array_position(F.transform(chapters, lambda c: fit(c, most)), F.lit(False)))
        return F.coalesce(_fault_of(value, SNAPSHOT), _let(bad, lambda n: F.when(n > 0, F.concat(F.lit("chapter-"), (n - 1).cast("string")))))

    return F.when(text.isNull(), "broken").otherwise(_let(parsed(text), of))
