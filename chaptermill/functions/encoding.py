"""Strict detection and decoding of text encodings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Byte order marks in the order they are tested, and encodings a user may choose.
BOMS = [("utf-32be", "0000FEFF"), ("utf-32le", "FFFE0000"), ("utf-8", "EFBBBF"), ("utf-16le", "FFFE"), ("utf-16be", "FEFF")]
LEGACY = ["gb2312", "gbk", "gb18030", "big5"]
CHOICES = [*LEGACY, "utf-16le", "utf-16be"]

_CODEC = {"utf-8": "utf-8", "utf-16le": "utf-16-le", "utf-16be": "utf-16-be", "gb2312": "gb2312", "gbk": "gbk", "gb18030": "gb18030", "big5": "big5"}


def bom(data: Column) -> Column:
    """The encoding that a byte order mark names; UTF-32 is tested first."""
    head = F.hex(F.substring(data, 1, 4))
    found = F.lit(None).cast("string")
    for name, mark in reversed(BOMS):
        found = F.when(head.startswith(mark), name).otherwise(found)
    return found


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and give it to ``body``."""
    return F.transform(F.array(value), body)[0]


#: Units of UTF-16 as hexadecimal digits: high bytes of high and of low surrogates.
_HIGH, _LOW = "D[89AB]", "D[C-F]"


def _rest(data: Column, unit: str) -> Column:
    """What is left of the bytes, as hexadecimal digits, once leading stretches of ``unit`` are taken off. Each match starts
    where the one before ended, so units stay aligned; stretches are bounded, so no match goes deep."""
    return F.regexp_replace(F.hex(data), rf"\G(?:{unit}){{1,256}}", "")


def _units(little: bool) -> str:
    """A character of valid UTF-16: a unit that is no surrogate, or a pair of them."""
    byte = "[0-9A-F]{2}"
    order = (lambda high: byte + high) if little else (lambda high: high + byte)
    return f"{order(f'(?!D[89A-F]){byte}')}|{order(_HIGH)}{order(_LOW)}"


def valid_utf16(data: Column, little: bool) -> Column:
    """Whether the bytes are whole units without a lone surrogate."""
    return (F.octet_length(data) % 2 == 0) & (_rest(data, _units(little)) == "")


def _utf16(data: Column, little: bool) -> Column:
    return F.when(valid_utf16(data, little), F.decode(data, "UTF-16LE" if little else "UTF-16BE"))


@F.pandas_udf(StringType())
def _legacy(data: pd.Series, encoding: pd.Series) -> pd.Series:
    """Text of ``data`` in a codec of Python's, strictly decoded; null where it can't be."""

    def one(b, name):
        if b is None or name not in LEGACY:
            return None
        try:
            return bytes(b).decode(name, "strict")
        except UnicodeDecodeError:
            return None

    return pd.Series([one(b, n) for b, n in zip(data, encoding, strict=True)], dtype="object")


def decode_unicode(data: Column, encoding: Column) -> Column:
    """As :func:`decode`, of UTF-8 and UTF-16 only, by built-in functions."""
    text = (
        F.when(encoding == "utf-8", F.when(F.is_valid_utf8(data.cast("string")), data.cast("string")))
        .when(encoding == "utf-16le", _utf16(data, True)).when(encoding == "utf-16be", _utf16(data, False))
    )
    return F.regexp_replace(text, "^\ufeff", "")


def decode(data: Column, encoding: Column) -> Column:
    """Text of ``data``, strictly decoded, without a leading byte order mark; null where it can't be. Python gets the bytes of
    legacy encodings only."""
    old = encoding.isin(*LEGACY)
    return F.when(old, _legacy(F.when(old, data), encoding)).otherwise(decode_unicode(data, encoding))


def plausible_utf16(data: Column) -> Column:
    """Even length, NULs at one parity only, and a strict decoding without NUL."""
    byte = "[0-9A-F]{2}"
    first, second = _rest(data, f"(?!00){byte}{byte}") != "", _rest(data, f"{byte}(?!00){byte}") != ""
    shaped = (F.octet_length(data) > 0) & (F.octet_length(data) % 2 == 0)
    plain = lambda text: ~F.contains(text, F.lit("\0")) & ~text.isin("", "\ufeff")
    by_parity = lambda nul: F.when(nul["first"] != nul["second"], _let(F.when(nul["second"], _utf16(data, True)).otherwise(_utf16(data, False)), plain))
    return F.coalesce(F.when(shaped, _let(F.struct(first.alias("first"), second.alias("second")), by_parity)), F.lit(False))


def probe(data: Column) -> Column:
    """struct(status, encoding, method, reason): confirmed, rejected or selection-required."""
    mark = bom(data)
    by_mark = F.when(mark == "utf-8", data).otherwise(F.lit(None))
    valid = F.is_valid_utf8(data.cast("string"))
    wide = decode_unicode(F.when(mark.isin("utf-16le", "utf-16be"), data), mark)
    text = F.when(mark == "utf-8", F.when(valid, F.regexp_replace(by_mark.cast("string"), "^\ufeff", ""))).otherwise(wide)
    say = lambda status, encoding=None, method=None, reason=None: F.struct(
        *[F.lit(v).cast("string").alias(k) if not isinstance(v, Column) else v.alias(k) for k, v in (("status", status), ("encoding", encoding), ("method", method), ("reason", reason))]
    )
    has_nul = F.contains(data, F.lit(bytearray(b"\0")))
    marked = lambda text: (
        F.when(text.isNull(), say("rejected", reason="decode-failed")).when(text == "", say("rejected", reason="empty"))
        .when(F.contains(text, F.lit("\0")), say("rejected", reason="binary-nul")).otherwise(say("confirmed", mark, "bom"))
    )
    return (
        F.when(F.octet_length(data) == 0, say("rejected", reason="empty"))
        .when(mark.startswith("utf-32"), say("rejected", reason="utf-32"))
        .when(mark.isNotNull(), _let(text, marked))
        .when(~valid, say("selection-required"))
        .when(~has_nul, say("confirmed", "utf-8", "strict-utf8"))
        .when(plausible_utf16(data), say("selection-required"))
        .otherwise(say("rejected", reason="binary-nul"))
    )


def decode_choice(data: Column, choice: Column, chosen_hash: Column) -> Column:
    """struct(text, encoding, method, error): decoded as probed, or as chosen for exactly this data."""
    bound = F.coalesce(chosen_hash == F.sha2(data, 256), F.lit(False))
    old = choice.isin(*LEGACY)

    def decoded(x: Column) -> Column:
        encoding = F.coalesce(choice, x["found"]["encoding"])
        text = F.when(old, x["old"]).otherwise(decode_unicode(data, encoding))
        return _let(F.struct(x["found"].alias("found"), encoding.alias("encoding"), text.alias("text")), judged)

    def judged(x: Column) -> Column:
        found, text = x["found"], x["text"]
        error = (
            F.when(choice.isNotNull() & ~bound, "source-changed")
            .when(choice.isNotNull() & ~choice.isin([*CHOICES, "utf-8"]), "encoding-not-allowed")
            .when((found["status"] == "rejected") & (choice.isNull() | found["reason"].isin("empty", "utf-32")), found["reason"])
            .when(choice.isNull() & (found["status"] == "selection-required"), "selection-required")
            .when(text.isNull(), "decode-failed").when(text == "", "empty").when(F.contains(text, F.lit("\0")), "binary-nul")
        )
        method = F.when(choice.isNotNull() & ~F.coalesce(choice == found["encoding"], F.lit(False)), "user").otherwise(found["method"])
        done = lambda e: F.struct(F.when(e.isNull(), text).alias("text"), F.when(e.isNull(), x["encoding"]).alias("encoding"), F.when(e.isNull(), method).alias("method"), e.alias("error"))
        return _let(error, done)

    return _let(F.struct(probe(data).alias("found"), _legacy(F.when(old, data), choice).alias("old")), decoded)
