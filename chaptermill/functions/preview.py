"""Paged previews of encoded text: pages end at line ends, never inside a line break or a character."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from chaptermill.functions.encoding import _CODEC
from chaptermill.functions.text import PREVIEW_BYTES, PREVIEW_LINES, normalize

# Bytes that may be given up to end at a character, lines shown where a viewport has no height.
LOOK_AHEAD, FALLBACK_LINES = 4, 50

_PAGE = StructType([StructField("text", StringType()), StructField("end_byte", LongType()), StructField("done", BooleanType()), StructField("error", StringType())])


def _line_breaks(data: bytes, encoding: str, most: int):
    """Ends of the line breaks that lie within ``most`` bytes, in order."""
    unit = 2 if encoding.startswith("utf-16") else 1
    order = "big" if encoding == "utf-16be" else "little"
    at = 0
    while at + unit <= most:
        code = int.from_bytes(data[at : at + unit], order)
        at += unit
        if code == 13 and int.from_bytes(data[at : at + unit], order) == 10 and len(data) >= at + unit:
            if at + unit > most:
                return
            at += unit
            yield at
        elif code in (10, 13):
            yield at


def page_of(data: bytes, encoding: str, start: int, lines: int, cap: int = PREVIEW_BYTES):
    """(text, end_byte, done, error) of ``lines`` lines from ``start``, or of what fits in ``cap`` bytes."""
    total = len(data)
    if encoding not in _CODEC or not 0 <= start <= total or not 1 <= lines <= PREVIEW_LINES or (encoding.startswith("utf-16") and start % 2):
        return None, None, None, "invalid-request"
    rest = data[start : start + cap + LOOK_AHEAD]
    most = min(cap, total - start)
    if not most:
        return "", start, True, None
    end = None
    for number, at in enumerate(_line_breaks(rest, encoding, most), 1):
        if number == lines:
            end = at
            break
    if end is None:
        unit = 2 if encoding.startswith("utf-16") else 1
        order = "big" if encoding == "utf-16be" else "little"
        end = most - most % unit
        if end >= unit and int.from_bytes(rest[end - unit : end], order) == 13 and int.from_bytes(rest[end : end + unit], order) == 10 and len(rest) >= end + unit:
            end -= unit
    for shorter in range(end, max(end - LOOK_AHEAD, 1) - 1, -1):
        try:
            text = rest[:shorter].decode(_CODEC[encoding], "strict")
        except UnicodeDecodeError:
            continue
        if start == 0 and encoding.startswith("utf") and text[:1] == "﻿":
            text = text[1:]
        if "\0" in text:
            return None, None, None, "binary-nul"
        return text, start + shorter, start + shorter == total, None
    return None, None, None, "decode-failed"


@F.pandas_udf(_PAGE)
def _page(data: pd.Series, encoding: pd.Series, start: pd.Series, lines: pd.Series, cap: pd.Series) -> pd.DataFrame:
    rows = [page_of(bytes(d or b""), e, int(s), int(n), int(c)) for d, e, s, n, c in zip(data, encoding, start, lines, cap, strict=True)]
    return pd.DataFrame(rows, columns=["text", "end_byte", "done", "error"]).astype({"end_byte": "Int64", "done": "boolean", "text": "object", "error": "object"})


def source_page(data: Column, encoding: Column, start: Column, lines: Column, cap: int = PREVIEW_BYTES) -> Column:
    """struct(text, end_byte, done, error), the text with normalized line ends."""
    page = _page(data, encoding, start.cast("long"), lines.cast("long"), F.lit(cap).cast("long"))
    return F.struct(normalize(page["text"]).alias("text"), page["end_byte"].alias("end_byte"), page["done"].alias("done"), page["error"].alias("error"))


def visible_lines(height: Column, line_height: Column) -> Column:
    measured = F.when(height > 0, height).otherwise(FALLBACK_LINES * line_height)
    return F.greatest(F.lit(1), F.ceil(measured / line_height)).cast("long")


def first_lines(visible: Column) -> Column:
    """Lines of the first page: two viewports."""
    return F.least(F.lit(PREVIEW_LINES), visible * 2)


def next_lines(visible: Column, scrolled: Column, line_height: Column) -> Column:
    """Lines of the next page: more after a fast scroll, from two to eight viewports."""
    asked = F.greatest(visible * 2, visible + 2 * F.ceil(F.abs(scrolled) / line_height))
    return F.least(F.lit(PREVIEW_LINES), F.greatest(visible * 2, F.least(visible * 8, asked))).cast("long")


def should_fetch(scroll_height: Column, scroll_top: Column, viewport: Column) -> Column:
    """Whether less than half a viewport is left below."""
    return scroll_height - scroll_top - viewport <= F.ceil(viewport / 2)


def joined_pages(pages: DataFrame, key: list[str]) -> DataFrame:
    """Pages (key, start_byte, end_byte, text, done) put together: text, end_byte and whether they follow one
    another without gap from 0 to a done one."""
    ordered = F.sort_array(F.collect_list(F.struct("start_byte", "end_byte", "text", "done")))
    whole = pages.groupBy(*key).agg(ordered.alias("p"))
    follows = F.forall(F.sequence(F.lit(0), F.size("p") - 1), lambda i: F.get("p", i)["start_byte"] == F.coalesce(F.get("p", i - 1)["end_byte"], F.lit(0)))
    return whole.select(*key, F.array_join("p.text", "").alias("text"), F.element_at("p", -1)["end_byte"].alias("end_byte"), (follows & F.element_at("p", -1)["done"]).alias("complete"))
