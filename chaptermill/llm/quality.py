"""Quality rules as a short-circuit cascade.

Base statistics are taken from every whole text. Further rules form a cascade: a sample gives
each rule's share of rejections and its cost (the characters or words it visits, times a weight),
and the rules run in falling order of rejections per cost, each only where all before it passed.
The order changes the work, never the verdict. Everything is DataFrame functions inside one
projection of the scan, so a document never leaves its partition.

Null and empty texts have no words and fail the base rule. Repeated rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chaptermill.llm.common import GAP, let, words

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
#: Share of rows that the cost and selectivity of the rules are estimated on.
SAMPLE_SHARE = 0.01

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a condition on the text and the base statistics; ``cost`` what it visits."""

    name: str
    rejects: Callable[[Column], Column]
    cost: Callable[[Column], Column]


def _chars(weight: float) -> Callable[[Column], Column]:
    return lambda text: F.length(text) * weight


def _fixed(text: Column) -> Column:
    return F.lit(1.0)


def _upper_share(text: Column) -> Column:
    upper = F.regexp_count(text, F.lit(r"\p{Lu}"))
    return 2 * upper > F.col("word_chars")


def stutters(text: Column) -> Column:
    """Words equal to the word before them."""
    return let(words(text), lambda w: F.size(F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.coalesce(F.get(w, i) == F.get(w, i - 1), F.lit(False)))))


RULES = [
    Rule("symbols", lambda t: 10 * F.col("n_symbols") > F.col("n_words") + 20, _fixed),
    Rule("long_words", lambda t: F.col("word_chars") > 20 * F.col("n_words"), _fixed),
    Rule("short_words", lambda t: F.col("word_chars") < 2 * F.col("n_words"), _fixed),
    Rule("repeated_lines", lambda t: 2 * F.col("n_dup_lines") > F.regexp_count(t, F.lit(r"\n")) + 1, _chars(0.5)),
    Rule("shouting", _upper_share, _chars(1.0)),
    Rule("stuttering", lambda t: 3 * stutters(t) > F.col("n_words"), _chars(4.0)),
    Rule("exclaiming", lambda t: 3 * F.regexp_count(t, F.lit("!!")) > F.col("n_words"), _chars(0.8)),
]


def _covered(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more."""

    def of_sorted(s: Column) -> Column:
        twice = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda j: F.coalesce(F.get(s, j)["h"] == F.get(s, j - 1)["h"], F.lit(False)) | F.coalesce(F.get(s, j)["h"] == F.get(s, j + 1)["h"], F.lit(False)),
        )
        at = F.sort_array(F.transform(twice, lambda j: F.get(s, j)["i"]))
        return let(
            at,
            lambda p: F.aggregate(
                F.sequence(F.lit(0), F.size(p) - 1),
                F.lit(0),
                lambda total, k: total + F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - F.get(p, k), F.lit(WINDOW))),
            ),
        )

    pairs = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return let(pairs, of_sorted)


def repeated_words(w: Column) -> Column:
    """Words that lie in 8-word windows found twice or more in the text, the first one included."""

    def of_hashes(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h))

    windows = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(let(windows, of_hashes))


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda kept: F.size(kept) - F.size(F.array_distinct(kept)))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base statistics of every whole text; they replace columns of those names."""
    t = F.coalesce(F.col(text), F.lit(""))
    by_words = let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("again")))
    own = [c for c in docs.columns if c not in (*BASE, "_by_words")]
    return docs.select(*own, by_words.alias("_by_words")).select(
        *own,
        F.col("_by_words")["n"].alias("n_words"),
        F.length(F.regexp_replace(t, GAP, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        duplicate_lines(t).cast("long").alias("n_dup_lines"),
        F.col("_by_words")["again"].alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def cascade_order(docs: DataFrame, rules: list[Rule], text: str = "text", share: float = SAMPLE_SHARE) -> list[Rule]:
    """The rules by rejections per cost on a sample; as given where the sample is empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    sample = with_statistics(docs.select(text).sample(share, seed=7), text).filter(~base_failed())
    found = sample.agg(
        F.count("*").alias("n"),
        *[F.avg(r.rejects(t).cast("double")).alias(f"rejected_{i}") for i, r in enumerate(rules)],
        *[F.avg(r.cost(t)).alias(f"cost_{i}") for i, r in enumerate(rules)],
    ).first()
    if not found["n"]:
        return list(rules)
    return [r for _, r in sorted(enumerate(rules), key=lambda x: -found[f"rejected_{x[0]}"] / max(found[f"cost_{x[0]}"], 1e-9))]


def judge(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text", share: float = SAMPLE_SHARE) -> DataFrame:
    """``docs`` with the base statistics, base_failed, kept and rejected_by (null where kept)."""
    t = F.coalesce(F.col(text), F.lit(""))
    first = F.when(base_failed(), F.lit("base"))
    for rule in cascade_order(docs, rules, text, share):
        first = first.when(rule.rejects(t), F.lit(rule.name))
    judged = with_statistics(docs.drop("base_failed", "kept", "rejected_by"), text)
    return judged.withColumn("base_failed", base_failed()).withColumn("rejected_by", first).withColumn("kept", F.col("rejected_by").isNull())


def verdicts(docs: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "text")).select("doc_id", *BASE, "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns, whatever these are named."""
    packed = docs.select(F.struct(*docs.columns).alias("_document"), "text")
    return judge(packed).filter("kept").select("_document.*")


SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), grams AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM w, unnest(range(1, len(ws) - 6)) AS u(i)
), twice AS (
  SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), again AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, unnest(range(0, 8)) AS u(k) GROUP BY doc_id
), s AS (
  SELECT w.doc_id, t, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN again ON again.doc_id = w.doc_id
), b AS (
  SELECT s.*, w.ws, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s JOIN w ON w.doc_id = s.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words + 20 OR word_chars > 20 * n_words OR word_chars < 2 * n_words
    OR 2 * n_dup_lines > len(string_split(t, chr(10)))
    OR 2 * len(regexp_extract_all(t, '\p{Lu}')) > word_chars
    OR 3 * len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) > n_words
    OR 3 * len(regexp_extract_all(t, '!!')) > n_words) AS kept
FROM b
"""
