"""Mixing sources to target weights: hierarchical budgeting.

The documents' leaves form a tree domain > language > source. A token budget goes down the tree:
at each node the children share it by weight, a child takes no more than its subtree can give
(its tokens times the epochs allowed), and what it can't take goes to its siblings by their
weights; only when all of them are full does it reach the node above. A leaf then gives its
documents in epochs, each in its own seeded order: full epochs first, of the last one the longest
prefix whose tokens fit.

Tokens are words. Null domains, languages and sources are leaves of their own, named ``unknown``.
Documents without words are never selected. Rows of one doc_id stand together in the order, by a hash of
their texts; rows that repeat both are selected one by one, so no leaf gives more than its budget. Rows without
doc_id are placed by their texts. Other columns are carried along, but for mix_domain, mix_epoch and mix_tokens.

No order is ever held in one task: tokens are summed by leaf and the first three digits of the
seeded key, and only the bucket in which a leaf's budget ends, 1/4096 of the leaf, is sorted.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chaptermill.llm.common import WORD, written

LEVELS = ["domain", "lang", "source"]
#: Leaves up to this number are sent to every task (about 100 bytes each); beyond, they are joined.
LEAVES_TO_SEND = 50_000
#: Stands for no doc_id where rows are ordered.
LOWEST = -(1 << 63)


@dataclass(frozen=True)
class Mix:
    """Weights are positive whole numbers by name at each level; what isn't named weighs ``other``."""

    share: tuple[int, int] = (1, 2)  # of all tokens
    epochs: int = 2
    seed: int = 17
    other: int = 1
    weights: dict[str, dict[str, int]] = field(
        default_factory=lambda: {"domain": {"web": 4, "books": 3, "forum": 2}, "lang": {"en": 4, "de": 2, "es": 2, "fr": 2}, "source": {"src1": 3, "src2": 2}}
    )


def domain_of(source: Column) -> Column:
    return F.when(source == "src0", "web").when(source.rlike("^src[0-9]*[02468]$"), "books").when(source.rlike("^src[0-9]*[13579]$"), "forum")


def leaf_columns(docs: DataFrame, domain: Column | None = None) -> dict[str, Column]:
    columns = {"domain": domain if domain is not None else domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
    return {k: F.coalesce(c, F.lit("unknown")) for k, c in columns.items()}


def _weight(level: str, mix: Mix) -> Column:
    named = mix.weights.get(level, {})
    found = F.lit(None).cast("bigint")
    for name, w in sorted(named.items()):
        found = F.when(F.col(level) == name, F.lit(w).cast("bigint")).otherwise(found)
    return F.coalesce(found, F.lit(mix.other).cast("bigint"))


def _shared(children: DataFrame, parent: list[str], level: str) -> DataFrame:
    """``children`` (with budget of the parent, cap and w) with ``give``: their shares of the budget."""
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("w"), level)
    all_of = Window.partitionBy(*parent)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight_on = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    full = children.withColumn("full", F.col("cap") * weight_on <= F.col("w") * (F.col("budget") - before))
    left = F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(all_of)
    open_weight = F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(all_of)
    give = full.withColumn("left", left).withColumn("open", F.greatest(open_weight, F.lit(1)))
    return give.withColumn("give", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("(left * w) div open"))).drop("full", "left", "open")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens) with ``give``, the tokens each leaf is to give."""
    capped = leaves.withColumn("cap", F.col("tokens") * mix.epochs)
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all")).select(F.expr(f"(all * {mix.share[0]}) div {mix.share[1]}").alias("budget"), F.lit(1).alias("one"))
    top = capped.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("w", _weight("domain", mix)).withColumn("one", F.lit(1)).join(total, "one")
    top = _shared(top, ["one"], "domain").select("domain", F.col("give").alias("budget"))
    middle = capped.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).withColumn("w", _weight("lang", mix)).join(top, "domain")
    middle = _shared(middle, ["domain"], "lang").select("domain", "lang", F.col("give").alias("budget"))
    low = capped.withColumn("w", _weight("source", mix)).join(middle, ["domain", "lang"])
    return _shared(low, ["domain", "lang"], "source").select(*LEVELS, "tokens", "give")


def _seeded(mix: Mix, whole: Column, doc_id: Column, place: Column) -> Column:
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), place.cast("string")))
    return F.md5(F.concat_ws(":", F.lit(str(mix.seed)), whole.cast("string"), name).cast("binary"))


def plan(docs: DataFrame, mix: Mix, domain: Column | None = None) -> DataFrame:
    """One row a leaf: whole (full epochs), cut (the seeded key, doc_id and text hash up to which rows are in the next
    epoch), and part (the key, doc_id and text hash of repeated rows of which the next epoch has n)."""
    leaf = leaf_columns(docs, domain)
    tokens = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint")
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("place"), *[c.alias(k) for k, c in leaf.items()], tokens.alias("n_tokens"))
    base = written(base.filter("n_tokens > 0"), "mix-tokens")
    given = written(budgets(base.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), mix), "mix-budgets")
    leaves = given.select(*LEVELS, "tokens", "give", F.expr("give div tokens").alias("whole"), F.expr("give % tokens").alias("rest"))
    keyed = with_leaves(base, leaves).withColumn("key", _seeded(mix, F.col("whole"), F.col("doc_id"), F.col("place"))).withColumn("bucket", F.substring("key", 1, 3))
    order = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = keyed.groupBy(*LEVELS, "bucket", "rest").agg(F.sum("n_tokens").alias("n")).withColumn("upto", F.sum("n").over(order))
    # The first bucket that doesn't fit whole; a leaf whose buckets all fit has none.
    ends = sums.filter("upto > rest").groupBy(*LEVELS).agg(F.min(F.struct("bucket", (F.col("rest") - (F.col("upto") - F.col("n"))).alias("room"))).alias("end"))
    ends = ends.select(*LEVELS, F.col("end.bucket").alias("bucket"), F.col("end.room").alias("room"))
    row = F.struct("key", F.coalesce("doc_id", F.lit(LOWEST)).alias("doc_id"), "place").alias("row")
    last = keyed.join(ends, [*LEVELS, "bucket"]).groupBy(*LEVELS, "room", row).agg(F.max("n_tokens").alias("one"), F.sum("n_tokens").alias("n"))
    within = Window.partitionBy(*LEVELS).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    left = F.col("room") - (F.col("sum") - F.col("n"))
    placed = last.withColumn("sum", F.sum("n").over(within)).withColumn("times", F.when((left > 0) & (left < F.col("n")), F.floor(left / F.col("one"))))
    cuts = placed.groupBy(*LEVELS).agg(F.max(F.when(F.col("sum") <= F.col("room"), F.col("row"))).alias("cut"), F.max(F.when(F.col("times") > 0, F.struct("row", "times"))).alias("part"))
    start = F.struct(F.coalesce("bucket", F.lit("")).alias("key"), F.lit(LOWEST).alias("doc_id"), F.lit(LOWEST).alias("place"))
    return leaves.join(ends, LEVELS, "left").join(cuts, LEVELS, "left").select(*LEVELS, "whole", F.coalesce("cut", start).alias("cut"), "part")


def with_leaves(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """``rows`` joined to their leaves. The leaves are sent to all tasks while they are few."""
    few = leaves.limit(LEAVES_TO_SEND + 1).count() <= LEAVES_TO_SEND
    return rows.join(F.broadcast(leaves) if few else leaves, LEVELS)


def select(docs: DataFrame, mix: Mix = Mix(), domain: Column | None = None) -> DataFrame:
    """``docs`` rows once for each epoch they are selected in, with mix_domain, mix_epoch and mix_tokens."""
    own = [c for c in docs.columns if c not in ("mix_domain", "mix_epoch", "mix_tokens")]
    docs = docs.select(*own)
    leaves = written(plan(docs, mix, domain), "mix-plan")
    names = {k: f"_mix_{k}" for k in LEVELS}
    renamed = leaves.select(*[F.col(k).alias(n) for k, n in names.items()], F.col("whole").alias("_whole"), F.col("cut").alias("_cut"), F.col("part").alias("_part"))
    few = leaves.limit(LEAVES_TO_SEND + 1).count() <= LEAVES_TO_SEND
    clash = docs.select(F.struct(*own).alias("_doc"), *[c.alias(names[k]) for k, c in leaf_columns(docs, domain).items()], F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint").alias("mix_tokens"))
    joined = clash.filter("mix_tokens > 0").join(F.broadcast(renamed) if few else renamed, list(names.values()))
    doc_id, place = F.col("_doc.doc_id").cast("bigint"), F.xxhash64("_doc.text")
    row = F.struct(_seeded(mix, F.col("_whole"), doc_id, place).alias("key"), F.coalesce(doc_id, F.lit(LOWEST)).alias("doc_id"), place.alias("place"))
    joined = joined.withColumn("_row", row).withColumn("_n", F.col("_whole") + (F.col("_row") <= F.col("_cut")).cast("int"))
    if not leaves.filter("part IS NOT NULL").isEmpty():
        # Of rows that repeat doc_id and text only some fit; only those rows are numbered.
        repeated = F.coalesce(F.col("_row") == F.col("_part.row"), F.lit(False))
        some = joined.filter(repeated).withColumn("_at", F.row_number().over(Window.partitionBy(*names.values()).orderBy("_row")))
        joined = joined.filter(~repeated).unionByName(some.withColumn("_n", F.col("_n") + (F.col("_at") <= F.col("_part.times")).cast("int")).drop("_at"))
    chosen = joined.filter("_n > 0").withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int"))))
    return chosen.select("_doc.*", F.col(names["domain"]).alias("mix_domain"), "mix_epoch", "mix_tokens")


def selection(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    chosen = select(docs.select("doc_id", "text", "lang", "source"), mix)
    return chosen.select("doc_id", F.col("mix_epoch").alias("epoch"), F.col("mix_domain").alias("domain"), F.coalesce("lang", F.lit("unknown")).alias("lang"), F.coalesce("source", F.lit("unknown")).alias("source"), F.col("mix_tokens").alias("n_tokens"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
    CASE WHEN source = 'src0' THEN 'web' WHEN regexp_matches(source, '^src[0-9]*[02468]$') THEN 'books'
      WHEN regexp_matches(source, '^src[0-9]*[13579]$') THEN 'forum' ELSE 'unknown' END AS domain,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens
  FROM documents
), b AS (SELECT * FROM d WHERE n_tokens > 0),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(2 * sum(n_tokens) AS BIGINT) AS cap FROM b GROUP BY ALL),
d1 AS (
  SELECT domain, CAST(sum(cap) AS BIGINT) AS cap, CASE domain WHEN 'web' THEN 4 WHEN 'books' THEN 3 WHEN 'forum' THEN 2 ELSE 1 END AS w,
    (SELECT CAST(sum(tokens) AS BIGINT) // 2 FROM leaf) AS budget FROM leaf GROUP BY domain
), d2 AS (
  SELECT *, cap * sum(w) OVER (ORDER BY cap / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= w * (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS filled FROM d1
), d3 AS (
  SELECT domain, CAST(CASE WHEN filled THEN cap ELSE (budget - coalesce(sum(cap) FILTER (filled) OVER (), 0)) * w
    // greatest(coalesce(sum(w) FILTER (NOT filled) OVER (), 0), 1) END AS BIGINT) AS budget FROM d2
), l1 AS (
  SELECT leaf.domain, lang, CAST(sum(cap) AS BIGINT) AS cap, CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'es' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS w,
    any_value(budget) AS budget FROM leaf JOIN d3 ON d3.domain = leaf.domain GROUP BY leaf.domain, lang
), l2 AS (
  SELECT *, cap * sum(w) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= w * (budget - coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS filled FROM l1
), l3 AS (
  SELECT domain, lang, CAST(CASE WHEN filled THEN cap ELSE (budget - coalesce(sum(cap) FILTER (filled) OVER p, 0)) * w
    // greatest(coalesce(sum(w) FILTER (NOT filled) OVER p, 0), 1) END AS BIGINT) AS budget FROM l2 WINDOW p AS (PARTITION BY domain)
), s1 AS (
  SELECT leaf.*, CASE source WHEN 'src1' THEN 3 WHEN 'src2' THEN 2 ELSE 1 END AS w, budget
  FROM leaf JOIN l3 ON l3.domain = leaf.domain AND l3.lang = leaf.lang
), s2 AS (
  SELECT *, cap * sum(w) OVER (PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= w * (budget - coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS filled FROM s1
), s3 AS (
  SELECT domain, lang, source, tokens, CAST(CASE WHEN filled THEN cap ELSE (budget - coalesce(sum(cap) FILTER (filled) OVER p, 0)) * w
    // greatest(coalesce(sum(w) FILTER (NOT filled) OVER p, 0), 1) END AS BIGINT) AS give FROM s2 WINDOW p AS (PARTITION BY domain, lang)
), k AS (
  SELECT b.*, give // tokens AS whole, give % tokens AS rest, md5('17:' || (give // tokens) || ':' || doc_id) AS key
  FROM b JOIN s3 ON s3.domain = b.domain AND s3.lang = b.lang AND s3.source = b.source
), c AS (
  SELECT *, whole + CASE WHEN sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END AS copies FROM k
)
SELECT doc_id, CAST(e AS INTEGER) AS epoch, domain, lang, source, n_tokens FROM c, unnest(range(0, CAST(copies AS BIGINT))) AS u(e)
"""
