"""Document fingerprints by SimHash.

A text's terms are its runs of five words (A-Z lower-cased; the whole sequence where it has
fewer), weighted by how often they occur. Each term's 64-bit hash votes on every bit of the
fingerprint, for 1 or against it, with the term's weight. The votes are counted as ordinary
sums: two 32-bit lanes to a long, so 32 sums carry all 64 bits through one partial aggregate.

All fingerprints within a Hamming radius are found through permuted block tables: the 64 bits are
cut into ``radius + spare`` blocks; for two fingerprints at most ``radius`` apart, ``spare``
blocks at least agree, so each choice of ``spare`` blocks is the key of one table.

Null and empty texts, and texts without words, have the fingerprint of no votes, all zeros.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chaptermill.llm.common import let, lower_ascii, words, written

WORDS = 5


def term_hashes(text: Column) -> Column:
    def of_words(w: Column) -> Column:
        n = F.size(w)
        runs = F.transform(F.sequence(F.lit(1), n - (WORDS - 1)), lambda i: F.xxhash64(F.slice(w, i, WORDS)))
        return F.when(n == 0, F.array().cast("array<bigint>")).when(n <= WORDS, F.array(F.xxhash64(w))).otherwise(runs)

    return let(words(lower_ascii(text)), of_words)


def fingerprints(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """``key`` columns and ``bits``, the 64-bit fingerprint, one row for each distinct key."""
    lanes = F.lit(0x0000000100000001)
    terms = texts.select(*key, F.explode_outer(term_hashes(F.col(text))).alias("h"))
    sums = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(lanes)).alias(f"v{k}") for k in range(32)]
    voted = terms.groupBy(*key).agg(F.count("h").alias("n"), *sums)
    bits = F.lit(0).cast("bigint")
    for k in range(32):
        low, high = F.col(f"v{k}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"v{k}", 32)
        bits = bits.bitwiseOR(F.when(2 * low > F.col("n"), F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint"))
        top = 1 << (k + 32)
        bits = bits.bitwiseOR(F.when(2 * high > F.col("n"), F.lit(top if k < 31 else -(1 << 63))).otherwise(F.lit(0)).cast("bigint"))
    return voted.select(*key, bits.alias("bits"))


def as_text(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """1 less the share of bits that differ."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def block_keys(bits: Column, radius: int, spare: int = 3) -> Column:
    """(table, key) for every permuted block table."""
    n = radius + spare
    cuts = [64 * i // n for i in range(n + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(n), spare)):
        mask = sum((1 << cuts[i + 1]) - (1 << cuts[i]) for i in chosen)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.struct(F.lit(number).alias("t"), bits.bitwiseAND(F.lit(signed).cast("bigint")).alias("k")))
    return F.array(*keys)


def near(queries: DataFrame, prints: DataFrame, radius: int = 3) -> DataFrame:
    """For each row (doc_id, bits) of ``queries``: (query_id, bits, distance) for every distinct
    fingerprint of ``prints`` within ``radius``. Distinct fingerprints stand for all their documents,
    so copies aren't expanded into pairs."""
    q = queries.select(F.col("doc_id").alias("query_id"), F.col("bits").alias("query_bits"), F.explode(block_keys(F.col("bits"), radius)).alias("b"))
    p = prints.select("bits").distinct().select("bits", F.explode(block_keys(F.col("bits"), radius)).alias("b"))
    distance = F.bit_count(F.col("query_bits").bitwiseXOR(F.col("bits")))
    # Both sides grow with the data by the number of tables, which their sizes before don't tell: merge them.
    return q.join(p.hint("merge"), "b").filter(distance <= radius).select("query_id", "bits", distance.alias("distance")).distinct()


def near_documents(prints: DataFrame, radius: int = 3) -> DataFrame:
    """query_id and near_documents: how many other documents have a fingerprint within ``radius``, for every
    document whose doc_id is divisible by 50, against all of ``prints`` (doc_id, bits)."""
    queries = prints.filter("doc_id % 50 = 0").select("doc_id", "bits").distinct()
    shared = prints.groupBy("bits").agg(F.countDistinct("doc_id").alias("n"))
    return near(queries, prints, radius).join(shared, "bits").groupBy("query_id").agg((F.sum("n") - 1).alias("near_documents"))


def following(ids: DataFrame) -> DataFrame:
    """doc_id and next_id: the next lower doc_id, after the lowest the highest. The ids are range
    partitioned, so no task sees them all; only one row a partition goes through a single task."""
    placed = written(ids.select("doc_id").filter("doc_id IS NOT NULL").distinct().repartitionByRange(F.desc("doc_id")).withColumn("part", F.spark_partition_id()), "simhash-order")
    within = placed.withColumn("lower", F.lead("doc_id").over(Window.partitionBy("part").orderBy(F.desc("doc_id"))))
    heads = placed.groupBy("part").agg(F.max("doc_id").alias("head"))
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("part", F.coalesce(F.lead("head").over(Window.orderBy("part")), F.max("head").over(every)).alias("head"))
    return within.join(heads, "part").select("doc_id", F.coalesce("lower", "head").alias("next_id"))


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_chars, next_id and edited: the last third of the text replaced by as much of the
    start of the next document, in falling order of doc_id. Texts are shuffled once by doc_id; only
    the starts that are asked for, a third of the text, move again."""
    texts = docs.filter("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sizes = docs.groupBy("doc_id").agg(F.max(F.length(F.coalesce("text", F.lit("")))).alias("n"))
    wanted = following(docs).join(sizes, "doc_id").select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("for_id"), F.floor(F.col("n") / 3).cast("int").alias("third"))
    heads = texts.join(wanted, "doc_id").select(F.col("for_id").alias("doc_id"), F.col("doc_id").alias("next_id"), F.expr("left(text, third)").alias("head"))
    rest = F.expr("left(text, CAST(length(text) - floor(length(text) / 3) AS INT))")
    changed = F.concat(rest, F.expr("left(head, CAST(floor(length(text) / 3) AS INT))")).alias("edited")
    return texts.join(heads, "doc_id").select("doc_id", "text", "next_id", F.length("text").cast("long").alias("n_chars"), changed)


def digests(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and its edited text, their likeness, and how many other documents' fingerprints
    lie within three bits, for documents whose id is divisible by 50 (null for others).

    Rows that repeat a doc_id and its text count once; one doc_id with several texts gives a row for
    each and for each start of a next text; rows without a doc_id have no place in the order and
    are left out.
    """
    versions = F.explode(F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("t")), F.struct(F.lit(1).alias("v"), F.col("edited").alias("t"))))
    both = edited(docs.select("doc_id", "text")).select("doc_id", "next_id", "n_chars", F.xxhash64("text").alias("place"), F.unhex(F.sha2("edited", 256)).alias("sha"), versions.alias("x"))
    key = ["doc_id", "next_id", "n_chars", "place", "sha"]
    bits = fingerprints(both.select(*key, "x.v", "x.t"), [*key, "v"], "t")
    each = lambda v: F.max(F.when(F.col("v") == v, F.col("bits")))
    prints = written(bits.groupBy(*key).agg(each(0).alias("bits"), each(1).alias("edited_bits")), "simhash-prints")
    after = prints.groupBy(F.col("doc_id").alias("next_id")).agg(F.min("bits").alias("next_bits"))
    found = near_documents(prints).withColumnRenamed("query_id", "doc_id")
    return prints.join(after, "next_id").join(found, "doc_id", "left").select(
        "doc_id",
        "n_chars",
        F.lower(F.hex("sha")).alias("edited_sha256"),
        as_text(F.col("bits")).alias("fingerprint"),
        as_text(F.col("edited_bits")).alias("edited_fingerprint"),
        likeness(F.col("bits"), F.col("edited_bits")).alias("near_edited"),
        likeness(F.col("bits"), F.col("next_bits")).alias("near_next"),
        "near_documents",
    )
