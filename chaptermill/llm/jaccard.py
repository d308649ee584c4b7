"""N-gram Jaccard join by parity sketches.

A document's set is its distinct five-word shingles (A-Z lower-cased; with fewer words the whole
sequence is one shingle). Two documents link when 100 * intersection >= 75 * union. A linked pair
of sizes n and m differs in at most (n + m) // 7 shingles, and 3 * larger <= 4 * smaller.

*Sketches.* Shingles are dealt by hash into the parts of a size band; a part's sketch is the XOR of
its shingles' 64-bit hashes, so a part in which two sets agree has one sketch in both, and each
shingle in which they differ spoils one part at most. Bands quadruple: a set is sketched in the band
of its size and, if a larger partner may lie there, in the next. Let d be the most shingles in which
it can differ from a partner in the band. Of the first d + 1 + s filled parts of two linked sets,
1 + s agree at least, wherever the spare number s is set; so when each set leaves out the s sketches
that most classes share, by one order for all, one sketch still meets (pigeonhole). Sets of up to 256
shingles keep all filled parts, larger ones ``spare_of`` more than d + 1. This holds for every size;
it needs d + 1 filled parts, which hashing gives with room of ten standard deviations and more.

*Join.* Documents with one set are one class. A sketch that no other class has is dropped, and so are
the s most shared ones; unlike texts with a passage in common leave the passage out. Each bucket
joins its members to two leaders of about their size, drawn by one order for all buckets, so a group of copies
gives few pairs a copy; sizes and 256-bit parity sketches, whose Hamming distance never exceeds the number of
shingles that differ, are compared on the spot, wide ones (four bits or more to a shingle) next, and the
sets decide. Linked classes take one root, and buckets torn between roots draw a leader by another order,
``ROUNDS`` times in all. What is torn then is decided in full: buckets of up to ``COLD`` classes by pairs
of different roots, classes of larger ones by their rarest shingles, as in prefix filtering: of sets
a <= b that link, one of the a // 7 + 1 rarest shingles of a is among the b // 4 + 1 rarest of b. There too
leaders merge what they can before pairs of different roots decide.

Sketches that fill a task's block of texts are dealt to many tasks; two of a block's rows stay behind so
that every class still learns that its sketch is shared.

Null and empty texts, and texts without words, have an empty set and are linked with nothing. Rows
that repeat a doc_id are documents of their own with one id; a row without doc_id is linked like any
other and takes the smallest doc_id of its component, null if none has one. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chaptermill.llm.common import Scratch, unused, written
from chaptermill.llm.hashing import WordHasher, mixed, runs, text_chunks

WORDS = 5
#: Classes of a torn bucket that are paired; classes of larger ones meet by rare shingles.
COLD = 16
ROUNDS = 2
#: A sketch that a block of texts has more often is dealt to so many groups of rows.
OFTEN = 16
SALTS = 1024
#: Rank of a dealt sketch: shared by more than any other.
DEALT = 1 << 40
#: Classes whose sketches a task remembers having sent, so copies in one task are sent once.
SENT = 200_000
#: Documents whose ids (24 bytes each) are broadcast rather than joined by shuffling all texts.
IDS_TO_SEND = 250_000
BITS = [f"s{i}" for i in range(4)]


def band_of(n: int) -> int:
    """The band of a set of n shingles: band b holds sizes up to 4 ** b."""
    return max((max(n - 1, 1).bit_length() + 1) // 2, 1)


def parts_of(band: int) -> int:
    top = 4**band
    return max(4096, 4 * top) if top <= 256 else top * 3 // 8


def spare_of(n: int) -> int:
    """Sketches beyond the necessary that a set of more than 256 shingles sends."""
    return 24 + n // 32


def shingle_sets(hasher: WordHasher, texts: list[bytes]):
    """The sorted distinct shingle hashes of each text."""
    import numpy as np

    words, starts = hasher.words(texts)
    shingles = runs(words, WORDS)
    for i in range(len(texts)):
        s, e = starts[i], starts[i + 1]
        if e - s >= WORDS:
            yield np.unique(shingles[s : e - WORDS + 1])
        elif e > s:
            yield mixed(np.array([mixed(words[s:e] * np.arange(3, 3 + 2 * (e - s), 2, dtype=np.uint64)).sum() + np.uint64(e - s)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def set_key(tokens) -> int:
    """A 64-bit key of a whole set."""
    import numpy as np

    total = mixed(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(mixed(np.array([total + np.uint64(len(tokens) * 0x2545F491 % (1 << 64))], np.uint64)).view(np.int64)[0])


def parity_bits(tokens, width: int = 256):
    """The parity sketch of ``width`` bits as signed 64-bit numbers; halves of a wide one XOR to the narrower."""
    import numpy as np

    odd = np.bincount((tokens & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def width_of(n: int) -> int:
    """Bits of the wide sketch of n shingles: 256, 2,048, 16,384 or 131,072."""
    return next((w for w in (256, 2048, 16384) if 4 * n <= w), 131072)


def band_sketches(tokens):
    """(sketches, spare) of one set in each of its bands: spare of the sketches may be left out. The last
    four bits of a sketch are its band."""
    import numpy as np

    n = len(tokens)
    own = band_of(n)
    out = []
    for band in (own, own + 1):
        if band > own and 4 * n <= 3 * 4**own:
            continue
        most = (n + min(4 * n // 3, 4**band)) // 7
        part = (mixed(tokens ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)) % np.uint64(parts_of(band))
        order = np.argsort(part, kind="stable")
        part, kept = part[order], tokens[order]
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        if band > 4:
            starts = starts[: most + 2 + spare_of(n)]
            ends = min(starts[-1], n) if len(starts) == most + 2 + spare_of(n) else n
            starts = starts[: most + 1 + spare_of(n)]
            kept = kept[:ends]
        sketch = mixed(np.bitwise_xor.reduceat(kept, starts) ^ mixed(part[starts] + np.uint64(band << 40)))
        out.append(((sketch & ~np.uint64(15) | np.uint64(band & 15)).view(np.int64), max(len(sketch) - most - 1, 0)))
    return out


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, place, n_shingles, key (null for empty sets), s0 to s3, the 256-bit parity sketch, and wide, the wide one."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        hasher = WordHasher()
        for batch in batches:
            sizes, keys, bits, wide = [], [], [], []
            for _, texts in text_chunks(batch.column("text")):
                for tokens in shingle_sets(hasher, texts):
                    sizes.append(len(tokens))
                    keys.append(set_key(tokens) if len(tokens) else None)
                    bits.append(parity_bits(tokens))
                    wide.append(parity_bits(tokens, width_of(len(tokens))))
            sketch = np.array(bits, np.int64).reshape(len(bits), 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("place"), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), *[pa.array(sketch[:, i]) for i in range(4)], pa.array(wide, pa.list_(pa.int64()))],
                names=["doc_id", "place", "n_shingles", "key", *BITS, "wide"],
            )

    return docs.mapInArrow(run, "doc_id long, place long, n_shingles long, key long, s0 long, s1 long, s2 long, s3 long, wide array<long>")


def sketches(docs: DataFrame) -> DataFrame:
    """sketch, key, spare and salt: every sketch of every class, at least once. Where a block of texts has a sketch
    often, its first two rows have the salt -1 and the others one drawn from their key."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        hasher = WordHasher()
        sent: set[int] = set()
        for batch in batches:
            for _, texts in text_chunks(batch.column("text")):
                if len(sent) >= SENT:
                    sent.clear()
                found, keys, spare, sizes = [], [], [], []
                for tokens in shingle_sets(hasher, texts):
                    if not len(tokens) or (key := set_key(tokens)) in sent:
                        continue
                    sent.add(key)
                    for sketch, spared in band_sketches(tokens):
                        found.append(sketch)
                        keys.append(key)
                        spare.append(spared)
                        sizes.append(len(sketch))
                if not found:
                    continue
                sketch, key = np.concatenate(found), np.repeat(np.array(keys, np.int64), sizes)
                order = np.argsort(sketch, kind="stable")
                first = np.flatnonzero(np.concatenate([[True], np.diff(sketch[order]) != 0]))
                count = np.diff(np.concatenate([first, [len(order)]]))
                at = np.arange(len(order)) - np.repeat(first, count)
                drawn = (mixed(key[order].view(np.uint64)) % np.uint64(SALTS)).astype(np.int16) + 1
                salt = np.zeros(len(order), np.int16)
                salt[order] = np.where(np.repeat(count, count) <= OFTEN, 0, np.where(at < 2, -1, drawn))
                yield pa.RecordBatch.from_arrays([pa.array(sketch), pa.array(key), pa.array(np.repeat(np.array(spare, np.int32), sizes)), pa.array(salt)], names=["sketch", "key", "spare", "salt"])

    return docs.select("text").mapInArrow(run, "sketch long, key long, spare int, salt short")


def buckets(found: DataFrame, known: DataFrame) -> DataFrame:
    """sketch, key, n, parity bits and lone of the sketches in which a class has to meet others: shared ones without
    the class's ``spare`` most shared. lone is less the more sketches of a shingle the class shares."""
    group = Window.partitionBy("sketch", F.greatest("salt", F.lit(0).cast("short")))
    counted = found.withColumns({"size": F.count("*").over(group), "several": F.min("key").over(group) != F.max("key").over(group), "dealt": F.max(F.col("salt") != 0).over(group)})
    shared = counted.filter("several OR dealt").select("sketch", "key", "spare", F.when(F.col("dealt"), F.lit(DEALT)).otherwise(F.col("size")).alias("rank"))
    hottest = Window.partitionBy("key", F.col("sketch").bitwiseAND(F.lit(15))).orderBy(F.desc("rank"), "sketch")
    facts = shared.join(known.select("key", "n", *BITS), "key").withColumn("lone", -F.count("*").over(Window.partitionBy("key")) / F.col("n"))
    return facts.withColumn("at", F.row_number().over(hottest)).filter("at > spare").drop("at", "spare", "rank")


def _folded(bits: Column, to: Column) -> Column:
    """A parity sketch brought to fewer numbers by XOR."""
    folds = F.floor(F.size(bits) / to).cast("int")
    narrow = F.transform(F.sequence(F.lit(0), to - 1), lambda i: F.aggregate(F.sequence(F.lit(0), folds - 1), F.lit(0).cast("bigint"), lambda x, k: x.bitwiseXOR(F.get(bits, i + k * to))))
    return F.when(folds == 1, bits).otherwise(narrow)


def sizes_allow(n: Column, m: Column) -> Column:
    return 4 * F.least(n, m) >= 3 * F.greatest(n, m)


def near(p: str, q: str) -> Column:
    """Whether sizes and 256-bit sketches of two rows (or structs) ``p`` and ``q`` allow a link."""
    n, m = F.col(f"{p}.n"), F.col(f"{q}.n")
    bits = [F.bit_count(F.col(f"{p}.{c}").bitwiseXOR(F.col(f"{q}.{c}"))) for c in BITS]
    return sizes_allow(n, m) & (7 * (bits[0] + bits[1] + bits[2] + bits[3]) <= n + m)


def widely_near(p: Column, q: Column, n: Column, m: Column) -> Column:
    """Whether the wide sketches ``p`` and ``q`` of sets of n and m allow a link."""
    to = F.least(F.size(p), F.size(q))
    apart = F.aggregate(F.zip_with(_folded(p, to), _folded(q, to), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    return 7 * apart <= n + m


def _ordered(p: Column, q: Column) -> list[Column]:
    return [F.least(p, q).alias("a"), F.greatest(p, q).alias("b")]


class _Join:
    """One run of the join over ``docs`` (doc_id, text, place)."""

    def __init__(self, docs: DataFrame, scratch: Scratch):
        self.docs, self.put = docs, scratch.stored
        self.all = self.put(classes(docs), "jaccard-classes")
        facts = [F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "place")).alias("where"), F.max("n_shingles").alias("n"), *[F.max(c).alias(c) for c in BITS], F.first("wide").alias("wide")]
        named = self.all.filter("key IS NOT NULL").groupBy("key").agg(*facts)
        self.known = self.put(named.select("key", "where.doc_id", "where.place", "n", *BITS, "wide"), "jaccard-known")

    def sets(self, wanted: DataFrame) -> DataFrame:
        """key and tokens of the classes ``wanted`` (key). While the documents in question are few their ids are
        sent to the texts; beyond that texts are shuffled to them. After that only the sets in question move."""
        wanted = self.put(wanted.join(self.known.select("key", "doc_id", "place"), "key"), "jaccard-wanted")
        few = wanted.count() <= IDS_TO_SEND
        texts, w = self.docs.alias("t"), (F.broadcast(wanted) if few else wanted).alias("w")

        def sets(batches):
            import numpy as np
            import pyarrow as pa

            hasher = WordHasher()
            for batch in batches:
                for at, texts in text_chunks(batch.column("text")):
                    keys = batch.column("key").slice(at, len(texts)).to_pylist()
                    out = [(k, t.view(np.int64)) for k, t in zip(keys, shingle_sets(hasher, texts), strict=True) if len(t) and set_key(t) == k]
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([t for _, t in out], pa.list_(pa.int64()))], names=["key", "tokens"])

        found = texts.join(w, (F.col("t.place") == F.col("w.place")) & F.col("t.doc_id").eqNullSafe(F.col("w.doc_id"))).select("key", "text")
        fetched = self.put(found.mapInArrow(sets, "key long, tokens array<long>"), "jaccard-sets")
        if fetched.count() == wanted.count():
            return fetched
        return self.put(fetched.groupBy("key").agg(F.first("tokens").alias("tokens")), "jaccard-sets")

    def linked(self, pairs: DataFrame) -> DataFrame | None:
        """The pairs (a, b) of class keys whose sets link, None where there are no pairs."""
        side = lambda c: self.known.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("wide").alias(f"wide{c}"))
        pairs = pairs.join(side("a"), "a").join(side("b"), "b").filter(widely_near(F.col("widea"), F.col("wideb"), F.col("na"), F.col("nb"))).select("a", "b")
        pairs = self.put(pairs, "jaccard-pairs")
        if pairs.isEmpty():
            return None
        fetched = self.sets(pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct())
        joined = pairs.join(fetched.select(F.col("key").alias("a"), F.col("tokens").alias("x")), "a").join(fetched.select(F.col("key").alias("b"), F.col("tokens").alias("y")), "b")
        shared = F.size(F.array_intersect("x", "y"))
        return self.put(joined.filter(100 * shared >= 75 * (F.size("x") + F.size("y") - shared)).select("a", "b"), "jaccard-links")

    def components(self, links: DataFrame) -> DataFrame:
        """key and root (the smallest key that links reach) for every key in ``links`` (a, b), by alternating
        large and small stars. A star's leaves are never gathered in one row."""
        edges = self.put(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "jaccard-edges")
        while True:
            # Done when every key is the leaf of one root or a root that is no leaf.
            ends = edges.select("u", F.lit(1).alias("leaf"), F.lit(0).alias("root")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("leaf"), F.lit(1).alias("root")))
            if ends.groupBy("u").agg(F.sum("leaf").alias("leaf"), F.max("root").alias("root")).filter("leaf + root > 1").isEmpty():
                break
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            large = self.put(large.filter("u <> v").distinct(), "jaccard-edges")
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
            edges = self.put(small.filter("u <> v").distinct(), "jaccard-edges")
        return self.put(edges.select(F.col("u").alias("key"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("key"), F.col("v").alias("root")).distinct()), "jaccard-roots")

    def merge(self, pairs: DataFrame) -> bool:
        """Take the links among ``pairs`` (a, b) into ``roots``; whether there were any."""
        links = self.linked(pairs)
        if links is None or links.isEmpty():
            return False
        self.roots = self.components(links.unionByName(self.roots.select(F.col("key").alias("a"), F.col("root").alias("b"))))
        return True

    def torn(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the present roots, from buckets whose members have several."""
        rooted = rows.drop("root").join(self.roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
        apart = rooted.groupBy("sketch").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size")).filter("lo <> hi").select("sketch", "size")
        return self.put(rooted.drop("size").join(apart, "sketch"), "jaccard-torn")

    def to_leaders(self, rows: DataFrame, draw: int) -> DataFrame:
        """Pairs (a, b) of a bucket's leaders of a range of sizes, one drawn by hash and the least lone (the least
        edited copy links with most), and the other members of that range and of another root that may link with
        them. Ranges and leaders are other ones for each ``draw``."""
        rows = rows.withColumn("range", F.floor(F.log("n") / F.log(F.lit(4 / 3)) + draw / ROUNDS))
        by = lambda first: F.min(F.struct(first.alias("first"), F.xxhash64("key", F.lit(draw)).alias("drawn"), "key", "root", "n", *BITS))
        leaders = rows.groupBy("sketch", "range").agg(F.array(by(F.lit(0.0)), by(F.col("lone"))).alias("leaders"))
        leaders = leaders.select("sketch", "range", F.explode("leaders").alias("led"))
        met = rows.alias("r").join(leaders, ["sketch", "range"]).filter((F.col("led.root") != F.col("r.root")) & near("r", "led"))
        return met.select(*_ordered(F.col("led.key"), F.col("r.key"))).distinct()

    def settle(self, rows: DataFrame, rounds: int) -> DataFrame:
        """Merge by leaders; the rows of the buckets still torn."""
        for draw in range(rounds):
            if self.merge(self.to_leaders(rows, draw)) or draw == 0:
                rows = self.torn(rows)
        return rows

    def rare_shingles(self, bound: DataFrame) -> DataFrame:
        """sketch, key, n, parity bits, root and at for each of the ``n // 4 + 1`` shingles of a class that are rarest
        among the classes ``bound``: the shingle's hash as sketch and its place in that order, if roots share it."""
        tokens = self.sets(bound.select("key")).select("key", F.explode("tokens").alias("sketch"))
        shingles = self.put(tokens.join(bound.select("key", "root"), "key"), "jaccard-shingles")
        counts = shingles.groupBy("sketch").agg(F.count("*").alias("count"), (F.min("root") != F.max("root")).alias("torn"))
        ordered = shingles.join(counts, "sketch").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("count", "sketch", "torn"))).alias("rare"))
        rare = ordered.join(bound, "key").select(*bound.columns, F.slice("rare", 1, F.floor(F.col("n") / 4).cast("int") + 1).alias("rare"))
        placed = rare.select(*bound.columns, F.posexplode("rare").alias("at", "r")).filter("r.torn")
        return self.put(placed.select(*bound.columns, "at", "r.sketch"), "jaccard-rare")

    def find_roots(self) -> DataFrame:
        """key and root of every class that is linked with another."""
        self.roots = self.known.sparkSession.createDataFrame([], "key long, root long")
        rows = self.put(buckets(sketches(self.docs), self.known).withColumn("root", F.col("key")), "jaccard-buckets")
        rows = self.settle(rows, ROUNDS)
        p, q = (lambda c: F.col(f"p.{c}")), (lambda c: F.col(f"q.{c}"))
        apart = (p("sketch") == q("sketch")) & (p("root") != q("root")) & near("p", "q")
        told = rows.filter(f"size <= {COLD}")
        self.merge(told.alias("p").join(told.alias("q"), apart & (p("key") < q("key"))).select(p("key").alias("a"), q("key").alias("b")).distinct())
        bound = self.put(self.torn(rows.filter(f"size > {COLD}")).select("key", "root", "n", *BITS, "lone").distinct(), "jaccard-bound")
        if not bound.isEmpty():
            large = self.settle(self.rare_shingles(bound), 1)
            small = large.filter(F.col("at") <= F.floor(F.col("n") / 7))
            smaller = (p("n") < q("n")) | ((p("n") == q("n")) & (p("key") < q("key")))
            # Of the shingles a linked pair shares, the rarest has all others after it in both sets.
            enough = 7 * F.least(p("n") - p("at"), q("n") - q("at")) >= 3 * (p("n") + q("n"))
            self.merge(small.alias("p").join(large.alias("q"), apart & smaller & enough).select(*_ordered(p("key"), q("key"))).distinct())
        return self.roots


def _placed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("place"))


def _groups(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows doc_id, place, n_shingles and key of all documents, and of linked classes key, root and the smallest
    (doc_id, place) of their component; rows without doc_id come last."""
    join = _Join(_placed(docs), scratch)
    linked = join.find_roots().join(join.known.select("key", "doc_id", "place"), "key")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "place"))
    least = scratch.stored(linked.groupBy("root").agg(first.alias("least")).select("root", "least.doc_id", "least.place"), "jaccard-least")
    return join.all, scratch.stored(linked.select("key", "root").join(least, "root"), "jaccard-members")


def join_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id that links reach, of every document."""
    with Scratch(docs.sparkSession) as scratch:
        rows, members = _groups(docs, scratch)
        alone = rows.filter("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("own"))
        ids = scratch.stored(alone.join(members.select("key", "doc_id"), "key", "left").select("key", F.coalesce("doc_id", "own").alias("component_id")), "jaccard-ids")
        of_rows = rows.filter("key IS NOT NULL").select("doc_id", "n_shingles", "key").join(ids, "key").select("doc_id", "n_shingles", "component_id")
        return written(of_rows.unionByName(rows.filter("key IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))), "jaccard-groups")


def first_of_groups(docs: DataFrame) -> DataFrame:
    """One row of each group, with its own columns: the one of the smallest doc_id (rows without one come last,
    and equal ids are ordered by a hash of their texts); of a row that is repeated, one. Texts without words
    stay. The rows to leave out are sent to the documents while they are few, else joined by a shuffle."""
    with Scratch(docs.sparkSession) as scratch:
        rows, members = _groups(docs, scratch)
        named = rows.filter("key IS NOT NULL").select("key", "doc_id", "place").groupBy("key", "doc_id", "place").agg(F.count("*").alias("times"))
        own = named.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "place")).alias("own"))
        firsts = own.join(members, "key", "left")
        member = F.col("root").isNotNull()
        firsts = firsts.select("key", F.when(member, F.col("doc_id")).otherwise(F.col("own.doc_id")).alias("first_id"), F.when(member, F.col("place")).otherwise(F.col("own.place")).alias("first"))
        judged = scratch.stored(named.join(firsts, "key").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("place") == F.col("first"))), "jaccard-judged")
        others = written(judged.filter("NOT stays").select("doc_id", "place"), "jaccard-others")
        repeated = written(judged.filter("stays AND times > 1").select("doc_id", "place"), "jaccard-repeated")

    def matched(rows: DataFrame, to: DataFrame, how: str) -> DataFrame:
        o = (F.broadcast(to) if to.count() <= IDS_TO_SEND else to).alias("o")
        return rows.alias("d").join(o, (F.xxhash64("d.text") == F.col("o.place")) & F.col("d.doc_id").cast("long").eqNullSafe(F.col("o.doc_id")), how)

    kept = matched(docs, others, "left_anti")
    if repeated.isEmpty():
        return kept
    place = unused(docs, "place")
    once = matched(kept, repeated, "left_semi").withColumn(place, F.xxhash64("text")).dropDuplicates(["doc_id", place]).drop(place)
    return matched(kept, repeated, "left_anti").unionByName(once)
