"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector is a sparse row of integer weights over its dimensions, the terms. Candidates are taken in
blocks that hold, for each term, the posting list of the rows that have it and their weights. For each
term of a query its weight times each posting is added to the query's dense array of scores, and a
partition selection then keeps the k best of the block; a task carries them, and the score that a
candidate has to reach, from block to block. What tasks have kept for a query is merged by rank.

Queries are taken in blocks of bounded bytes, each sent to all tasks that scan the candidates: one
scan a block, none of which is larger than ``QUERY_BYTES``. Scores are exact integers: the type of the
score arrays is the narrowest that the largest weights of both sides can't overflow, Python's
integers in the last resort (a score beyond a long then counts as the nearest long).

Vectors that are null or hold null, NaN, infinite or such components as don't fit a long when scaled
take no part; an empty vector scores 0, and of two lengths the missing components count as 0. A
query's candidates are all rows of another id. Rows that repeat an id are candidates each, and as
queries each gets its own ranks. Ids that are null are candidates of the largest id, never queries.
An empty table, or one without queries, gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chaptermill.llm.common import Scratch, written
from chaptermill.llm.vectors import with_integers

SCALE = 1024
#: Bytes of the queries that are sent to all tasks at once.
QUERY_BYTES = 16_000_000
#: Queries and candidates whose scores are held at once.
TILE = (128, 2048)


def _dense(lists, length: int):
    """Lists of integers as a matrix of ``length`` columns, with zeros where a list is shorter."""
    import numpy as np

    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False)
    if length and (sizes == length).all():
        return values.reshape(-1, length)
    out = np.zeros((len(sizes), length), np.int64)
    out[np.arange(length) < sizes[:, None]] = values
    return out


def _score_type(length: int, left: int, right: int):
    """The narrowest type that a sum of ``length`` products of such weights fits."""
    import numpy as np

    bound = max(length, 1) * max(left, 1) * max(right, 1)
    return np.int32 if bound < 1 << 31 else np.int64 if bound < 1 << 63 else object


def _largest(x) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


class Search:
    """The k best candidates of a block of queries, over all candidates that are shown to it."""

    def __init__(self, ids, weights, k: int):
        import numpy as np

        self.ids, self.weights, self.k = np.asarray(ids, np.int64), weights, k
        self.largest = _largest(weights)
        self.best: list[list] = [[]] * len(self.ids)  # (-score, id is null, id), the best first
        self.least = [None] * len(self.ids)  # the k-th score

    def _postings(self, block):
        """For each term that occurs, the rows that have it, or all as a slice if most have, and their weights."""
        import numpy as np

        for term in range(block.shape[1]):
            weights = block[:, term]
            at = np.flatnonzero(weights)
            if 2 * len(at) > len(weights):
                yield term, slice(None), weights
            elif len(at):
                yield term, at, weights[at]

    def _scores(self, queries, postings, n: int, kind):
        import numpy as np

        scores = np.zeros((len(queries), n), kind)
        room = np.empty_like(scores)
        for term, at, weights in postings:
            own = queries[:, term]
            who = np.flatnonzero(own)
            if not len(who):
                continue
            every = 2 * len(who) > len(own)
            if every and isinstance(at, slice):
                np.multiply(own[:, None], weights, out=room)
                np.add(scores, room, out=scores)
            else:
                who = np.arange(len(own)) if every else who
                cells = np.ix_(who, np.arange(n)[at])
                scores[cells] += own[who, None] * weights
        return np.clip(scores, -(1 << 63), (1 << 63) - 1).astype(np.int64) if kind is object else scores

    def show(self, ids: list, block) -> None:
        """Take in candidates: their ids (null allowed) and the matrix of their weights."""
        import numpy as np

        kind = _score_type(min(block.shape[1], self.weights.shape[1]), self.largest, _largest(block))
        queries = self.weights.astype(kind, copy=False)
        known = np.array([i is not None for i in ids])
        number = np.array([0 if i is None else i for i in ids], np.int64)
        for start in range(0, len(ids), TILE[1]):
            part = slice(start, start + TILE[1])
            postings = list(self._postings(block[part, : queries.shape[1]].astype(kind)))
            for first in range(0, len(queries), TILE[0]):
                self._select(first, self._scores(queries[first : first + TILE[0]], postings, len(number[part]), kind), number[part], known[part])

    def _select(self, first: int, scores, ids, known) -> None:
        """Of a tile of scores, merge what reaches the k-th of the tile and of those before into the best."""
        import numpy as np

        own = (self.ids[first : first + len(scores), None] == ids) & known
        n = scores.shape[1]
        ordered = np.where(own, np.iinfo(scores.dtype).min, scores)
        bar = np.partition(ordered, n - self.k, axis=1)[:, n - self.k] if n > self.k else ordered.min(axis=1)
        least = self.least[first : first + len(scores)]
        bar = np.array([b if m is None else max(b, m) for b, m in zip(bar.tolist(), least, strict=True)], np.int64)
        rows, columns = np.nonzero((ordered >= bar[:, None]) & ~own)
        cuts = np.searchsorted(rows, np.arange(len(scores) + 1)).tolist()
        for i in np.unique(rows).tolist():
            at = columns[cuts[i] : cuts[i + 1]]
            found = [(-s, not is_id, v) for s, v, is_id in zip(scores[i, at].tolist(), ids[at].tolist(), known[at].tolist(), strict=True)]
            self.best[first + i] = merged = sorted([*self.best[first + i], *found])[: self.k]
            if len(merged) == self.k:
                self.least[first + i] = -merged[-1][0]

    def found(self):
        """(number of the query, id or None, score) of everything that was kept."""
        for i, kept in enumerate(self.best):
            for score, no_id, v in kept:
                yield i, None if no_id else v, -score


def _numbered(queries: DataFrame, n: int, length: int) -> tuple[DataFrame, int]:
    """Queries dealt evenly into blocks of at most QUERY_BYTES, or nearly, and the number of blocks."""
    blocks = max(1, -(-n * 8 * max(length, 1) // QUERY_BYTES))
    return queries.repartition(blocks).withColumn("_block", F.spark_partition_id()), blocks


def search(vectors: DataFrame, is_query: Column, k: int, id: str = "vec_id", weights: str = "x") -> DataFrame:
    """query_id, rank (from 1), vec_id and score: for each row of ``vectors`` (``id`` long, ``weights`` array<long>)
    for which ``is_query`` holds the ``k`` rows of another id of the highest inner product, ties to the smaller id."""
    spark = vectors.sparkSession
    vectors = vectors.select(F.col(id).alias("vec_id"), F.col(weights).alias("x"), is_query.alias("_query"))
    with Scratch(spark) as scratch:
        chosen = vectors.filter(F.coalesce("_query", F.lit(False)) & F.col("vec_id").isNotNull()).drop("_query")
        counts = chosen.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("length")).first()
        dealt, blocks = _numbered(chosen, counts["n"], counts["length"] or 0)
        dealt = scratch.stored(dealt, "topk-queries")
        kept = None
        for block in range(blocks):
            table = dealt.filter(F.col("_block") == block).select("vec_id", "x").toArrow().combine_chunks()  # about QUERY_BYTES
            sent = spark.sparkContext.broadcast((table.column("vec_id").to_pylist(), [c for c in table.column("x").chunks], counts["length"] or 0))
            found = scratch.stored(vectors.drop("_query").mapInArrow(_searcher(sent, k, block), "query long, query_id long, vec_id long, score long"), "topk-found")
            sent.destroy()
            kept = found if kept is None else kept.unionByName(found)
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
        ranked = kept.withColumn("rank", place).filter(F.col("rank") <= k)
        return written(ranked.select("query_id", "rank", "vec_id", "score"), "topk")


def _searcher(sent, k: int, block: int):
    """A function of a task's batches that gives the k best of its rows for each query of a block."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        ids, chunks, length = sent.value
        queries = np.concatenate([_dense(c, length) for c in chunks]) if chunks else np.zeros((0, length), np.int64)
        searched = Search(ids, queries, k)
        for batch in batches:
            if len(ids) and batch.num_rows:
                lists = batch.column(1)
                searched.show(batch.column(0).to_pylist(), _dense(lists, int(np.diff(lists.offsets.to_numpy()).max(initial=0))))
        rows = list(searched.found())
        columns = [[block << 32 | i for i, _, _ in rows], [ids[i] for i, _, _ in rows], [v for _, v, _ in rows], [s for _, _, s in rows]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame) -> DataFrame:
    """The 10 best of all rows of ``embeddings`` for each whose id is divisible by 100."""
    integers = with_integers(vectors.select("vec_id", "embedding"), "embedding", "x", SCALE)
    return search(integers, F.col("vec_id") % 100 == 0, 10)


SQL = """
WITH used AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
  FROM used q JOIN used c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM pairs QUALIFY rank <= 10
"""
