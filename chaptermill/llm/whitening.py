"""Whitening of embeddings by TSQR.

Components become integers first, so the sums that centre the rows are exact. Each task then centres
its rows and keeps one triangular factor, the R of a QR of its earlier factor above the next rows;
the factors of all tasks are merged by further QRs in a tree of three levels, and the right singular
vectors of the last R, divided by the roots of the eigenvalues, whiten. No covariance is formed on the
way, so its squared condition number never enters. What reaches the driver is one row of sums, one R
and one Gram matrix of the whitened rows, all of the size of the dimension.

Dropped are rows whose vector is null or empty, or holds null, NaN, infinite or such components as
don't fit a long when scaled; and rows whose vector has another length than most have (the longer
length, if two are equally frequent). Rows that repeat an id or a vector count each. Components
without variance can't be whitened and aren't returned: fewer rows than dimensions give fewer
components, a single row or an empty table none. A column of ``vectors`` that bears the name of an
output is replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chaptermill.llm.vectors import matrix, with_integers

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
#: Groups of the first and of the second level of the merge tree.
TREE = (4096, 64)


@dataclass
class Whitening:
    """A fitted model. The mean is ``whole`` + ``rest`` / ``n`` in every dimension, with 0 <= ``rest`` < ``n``."""

    n: int
    whole: list[int]
    rest: list[int]
    directions: list[list[float]]  # unit eigenvectors, one a component
    eigenvalues: list[float]
    explained: list[float]

    @property
    def length(self) -> int:
        return len(self.whole)

    def centred(self, x):
        """Rows minus the mean, as doubles: the whole part is taken off exactly."""
        import numpy as np

        return (x - np.array(self.whole, np.int64)).astype(np.float64) - np.array(self.rest, np.float64) / self.n

    def whitened(self, x):
        import numpy as np

        return self.centred(x) @ (np.array(self.directions) / np.sqrt(np.array(self.eigenvalues))[:, None]).T

    def deviations(self, x) -> list[int | None]:
        """Sum over the dimensions of (n * x - sum) ** 2 of every row, exact; null if a long can't hold it."""
        import numpy as np

        off = x - np.array(self.whole, np.int64)
        rest = np.array(self.rest, np.int64)
        largest = max(int(np.abs(off).max(initial=0)), 1)
        if self.length * largest * max(largest, self.n) >= 1 << 62:
            off, rest = off.astype(object), rest.astype(object)
        squares, mixed, last = (off * off).sum(axis=1).tolist(), (off * rest).sum(axis=1).tolist(), sum(r * r for r in self.rest)
        exact = [self.n * (self.n * a - 2 * b) + last for a, b in zip(squares, mixed, strict=True)]
        return [d if d < 1 << 63 else None for d in exact]


def _rows_of(batches, column: str):
    for batch in batches:
        if batch.num_rows:
            yield batch, matrix(batch.column(batch.schema.get_field_index(column)))


def exact_sums(integers: DataFrame, column: str) -> tuple[int, list[int]]:
    """Number of rows of the most frequent length of ``column`` (array<long>), and their sums by dimension."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held = {}
        for batch in batches:
            lists = batch.column(0)
            sizes = np.diff(lists.offsets.to_numpy())
            for size in np.unique(sizes).tolist():
                x = matrix(lists.filter(pa.array(sizes == size)))
                n, high, low = held.get(size, (0, 0, 0))
                held[size] = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        for size, (n, high, low) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in ([size] * size, range(size), high, low, [n] * size)], names=["size", "dim", "high", "low", "n"])

    parts = integers.filter(F.size(column) > 0).select(column).mapInArrow(run, "size long, dim long, high long, low long, n long")
    each = parts.groupBy("size", "dim").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")], F.sum("n").alias("n"))
    lengths = each.groupBy("size").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("dim", "high", "low"))).alias("sums"))
    found = lengths.orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    return (found[0]["n"], [int(s["high"]) * (1 << 32) + int(s["low"]) for s in found[0]["sums"]]) if found else (0, [])


def _factor(rows, above=None):
    """The triangular factor of ``rows`` below the factor ``above``."""
    import numpy as np

    return np.linalg.qr(rows if above is None else np.concatenate([above, rows]), mode="r")


def triangular_factor(integers: DataFrame, column: str, model: Whitening):
    """R of the centred rows of all tasks: R'R is n times their covariance."""
    import numpy as np

    length = model.length

    def of_task(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        r = None
        for _, x in _rows_of(batches, column):
            r = _factor(model.centred(x), r)
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([r.tobytes()])], names=["task", "r"])

    def merge(group):
        import pandas as pd

        r = None
        for packed in group["r"]:
            r = _factor(np.frombuffer(packed).reshape(-1, length), r)
        return pd.DataFrame({"task": group["task"].iloc[:1], "r": [r.tobytes()]})

    factors = integers.select(column).mapInArrow(of_task, "task long, r binary")
    for groups in (*TREE, 1):
        factors = factors.groupBy(F.col("task") % groups).applyInPandas(merge, "task long, r binary")
    return np.frombuffer(factors.first()["r"]).reshape(-1, length)


def fit(integers: DataFrame, column: str, components: int = COMPONENTS) -> Whitening:
    """The model of the vectors ``column`` (array<long>) of the most frequent length."""
    import numpy as np

    n, sums = exact_sums(integers, column)
    model = Whitening(n, [s // n for s in sums] if n else [], [s % n for s in sums] if n else [], [], [], [])
    if n < 2:
        return model
    _, values, directions = np.linalg.svd(triangular_factor(integers.filter(F.size(column) == len(sums)), column, model), full_matrices=False)
    some = int((values > values[0] * max(n, len(sums)) * np.finfo(float).eps).sum()) if values[0] > 0 else 0
    kept = min(some, components)
    eigenvalues = values**2 / n
    model.directions = directions[:kept].tolist()
    model.eigenvalues = eigenvalues[:kept].tolist()
    model.explained = (eigenvalues[:kept] / eigenvalues.sum()).tolist() if kept else []
    return model


def whiten(integers: DataFrame, column: str, model: Whitening) -> DataFrame:
    """The rows of the model's length with ``whitened`` (array<double>, one entry a component) and ``deviation``."""
    kept = integers.filter(F.size(column) == model.length).drop(*{"whitened", "deviation"} - {column})

    def run(batches):
        import pyarrow as pa

        for batch, x in _rows_of(batches, column):
            done = model.whitened(x) if model.directions else x[:, :0].astype(float)
            offsets = pa.array(range(0, done.size + 1, done.shape[1]) if done.shape[1] else [0] * (len(done) + 1), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(done.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(model.deviations(x), pa.int64())], names=[*batch.schema.names, "whitened", "deviation"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("whitened", T.ArrayType(T.DoubleType())), T.StructField("deviation", T.LongType())]))


def identity_error(whitened: DataFrame, components: int, n: int) -> float:
    """The largest absolute entry of the covariance of ``whitened`` minus the identity, from sums over all rows."""
    import numpy as np

    if not components:
        return 0.0

    def run(batches):
        import pyarrow as pa

        gram, sums = np.zeros((components, components)), np.zeros(components)
        for _, w in _rows_of(batches, "whitened"):
            gram += w.T @ w
            sums += w.sum(axis=0)
        flat = np.concatenate([gram.ravel(), sums])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["at", "value"])

    flat = np.zeros(components * (components + 1))
    for row in whitened.select("whitened").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        flat[row["at"]] = row["value"]  # components * (components + 1) rows
    gram, mean = flat[: components**2].reshape(components, components), flat[components**2 :] / n
    return float(np.abs(gram / n - np.outer(mean, mean) - np.eye(components)).max())


def components_of(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error: a row for each vector of
    ``embeddings`` and each of the first ``components`` components."""
    integers = with_integers(vectors.select("vec_id", "embedding"), "embedding", "x", SCALE, SHIFT)
    model = fit(integers, "x", components)
    done = whiten(integers, "x", model)
    error = identity_error(done, len(model.directions), model.n)
    explained = F.array(*[F.lit(e) for e in model.explained]) if model.explained else F.array().cast("array<double>")
    rows = done.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
