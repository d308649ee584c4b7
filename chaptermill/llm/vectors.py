"""Vectors as exact integers, for the operators on ``embeddings``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integers made of components stay below this, so their differences fit a long.
LARGEST = float(1 << 62)


def usable(vector: Column, scale: int) -> Column:
    """Whether a vector is there and all its components are, finite, and fit a long when scaled."""
    fits = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < LARGEST))
    return F.coalesce(vector.isNotNull() & fits, F.lit(False))


def integers(vector: Column, scale: int, shift: int = 0) -> Column:
    """floor(scale * component) + shift of every component, as array<long>."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale) + F.lit(shift).cast("long"))


def matrix(column):
    """A pyarrow list column of equally long lists as a matrix of one row each."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def with_integers(df: DataFrame, vector: str, into: str, scale: int, shift: int = 0) -> DataFrame:
    """The rows of ``df`` with a usable ``vector``, with its integers as column ``into`` instead of ``vector``."""
    return df.filter(usable(F.col(vector), scale)).withColumn(into, integers(F.col(vector), scale, shift)).drop(*{vector} - {into})
