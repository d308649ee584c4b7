"""Keyed tables as versions: upsert, insert-or-ignore, delete, latest by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``. Spark limits each task's rows to one a key before it shuffles (a window group limit), so
    a key with very many rows sends no more than one a task."""
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_n", first).filter("_n = 1").drop("_n")


def upsert(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``stored`` with the rows of ``new`` in place of those of their keys."""
    return stored.join(new.select(*key), key, "left_anti").unionByName(new)


def insert_missing(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``stored`` and the rows of ``new`` whose keys it lacks."""
    return stored.unionByName(new.join(stored.select(*key), key, "left_anti"))


def upsert_project(stored: DataFrame, new: DataFrame) -> DataFrame:
    """As :func:`upsert` by project_id; a stored project of another id in a new one's directory goes."""
    other = stored.alias("s").join(new.alias("n"), (F.col("s.directory_path") == F.col("n.directory_path")) & (F.col("s.project_id") != F.col("n.project_id")), "left_anti")
    return upsert(other, new, ["project_id"])


def recent(projects: DataFrame) -> DataFrame:
    return projects.orderBy(F.desc("last_opened_at"), F.asc("project_id"))


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*key).count().filter("count > 1")


def inspected(projects: DataFrame, facts: DataFrame) -> DataFrame:
    """Projects with availability: missing (no directory), invalid (its manifest fails or names another project)
    or available. ``facts``: directory_path, manifest_valid, manifest_project_id."""
    joined = projects.join(facts, "directory_path", "left")
    valid = F.coalesce(F.col("manifest_valid") & (F.col("manifest_project_id") == F.col("project_id")), F.lit(False))
    kind = F.when(F.col("manifest_valid").isNull(), "missing").when(~valid, "invalid").otherwise("available")
    return joined.withColumn("availability", kind).drop("manifest_valid", "manifest_project_id")


def with_default(rows: DataFrame, column: str, default) -> DataFrame:
    """``rows`` with ``column``, added or filled."""
    return rows.withColumn(column, F.coalesce(F.col(column), F.lit(default)) if column in rows.columns else F.lit(default))
