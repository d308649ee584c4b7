"""Revisions of artifacts, their dependencies and what a change makes stale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chaptermill.operators.catalog import latest


def affected(dependencies: DataFrame, revisions: DataFrame, producers: DataFrame) -> DataFrame:
    """Current revisions that depend on one of ``producers`` (producer_revision_id), one hop only."""
    edges = dependencies.join(producers.select("producer_revision_id").distinct(), "producer_revision_id")
    current = revisions.filter("validity_status = 'current'").select(F.col("revision_id").alias("consumer_revision_id"), "artifact_id", "artifact_type")
    return edges.join(current, "consumer_revision_id").select("artifact_type", "artifact_id", "consumer_revision_id", "producer_revision_id", "dependency_type")


def in_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("artifact_type", "artifact_id", "consumer_revision_id")


def propagate(dependencies: DataFrame, revisions: DataFrame, replaced: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(revisions with the affected ones stale, causes). ``replaced``: producer_revision_id and current_revision_id.
    Confirming a review replaces nothing and so makes nothing stale."""
    hit = affected(dependencies, revisions, replaced)
    stale = revisions.join(hit.select(F.col("consumer_revision_id").alias("revision_id")).distinct().withColumn("_hit", F.lit(True)), "revision_id", "left")
    stale = stale.withColumn("validity_status", F.when(F.col("_hit"), "stale").otherwise(F.col("validity_status"))).drop("_hit")
    causes = hit.join(replaced, "producer_revision_id").select(
        "consumer_revision_id", F.col("producer_revision_id").alias("previous_producer_revision_id"), F.col("current_revision_id").alias("current_producer_revision_id"), "dependency_type", F.lit("active").alias("status")
    )
    return stale, causes


def next_baseline(revisions: DataFrame, by: list[str]) -> DataFrame:
    """One more than the largest baseline revision; 1 where there is none."""
    return revisions.groupBy(*by).agg((F.coalesce(F.max("baseline_revision"), F.lit(0)) + 1).alias("next_baseline"))


def activate(revisions: DataFrame, by: list[str]) -> DataFrame:
    """Revisions with only the last baseline of each group active."""
    last = F.max("baseline_revision").over(Window.partitionBy(*by))
    return revisions.withColumn("active", F.col("baseline_revision") == last)


def without_one_active(revisions: DataFrame, by: list[str]) -> DataFrame:
    """Groups that don't have exactly one active revision."""
    return revisions.groupBy(*by).agg(F.sum(F.col("active").cast("int")).alias("n_active")).filter("n_active <> 1")


def snapshot_history(history: DataFrame, new: DataFrame) -> DataFrame:
    """Snapshots (key, history) with the new entry active and all earlier ones not. ``history`` is an array of
    struct(revision_id, baseline_revision, active); ``new`` has key, revision_id and baseline_revision."""
    joined = history.join(new, "key")
    old = F.transform("history", lambda h: F.struct(h["revision_id"].alias("revision_id"), h["baseline_revision"].alias("baseline_revision"), F.lit(False).alias("active")))
    entry = F.struct("revision_id", "baseline_revision", F.lit(True).alias("active"))
    return joined.select("key", F.concat(F.filter(old, lambda h: h["revision_id"] != F.col("revision_id")), F.array(entry)).alias("history"))


def conflicts(commands: DataFrame, active: DataFrame) -> DataFrame:
    """Commands (key, baseline_revision) that weren't made on the active baseline."""
    held = active.select("key", F.col("baseline_revision").alias("active_baseline"))
    return commands.join(held, "key", "left").filter(~F.coalesce(F.col("baseline_revision") == F.col("active_baseline"), F.lit(False)))


def usable_previews(previews: DataFrame, now, command: tuple[str, ...] = ("command_hash",)) -> DataFrame:
    """Previews neither expired nor consumed, the last of each ``command``, of equal times the one of the smallest id. ``now``
    is a timestamp column."""
    open_ones = previews.filter(F.col("consumed_at").isNull() & (F.col("expires_at") > now))
    return latest(open_ones, [*command], [F.desc("created_at"), F.asc("preview_id")])
