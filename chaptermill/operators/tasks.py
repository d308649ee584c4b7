"""Tasks as folds over their events, and what screens show of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chaptermill.functions.encoding import CHOICES
from chaptermill.operators.ordered import along

# The pages and the stage each belongs to.
PAGE_STAGE = {
    "text-extraction": "01", "chapter-splitting": "01", "proofreading": "02", "script-management": "03", "character-extraction": "04",
    "primary-character-marking": "04", "crowd-voice-pool": "05", "character-voice-refinement": "05", "chapter-parameters": "07",
    "selection-requirements": "07", "chapter-generation": "07", "stale-propagation": "07", "asr-review": "08", "loudness-consistency": "09",
    "timeline-alignment": "10", "chapter-summary": "11", "chapter-cover": "11", "tar-export": "11", "offline-player-export": "11",
    "project-settings": None, "project-backup": "11", "software-settings": None,
}


def valid_events(events: DataFrame) -> DataFrame:
    """Events of a known state, with a positive sequence and one time in payload and envelope."""
    return events.filter(F.col("state").isin("pending", "running", "succeeded", "failed", "canceled") & (F.col("sequence") > 0) & F.col("occurred_at").eqNullSafe(F.col("updated_at")))


def latest_state(events: DataFrame, task: str = "task_id") -> DataFrame:
    """The state of each task after its last event; the fold combines before it shuffles."""
    facts = F.struct("state", "completed", "total", "occurred_at")
    folded = events.groupBy(task).agg(F.max_by(facts, "sequence").alias("last"), F.sum((F.col("state") == "pending").cast("int")).alias("starts"), F.max("sequence").alias("sequence"))
    return folded.select(task, "last.*", F.greatest(F.col("starts"), F.lit(1)).alias("attempt"), "sequence")


def summary(tasks: DataFrame) -> DataFrame:
    """Progress clamped and in per cent, and what can be done with the task."""
    total = F.greatest(F.col("total"), F.lit(1))
    done = F.least(total, F.greatest(F.lit(0), F.col("completed")))
    return tasks.withColumn("completed", done).withColumn("total", total).withColumn("percent", F.floor(F.col("completed") / F.col("total") * 100 + 0.5).cast("int")).withColumn("can_cancel", F.col("state").isin("pending", "running")).withColumn("can_retry", F.col("state").isin("failed", "canceled"))


def to_start(requests: DataFrame, tasks: DataFrame) -> DataFrame:
    """Requests without a pending, running or succeeded task of their fingerprint."""
    busy = tasks.filter(F.col("state").isin("pending", "running", "succeeded")).select("project_id", "input_fingerprint").distinct()
    return requests.join(busy, ["project_id", "input_fingerprint"], "left_anti")


def recover(tasks: DataFrame) -> DataFrame:
    """After a crash: what was pending or running has failed and can be tried again."""
    broken = F.col("state").isin("pending", "running")
    return tasks.withColumn("recovery", F.when(broken, "retryable").otherwise("none")).withColumn("state", F.when(broken, "failed").otherwise(F.col("state")))


def cancel(tasks: DataFrame, ids: DataFrame) -> DataFrame:
    """Pending and running tasks of ``ids`` canceled."""
    return _moved(tasks, ids, ["pending", "running"], "canceled", 0)


def retry(tasks: DataFrame, ids: DataFrame) -> DataFrame:
    """Failed and canceled tasks of ``ids`` pending again, one attempt on."""
    return _moved(tasks, ids, ["failed", "canceled"], "pending", 1)


def _moved(tasks: DataFrame, ids: DataFrame, states: list[str], to: str, attempts: int) -> DataFrame:
    asked = tasks.join(ids.select("task_id").distinct().withColumn("_asked", F.lit(True)), "task_id", "left")
    hit = F.coalesce("_asked", F.lit(False)) & F.col("state").isin(*states)
    return asked.withColumn("attempt", F.col("attempt") + F.when(hit, attempts).otherwise(0)).withColumn("state", F.when(hit, to).otherwise(F.col("state"))).drop("_asked")


def routed(events: DataFrame, windows: DataFrame) -> DataFrame:
    """Events with the window open on their project and session."""
    return events.join(windows, ["project_id", "session_id"])


def newest(responses: DataFrame, key: list[str], generation: str) -> DataFrame:
    """Responses of the last generation asked for by each key; earlier ones came late and are dropped."""
    last = responses.groupBy(*key).agg(F.max(generation).alias(generation))
    return responses.join(last, [*key, generation], "left_semi")


def stored_input(json: Column) -> Column:
    """struct(encoding, error) of a task's stored input: a null or absent encoding is ``automatic``; what is no object or
    names an encoding that can't be chosen can't be retried."""
    parsed = F.try_parse_json(json)
    name = F.try_variant_get(parsed, "$.sourceEncoding", "string")
    named = F.array_contains(F.json_object_keys(json), "sourceEncoding") & name.isNotNull()
    broken = parsed.isNull() | ~F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    error = F.when(broken, "input-broken").when(named & ~name.isin(*CHOICES, "utf-8"), "encoding-broken")
    return F.struct(F.when(error.isNull(), F.when(named, name).otherwise("automatic")).alias("encoding"), error.alias("error"))


def first_pages(stage: Column) -> Column:
    """The first page of a stage, null where it has none."""
    firsts = {}
    for page, own in PAGE_STAGE.items():
        if own:
            firsts.setdefault(own, page)
    found = F.lit(None).cast("string")
    for own, page in firsts.items():
        found = F.when(stage == own, page).otherwise(found)
    return found


def status_groups(items: DataFrame) -> DataFrame:
    """Application and project items of status bars (region, order, key) with their place in their region from 1: these by
    rising, those by falling order, of equal order by key; those without an
    order are first. Items are counted by order; only equal ones are sorted together."""
    known = items.filter(F.col("region").isin("application", "project")).withColumn("_rank", F.coalesce(F.when(F.col("region") == "application", F.col("order")).otherwise(-F.col("order")), F.lit(-(1 << 62))))
    counts = known.groupBy("region", "_rank").count()
    before = along(counts, ["region"], "_rank", totals={"_before": F.col("count")}).drop("count")
    among = F.row_number().over(Window.partitionBy("region", "_rank").orderBy("key"))
    return known.withColumn("_among", among).join(before, ["region", "_rank"]).withColumn("place", F.col("_before") + F.col("_among")).drop("_rank", "_before", "_among")


def stages(projects: DataFrame) -> DataFrame:
    """The 11 stages of each project (has_task, completed, reviewable)."""
    rows = projects.withColumn("stage", F.explode(F.sequence(F.lit(1), F.lit(11))))
    first = F.when(F.col("has_task"), "running").when(F.col("completed"), "completed").when(F.col("reviewable"), "review-required").otherwise("ready")
    status = F.when(F.col("stage") == 1, first).when(F.col("completed") & (F.col("stage") == 2), "ready").otherwise("blocked")
    return rows.select("project_id", F.lpad(F.col("stage").cast("string"), 2, "0").alias("stage_id"), status.alias("status"))


def capabilities(projects: DataFrame) -> DataFrame:
    """What each page of each project offers. The pages are a fixed list."""
    pages = F.array(*[F.struct(F.lit(k).alias("page"), F.lit(v).cast("string").alias("stage")) for k, v in PAGE_STAGE.items()])
    rows = projects.withColumn("p", F.explode(pages)).select("project_id", "completed", "reviewable", "p.*")
    always = F.col("page").isin("text-extraction", "project-settings")
    split = F.col("page") == "chapter-splitting"
    open_split = split & (F.col("reviewable") | F.col("completed"))
    early = ~F.col("completed") & (F.col("page") != "software-settings")
    reason = F.when(always | open_split, "available").when(split | early, "prerequisite").otherwise("not-implemented")
    needs = F.when(always | open_split, F.lit(None)).when(split, "text-extraction").when(early, "chapter-splitting")
    return rows.select("project_id", "page", (always | open_split).alias("available"), reason.alias("reason"), F.when(~always, F.col("stage")).alias("required_stage"), needs.alias("prerequisite"))


def entry_page(has_task: Column, recoverable: Column, last_page: Column, reviewable: Column, completed: Column) -> Column:
    """Where a project opens: a task in hand first, then the last page, then what is to be done."""
    return F.when(has_task | recoverable, "text-extraction").when(last_page.isNotNull(), last_page).when(reviewable, "chapter-splitting").when(completed, "proofreading").otherwise("text-extraction")
