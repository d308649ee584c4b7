"""URL allow and block rules by a sort-merge range join.

A rule is a host and a path, written ``example.com/en/``; it fits its host and all subdomains
where the url's path starts with the rule's. With the host's labels reversed, ``com.example/en/``
is a canonical key, and all keys that start with it form one interval of the sorted order. A url
gets one key for each suffix of its host that a rule could name. Rules and keys are sorted
together by range partitioning. The last rule opened at or before a key carries the stack of
rules nested around it, and the deepest of these that the key starts with is the answer. What
was open at the end of a partition is carried into the next.

Null urls and urls without ``://`` have an empty host and path and fit no rule. Only distinct
(host, path) pairs are swept; each row then gets its pair's verdict, so repeated rows all have one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chaptermill.llm.common import lower_ascii, written


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def with_stacks(rules: DataFrame) -> DataFrame:
    """Rules (rule, verdict) with their key and ``stack``: the rule and those nested around it, longest first.

    Rules with one key count once; block goes before allow among them.
    """
    host, path = F.regexp_extract("rule", r"^[^/]*", 0), F.regexp_extract("rule", r"^[^/]*(.*)$", 1)
    keyed = rules.filter(F.col("rule").isNotNull()).select(F.concat(F.array_join(reversed_host(lower_ascii(host)), "."), F.when(path == "", F.lit("/")).otherwise(path)).alias("key"), "rule", "verdict")
    keyed = keyed.groupBy("key").agg(F.max(F.struct("verdict", "rule")).alias("r")).select("key", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict"))
    prefixes = keyed.select(F.col("key").alias("owner"), F.explode(F.sequence(F.lit(1), F.length("key"))).alias("n")).select("owner", F.expr("substring(owner, 1, n)").alias("key"))
    nested = prefixes.join(keyed, "key")
    entry = F.struct(F.length("key").alias("size"), "key", "rule", "verdict")
    return nested.groupBy(F.col("owner").alias("key")).agg(F.sort_array(F.collect_list(entry), asc=False).alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (null where none fits) and verdict."""
    host, path = host_and_path(F.col(url))
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    pages = pages.select(*own, host.alias("host"), path.alias("path"))
    stacked = with_stacks(rules)
    labels = stacked.select(F.max(F.size(F.split(F.regexp_extract("key", r"^[^/]*", 0), r"\.")))).first()[0] or 0
    pairs = pages.filter((F.col("host") != "") & F.col("path").startswith("/")).select("host", "path").distinct()
    suffixes = F.explode(F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(max(labels, 1)))))
    keys = pairs.withColumn("labels", reversed_host(F.col("host"))).withColumn("n", suffixes).select(
        F.concat(F.array_join(F.slice("labels", 1, F.col("n")), "."), "path").alias("key"), "host", "path", F.lit(1).alias("kind")
    )
    stack_type = stacked.schema["stack"].dataType
    opened = stacked.select("key", F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), F.lit(0).alias("kind"), "stack")
    events = opened.unionByName(keys.withColumn("stack", F.lit(None).cast(stack_type)))
    swept = written(events.repartitionByRange("key", "kind", "host").withColumn("part", F.spark_partition_id()), "url-sweep")
    # What the partitions before a given one left open: one row a partition.
    ends = swept.filter("kind = 0").groupBy("part").agg(F.max_by("stack", "key").alias("end"))
    ends = swept.select("part").distinct().join(ends, "part", "left")
    ends = ends.select("part", F.last("end", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    sweep = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    active = swept.withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).filter("kind = 1").join(ends, "part")
    stack = F.coalesce("open", "carried")
    hit = active.select("host", "path", F.get(F.filter(stack, lambda r: F.col("key").startswith(r["key"])), F.lit(0)).alias("hit")).filter("hit IS NOT NULL")
    best = hit.groupBy("host", "path").agg(F.max("hit").alias("hit")).select("host", "path", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("verdict"))
    return pages.join(best, ["host", "path"], "left").select(*own, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


#: The rules of the registered query.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def rules_table(spark, rules=RULES) -> DataFrame:
    rows = ", ".join("('{}', '{}')".format(r.replace("'", "''"), v) for r, v in rules)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS rules(rule, verdict)")


def verdicts(pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url"), rules_table(pages.sparkSession)).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), r(rule, verdict) AS (
  VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')
), k AS (
  SELECT rule, verdict, split_part(rule, '/', 1) AS rhost, substr(rule, strpos(rule, '/')) AS rpath FROM r
), m AS (
  SELECT page_id, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS n
  FROM h JOIN k ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT h.page_id, host, path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM h LEFT JOIN m ON m.page_id = h.page_id AND m.n = 1
"""
