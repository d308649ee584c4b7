"""Body lengths of chapters and their outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chaptermill.functions import text as T
from chaptermill.operators import structure
from chaptermill.operators.ordered import WIDTH, along
from chaptermill.operators.stored import stored

# Fences and thresholds of an unusual length.
IQR_FENCE, MAD_SCALE, MAD_THRESHOLD, LEAST_RATIO, LEAST_SAMPLE, RADIUS = 1.5, 1.4826, 3, 1.75, 4, 5


def median(values: Column) -> Column:
    """The middle of an array, the mean of the middle two of an even one."""
    ordered = F.sort_array(values)
    half = F.floor(F.size(values) / 2).cast("int")
    return F.when(F.size(values) == 0, F.lit(None)).when(F.size(values) % 2 == 1, F.get(ordered, half)).otherwise((F.get(ordered, half - 1) + F.get(ordered, half)) / 2)


def deviation(values: Column, center: Column) -> Column:
    """The median distance from ``center``."""
    return median(F.transform(values, lambda x: F.abs(x - center)))


def fences(lengths: DataFrame, by: str) -> DataFrame:
    """Quartiles and fences of the non-zero lengths of each group, exact. Lengths repeat, so the sample of a
    group is held as counts of distinct lengths and only the four ranks in question are looked up."""
    counts = lengths.filter("length > 0").groupBy(by, "length").agg(F.count("*").alias("k"))
    upto = Window.partitionBy(by).orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("upto", F.sum("k").over(upto)).withColumn("n", F.sum("k").over(Window.partitionBy(by)))

    def rank(share: float, step: int) -> Column:
        exact = (F.col("n") + 1) * F.lit(share)
        return F.least(F.greatest(F.floor(exact) + step, F.lit(1)), F.col("n"))

    def at(share: float, step: int) -> Column:
        r = rank(share, step)
        return F.max(F.when((F.col("upto") >= r) & (F.col("upto") - F.col("k") < r), F.col("length")))

    found = placed.groupBy(by).agg(F.max("n").alias("n"), *[at(q, s).alias(f"q{int(q * 100)}_{s}") for q in (0.25, 0.75) for s in (0, 1)])

    def value(q: int) -> Column:
        exact = (F.col("n") + 1) * F.lit(q / 100)
        low, high = F.col(f"q{q}_0").cast("double"), F.col(f"q{q}_1").cast("double")
        return F.when(exact <= 1, low).when(exact >= F.col("n"), high).otherwise(low + (exact - F.floor(exact)) * (high - low))

    both = found.select(by, "n", value(25).alias("q1"), value(75).alias("q3"))
    fence = IQR_FENCE * (F.col("q3") - F.col("q1"))
    return both.select(by, "n", "q1", "q3", (F.col("q1") - fence).alias("low"), (F.col("q3") + fence).alias("high"))


def local_spread(lengths: DataFrame, by: str, order: str) -> DataFrame:
    """``lengths`` with n_near, center and spread (median distance) of the logarithms of the non-zero lengths
    within RADIUS rows. Rows are numbered and cut into stretches; those near an edge are lent to the next one."""
    ranked = along(lengths, [by], order, totals={"_rank": F.lit(1)})
    stretch, place = F.floor(F.col("_rank") / WIDTH), F.col("_rank") % WIDTH
    at = lambda s, own: F.struct(s.alias("s"), F.lit(own).alias("own"))
    copies = F.array_compact(F.array(at(stretch, True), F.when(place < RADIUS, at(stretch - 1, False)), F.when(place >= WIDTH - RADIUS, at(stretch + 1, False))))
    lent = ranked.withColumn("_in", F.explode(copies)).withColumn("_stretch", F.col("_in.s"))
    near = Window.partitionBy(by, "_stretch").orderBy("_rank").rowsBetween(-RADIUS, RADIUS)
    logs = F.collect_list(F.when(F.col("length") > 0, F.log(F.col("length").cast("double")))).over(near)
    placed = lent.withColumn("_logs", logs).filter("_in.own").withColumn("center", median(F.col("_logs")))
    return placed.withColumn("n_near", F.size("_logs")).withColumn("spread", deviation(F.col("_logs"), F.col("center"))).select(*lengths.columns, "center", "n_near", "spread")


def anomalies(lengths: DataFrame, by: str, order: str) -> DataFrame:
    """Rows with length 0 (empty), or beyond both the global fences and the local spread on one side
    (short, long); accepted rows count in the samples but aren't reported. ``lengths``: by, order, length,
    accepted and any others."""
    judged = local_spread(lengths, by, order).join(fences(lengths, by).select(by, "n", "low", "high"), by, "left")
    globally = F.when(F.coalesce("n", F.lit(0)) < LEAST_SAMPLE, F.lit(None)).when(F.col("length") < F.col("low"), "short").when(F.col("length") > F.col("high"), "long")
    allowed = F.greatest(MAD_THRESHOLD * F.lit(MAD_SCALE) * F.col("spread"), F.log(F.lit(LEAST_RATIO)))
    away = F.log(F.greatest(F.col("length"), F.lit(1)).cast("double")) - F.col("center")
    locally = F.when(F.col("n_near") < LEAST_SAMPLE, F.lit(None)).when(away < -allowed, "short").when(away > allowed, "long")
    kind = F.when(F.col("length") == 0, "empty").when(globally == locally, globally)
    found = judged.withColumn("kind", kind).filter("kind IS NOT NULL AND NOT accepted")
    return found.select(*lengths.columns, "kind")


def reason(kind: Column, length: Column) -> Column:
    number = F.concat(length.cast("string"), F.lit(" 字"))
    return F.when(kind == "empty", "无正文").when(kind == "short", F.concat(F.lit("偏短 · "), number)).when(kind == "long", F.concat(F.lit("偏长 · "), number))


def body_lengths(parts: DataFrame) -> DataFrame:
    """The chapters of books with length, the visible code points of their text outside the heading. They are counted
    where texts are read; only counts by heading and part move. What comes before a book's first heading has no chapter."""
    laid = stored(structure.layout(parts, measure=True), "measured")
    counts = laid.select("book_id", "before", F.explode("visible").alias("v")).select("book_id", (F.col("before") + F.col("v.k")).cast("int").alias("ord"), "v.n")
    sums = counts.filter("ord > 0").groupBy("book_id", "ord").agg(F.sum("n").alias("length"))
    return structure.chapters_of(laid).join(sums, ["book_id", "ord"])
