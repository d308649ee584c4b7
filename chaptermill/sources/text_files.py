"""Text assets, manifests and stored tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chaptermill.functions.hashing import SHA256, UUID4

MANIFEST = "schemaVersion int, layoutVersion int, projectId string, displayName string, createdAt string, sourceAsset struct<id:string,originalName:string,relativePath:string,byteLength:bigint,sha256:string>"


def assets(spark: SparkSession, path: str) -> DataFrame:
    """path, name, content, byte_length and sha256 of the .txt files below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*").load(path)
    named = files.withColumn("name", F.regexp_extract("path", r"[^/]*$", 0)).filter(is_text_name(F.col("name")))
    return named.select("path", "name", "content", F.col("length").alias("byte_length"), F.sha2("content", 256).alias("sha256"))


def is_text_name(name: Column) -> Column:
    """A name with the extension .txt, in any case, and something before it."""
    return name.rlike(r"(?is)^.+\.txt\z")


def window(content: Column, start: Column, size: Column, behind: Column) -> Column:
    """Bytes from ``behind`` before ``start`` to ``size`` after it, as far as there are any."""
    first = F.greatest(F.lit(0), start - behind)
    return F.substring(content, first + 1, F.least(F.octet_length(content), start + size) - first)


def exact(content: Column, start: Column, size: Column) -> Column:
    """Exactly ``size`` bytes from ``start``; null where the content ends before."""
    return F.when(start + size <= F.octet_length(content), F.substring(content, start + 1, size))


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifests with what is wrong with each: an empty array where nothing is."""
    read = spark.read.schema(MANIFEST).option("multiLine", "true").json(path)
    return read.withColumn("faults", manifest_faults())


def safe_name(name: Column) -> Column:
    return (F.length(name) > 0) & ~name.isin(".", "..") & ~name.rlike(r"[/\\\x00]")


def inside(path: Column) -> Column:
    """A relative path that stays below where it starts."""
    return ~path.rlike(r"^/|^[A-Za-z]:|\\|\x00") & ~F.concat(F.lit("/"), path, F.lit("/")).rlike(r"/\.{0,2}/")


def display_name(name: Column) -> Column:
    """The trimmed name; null where it is empty or has control characters."""
    trimmed = F.regexp_replace(name, r"^[\s\u00A0\u3000\uFEFF]+|[\s\u00A0\u3000\uFEFF]+\z", "")
    return F.when((trimmed != "") & ~trimmed.rlike(r"[\x00-\x1F\x7F]"), trimmed)


def manifest_faults() -> Column:
    a = F.col("sourceAsset")
    expected = F.concat_ws("/", F.lit("inputs/source-assets"), a["id"], a["originalName"])
    tests = {
        "project-id": F.col("projectId").rlike(UUID4),
        "asset-id": a["id"].rlike(UUID4),
        "hash": a["sha256"].rlike(SHA256),
        "length": a["byteLength"] >= 0,
        "name": safe_name(a["originalName"]) & is_text_name(a["originalName"]),
        "path": a["relativePath"] == expected,
        "created-at": F.col("createdAt").cast("string").rlike(r"^\d{4}-\d{2}-\d{2}T") & F.expr("try_to_timestamp(createdAt)").isNotNull(),
    }
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in tests.items()]))


def unmatched_assets(manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """Manifests whose stored asset is missing or has another length or hash. ``stored``: id, byte_length, sha256."""
    m = manifest.select("projectId", F.col("sourceAsset.id").alias("id"), F.col("sourceAsset.byteLength").alias("n"), F.col("sourceAsset.sha256").alias("h"))
    joined = m.join(stored, "id", "left")
    fault = F.when(F.col("byte_length").isNull(), "missing").when(F.col("byte_length") != F.col("n"), "length").when(F.col("sha256") != F.col("h"), "hash")
    return joined.select("projectId", "id", fault.alias("fault")).filter("fault IS NOT NULL")
