"""Books constructed from the ``documents`` table.

No supplied text has a chapter heading, so books are made: a source is a book, each of its documents,
in order of doc_id, a part: a heading line, the text and a line end. Even ids get a Chinese heading with
an ideographic space, odd ones an English one; a no-break space and CRLF line ends give the
normalization work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id IS NOT NULL")
    number = F.col("doc_id").cast("string")
    heading = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("第"), number, F.lit("章\u3000"), F.coalesce("lang", F.lit("")), F.lit("\u00a0"))).otherwise(F.concat(F.lit("Chapter "), number, F.lit(" - "), F.coalesce("lang", F.lit("")), F.lit("\u00a0")))
    return docs.select(
        F.coalesce("source", F.lit("unknown")).alias("book_id"),
        F.col("doc_id").alias("part"),
        F.concat(heading, F.lit("\r\n"), F.coalesce("text", F.lit("")), F.lit("\r\n")).alias("text"),
    )
