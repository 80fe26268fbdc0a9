"""Whether a copy of an export folder is true to its source, by size and SHA-256 of every file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_digests(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """(name, bytes, hash) of the files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("hash"))


def compare(source: DataFrame, copy: DataFrame) -> DataFrame:
    """(name, in_source, in_copy, equal) for every name on either side."""
    one, two = source.alias("s"), copy.alias("c")
    equal = (F.col("s.bytes") == F.col("c.bytes")) & (F.col("s.hash") == F.col("c.hash"))
    return one.join(two, F.col("s.name") == F.col("c.name"), "full_outer").select(
        F.coalesce("s.name", "c.name").alias("name"), F.col("s.name").isNotNull().alias("in_source"), F.col("c.name").isNotNull().alias("in_copy"), F.coalesce(equal, F.lit(False)).alias("equal")
    )


def verify(spark: SparkSession, source: str, copy: str) -> dict:
    """Totals of a comparison, every file with its size and digests, and the names that differ.  An export has as many files as it has parts."""
    one, two = (file_digests(spark, folder).cache() for folder in (source, copy))
    try:
        sizes = one.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
        found = compare(one, two).join(one.select("name", "bytes", "hash"), "name", "left").orderBy("name").collect()
    finally:
        one.unpersist()
        two.unpersist()
    return {
        "files": len(found), "source_files": sizes["files"], "total_bytes": sizes["bytes"], "equal": sum(r["equal"] for r in found), "all_match": bool(found) and all(r["equal"] for r in found),
        "differ": [r["name"] for r in found if not r["equal"]], "entries": [{"name": r["name"], "bytes": r["bytes"], "sha256": r["hash"], "equal": r["equal"]} for r in found],
    }
