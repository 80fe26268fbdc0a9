"""Tables that are written once to the folder all executors share, and read again.

Lineage ends there, so what a lost executor held is read and not made anew, and a
table that several steps use is made once.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None
_files: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, as in tests on one machine, a temporary folder."""
    global _own
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    _own = _own or tempfile.mkdtemp(prefix="trawl-")
    return _own


def written(table: DataFrame, label: str) -> DataFrame:
    spark = table.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    table.write.parquet(path)
    _files[path] = spark
    found = spark.read.schema(table.schema).parquet(path)
    found.scratch_path = path
    return found


def released(table: DataFrame) -> None:
    """Delete a written table that no plan reads any more."""
    path = getattr(table, "scratch_path", None)
    if path in _files:
        _delete(path, _files.pop(path))


def _delete(path: str, spark: SparkSession) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended; the folder is scratch space
        pass


@atexit.register
def _clear() -> None:
    while _files:
        _delete(*_files.popitem())
