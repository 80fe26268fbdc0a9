"""What the operators share: scratch tables, distributed ranks, bounded literal tables."""

from __future__ import annotations

import atexit
import json
import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Largest table, in rows, that is ever broadcast.  Beyond it a shuffle join is used.
BROADCAST_ROWS = 100_000
#: Rows of one group that one task ranks at a time.
RANK_ROWS = 5_000

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where unset (tests)."""
    global _own_dir
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="trawl-")
    return _own_dir


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written once to the shared folder and read back: lineage ends here, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _scratch[path] = spark
    found = spark.read.schema(df.schema).parquet(path)
    found.scratch_path = path
    return found


def measured(df: DataFrame, label: str, *sums: Column) -> tuple[DataFrame, dict]:
    """written(df), and aggregates over it (by alias) that were taken while it was written."""
    seen = Observation()
    found = written(df.observe(seen, *(sums or [F.count(F.lit(1)).alias("n")])), label)
    return found, seen.get


def released(df: DataFrame) -> None:
    """Delete the files of a written table that nothing needs any more."""
    path = getattr(df, "scratch_path", None)
    if path in _scratch:
        _quiet_delete(_scratch.pop(path), path)


#: Files of written tables by path, for the end of the application at the latest.
_scratch: dict[str, SparkSession] = {}


@atexit.register
def _clear() -> None:
    while _scratch:
        path, spark = _scratch.popitem()
        _quiet_delete(spark, path)


def _quiet_delete(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # the session may have ended already; the folder is scratch space
        pass


#: Rows and bytes of an Arrow batch, where the session says nothing else.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def batch_limits(spark: SparkSession) -> None:
    """Bound the rows and bytes of an Arrow batch, so very long texts do not pile up in a Python worker; a single longer row is a batch by itself."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}", None) is None:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small driver-side table as a literal in the plan."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema.replace(' ', ':')}>>".replace(",:", ","))))


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a table whose row count is known and within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def anew(key: str) -> Column:
    """A whole-number key, changed one to one: for both sides of a join with a table that is aggregated by it.

    By the key itself the other side would have to come to where the table was
    aggregated, and Spark could not split the partition of a hot key in the join.
    """
    return F.col(key).bitwiseXOR(F.lit(1).cast("long"))


def part() -> Column:
    """The scan task a row comes from.  Only meaningful once written()."""
    return F.spark_partition_id()


def group_ranks(slim: DataFrame, group: str, part_col: str, order: list[str], total: int, rank: str) -> tuple[DataFrame, DataFrame]:
    """Dense 0-based ranks of rows within `group`, without gathering a group in one task.

    slim is a written table.  Rows are dealt by (group, piece of the scan); a
    group of any size is spread over as many pieces as keep about RANK_ROWS
    rows together if it held all rows.  Returns (ranked rows, counts per group).
    """
    pieces = max(1, math.ceil(total / RANK_ROWS))
    chunk, before = f"{rank}_chunk", f"{rank}_before"
    dealt = slim.withColumn(chunk, F.pmod(F.col(part_col), F.lit(pieces)))
    counts = dealt.groupBy(group, chunk).agg(F.count(F.lit(1)).alias(f"{rank}_n"))
    sums = counts.withColumn(before, F.sum(f"{rank}_n").over(Window.partitionBy(group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)))
    sums = sums.select(F.col(group).alias(f"{rank}_g"), F.col(chunk).alias(f"{rank}_c"), F.coalesce(before, F.lit(0)).alias(before))
    own = Window.partitionBy(group, chunk).orderBy(*order)
    ranked = (
        dealt.withColumn(f"{rank}_own", F.row_number().over(own) - 1)
        .join(sums, F.col(group).eqNullSafe(F.col(f"{rank}_g")) & (F.col(chunk) == F.col(f"{rank}_c")))
        .withColumn(rank, F.col(before) + F.col(f"{rank}_own"))
        .drop(chunk, before, f"{rank}_own", f"{rank}_g", f"{rank}_c")
    )
    return ranked, counts.groupBy(group).agg(F.sum(f"{rank}_n").alias("n"))
