"""Tables of an archive as Parquet, in versions that are never changed.

A build goes to a folder of its own; a manifest names the version in use and is
written last, so readers see whole builds only.  All file access goes through
Spark's file systems, so an archive may lie wherever Spark can read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L

#: Columns of which a least and a greatest value say nothing.
LONG_TEXTS = ("text", "user_text", "assistant_text", "metadata_json", "match_form", "content_hash")
TABLES = ("conversations", "messages", "turns", "chunks", "corpus_stats", "postings", "positions", "blocks", "vectors")


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    where, fs = _path(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_manifest(spark: SparkSession, root: str) -> dict:
    where, fs = _path(spark, f"{root}/manifest.json")
    if not fs.exists(where):
        raise FileNotFoundError(f"no archive in {root}")
    return json.loads("\n".join(r.value for r in spark.read.text(f"{root}/manifest.json", wholetext=True).collect()))


def about(encoder=None) -> dict:
    """What a manifest says besides its tables: formats, and what its vectors were made with."""
    found = {"schema_version": L.SCHEMA_VERSION}
    if encoder is not None:
        found["embedding"] = {"encoder": encoder.name, "dimension": encoder.size}
    return found


def save(spark: SparkSession, root: str, tables: dict[str, DataFrame | Callable], about: dict | None = None) -> dict:
    """Write tables as a new version and make it the one in use; returns the manifest.

    A table may be a function of the stored tables before it: it is then made from what has been written.
    """
    version, stored = uuid.uuid4().hex, {}
    for name, table in tables.items():
        df = table(stored) if callable(table) else table
        df.write.parquet(f"{root}/{version}/{name}")
        stored[name] = spark.read.schema(df.schema).parquet(f"{root}/{version}/{name}")
    manifest = {"version": version, "tables": {n: stored[n].count() for n in tables}, **(about or {})}
    manifest["statistics"] = statistics(spark, f"{root}/{version}", stored, manifest["tables"])
    write_text(spark, f"{root}/manifest.json", json.dumps(manifest, indent=2))
    return manifest


def bytes_of(spark: SparkSession, path: str) -> int:
    where, fs = _path(spark, path)
    return fs.getContentSummary(where).getLength() if fs.exists(where) else -1


def statistics(spark: SparkSession, folder: str, tables: dict[str, DataFrame], counts: dict[str, int]) -> dict:
    """Of each table: rows, bytes, and of every plain column the least and greatest value, the nulls and about how many different values there are."""
    found = {}
    for name, df in tables.items():
        plain = [f.name for f in df.schema if f.dataType.simpleString() in ("string", "int", "bigint", "double", "boolean") and f.name not in LONG_TEXTS]
        asked = [g for c in plain for g in (F.min(c).cast("string"), F.max(c).cast("string"), F.count_if(F.col(c).isNull()), F.approx_count_distinct(c))]
        row = list(df.agg(*asked).first()) if asked else []
        columns = {c: dict(zip(("least", "greatest", "nulls", "different"), row[4 * i : 4 * i + 4], strict=True)) for i, c in enumerate(plain)}
        found[name] = {"rows": counts[name], "bytes": bytes_of(spark, f"{folder}/{name}"), "columns": columns}
    return found


def load_version(spark: SparkSession, root: str, version: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{root}/{version}/{n}") for n in names}


def load(spark: SparkSession, root: str, encoder=None, whole: bool = False) -> dict[str, DataFrame]:
    """The tables of the version in use; raises where their files are not of the manifest's size, or the vectors were made by another encoder.

    whole: also count all rows and check every vector, as validation does.
    """
    manifest = read_manifest(spark, root)
    for name, told in manifest.get("statistics", {}).items():
        if (there := bytes_of(spark, f"{root}/{manifest['version']}/{name}")) != told["bytes"]:
            raise ValueError(f"{name} has {there} bytes; the manifest says {told['bytes']}")
    tables = load_version(spark, root, manifest["version"], tuple(manifest["tables"]))
    if whole or "statistics" not in manifest:
        for name, n in manifest["tables"].items():
            if (there := tables[name].count()) != n:
                raise ValueError(f"{name} has {there} rows; the manifest says {n}")
    if encoder is not None and "vectors" in tables:
        check_encoder(manifest.get("embedding", {}), encoder)
        if whole:
            check_vectors(tables, encoder)
    return tables


def check_encoder(made: dict, encoder) -> None:
    if (made.get("encoder"), made.get("dimension")) != (encoder.name, encoder.size):
        raise ValueError(f"the vectors were made by {made.get('encoder')} of dimension {made.get('dimension')}, not by {encoder.name} of {encoder.size}")


def check_vectors(tables: dict[str, DataFrame], encoder) -> None:
    wrong = tables["vectors"].where(F.size("embedding") != encoder.size).limit(1).count()
    strange = tables["vectors"].join(tables["chunks"].select("chunk_id"), "chunk_id", "left_anti").limit(1).count()
    again = tables["vectors"].groupBy("chunk_id").count().where("count > 1").limit(1).count()
    if wrong or strange or again:
        raise ValueError("vectors of another dimension, of unknown chunks, or several of one chunk")
