"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again as the next one's docs.  All but the last return the columns of
documents, and any others that docs has, whatever their names.

For all stages: texts of any length are read in full; rows with a null source are
judged on their own; rows with a null doc_id go through like any other; an empty
table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trawl.llm import neardup, packing, quality, rules
from trawl.llm.common import written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier does not reject.

    Null and empty texts are judged by an empty feature vector, a score equal to the limit stays, and repeated rows stay or go together.
    """
    return quality.documents_kept(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host does.

    Null and empty texts fail; repeated rows stay or go together, and each counts for its host.
    """
    return rules.documents_kept(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, similarity 0.8.

    The least doc_id of a group stays, with one of its rows; texts without a word are linked with nothing and all stay, one row of each doc_id.
    """
    return neardup.deduplicated(docs, 5, (4, 5))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their places in sequences of 1024 tokens.

    Null and empty texts are documents of the end token alone; repeated rows are packed one by one.
    """
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024, 2)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("minhash near-dedup", near_dedup),
    ("best-fit packing", best_fit_packing),
]

#: The classifier is learnt and the packing is greedy: not in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
