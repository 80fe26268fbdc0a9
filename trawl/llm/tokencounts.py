"""Token counts without token ids.

A document's count is the sum, over its distinct pre-tokens, of frequency times
number of pieces, and a pre-token has the same pieces everywhere.  So:

1. pre-tokens of the corpus are counted (per task first, then by a shuffle);
2. pieces are counted once per distinct pre-token: the piece table;
3. per-document frequencies are joined to the piece table and summed.

The join is split by frequency.  The most frequent pre-tokens, at most
`HOT_WORDS` of them, go to every task, longer ones than `HOT_CHARS` characters as
their SHA-256: that table's size is bounded by these parameters whatever the
corpus, and no hot key is ever shuffled, however long it is.  All other
pre-tokens, of any number, are joined by a shuffle.

Special strings inside texts count one token each, as the library's default has it.

Defined results: null and empty texts have 0 bytes and 0 tokens; texts of any
length are read in full, a single word or white space of millions of characters
included; repeated rows are counted one by one, rows without doc_id too; of ties
in frequency all or none are broadcast, with equal results; an empty table gives
no rows; other columns are dropped, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytelevel import piece_ids, split
from .common import batch_limits, written

HOT_WORDS, HOT_CHARS = 1 << 18, 64
#: Distinct pre-tokens, and characters of them, that a task holds before it passes them on.
HELD_WORDS, HELD_CHARS = 200_000, 1 << 24
#: Frequencies are told apart by this many steps per doubling when the hot ones are chosen.
STEPS = 8


def hot_key(word: str) -> str:
    """What stands for a pre-token in the table of the frequent ones."""
    return word if len(word) <= HOT_CHARS else "\0" + hashlib.sha256(word.encode()).hexdigest()


def hot_key_of(word: Column) -> Column:
    return F.when(F.char_length(word) <= HOT_CHARS, word).otherwise(F.concat(F.lit("\0"), F.sha2(word, 256)))


def corpus_words(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """(word, n): frequencies of all pre-tokens."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        held, chars = Counter(), 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                held.update(split(t, tokenizer)[0] if t else ())
                chars += len(t or "")
                if len(held) > HELD_WORDS or chars > HELD_CHARS and sum(map(len, held)) > HELD_CHARS:
                    yield out()
                    held.clear()
                chars = 0 if chars > HELD_CHARS else chars
        yield out()

    return docs.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def piece_table(words: DataFrame, tokenizer: str) -> DataFrame:
    """(word, n, pieces): pieces of each distinct pre-token."""

    def run(batches):
        for b in batches:
            found = [len(piece_ids(w, tokenizer)) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.int64())], ["word", "n", "pieces"])

    return words.mapInArrow(run, "word string, n long, pieces long")


def hot_words(pieces: DataFrame, limit: int = HOT_WORDS) -> dict[str, int]:
    """Pieces of the most frequent pre-tokens, at most `limit` of them."""
    step = F.floor(F.log2("n") * STEPS)
    levels = sorted(((r["step"], r["count"]) for r in pieces.groupBy(step.alias("step")).count().collect()), reverse=True)
    least, total = None, 0
    for level, n in levels:
        if total + n > limit:
            break
        least, total = level, total + n
    if least is None:
        return {}
    return {r["key"]: r["pieces"] for r in pieces.where(step >= least).select(hot_key_of(F.col("word")).alias("key"), "pieces").collect()}


def count_tokens(docs: DataFrame, tokenizer: str, hot: int = HOT_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row."""
    spark = docs.sparkSession
    batch_limits(spark)
    pieces = written(piece_table(corpus_words(docs, tokenizer, text), tokenizer), "pieces")
    known = spark.sparkContext.broadcast(hot_words(pieces, hot))
    kind = docs.schema[key].dataType

    def run(batches):
        table, serial = known.value, TaskContext.get().partitionId() << 40
        for b in batches:
            rows, sizes, sums, rare_rows, rare, times = [], [], [], [], [], []
            for t in b.column(1).to_pylist():
                serial += 1
                words, total = split(t, tokenizer) if t else ([], 0)
                for w, n in Counter(words).items():
                    got = table.get(w if len(w) <= HOT_CHARS else hot_key(w))
                    if got is None:
                        rare_rows.append(serial)
                        rare.append(w)
                        times.append(n)
                    else:
                        total += got * n
                rows.append(serial)
                sizes.append(len(t.encode()) if t else 0)
                sums.append(total)
            more = len(rare)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows + rare_rows, pa.int64()),
                    pa.chunked_array([b.column(0), pa.nulls(more, b.column(0).type)]).combine_chunks(),
                    pa.array(sizes + [None] * more, pa.int64()),
                    pa.array(sums + times, pa.int64()),
                    pa.array([None] * len(rows) + rare, pa.string()),
                ],
                ["serial", "doc_id", "n_bytes", "n", "word"],
            )

    found = written(docs.select(key, text).mapInArrow(run, f"serial long, doc_id {kind.simpleString()}, n_bytes long, n long, word string"), "frequencies")
    known.destroy()
    rest = found.where("word is not null").select("serial", "word", F.col("n").alias("times")).join(pieces.select("word", "pieces"), "word")
    rest = rest.groupBy("serial").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    return found.where("word is null").drop("word").join(rest, "serial", "left").select("doc_id", "n_bytes", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n_tokens"))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)
