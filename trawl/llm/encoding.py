"""BPE encoding and decoding of whole texts (see bpe.py for the transducer).

Defined results: null or empty text has no ids, and its decoded text is empty;
texts of any length are read in full, in pieces, words of any length through a
window; a stretch of a text without space or line end is held as one piece;
repeated rows give repeated results, rows without doc_id too; there are no ties
but between equal merges, which the merge list orders; an empty table gives no
rows; other columns are dropped, whatever their names.  Ids in `ids` (encode) are arrays of integers; `decode`
takes any such column, null as no ids; unknown ids are passed over, as the
library does.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe
from .common import batch_limits

#: Ids decoded at a time.
BLOCK_IDS = 1 << 15


def ids_of(text: str | None, path: str) -> bytes:
    return b"".join(bpe.encoder(path).encode(text)) if text else b""


def encode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) for every row."""
    batch_limits(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            ids = [np.frombuffer(ids_of(t, tokenizer), "<u4").astype("i4") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str, form: str = "library", key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) from id arrays."""
    batch_limits(encoded.sparkSession)
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches):
        machine = bpe.decoder(tokenizer, form)
        for b in batches:
            texts = [machine.feed(row or ()) + machine.finish() for row in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [key, "text"])

    return encoded.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")


def digests(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): each text encoded and its ids decoded again, neither of them kept."""
    batch_limits(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        machine = bpe.decoder(tokenizer, "library")
        for b in batches:
            counts, first, second = [], [], []
            for t in b.column(1).to_pylist():
                ids = ids_of(t, tokenizer)
                back, view = hashlib.sha256(), memoryview(ids).cast("I")
                for at in range(0, len(view), BLOCK_IDS):
                    back.update(machine.feed(view[at : at + BLOCK_IDS].tolist()).encode("utf-8", "surrogatepass"))
                back.update(machine.finish().encode())
                counts.append(len(view))
                first.append(hashlib.sha256(ids).hexdigest())
                second.append(back.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(first), pa.array(second)], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))


assert sys.byteorder == "little", "ids are handed over in the machine's byte order"
