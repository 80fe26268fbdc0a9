"""Embeddings: encoding chunks, exact nearest neighbours by cosine."""

from __future__ import annotations

import hashlib
import json
import os
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .inverted import kept


class Encoder(Protocol):
    """Anything that turns texts into vectors; it is shipped to the workers."""

    name: str
    size: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEncoder:
    """Feature hashing of words: the encoder that needs no model."""

    def __init__(self, size: int = 256):
        self.name, self.size = "hashing", size

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in text.casefold().split():
                h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little")
                row[h % self.size] += 1.0 if h >> 63 else -1.0
        return out


class ModelEncoder:
    """A local model: a folder with tokenizer.json and either embeddings.npy (a vector for each token id) or model.onnx.

    Vectors are means over all of a text's tokens; a model sees `window` tokens at a time, and the means of a text's
    windows count by their tokens, so nothing of a text is left out.  The folder is read by each worker, once; it has to
    be where workers can read it.
    """

    def __init__(self, folder: str, window: int = 512):
        self.name, self.folder, self.window, self._model = os.path.basename(os.path.normpath(folder)), folder, window, None
        self.size = int(self.encode(["size"]).shape[1])

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_model": None}

    def _load(self) -> tuple:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(os.path.join(self.folder, "tokenizer.json"))
        tokenizer.no_truncation()
        tokenizer.no_padding()
        table = os.path.join(self.folder, "embeddings.npy")
        if os.path.exists(table):
            return tokenizer, np.load(table, mmap_mode="r"), None
        import onnxruntime

        return tokenizer, None, onnxruntime.InferenceSession(os.path.join(self.folder, "model.onnx"), providers=["CPUExecutionProvider"])

    def encode(self, texts: list[str]) -> np.ndarray:
        self._model = self._model or self._load()
        tokenizer, table, session = self._model
        ids = [e.ids for e in tokenizer.encode_batch(texts)]
        if table is not None:
            return np.stack([np.asarray(table[i], np.float32).mean(axis=0) if i else np.zeros(table.shape[1], np.float32) for i in ids])
        windows = [(k, i[at : at + self.window]) for k, i in enumerate(ids) for at in range(0, max(len(i), 1), self.window)]
        out = None
        for at in range(0, len(windows), max(len(texts), 1)):  # as many at a time as there are texts
            some = windows[at : at + max(len(texts), 1)]
            mask = np.zeros((len(some), max(max(len(i) for _, i in some), 1)), np.int64)
            padded = np.zeros_like(mask)
            for row, (_, i) in enumerate(some):
                mask[row, : len(i)], padded[row, : len(i)] = 1, i
            known = {"input_ids": padded, "attention_mask": mask, "token_type_ids": np.zeros_like(mask)}
            hidden = session.run(None, {i.name: known[i.name] for i in session.get_inputs()})[0]
            sums = hidden * mask.sum(axis=1, keepdims=True) if hidden.ndim == 2 else (hidden * mask[:, :, None]).sum(axis=1)
            out = np.zeros((len(texts), sums.shape[1])) if out is None else out
            np.add.at(out, [k for k, _ in some], sums)
        return (out / np.maximum([[len(i)] for i in ids], 1)).astype(np.float32)


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def embed(chunks: DataFrame, encoder: Encoder, roles: str = "user", most: int = 2400, batch: int = 64) -> DataFrame:
    """(chunk_id, embedding, and what searches filter by) of unit length for chunks of user messages, or of all."""
    rows, more = chunks if roles == "all" else chunks.where(F.col("role") == roles), kept(chunks)
    texts = rows.select("chunk_id", *more, F.concat("title", F.lit("\n\n"), X.shorten(F.col("text"), most)).alias("body"))

    def run(batches):
        for b in batches:
            body = b.column("body").to_pylist()
            parts = [unit(np.asarray(encoder.encode(body[i : i + batch]), np.float32)) for i in range(0, len(body), batch)]
            found = [v.tolist() for p in parts for v in p]
            yield pa.RecordBatch.from_arrays([b.column("chunk_id"), pa.array(found, pa.list_(pa.float32())), *map(b.column, more)], ["chunk_id", "embedding", *more])

    kinds = ", ".join(["chunk_id long", "embedding array<float>", *(f"{c} {chunks.schema[c].dataType.simpleString()}" for c in more)])
    return texts.mapInArrow(run, kinds)


def query_vector(encoder: Encoder, query: str) -> list[float]:
    vector = np.asarray(encoder.encode([query]), np.float32)[0]
    norm = float(np.linalg.norm(vector))
    return [float(x) for x in (vector / norm if norm else vector)]


def dot(one: Column, vector: list[float]) -> Column:
    """Inner product with a fixed vector, added up in double precision."""
    other = F.from_json(F.lit(json.dumps([float(x) for x in vector])), "array<double>")  # folded to a constant
    return F.aggregate(F.zip_with(one, other, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda total, x: total + x)


def nearest(vectors: DataFrame, vector: list[float], most: int, key: str = "chunk_id", *more: str) -> DataFrame:
    """(key, more, similarity, rank) of the most similar; ties by key.  Each task keeps `most` rows, no more are merged."""
    top = vectors.select(key, *more, dot(F.col("embedding"), vector).alias("similarity")).orderBy(F.desc("similarity"), key).limit(most)
    return with_rank(top, [F.desc("similarity"), F.col(key)])


def with_rank(top: DataFrame, order: list[Column]) -> DataFrame:
    """Ranks from 1 over a result that a limit has bounded."""
    from pyspark.sql import Window

    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def nearest_filtered(vectors: DataFrame, vector: list[float], most: int, condition: Column, key: str = "chunk_id", *more: str) -> DataFrame:
    """The plain search's way: three times as many, then the filter on `more` and the key, then the first `most`; ranks count what is left."""
    wide = nearest(vectors, vector, 3 * most, key, *more).withColumnRenamed("rank", "raw_rank")
    return with_rank(wide.where(condition).orderBy("raw_rank").limit(most), [F.col("raw_rank")]).drop("raw_rank")
