"""Vectors compressed to codes: product quantisation with codebooks from Yinyang Lloyd rounds.

Components become integers, vectors are cut into parts, and each part position
has a codebook.  The first assignment looks at every entry.  From then on each
vector keeps its code and, for each part and each group of entries, a lower
bound on the distance to the group's other entries.  When entries move, bounds
fall by the greatest drift of their group, and only groups whose bound does not
clear the distance to the vector's own entry are looked at again.  Bounds are
rounded downwards and only ever rule groups out; whatever is looked at is
compared by exact integer distances, so ties go to the lower index as they
would without bounds.

Each round is one pass over a written table of codes and bounds; a task adds up
its parts by entry, so that sums of a few thousand numbers meet, however many
vectors there are.

Defined results: rows whose vector is null or holds a null, an infinity or a NaN
are dropped, and so are rows whose vector has not the length of that of the
smallest id; integers saturate at +-2^24; parts differ by one component at most
where the length is no multiple of their number; fewer vectors than entries give
smaller codebooks.  Rows without an id come last in the order of ids, rows with
equal ids are ordered by their vectors; repeated rows each count and each get a
row; labels that are null are equal; an empty table gives no rows; other
columns are dropped, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_limits, released, small, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Groups of a codebook that keep one bound each.
GROUPS = 6
#: Greatest magnitude of an integer component: squared distances stay below 2^62.
MOST = 1 << 24
#: A bound is kept in half precision, cut by more than its rounding.
CUT, GREATEST = 1 - 2.0**-10, 60_000.0


@dataclass
class Books:
    """Codebooks by part position (entries x components, integers) and the group of each entry."""

    entries: list[np.ndarray]
    groups: list[np.ndarray]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for book in self.entries for x in book.ravel().tolist()).encode()).hexdigest()


def edges(length: int, parts: int) -> list[int]:
    return [p * length // parts for p in range(parts + 1)]


def quantised(rows: list[list[float]], scale: int = SCALE) -> np.ndarray:
    """Integers floor(scale * x), a row for each vector."""
    return np.clip(np.floor(np.asarray(rows, np.float64) * scale), -MOST, MOST).astype(np.int64)


def grouped(book: np.ndarray, groups: int = GROUPS, rounds: int = 5) -> np.ndarray:
    """A group for each entry: a few Lloyd rounds over the entries themselves.  Any grouping is right, a tight one rules out more."""
    k = min(groups, len(book))
    if not k:
        return np.zeros(0, np.int64)
    middle = book[np.linspace(0, len(book) - 1, k).astype(int)].astype(float)
    for _ in range(rounds):
        own = ((book[:, None] - middle[None]) ** 2).sum(-1).argmin(1)
        for g in range(k):
            if (own == g).any():
                middle[g] = book[own == g].mean(0)
    return own


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row to each entry."""
    return ((x[:, None] - book[None]) ** 2).sum(-1)


def kept_bound(squared: np.ndarray) -> np.ndarray:
    return np.minimum(np.sqrt(squared) * CUT, GREATEST).astype(np.float16)


FAR = np.iinfo(np.int64).max


def first_codes(x: np.ndarray, book: np.ndarray, group: np.ndarray, groups: int = GROUPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, squared distances, bounds by group) of one part of all rows, from every entry."""
    every = distances(x, book)
    code = every.argmin(1)  # the first of equals
    at = np.arange(len(x))
    own = every[at, code]
    every[at, code] = FAR
    low = np.full((len(x), groups), GREATEST, np.float16)
    for g in range(groups):
        if (of := group == g).any():
            low[:, g] = kept_bound(every[:, of].min(1))
    return code, own, low


def next_codes(x: np.ndarray, code: np.ndarray, low: np.ndarray, before: np.ndarray, book: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """As first_codes, from the codes and bounds for the entries `before`; last the number of bounds that failed."""
    drift = np.sqrt(((book - before) ** 2).sum(-1).astype(float))
    low = low.astype(float)
    own = ((x - book[code]) ** 2).sum(-1)
    reach = np.sqrt(own) * (1 + 1e-9)
    best, best_code = own.copy(), code.copy()
    looked = 0
    found = []
    for g in range(low.shape[1]):
        of = np.flatnonzero(group == g)
        if not len(of):
            continue
        low[:, g] -= drift[of].max() * (1 + 1e-9)
        rows = np.flatnonzero(low[:, g] <= reach)
        if not len(rows):
            continue
        looked += len(rows)
        near = distances(x[rows], book[of])
        near[of[None] == code[rows][:, None]] = FAR
        at = near.argmin(1)
        least = near[np.arange(len(rows)), at]
        near[np.arange(len(rows)), at] = FAR
        found.append((g, rows, of[at], least, near.min(1)))
        better = (least < best[rows]) | ((least == best[rows]) & (of[at] < best_code[rows]))
        best[rows[better]], best_code[rows[better]] = least[better], of[at][better]
    out = np.minimum(np.maximum(low, 0) * CUT, GREATEST).astype(np.float16)
    for g, rows, which, least, second in found:
        out[rows, g] = kept_bound(np.where(which == best_code[rows], second, least))
    moved = np.flatnonzero(best_code != code)
    g = group[code[moved]]  # the entry that was left is one of its group's others now
    out[moved, g] = np.minimum(out[moved, g], kept_bound(own[moved]))
    return best_code, best, out, looked


def _sums(totals: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
    rows = [(p, e, n, total) for p, (count, t) in enumerate(zip(counts, totals, strict=True)) for e, (n, total) in enumerate(zip(count.tolist(), t.tolist(), strict=True)) if n]
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["part", "entry", "n", "total"])


STATE = ("ints", "code", "low", "error")


def assigned(rows: DataFrame, books: Books, before: Books | None, length: int, parts: int, final: bool = False) -> DataFrame:
    """One pass: vectors with their codes and bounds, then each task's sums by part and entry (part is null for vectors).

    rows: (id, label, vector), or what an earlier pass returned for the books `before`.
    """
    cut = edges(length, parts)
    id_kind, label_kind = (rows.schema[c].dataType.simpleString() for c in ("id", "label"))

    def run(batches):
        totals = [np.zeros((len(b), cut[p + 1] - cut[p]), np.int64) for p, b in enumerate(books.entries)]
        counts = [np.zeros(len(b), np.int64) for b in books.entries]
        ends = None
        for b in batches:
            n = b.num_rows
            ends = b.slice(0, 0).select(["id", "label"])
            if not n:
                continue
            if before is None:
                x = quantised(b.column("vector").to_pylist())
            else:
                x = np.frombuffer(b"".join(b.column("ints").to_pylist()), "<i4").reshape(n, length).astype(np.int64)
                old = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(n, parts).astype(np.int64)
                bounds = np.frombuffer(b"".join(b.column("low").to_pylist()), np.float16).reshape(n, parts, GROUPS)
            code, low, error = np.zeros((n, parts), np.uint8), np.zeros((n, parts, GROUPS), np.float16), np.zeros(n, np.int64)
            for p in range(parts):
                part = x[:, cut[p] : cut[p + 1]]
                if before is None:
                    got, own, low[:, p] = first_codes(part, books.entries[p], books.groups[p])
                else:
                    got, own, low[:, p], _ = next_codes(part, old[:, p], bounds[:, p], before.entries[p], books.entries[p], books.groups[p])
                code[:, p] = got
                error += own
                if not final:
                    counts[p] += np.bincount(got, minlength=len(counts[p]))
                    np.add.at(totals[p], got, part)
            told = [] if final else [pa.array([r.tobytes() for r in a], pa.binary()) for a in (x.astype("<i4"), low)]
            codes = pa.array([r.tobytes() for r in code], pa.binary())
            yield _filled([b.column("id"), b.column("label")], codes, pa.array(error), told)
        if ends is not None and not final:
            yield _summed(ends, _sums(totals, counts))

    schema = f"id {id_kind}, label {label_kind}, code binary, error long" + ("" if final else ", ints binary, low binary, part int, entry int, n long, total array<long>")
    return rows.mapInArrow(run, schema)


def _filled(ends: list, codes: pa.Array, error: pa.Array, told: list) -> pa.RecordBatch:
    names = ["id", "label", "code", "error"]
    if not told:
        return pa.RecordBatch.from_arrays([*ends, codes, error], names)
    nothing = [pa.nulls(len(codes), t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays([*ends, codes, error, *told, *nothing], [*names, "ints", "low", "part", "entry", "n", "total"])


def _summed(ends: pa.RecordBatch, sums: pa.RecordBatch) -> pa.RecordBatch:
    n = sums.num_rows
    nothing = [pa.nulls(n, t) for t in (ends.schema.field(0).type, ends.schema.field(1).type, pa.binary(), pa.int64(), pa.binary(), pa.binary())]
    return pa.RecordBatch.from_arrays([*nothing, *sums.columns], ["id", "label", "code", "error", "ints", "low", "part", "entry", "n", "total"])


def moved(books: Books, table: DataFrame) -> Books:
    """Books with each entry at the floor of its parts' mean; unused entries stay."""
    each = table.where("part is not null").select("part", "entry", "n", F.posexplode("total").alias("at", "x"))
    sums = each.groupBy("part", "entry", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()  # parts x entries x components of a part
    entries = [b.copy() for b in books.entries]
    for r in sums:
        entries[r["part"]][r["entry"], r["at"]] = r["x"] // r["n"]
    return Books(entries, books.groups)


def usable(vectors: DataFrame, key: str, vector: str, label: str | None) -> DataFrame:
    """(id, label, vector) of the rows whose vector is whole."""
    told = F.lit(None).cast("int") if label is None else F.col(label)
    rows = vectors.select(F.col(key).alias("id"), told.alias("label"), F.col(vector).alias("vector"))
    strange = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("vector").isNotNull() & ~strange)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, key: str = "vec_id", vector: str = "embedding", label: str | None = "label") -> tuple[DataFrame, Books]:
    """((id, label, code binary, error) of every usable row, written; the final codebooks)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte a part: 1 to 256 entries")
    batch_limits(vectors.sparkSession)
    rows = usable(vectors, key, vector, label)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    length = len(first[0]["vector"]) if first else 0
    if any(len(r["vector"]) != length for r in first):
        first = rows.where(F.size("vector") == length).orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    seeds = quantised([r["vector"] for r in first]).reshape(len(first), length)
    cut = edges(length, parts)
    begun = [seeds[:, cut[p] : cut[p + 1]] for p in range(parts)]
    books, before = Books(begun, [grouped(b) for b in begun]), None
    table, source = rows.where(F.size("vector") == length), None
    for r in range(rounds + 1):
        last = r == rounds
        made = written(assigned(table, books, before, length, parts, last), "vector-codes")
        if source is not None:
            released(source)
        if not last:
            before, books = books, moved(books, made)
            source, table = made, made.where("part is null").select("id", "label", *STATE[:3])
    return made, books


def digests(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, code in hex, error, label_error, codebooks_sha256) of every usable row."""
    rows, books = compress(vectors, parts, entries, rounds, key, vector, label)
    sums = rows.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error"))
    n = sums.count()
    # joined by a hash, so that the rows of a hot label can be split where the sums are too many to be sent to all
    hashed = rows.withColumn("h", F.xxhash64("label"))
    sums = small(sums.withColumn("s", F.xxhash64("same")), n)
    joined = hashed.join(sums, (F.col("h") == F.col("s")) & F.col("label").eqNullSafe(F.col("same")))
    return joined.select(F.col("id").alias(key), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def restored(codes: DataFrame, books: Books, scale: int = SCALE) -> DataFrame:
    """(id, vector): what codes stand for, the middle of each integer cell."""
    tables = books.entries
    kind = codes.schema["id"].dataType

    def run(batches):
        for b in batches:
            rows = [np.concatenate([(t[c] + 0.5) / scale for t, c in zip(tables, code, strict=True)]).tolist() for code in b.column("code").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(rows, pa.list_(pa.float32()))], ["id", "vector"])

    return codes.select("id", "code").mapInArrow(run, T.StructType([T.StructField("id", kind), T.StructField("vector", T.ArrayType(T.FloatType()))]))


def query(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _assign(codebook: str) -> str:
    gap = " + ".join(f"(p.x{i} - c.x{i}) * (p.x{i} - c.x{i})" for i in range(1, 5))
    return f"SELECT vec_id, part, min(d) AS d, min_by(e, (d, e)) AS e FROM (SELECT p.vec_id, p.part, c.e, {gap} AS d FROM p JOIN {codebook} c USING (part)) GROUP BY vec_id, part"


def _update(codebook: str, codes: str) -> str:
    means = ", ".join(f"floor(sum(x{i}) / count(*)) AS m{i}" for i in range(1, 5))
    return f"""SELECT c.part, c.e, {", ".join(f"CAST(coalesce(m{i}, x{i}) AS BIGINT) AS x{i}" for i in range(1, 5))} FROM {codebook} c
  LEFT JOIN (SELECT a.part, a.e, {means} FROM {codes} a JOIN p USING (vec_id, part) GROUP BY a.part, a.e) s USING (part, e)"""


SQL = f"""WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, j AS part, v[4 * j + 1] AS x1, v[4 * j + 2] AS x2, v[4 * j + 3] AS x3, v[4 * j + 4] AS x4 FROM k, range(16) t(j)),
c0 AS MATERIALIZED (SELECT part, e, x1, x2, x3, x4 FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k) USING (vec_id) WHERE e < 64),
a0 AS MATERIALIZED ({_assign("c0")}), c1 AS MATERIALIZED ({_update("c0", "a0")}),
a1 AS MATERIALIZED ({_assign("c1")}), c2 AS MATERIALIZED ({_update("c1", "a1")}),
a2 AS MATERIALIZED ({_assign("c2")}),
books AS (SELECT sha256(string_agg(concat_ws(',', x1, x2, x3, x4), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c2),
r AS (SELECT vec_id, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY vec_id),
l AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM r JOIN k USING (vec_id) GROUP BY label)
SELECT vec_id, code, error, label_error, codebooks_sha256 FROM r JOIN k USING (vec_id) JOIN l ON l.label IS NOT DISTINCT FROM k.label, books"""
