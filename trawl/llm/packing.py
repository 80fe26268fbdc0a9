"""Best-fit packing of documents into sequences of a fixed number of tokens.

Only a document longer than a sequence is cut: into whole sequences from its
end, so that its first piece may be shorter.  Pieces are then packed best fit,
the longer ones first, in bulk-synchronous rounds over two range-sorted tables:
waiting pieces, as runs of equal length with their ranks (every piece gets its
rank within its length over all tasks at once, by `group_ranks`), and gaps at the
ends of open sequences, as runs of equal size.  A round

* takes the pieces of more than half of the longest waiting length;
* sweeps pieces and gaps in ranges of sizes, all ranges at once: in falling
  order, a piece takes its successor, the smallest gap that is large enough and
  that no longer piece has taken; what a range leaves over, gaps for smaller
  pieces and pieces for larger gaps, goes on to a range of `FAN` times the size,
  until one range holds all that is left.  That is best fit, range by range;
* resolves conflicts by rank: where more pieces than gaps of a size want a place,
  the lower ranks win, and the others go to the next larger gap;
* opens sequences for pieces without any gap: those longer than half a sequence
  one each, and for the others a share `OPEN` of what their tokens, less the gaps
  that could still take them, would fill;
* writes the gaps as they are now, and the pieces that still wait, for the next
  round, and notes the placements.

The rounds work on runs, of which there are few for each length a sequence can
have, so their cost has nothing to do with the number of documents.  They end as
each of them places or opens something; there are some tens.  The driver sees
three numbers a round.  At last every piece looks its place up by length and
rank, blocks of ranks apart, so that a length that very many pieces have is not
gathered.

Defined results: null and empty texts are documents of the end token alone;
texts of any length are read in full, white space of millions of characters
included; pieces of equal length are ranked by scan task, then doc_id, piece and
crc; repeated rows are packed one by one (under one doc_id), rows without doc_id
too; an empty table gives no rows; other columns are dropped, whatever their
names.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytelevel import ids_of
from .common import batch_limits, group_ranks, measured, part, small

#: Sizes in a range of the first sweep of a round, and ranges that the next sweep takes together.
FAN = 32
#: Share of the sequences that pieces without a gap would fill that a round opens.
OPEN = 0.5
#: Ranks in a block when places are looked up.
RANK_BLOCK = 1 << 16
#: Kinds of rows of a round: a gap, a waiting piece, a placement, a gap that this round has changed.
GAP, PIECE, PLACED, CHANGED = range(4)
NAMES = ["kind", "size", "first", "n", "sequence", "each", "offset"]
ROW = "kind int, size long, first long, n long, sequence long, each long, offset long"


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: whole sequences from the end, the first piece may be shorter."""
    head = length % capacity or min(length, capacity)
    return [(0, head)] + [(s, capacity) for s in range(head, length, capacity)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, keep_ids: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) for each piece of each tokenized document."""
    batch_limits(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def run(batches):
        for b in batches:
            row, piece, start, size, crc, kept = [], [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                ids = np.append(ids_of(t, tokenizer), end_id).astype("<u4")
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    row.append(i)
                    piece.append(k)
                    start.append(s)
                    size.append(n)
                    crc.append(zlib.crc32(ids[s : s + n].tobytes()))
                    if keep_ids:
                        kept.append(ids[s : s + n].astype("i4"))
            out = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                out.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    return docs.select(key, text).mapInArrow(run, schema)


class Sweep:
    """Best fit within one range of sizes: what is placed, which gaps change, what is left over."""

    def __init__(self, capacity: int):
        self.capacity, self.out = capacity, []

    def place(self, gap: int, sequence: int, gaps: int, length: int, rank: int, left: int) -> tuple[int, int]:
        """Fill up to `gaps` equal gaps with `left` pieces of a length, each as far as it goes; (gaps used, pieces placed)."""
        each, offset, used, placed = gap // length, self.capacity - gap, 0, 0
        for take, n in ((each, min(gaps, left // each)), (left % each, 1)):
            if take and n and used < gaps and placed < left:
                self.out.append((PLACED, length, rank + placed, take * n, sequence + used, take, offset))
                if gap > take * length:
                    self.out.append((CHANGED, gap - take * length, sequence + used, n, None, None, None))
                used, placed = used + n, placed + take * n
        return used, placed

    def run(self, rows: list[tuple]) -> tuple[list[tuple], list[tuple]]:
        """(gaps, pieces) left over of rows (kind, size, first, n, ...), in falling order of size."""
        free, over = [], []
        for kind, size, first, n, *_ in sorted(rows, key=lambda r: (-r[1], r[0], r[2])):
            if kind == GAP:
                free.append((size, first, n))
                continue
            while n and free:
                gap, sequence, gaps = free.pop()
                used, placed = self.place(gap, sequence, gaps, size, first, n)
                first, n = first + placed, n - placed
                if used < gaps:
                    free.append((gap, sequence + used, gaps - used))
            if n:
                over.append((PIECE, size, first, n, None, None, None))
        return [(GAP, *g, None, None, None) for g in free], over

    def open(self, pieces: list[tuple], opened: int) -> list[tuple]:
        """Open sequences for pieces without a gap, longest first; those that wait on."""
        most, waiting = None, []
        for at, (kind, size, first, n, *rest) in enumerate(pieces):
            if 2 * size > self.capacity:
                gaps = n
            else:
                if most is None:  # once the long ones have theirs
                    usable = sum(r[1] * r[3] for r in self.out if r[0] == CHANGED and r[1] >= pieces[-1][1])
                    most = max(0, math.ceil(OPEN * (sum(r[1] * r[3] for r in pieces[at:]) - usable) / self.capacity))
                gaps = min(most, math.ceil(n / (self.capacity // size)))
                most -= gaps
            used, placed = self.place(self.capacity, opened, gaps, size, first, n) if gaps else (0, 0)
            opened += used
            if placed < n:
                waiting.append((kind, size, first + placed, n - placed, *rest))
        return waiting


def swept(state: DataFrame, capacity: int, least: int, opened: int) -> DataFrame:
    """One round over (kind, ...) rows: pieces of more than `least` tokens are placed."""

    def sweep_of(last: bool):
        def run(table: pa.Table) -> pa.Table:
            rows = list(zip(*(table.column(n).to_pylist() for n in NAMES), strict=True))
            sweep = Sweep(capacity)
            taking = [r[0] == GAP or (r[0] == PIECE and r[1] > least) for r in rows]
            free, over = sweep.run([r for r, t in zip(rows, taking, strict=True) if t])
            sweep.out += [r for r, t in zip(rows, taking, strict=True) if not t]
            done = [*(sweep.open(over, opened) if last else over), *free, *sweep.out]
            return pa.table([pa.array([r[i] for r in done], pa.int64() if i else pa.int32()) for i in range(len(NAMES))], NAMES)

        return run

    width = 1
    while width < capacity or width == 1:
        width *= FAN
        state = state.groupBy(F.floor((F.col("size") - 1) / width).alias("range")).applyInArrow(sweep_of(width >= capacity), ROW)
    return state


def rounds(counts: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """(to_length, first, last, sequence0, each, offset0): the places of all ranks of each length; and how many rows.  counts: (length, n)."""
    none = F.lit(None).cast("long")
    sums = [
        F.max(F.when(F.col("kind") == PIECE, F.col("size"))).alias("longest"),
        F.max(F.when(F.col("kind") == PLACED, F.col("sequence") + F.ceil(F.col("n") / F.col("each")))).alias("opened"),
        F.count_if(F.col("kind") == PLACED).alias("placed"),
    ]
    first = counts.select(F.lit(PIECE).alias("kind"), F.col("length").alias("size"), F.lit(0).cast("long").alias("first"), "n", none.alias("sequence"), none.alias("each"), none.alias("offset"))
    table, seen = measured(first, "round", *sums)
    tables, opened, placed = [table], 0, 0
    while seen["longest"]:
        state = table.where(F.col("kind") != PLACED).withColumn("kind", F.when(F.col("kind") == PIECE, PIECE).otherwise(GAP))
        table, seen = measured(swept(state, capacity, seen["longest"] // 2, opened), "round", *sums)
        tables.append(table)
        opened, placed = max(opened, seen["opened"] or 0), placed + seen["placed"]
    found = tables[0]
    for t in tables[1:]:
        found = found.union(t)
    found = found.where(F.col("kind") == PLACED)
    return found.select(F.col("size").alias("to_length"), "first", (F.col("first") + F.col("n") - 1).alias("last"), F.col("sequence").alias("sequence0"), "each", F.col("offset").alias("offset0")), placed


def pack(parts: DataFrame, capacity: int) -> DataFrame:
    """Every row of parts (doc_id, piece, length, ...), with sequence_id and offset."""
    held, seen = measured(parts.withColumn("scan_part", part().cast("long")), "pieces")
    ranked, counts = group_ranks(held, "length", "scan_part", ["doc_id", "piece", "ids_crc32"], seen["n"], "rank")
    plan, runs = rounds(counts, capacity)
    plan = plan.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / RANK_BLOCK), F.floor(F.col("last") / RANK_BLOCK))))
    at = F.col("rank") - F.col("first")
    same = (F.col("length") == F.col("to_length")) & (F.floor(F.col("rank") / RANK_BLOCK) == F.col("block"))
    return (
        ranked.join(small(plan, runs + math.ceil(seen["n"] / RANK_BLOCK)), same & F.col("rank").between(F.col("first"), F.col("last")))
        .withColumn("sequence_id", F.col("sequence0") + F.floor(at / F.col("each")))
        .withColumn("offset", F.col("offset0") + at % F.col("each") * F.col("length"))
        .drop("to_length", "first", "last", "sequence0", "each", "offset0", "block", "rank", "scan_part")
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    return pack(pieces(docs, tokenizer, capacity, end_id, keep_ids), capacity)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024, 2).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
