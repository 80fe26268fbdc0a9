"""JSON lists in files of any size: the items of a list, read by many tasks side by side.

The text reader cuts files into splits, at a closing brace each.  A split cannot
know whether it begins inside a string, or how deep: a first pass says for both
cases what the split does to that (quotes and brackets it holds), and sums over
the splits before give each split's own beginning.  The second pass cuts the
items out.  Those that lie in one split are done there; the ends that cross
borders, two for each split at most, are put together by their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import written

#: Bytes that are looked at together.
CHUNK = 4 << 20
QUOTE, BACKSLASH, COMMA = (ord(c) for c in '"\\,')
#: What may stand around a list: blanks, and a byte order mark.
AROUND = b" \t\r\n\xef\xbb\xbf"
_STEP = np.zeros(256, np.int8)
_STEP[[ord("["), ord("{")]], _STEP[[ord("]"), ord("}")]] = 1, -1


def marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of quotes up to each byte, depth change at each byte whatever strings there are); escaped quotes don't count."""
    quote = data == QUOTE
    slash = data == BACKSLASH
    if slash.any():
        edge = np.diff(np.concatenate([[0], slash.view(np.int8), [0]]))
        first, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        odd = stop[(stop - first) % 2 == 1]
        quote[odd[odd < len(data)]] = False
    return np.cumsum(quote), _STEP[data]


def effect(data: bytes) -> tuple[int, int, int]:
    """(parity of quotes, change of depth if the data begins outside a string, if inside)."""
    seen, step = marks(np.frombuffer(data, np.uint8))
    inside = seen % 2
    total = int(step.sum(dtype=np.int64))
    within = int(step[inside == 1].sum(dtype=np.int64))
    return int(seen[-1] % 2) if len(data) else 0, total - within, within


class Cutter:
    """Cuts the items of a list out of one split's chunks, from the split's own beginning."""

    def __init__(self, inside: int, depth: int):
        self.inside, self.depth = inside, depth
        self.begun = 0  # items that begin here; 0 stands for the one that began before
        self.held: list[bytes] = []
        self.strange = False

    def feed(self, data: bytes) -> Iterator[tuple[int, bytes, bool]]:
        """(item number, text, whether that is its end) of what ends in this data."""
        raw = np.frombuffer(data, np.uint8)
        seen, step = marks(raw)
        outside = (seen + self.inside) % 2 == 0
        depth = self.depth + np.cumsum(np.where(outside, step, 0), dtype=np.int64)
        opened = outside & (step == 1) & (depth == 1)
        closed = outside & (step == -1) & (depth == 0)
        border = opened | closed | (outside & (raw == COMMA) & (depth == 1))
        at, within = 0, self.depth > 0
        for p in np.flatnonzero(border).tolist():
            if opened[p]:
                self.strange |= raw[p] != ord("[") or bool(data[at:p].strip(AROUND))
                self.begun, within = self.begun + 1, True
            else:
                yield self.begun, b"".join([*self.held, data[at:p]]), True
                self.held = []
                within = not closed[p]
                if within:
                    self.begun += 1
            at = p + 1
        rest = data[at:]
        if within:
            self.held.append(rest)
        elif rest.strip(AROUND + b"}"):  # that brace is one we have added
            self.strange = True  # something after or before the list
        if len(seen):
            self.inside, self.depth = int((seen[-1] + self.inside) % 2), int(depth[-1])

    def rest(self) -> bytes | None:
        found = b"".join(self.held)
        return found if self.depth > 0 else None


def _chunks(batches) -> Iterator[tuple[tuple, bytes]]:
    """(split, data) from rows (split..., piece) in order: pieces put together again, in chunks that end after a brace."""
    split, held, size = None, [], 0
    for b in batches:
        columns = [c.to_pylist() for c in b.columns]
        for *own, piece in zip(*columns, strict=True):
            if split is not None and (tuple(own) != split or size >= CHUNK):
                yield split, b"".join(held)
                held, size = [], 0
            split = tuple(own)
            data = piece.encode("utf-8", "surrogatepass") + b"}"
            held.append(data)
            size += len(data)
    if split is not None:
        yield split, b"".join(held)


def read_items(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(source_file, position, item): the items of the lists in a folder's files, in the order of each; raises where a file is not a JSON list."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}")
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) or ()
    if not len(files):
        raise FileNotFoundError(f"no {pattern} in {folder}")
    if empty := [f.getPath().getName() for f in files if not f.getLen()]:  # the reader passes over these
        raise ValueError(f"expected a JSON list in {empty[0]}")
    lines = spark.read.option("pathGlobFilter", pattern).option("lineSep", "}").text(folder)
    pieces = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")

    def effects(batches):
        own: dict[tuple, list[int]] = {}
        for split, data in _chunks(batches):
            parity, out, within = effect(data)
            s = own.setdefault(split, [0, 0, 0])
            if s[0]:  # what is outside from here on is inside if the split begins outside
                out, within = within, out
            own[split] = [s[0] ^ parity, s[1] + out, s[2] + within]
        columns = list(zip(*((*k, *v) for k, v in own.items()), strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.string(), pa.int64()] + [pa.int64()] * 3, strict=True)], ["path", "file", "start", "parity", "out", "within"])

    found = written(pieces.mapInArrow(effects, "path string, file string, start long, parity long, out long, within long"), "splits")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split of a file
    known = found.withColumn("inside", F.coalesce(F.sum("parity").over(before), F.lit(0)) % 2)
    known = known.withColumn("change", F.when(F.col("inside") == 1, F.col("within")).otherwise(F.col("out")))
    known = known.select(F.col("path").alias("p"), F.col("start").alias("s"), "inside", F.coalesce(F.sum("change").over(before), F.lit(0)).alias("depth"))
    begun = pieces.join(F.broadcast(known), (F.col("path") == F.col("p")) & (F.col("start") == F.col("s")))

    def cut(batches):
        split, cutter, out = None, None, []

        def ended():
            if cutter is not None:
                rest = cutter.rest()
                if rest is not None:
                    yield (*split[:3], cutter.begun, rest, False, cutter.strange)
                elif cutter.strange:
                    yield (*split[:3], cutter.begun, b"", True, True)

        for now, data in _chunks(batches):
            if split != now:
                out += ended()
                split, cutter = now, Cutter(*now[3:])
            for n, text, _ in cutter.feed(data):
                out.append((*split[:3], n, text, True, False))
            if len(out) >= 256:
                yield _rows(out)
                out = []
        out += ended()
        yield _rows(out)

    kinds = "path string, file string, start long, n long, text string, ended boolean, strange boolean"
    parts = written(begun.select("path", "file", "start", "inside", "depth", "value").mapInArrow(cut, kinds), "items")
    counts = parts.groupBy(F.col("path").alias("p"), F.col("start").alias("s")).agg(F.max("n").alias("n"), F.max("strange").alias("strange"))
    # splits without a border of items have no row; they hold no beginning either
    all_splits = found.select(F.col("path").alias("p"), F.col("start").alias("s")).join(counts, ["p", "s"], "left").na.fill(0, ["n"]).na.fill(False, ["strange"])
    earlier = Window.partitionBy("p").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    starts = all_splits.select("p", "s", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ends = known.join(found.select(F.col("path").alias("fp"), F.col("start").alias("fs"), "file", "parity", "out", "within"), (F.col("p") == F.col("fp")) & (F.col("s") == F.col("fs")))
    last = ends.groupBy("p", "file").agg(F.max_by(F.struct(((F.col("inside") + F.col("parity")) % 2).alias("inside"), (F.col("depth") + F.when(F.col("inside") == 1, F.col("within")).otherwise(F.col("out"))).alias("depth")), "s").alias("end"))
    bad = last.join(counts.groupBy(F.col("p").alias("cp")).agg(F.max("strange").alias("strange"), F.sum("n").alias("items")), F.col("p") == F.col("cp"), "left")
    # a brace is added after the last piece: a list that is whole ends one below
    bad = bad.where((F.col("end.inside") != 0) | ~F.col("end.depth").isin(-1) | F.coalesce("strange", F.lit(False)) | (F.coalesce("items", F.lit(0)) == 0)).select("file").limit(1).collect()
    if bad:
        raise ValueError(f"expected a JSON list in {bad[0]['file']}")
    numbered = parts.where("not strange").join(F.broadcast(starts), (F.col("path") == F.col("p")) & (F.col("start") == F.col("s"))).withColumn("position", F.col("before") + F.col("n") - 1)
    crossing = (F.col("n") == 0) | ~F.col("ended")
    whole = numbered.where(~crossing).select(F.col("file").alias("source_file"), "position", F.col("text").alias("item"))
    joined = numbered.where(crossing).groupBy("path", F.col("file").alias("source_file"), "position").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "").alias("item"))
    return whole.unionByName(joined.select("source_file", "position", "item"))


def _rows(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) or [[]] * 7
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
    columns[4] = [t.decode("utf-8", "surrogatepass") for t in columns[4]]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "file", "start", "n", "text", "ended", "strange"])
