"""Repeats among texts of any number: what contains what, and which are nearly the same."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.pytext import shingle_set
from ..scratch import released, written

#: Hits that leave a worker at a time, about.
FOUND_ROWS = 100_000
#: Characters of needles that one pass over the texts looks for, about.
PASS_CHARS = 32_000_000
#: Least share of shingles, and least length of a text inside another, as for episodes of one answer.
LEAST, INSIDE, WORDS = 0.88, 120, 5


def contained(forms: DataFrame, key: str, needles: DataFrame) -> DataFrame:
    """(key, id): which needles (id, needle) each form contains, in one pass for every PASS_CHARS characters of needles.

    The needles of a pass are one automaton, so a text is read once however many they are.
    """
    spark = forms.sparkSession
    _bounded_batches(spark)
    known = needles.where("needle <> ''")
    size = known.agg(F.sum(F.char_length("needle") + 16).alias("n")).first()["n"] or 0
    passes = math.ceil(size / PASS_CHARS)
    kind, id_kind = forms.schema[key].dataType.simpleString(), needles.schema["id"].dataType.simpleString()
    if not size:
        return forms.where(F.lit(False)).select(key, F.lit(None).cast(id_kind).alias("id"))
    found = None
    for k in range(passes):
        part = known.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == k)
        held = spark.sparkContext.broadcast([(r["id"], r["needle"]) for r in part.collect()])  # about PASS_CHARS characters

        def out(b, rows, ids):
            return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(ids, b.schema.field(0).type if kind == id_kind else pa.int64())], [key, "id"])

        def run(batches, held=held, out=out):
            import ahocorasick

            by_needle: dict[str, list] = {}
            for i, needle in held.value:
                by_needle.setdefault(needle, []).append(i)
            machine = ahocorasick.Automaton()
            for needle, ids in by_needle.items():
                machine.add_word(needle, ids)
            machine.make_automaton()
            for b in batches:
                rows, ids = [], []
                for i, text in enumerate(b.column(1).to_pylist()):
                    if text and by_needle:
                        for hit in {id(x): x for _, x in machine.iter(text)}.values():
                            rows += [i] * len(hit)
                            ids += hit
                    if len(rows) >= FOUND_ROWS:  # few texts may hold very many needles
                        yield out(b, rows, ids)
                        rows, ids = [], []
                yield out(b, rows, ids)

        pairs = forms.select(key, "form").mapInArrow(lambda batches, run=run: run(batches), f"`{key}` {kind}, id {id_kind}")
        found = pairs if found is None else found.union(pairs)
    return found


#: Rows and bytes of an Arrow batch of texts, where the session says nothing else.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
#: Shingles in a row of which the least is put into the index, and counters of shingles, 2 ** CELL_BITS of them, told in blocks.
RUN, CELL_BITS, BLOCK = 6, 22, 1 << 16
#: Bits of a table of all texts' anchors.
ANCHOR_BITS = 25
#: Bytes of a word that are read eight at a time.
WORD_BYTES = 32
#: Ids of texts up to which they are sent to every executor.
SENT_IDS = 1_000_000
#: What a shingle is to a text: one of its prefix, the least of a run, its anchor.
PREFIX, LEAST_OF_RUN, ANCHOR = 1, 2, 4
#: Words of 64 bits in each part of a sketch.
SKETCH = 4


def _bounded_batches(spark: SparkSession) -> None:
    """Bound what of many texts, or of long ones, is in a worker at a time; a single longer text is a batch by itself."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}", None) is None:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


_MIX, _STEP, _LENGTH = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15), np.uint64(0x94D049BB133111EB)


def _digests(forms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A digest for every place of WORDS words of each text, in order, one text after the other; where each text's begin, and the last's end; numbers of words.

    All words of the batch at once, eight bytes at a time: a word is what lies between single spaces.
    """
    forms = forms.cast(pa.large_string())
    bounds = np.frombuffer(forms.buffers()[1], np.int64)[forms.offset : forms.offset + len(forms) + 1]
    held = forms.buffers()[2]
    data = (np.zeros(0, np.uint8) if held is None else np.frombuffer(held, np.uint8))[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    spaces = np.flatnonzero(data == 32)
    at = np.searchsorted(spaces, bounds)
    words = np.diff(at) + 1
    ends = np.insert(spaces, at[1:], bounds[1:])
    first = np.cumsum(words) - words
    starts = np.empty_like(ends)
    starts[1:] = ends[:-1] + 1
    starts[first] = bounds[:-1]
    lengths = ends - starts
    eights = np.ndarray(data.size + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    single = lengths.astype(np.uint64) * _LENGTH
    for k in range(0, WORD_BYTES, 8):
        some = np.flatnonzero(lengths > k) if k else slice(None)
        read = eights[starts[some] + k] & masks[np.minimum(lengths[some] - k, 8)]
        read = (read ^ single[some]) * _MIX
        single[some] = read ^ (read >> np.uint64(32))
    for i in np.flatnonzero(lengths > WORD_BYTES):
        single[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    places = np.maximum(words - WORDS + 1, 0)
    found = np.zeros(max(single.size - WORDS + 1, 0), np.uint64)
    for k in range(WORDS):
        found = found * _STEP + single[k : k + found.size]
    whole = (np.arange(single.size) - np.repeat(first, words) < np.repeat(places, words))[: found.size]  # none over the end of a text
    found = found[whole]
    found = (found ^ (found >> np.uint64(31))) * _MIX
    return found ^ (found >> np.uint64(29)), np.concatenate([[0], np.cumsum(places)]), words


def _different(values: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different values of each text in order, their texts, and where each text's begin, and the last's end."""
    values = values.copy()
    for low, high in zip(places[:-1].tolist(), places[1:].tolist(), strict=True):
        values[low:high].sort()
    new = np.ones(values.size, bool)
    new[1:] = values[1:] != values[:-1]
    new[places[:-1][np.diff(places) > 0]] = True
    texts = np.repeat(np.arange(places.size - 1), np.diff(places))[new]
    return values[new], texts, np.searchsorted(texts, np.arange(places.size))


def _sketched(bodies: DataFrame) -> DataFrame:
    """(id, form, needle, sketch) of texts with a word: bits for the different shingles of a text, by which most pairs are ruled out without their texts; needle: a text of some length in few words.

    Texts without a word are left out here, as Spark would make a form once for a condition on it and once more for its value.

    A shingle has one of 64 * SKETCH bits.  The bits `odd` are of an odd number of shingles: where two texts differ in k
    shingles, k of these bits differ at most.  The bits `inner` have an inner shingle, the bits `all` any: what is inside a
    text has no inner bit that the text lacks.
    """
    kind = bodies.schema["id"].dataType.simpleString()
    names = [f"{part}{k}" for part in ("odd", "all", "inner") for k in range(SKETCH)]

    def run(batches):
        for b in batches:
            b = b.filter(pc.greater(pc.binary_length(b.column(1)), 0))
            digests, places, n = _digests(b.column(1))
            at = ((digests >> np.uint64(8)) % np.uint64(64 * SKETCH)).astype(np.int64)
            bits = np.zeros((b.num_rows, 3, 64 * SKETCH), bool)
            text = np.repeat(np.arange(b.num_rows), np.diff(places))
            bits[text, 1, at] = True
            inner = np.ones(at.size, bool)
            some = np.diff(places) > 0
            inner[places[:-1][some]] = inner[places[1:][some] - 1] = False
            bits[text[inner], 2, at[inner]] = True
            once, text, _ = _different(digests, places)
            at = ((once >> np.uint64(8)) % np.uint64(64 * SKETCH)).astype(np.int64)
            bits[:, 0] = np.bincount(text * 64 * SKETCH + at, minlength=b.num_rows * 64 * SKETCH).reshape(b.num_rows, -1) & 1
            sketches = np.packbits(bits.reshape(b.num_rows, -1), axis=1).view(np.int64)
            few = pa.array((n < WORDS + RUN + 1) & (pc.utf8_length(b.column(1)).to_numpy() >= INSIDE))
            needles = pc.if_else(few, b.column(1), pa.scalar(None, b.column(1).type))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), needles, *(pa.array(np.ascontiguousarray(w)) for w in sketches.T)], ["id", "form", "needle", *names])

    found = bodies.select("id", "form").mapInArrow(run, f"id {kind}, form string, needle string, " + ", ".join(f"{n} long" for n in names))
    return found.select("id", "form", "needle", F.struct(*names).alias("sketch"))


def _levels(bodies: DataFrame) -> np.ndarray:
    """For each cell of digests the bits of its number of texts: one byte for 2 ** CELL_BITS cells, whatever the size of the table.

    A task tells all of its counters, so there are two tasks for a core, however many files there are.
    """
    spark = bodies.sparkSession

    def count(batches):
        counts = np.zeros(1 << CELL_BITS, np.uint32)
        for b in batches:
            digests, places, _ = _digests(b.column(0))
            np.add.at(counts, _different((digests >> np.uint64(64 - CELL_BITS)).astype(np.int64), places)[0], np.uint32(1))
        for k in range(0, counts.size, BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array([k // BLOCK], pa.int32()), pa.array([counts[k : k + BLOCK].tobytes()], pa.binary())], ["block", "counts"])

    def add_up(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, counts in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                sums[block] = sums.get(block, 0) + np.frombuffer(counts.as_buffer(), np.uint32).astype(np.uint64)
        for block, total in sums.items():
            levels = np.frexp(total.astype(np.float64))[1].astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([levels.tobytes()], pa.binary())], ["block", "levels"])

    counted = bodies.select("form").coalesce(2 * spark.sparkContext.defaultParallelism).mapInArrow(count, "block int, counts binary")
    found = counted.repartition("block").mapInArrow(add_up, "block int, levels binary").toArrow()  # a byte a cell
    levels = np.zeros(1 << CELL_BITS, np.uint8)
    for block, part in zip(found["block"].to_pylist(), found["levels"], strict=True):
        levels[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(part.as_buffer(), np.uint8)
    return levels


def _ordered(digests: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Shingles in one order for all texts: those of few texts first."""
    return ((level[(digests >> np.uint64(64 - CELL_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(57)) | (digests >> np.uint64(7))).astype(np.int64)


def _anchors(ordered: np.ndarray, places: np.ndarray, forms: pa.Array) -> np.ndarray:
    """The least inner shingle of each text that can be looked for inside others, else -1."""
    found = np.full(len(forms), -1, np.int64)
    some = (np.diff(places) - 2 >= RUN) & (pc.utf8_length(forms).to_numpy() >= INSIDE)
    if some.any():
        ends = np.stack([places[:-1][some] + 1, places[1:][some] - 1], axis=1).ravel()
        found[some] = np.minimum.reduceat(ordered, ends)[::2]
    return found


def _anchor_bits(bodies: DataFrame, levels) -> np.ndarray:
    """A table of 2 ** ANCHOR_BITS bits, whatever the size of the table: only a shingle whose bit is set can be an anchor."""

    def run(batches):
        for b in batches:
            digests, places, _ = _digests(b.column(0))
            anchors = _anchors(_ordered(digests, levels.value), places, b.column(0))
            cells = np.unique(anchors[anchors >= 0] & ((1 << ANCHOR_BITS) - 1))
            yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32))], ["cell"])

    found = bodies.select("form").mapInArrow(run, "cell int").distinct().toArrow()  # a row a bit at most
    bits = np.zeros(1 << ANCHOR_BITS, bool)
    bits[found["cell"].to_numpy()] = True
    return np.packbits(bits)


def _least_of_runs(values: np.ndarray) -> np.ndarray:
    """The least of every RUN values in a row."""
    if values.size < RUN:
        return values[:0]
    found = values[: values.size - RUN + 1]
    for k in range(1, RUN):
        found = np.minimum(found, values[k : values.size - RUN + 1 + k])
    return found


def _marked(bodies: DataFrame) -> DataFrame:
    """(id, item, about): the shingles under which texts are looked up; about is 8 times the number of different shingles of the text, plus what the shingle is to it.

    The least of a run is told only where it can be some text's anchor.
    """
    spark = bodies.sparkSession
    levels = spark.sparkContext.broadcast(_levels(bodies))
    bits = spark.sparkContext.broadcast(_anchor_bits(bodies, levels))
    kind = bodies.schema["id"].dataType.simpleString()
    share = round(100 * LEAST)

    def run(batches):
        known = bits.value
        for b in batches:
            digests, places, _ = _digests(b.column(1))
            ordered = _ordered(digests, levels.value)
            anchors = _anchors(ordered, places, b.column(1))
            least = _least_of_runs(ordered)  # also over the ends of texts, left out below
            told = np.flatnonzero((known[(least & ((1 << ANCHOR_BITS) - 1)) >> 3] >> (7 - (least & 7)).astype(np.uint8)) & 1)
            text = np.searchsorted(places, told, "right") - 1
            inside = told + RUN <= places[text + 1]
            different, texts, places = _different(ordered, places)
            n = np.diff(places)
            prefix = np.where(n > 0, n - -(-share * n // 100) + 1, 0)
            first = np.arange(different.size) - places[texts] < prefix[texts]
            items, texts = np.concatenate([different[first], least[told][inside]]), np.concatenate([texts[first], text[inside]])
            flags = np.full(items.size, LEAST_OF_RUN)
            flags[: first.sum()] = PREFIX
            flags += (items == anchors[texts]) * ANCHOR
            order = np.lexsort((items, texts))
            items, texts, flags = items[order], texts[order], flags[order]
            new = np.ones(items.size, bool)
            new[1:] = (items[1:] != items[:-1]) | (texts[1:] != texts[:-1])
            if items.size:
                flags = np.bitwise_or.reduceat(flags, np.flatnonzero(new))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(texts[new])), pa.array(items[new]), pa.array(n[texts[new]] * 8 + flags)], ["id", "item", "about"])

    return bodies.select("id", "form").mapInArrow(run, f"id {kind}, item long, about long")


def _buckets(forms: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((id, form) of the different forms, (id, bucket, n, owner, sketch) of the buckets in which they meet, (one, two) of pairs that no bucket has).

    Shingles have one order for all texts: the number of texts in their cell, in
    powers of two, then their digest.  Two texts that share LEAST of their shingles
    share one among the first few of each, its prefix; no count by shingle is
    needed for that, so only prefixes leave a text.  A text inside another has in
    common with it every run of RUN inner shingles, so also the least of each
    run; the least of all is its anchor, and a text is looked up under the least
    of each of its runs.  A bucket is named by the texts in it, so that shingles with the
    same texts make one bucket.  A bucket below 0 is of an anchor, and its owners are the
    texts that have it as one.  Forms with too few words for a run are looked for as they are.
    """
    _bounded_batches(forms.sparkSession)
    bodies = written(_sketched(forms.groupBy("form").agg(F.min(key).alias("id"))), "forms")
    has = lambda flag: F.col("about").bitwiseAND(F.lit(flag)) > 0
    by_item = Window.partitionBy("item")
    counts = [F.count_if(has(flag)).over(by_item).alias(name) for name, flag in (("prefixes", PREFIX), ("leasts", LEAST_OF_RUN), ("anchors", ANCHOR))]
    texts = [F.bit_xor(F.when(has(flag), F.xxhash64("id", has(ANCHOR) if flag == LEAST_OF_RUN else F.lit(flag)))).over(by_item).alias(name) for name, flag in (("alike", PREFIX), ("inside", LEAST_OF_RUN))]
    met = _marked(bodies).select("*", *counts, *texts)
    alike = has(PREFIX) & (F.col("prefixes") > 1)
    inside = has(LEAST_OF_RUN) & (F.col("anchors") > 0) & (F.col("leasts") > 1)
    name = lambda *of: F.xxhash64(*of).bitwiseAND(F.lit((1 << 63) - 1))
    kinds = F.array_compact(F.array(F.when(alike, name("prefixes", "alike")), F.when(inside, -name("leasts", "inside") - 1)))
    rows = met.where(alike | inside).select("id", F.explode(kinds).alias("bucket"), F.shiftright("about", 3).alias("n"), has(ANCHOR).alias("owner"))
    rows = rows.withColumn("owner", F.col("owner") & (F.col("bucket") < 0)).repartition("id").distinct()
    rows = rows.join(bodies.select(F.col("id").alias("of"), F.col("sketch").alias("bits")), F.col("id") == F.col("of")).select("id", "bucket", "n", "owner", _sketch().alias("sketch"))
    few = bodies.where("needle is not null").select("id", "needle")
    found = contained(bodies.select(F.col("id").alias("of"), "form"), "of", few).where("of <> id")
    return bodies, written(rows, "buckets"), written(found.select(F.least("of", "id").alias("one"), F.greatest("of", "id").alias("two")).distinct(), "inside")


def _sketch() -> Column:
    """Of `bits` what pairs of a row's bucket are tested by: odd bits, or all bits and inner ones."""
    alike, bits = F.col("bucket") >= 0, lambda part, k: F.col(f"bits.{part}{k}")
    one = [F.when(alike, bits("odd", k)).otherwise(bits("all", k)).alias(f"one{k}") for k in range(SKETCH)]
    return F.struct(*one, *(F.when(~alike, bits("inner", k)).alias(f"two{k}") for k in range(SKETCH)))


def _possible(other: Callable[[str], Column]) -> Column:
    """Whether two texts of a bucket can be alike, or one inside the other, by their numbers of shingles and their sketches; other: a column of the other row."""
    n, m, own, theirs, owner, owns = F.col("n"), other("n"), F.col("sketch"), other("sketch"), F.col("owner"), other("owner")
    total = lambda words: reduce(add, map(F.bit_count, words))
    share, both = round(100 * LEAST), n + m
    # of `both` shingles, those in one text only are the part (1 - share) / (2 - (1 - share)) at most
    apart = total(own[f"one{k}"].bitwiseXOR(theirs[f"one{k}"]) for k in range(SKETCH))
    alike = (100 * F.least(n, m) >= share * F.greatest(n, m)) & (apart * (100 + share) <= (100 - share) * both)
    within = lambda a, b: F.coalesce(total(a[f"two{k}"].bitwiseAND(F.bitwise_not(b[f"one{k}"])) for k in range(SKETCH)) == 0, F.lit(True))
    return F.when(F.col("bucket") >= 0, alike).otherwise((owner & (n - 2 <= m) & within(own, theirs)) | (owns & (m - 2 <= n) & within(theirs, own)))


def _met(rows: DataFrame) -> DataFrame:
    """(one, two), one < two: prefixes meet prefixes, owners of an anchor meet all that are looked up under it."""
    return _pairs_met(rows).distinct()


def _pairs_met(rows: DataFrame) -> DataFrame:
    """As `_met`, a row for every bucket in which two texts meet."""
    own = rows.where("bucket >= 0 or owner")
    others = rows.select(F.col("id").alias("other"), F.col("bucket").alias("b"), F.struct("n", "owner", "sketch").alias("their"))
    once = F.when(F.col("bucket") >= 0, F.col("id") < F.col("other")).otherwise(F.col("id") != F.col("other"))
    pairs = own.join(others, (F.col("bucket") == F.col("b")) & once & _possible(lambda name: F.col(f"their.{name}")))
    return pairs.select(F.least("id", "other").alias("one"), F.greatest("id", "other").alias("two"))


def _nearly(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The pairs (one, two) whose forms are nearly the same, or one of which is inside the other."""
    pairs = written(pairs, "met")
    wanted = pairs.select(F.explode(F.array("one", "two")).alias("w")).distinct()
    if 2 * pairs.count() <= SENT_IDS:  # else all texts move
        wanted = F.broadcast(wanted)
    texts = written(bodies.select("id", "form").join(wanted, F.col("id") == F.col("w"), "left_semi"), "texts")
    both = pairs.join(texts.toDF("l", "l_form"), F.col("one") == F.col("l")).join(texts.toDF("r", "r_form"), F.col("two") == F.col("r"))
    return both.where(F.arrow_udf(_near, "boolean")("l_form", "r_form")).select("one", "two")


def _near(ones: pa.Array, twos: pa.Array) -> pa.Array:
    """The exact rule, for pairs whose digests or lengths do not rule them out; one pair at a time is out of Arrow's memory."""
    (left, from_, _), (right, to, _) = _digests(ones), _digests(twos)
    verdicts, last, one_digests, one_set = [], None, None, None
    for i, (one, two) in enumerate((a.as_py(), b.as_py()) for a, b in zip(ones, twos, strict=True)):
        if one != last:
            last, one_digests, one_set = one, np.unique(left[from_[i] : from_[i + 1]]), None
        short, long = sorted((one, two), key=len)
        near = len(short) >= INSIDE and short in long
        if not near:
            two_digests = np.unique(right[to[i] : to[i + 1]])
            same = np.intersect1d(one_digests, two_digests, assume_unique=True).size
            if same >= LEAST * (one_digests.size + two_digests.size - same):
                one_set = one_set or shingle_set(one, WORDS)
                two_set = shingle_set(two, WORDS)
                near = len(one_set & two_set) >= LEAST * len(one_set | two_set)
        verdicts.append(near)
    return pa.array(verdicts, pa.bool_())


def near_pairs(forms: DataFrame, key: str) -> DataFrame:
    """(one, two), one < two: least keys of different forms that are nearly the same, or of which one of some length is inside the other.

    Only pairs that meet in a bucket and whose numbers of shingles allow it are compared.  Null and empty forms are near nothing.
    """
    bodies, rows, within = _buckets(forms, key)
    return _nearly(_met(rows), bodies).union(within).distinct()


#: Meetings of pairs that sketches leave, for each row of a bucket, up to which buckets are compared whole; rows that are counted at least; pairs up to which sketches are asked.
PAIRS_A_ROW, FEW_ROWS, ASKED_PAIRS = 4, 10_000, 1 << 28


def near_kept(forms: DataFrame, key: str) -> DataFrame:
    """(key): the least keys of the different forms that a walk in the order of keys keeps, each nearly the same as none kept before it.

    Texts that could be alike share a bucket.  A round takes the texts that come
    first in all of their buckets: no text before them is open, so they are kept, and are compared with the others of
    their buckets, which closes their near duplicates.  A bucket of n texts costs n comparisons a round, not n * n,
    and a group of near copies is closed in one round, however large.  Once sketches leave few pairs in the open
    buckets, what is left is compared whole and walked by `kept_in_order`.  Texts that share a bucket but are not alike
    retire from it one a round; so that these are not waited for, each round doubles what is few.  Null and empty forms are not kept.
    """
    bodies, rows, within = _buckets(forms, key)
    # the few pairs that an automaton finds are buckets of two, with either as an owner
    pairs = within.select(F.explode(F.array("one", "two")).alias("id"), (-F.abs(F.xxhash64("one", "two")) - 1).alias("bucket"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("owner"), F.lit(None).cast(rows.schema["sketch"].dataType).alias("sketch"))
    open_rows, closed, patience = rows.union(pairs), None, 1
    while True:
        sizes = open_rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if("owner").alias("owners"))
        whole = F.when(F.col("bucket") >= 0, F.col("n") * (F.col("n") - 1) / 2).otherwise(F.col("n") * F.col("owners"))
        total = sizes.agg(F.sum("n").alias("rows"), F.sum(whole).alias("pairs")).first()
        few = patience * PAIRS_A_ROW * max(total["rows"] or 0, FEW_ROWS)
        if (total["pairs"] or 0) <= few or (total["pairs"] <= patience * ASKED_PAIRS and _pairs_met(open_rows).count() <= few):
            break
        patience *= 2
        leaders = open_rows.groupBy(F.col("bucket").alias("b")).agg(F.min_by(F.struct("id", "n", "owner", "sketch"), "id").alias("leader"))
        led = open_rows.join(leaders, F.col("bucket") == F.col("b")).select("id", "bucket", "n", "owner", "sketch", "leader")
        safe = written(led.groupBy(F.col("id").alias("safe")).agg(F.max(F.col("leader.id") < F.col("id")).alias("later")).where("not later").select("safe"), "safe")
        met = led.where((F.col("leader.id") != F.col("id")) & _possible(lambda name: F.col(f"leader.{name}")))
        met = met.select(F.col("leader.id").alias("one"), F.col("id").alias("two")).distinct().join(safe, F.col("one") == F.col("safe"), "left_semi")
        out = written(_nearly(met, bodies).select(F.col("two").alias("out")).distinct(), "closed")
        done = out.union(safe.select(F.col("safe").alias("out")))
        left = _several(open_rows.join(done, F.col("id") == F.col("out"), "left_anti"))
        released(rows)
        rows = open_rows = left
        closed = out if closed is None else closed.union(out)
    nodes = bodies.select("id")
    kept = nodes if closed is None else nodes.join(closed, F.col("id") == F.col("out"), "left_anti")
    return kept_in_order(_nearly(_met(open_rows), bodies), kept.withColumn("place", F.col("id")), "id", "place").select(F.col("id").alias(key))


def _several(rows: DataFrame) -> DataFrame:
    """(id, bucket, n, owner, sketch) in buckets of several, written."""
    again = rows.groupBy(F.col("bucket").alias("b")).agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    return written(rows.join(again, F.col("bucket") == F.col("b")).select("id", "bucket", "n", "owner", "sketch"), "buckets")


def kept_in_order(pairs: DataFrame, nodes: DataFrame, key: str, order: str) -> DataFrame:
    """The rows of nodes that a walk in `order` keeps, each that is a near duplicate of none kept before it.

    pairs: (one, two) of keys; order: a column of nodes with no ties among neighbours.  A round keeps
    every open node with no better open neighbour and closes the neighbours of those: what is kept is
    what the walk keeps, and a round costs two joins of the pairs that are open.  There are as many rounds
    as the longest run of ever better neighbours has steps, a few in graphs of copies.  Pairs of unknown
    keys and of a key with itself count for nothing.
    """
    known = nodes.select(F.col(key).alias("k"), F.col(order).alias("o"))
    known = known.groupBy("k").agg(F.min("o").alias("o"))
    both = pairs.select("one", "two").where("one <> two")
    placed = both.join(known.toDF("one", "o1"), "one").join(known.toDF("two", "o2"), "two")
    first = (F.col("o1") < F.col("o2")) | ((F.col("o1") == F.col("o2")) & (F.col("one") < F.col("two")))
    open_pairs = placed.select(F.when(first, F.col("one")).otherwise(F.col("two")).alias("better"), F.when(first, F.col("two")).otherwise(F.col("one")).alias("worse")).distinct()
    open_pairs, closed = written(open_pairs, "open-pairs"), None
    while not open_pairs.isEmpty():
        beaten = open_pairs.select(F.col("worse").alias("b")).distinct()
        safe = open_pairs.join(beaten, F.col("better") == F.col("b"), "left_anti")
        out = written(safe.select(F.col("worse").alias("out")).distinct(), "closed-nodes")
        left = open_pairs.join(out, F.col("worse") == F.col("out"), "left_anti").join(out, F.col("better") == F.col("out"), "left_anti")
        left = written(left, "open-pairs")
        released(open_pairs)
        open_pairs, closed = left, out if closed is None else closed.union(out)
    return nodes if closed is None else nodes.join(closed, F.col(key) == F.col("out"), "left_anti")
