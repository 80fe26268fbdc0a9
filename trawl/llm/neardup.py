"""Near-duplicate documents: MinHash, banding, verification, connected components.

A document's set has the hashes of its distinct word shingles.  Texts with
equal sets are one class, whose node is its least doc_id.

1. One pass over the texts: minima of many universal hash functions over each
   set, hashes of their bands, a digest of the set.  The bands are chosen so
   that a pair at the threshold shares none with a probability below `MISS`.
2. Nodes that share a band hash form a bucket; only nodes of one bucket are ever
   compared.  Buckets with the same nodes are one.  A node's weight is the size
   of all its buckets, and the heaviest node of a bucket is its centre.
3. Links are confirmed by signature and sketch, then on full sets.  A sketch has
   counts of the set's hashes by their low bits; two sets differ in as many
   hashes as their counts at least, so it rules out most pairs just below the
   threshold, and never a link.  First every node with the centres of its
   buckets; a centre's pairs may be split over tasks.  The links so found are
   made components.  Then, in buckets that still hold several components, nodes
   outside the centre's component with the nodes of other components, in blocks
   of bounded size: signatures and sketches go first, and sets are fetched only
   for nodes that these leave a partner.  Blocks are dealt by slim rows, which
   signatures or sets join after that.  Only links leave a block.
4. Components of the confirmed links, by contraction, large-star and small-star.

No bucket or component is gathered in one task, no cap is set on partners.  Two
different sets at the threshold are missed if they share no band (`MISS`), or if
their signatures agree in fewer positions than `SIGMAS` standard deviations below
the expected number (about 1e-9); both chances fall with higher similarity.
Within a bucket the work grows with the nodes outside the centre's component
times all its nodes, for signatures; nothing else does.

Defined results: null and empty texts, or texts without a word, have no
shingles and are linked with nothing; with fewer words than a shingle has, the
whole sequence is the only one; texts of any length are read in full; rows with
the same doc_id are one document, linked with all that any of its texts is
linked with; rows without doc_id have no component and are kept; an empty table
gives no rows; other columns are dropped (`deduplicated` keeps them, whatever
their names).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, anew, batch_limits, fresh, measured, released, small, written
from .components import components

#: Probability that a pair at the threshold shares no band.
MISS = 1e-6
#: Hash functions in a band.
ROWS = 6
#: Words remembered by one worker.
MEMO_WORDS = 1 << 18
#: Nodes of a block whose signatures are compared, and of one whose sets are; shingles of the latter; about.
BLOCK_SIGNATURES, BLOCK_SETS, BLOCK_SHINGLES = 250, 250, 400_000
#: Standard deviations below the threshold at which a signature rules a pair out.
SIGMAS = 6
#: Counts in a sketch, modulo 16; distances of two such counts by their difference.
COUNTS = 256
AWAY = np.minimum(np.arange(16), 16 - np.arange(16)).astype(np.uint8)


class Hashed(dict):
    """Word to 64-bit hash, with a bound on what it remembers."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


_hashed = Hashed()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text, A-Z in lower case, words between ASCII spaces."""
    words = text.encode().lower().split() if text else []  # bytes: only A-Z change, only ASCII spaces part
    if not words:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(_hashed.__getitem__, words), np.uint64, len(words))
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(ids.tobytes(), seed=len(words))], np.uint64)
    n = len(words) - size + 1
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = mixed(h + ids[k : k + n])
    return np.unique(h)


class MinHash:
    """`count` universal hash functions (multiply and add, odd factors), seeded."""

    def __init__(self, bands: int, rows: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)[:, None]

    def minima(self, items: np.ndarray) -> np.ndarray:
        least = None
        for at in range(0, len(items), 2048):
            m = (self.a * items[None, at : at + 2048] + self.b).min(axis=1)
            least = m if least is None else np.minimum(least, m)
        return least

    def bands_of(self, minima: np.ndarray) -> np.ndarray:
        h = np.arange(self.bands, dtype=np.uint64)
        for column in minima.reshape(self.bands, self.rows).T:
            h = mixed(h + column)
        return h.view(np.int64)

    @staticmethod
    def signature(minima: np.ndarray) -> bytes:
        return mixed(minima).astype(np.uint8).tobytes()  # low bits: the high ones of a minimum are nearly all zero


def sketch(items: np.ndarray) -> bytes:
    """Counts of a set's hashes by their low bits, modulo 16, two in a byte."""
    counts = (np.bincount((items & np.uint64(COUNTS - 1)).astype(np.int64), minlength=COUNTS) & 15).astype(np.uint8)
    return (counts[: COUNTS // 2] << 4 | counts[COUNTS // 2 :]).tobytes()


def apart(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """In how many hashes the set of one sketch differs from those of others, or each of one table from its row of another; at least."""
    return AWAY[(many - one) & 15].sum(axis=1, dtype=np.int64)


def bands_for(threshold: float, rows: int = ROWS) -> int:
    return math.ceil(math.log(MISS) / math.log1p(-(threshold**rows)))


def signed(docs: DataFrame, size: int, threshold: float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, digest, bands) of every row."""
    batch_limits(docs.sparkSession)
    kind, bands = docs.schema[key].dataType.simpleString(), bands_for(threshold)

    def run(batches):
        hashes = MinHash(bands, ROWS)
        for b in batches:
            n, digest, band = [], [], []
            for t in b.column(1).to_pylist():
                items = shingles(t, size)
                n.append(len(items))
                if len(items):
                    digest.append(xxhash.xxh3_128_digest(items.tobytes()))
                    band.append(hashes.bands_of(hashes.minima(items)))
                else:
                    for column in (digest, band):
                        column.append(None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(band, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "bands"]
            )

    return docs.select(key, text).mapInArrow(run, f"doc_id {kind}, n_shingles long, digest binary, bands array<long>")


def buckets(nodes: DataFrame, repeated: bool) -> DataFrame:
    """(bucket, node, centre, n): buckets of n nodes that share a band hash, two at least; of buckets with the same nodes the least.

    nodes: (node, bands); repeated: a node may have several rows.
    """
    slim = nodes.select("node", F.explode("bands").alias("bucket"))
    slim = slim.distinct() if repeated else slim
    sizes = slim.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(anew("bucket").alias("b"), "n")
    weight = F.sum("n").over(Window.partitionBy("node")).alias("weight")  # a node has one row for each band
    members = written(slim.join(sizes, anew("bucket") == F.col("b")).select("bucket", "node", weight), "members")
    heads = members.groupBy("bucket").agg(
        F.min(F.struct((-F.col("weight")).alias("w"), "node")).alias("best"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")
    )
    heads = heads.groupBy("n", "x", "y", F.col("best.node").alias("centre")).agg(F.min("bucket").alias("b"))
    found = written(members.join(heads, F.col("bucket") == F.col("b")).select("bucket", "node", "centre", "n"), "buckets")
    released(members)
    return found


def overlap(one: np.ndarray, many: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of a sorted set with others."""
    ends = np.cumsum([len(m) for m in many])
    flat = np.concatenate(many)
    at = np.searchsorted(one, flat)
    at[at == len(one)] = 0
    hit = np.concatenate([[0], np.cumsum(one[at] == flat)])
    return hit[ends] - hit[ends - [len(m) for m in many]]


class Pairs:
    """Confirms links between sets: by signature and sketch, then in full.  ratio: the threshold as (numerator, denominator)."""

    def __init__(self, ratio: tuple[int, int], hashes: int):
        self.num, self.den = ratio
        t = ratio[0] / ratio[1]
        self.floor = max(0.0, t - SIGMAS * math.sqrt(t * (1 - t) / hashes)) * hashes

    def left(self, sig: np.ndarray, counts: np.ndarray, size: int | np.ndarray, sigs: np.ndarray, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether signatures and sketches leave a link of one set with others, or of each of a table with its row of another."""
        near = (self.num + self.den) * apart(counts, others) <= (self.den - self.num) * (size + sizes)
        return near & ((sigs == sig).sum(axis=1) >= self.floor)

    def linked(self, items: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
        """Whether the one set is linked with each of the others."""
        both = overlap(items, sets)
        return self.den * both >= self.num * (np.array([len(s) for s in sets]) + len(items) - both)


def _signatures(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _sketches(column: pa.ChunkedArray) -> np.ndarray:
    packed = _signatures(column)
    return np.concatenate([packed >> 4, packed & 15], axis=1)


def _sizes(column: pa.ChunkedArray) -> np.ndarray:
    return np.array(column.to_pylist(), np.int64)


def _sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _paired(pairs: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
    """pairs (node, centre) with the columns of the node's set, and those of the centre's by the names c_..."""
    own = sets.select(F.col("node").alias("n"), *columns)
    other = sets.select(F.col("node").alias("c"), *(F.col(x).alias(f"c_{x}") for x in columns))
    return pairs.join(own, F.col("node") == F.col("n")).join(other, F.col("centre") == F.col("c")).drop("n", "c")


def signed_pairs(pairs: DataFrame, sets: DataFrame, ratio: tuple[int, int], hashes: int) -> DataFrame:
    """The pairs (node, centre) that their signatures and sketches do not rule out, written."""
    kind = sets.schema["node"].dataType.simpleString()

    def run(batches):
        test = Pairs(ratio, hashes)
        for b in batches:
            if b.num_rows:
                own, other = ((_signatures(b.column(f"{c}signature")), _sketches(b.column(f"{c}sketch")), _sizes(b.column(f"{c}n_shingles"))) for c in ("", "c_"))
                yield b.select(["node", "centre"]).filter(pa.array(test.left(*own, *other)))

    both = _paired(pairs, sets, ["n_shingles", "signature", "sketch"])
    return written(both.mapInArrow(run, f"node {kind}, centre {kind}").distinct(), "signed-pairs")


def centre_links(groups: DataFrame, sets: DataFrame, ratio: tuple[int, int], hashes: int) -> DataFrame:
    """(a, b): confirmed links between the centres of buckets and their members; sets leave their place only for pairs whose signatures and sketches agree enough."""
    pairs = signed_pairs(groups.where("node <> centre").select("node", "centre").distinct(), sets, ratio, hashes)
    kind = sets.schema["node"].dataType.simpleString()

    def run(batches):
        test = Pairs(ratio, hashes)
        for b in batches:
            columns = zip(*(_sets(b.column(n)) for n in ("items", "c_items")), strict=True)
            linked = pa.array([bool(test.linked(c_items, [items])[0]) for items, c_items in columns], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("centre").filter(linked), b.column("node").filter(linked)], ["a", "b"])

    return _paired(pairs, sets, ["items"]).mapInArrow(run, f"a {kind}, b {kind}")


def cells(rows: DataFrame, blocks, sets: DataFrame) -> DataFrame:
    """rows (bucket, node, asks, ...) dealt to (bucket, i, j), with the columns of sets by node: each node that asks meets each node of its bucket in one cell.

    blocks: from an aggregate function of a column of ones, or of any other, to the number of blocks.
    """
    asks = F.col("asks")
    sizes = rows.groupBy("bucket").agg(
        F.greatest(F.lit(1), blocks(lambda x: F.sum(x))).cast("int").alias("g_blocks"),
        F.greatest(F.lit(1), blocks(lambda x: F.sum(F.when(asks, x).otherwise(0)))).cast("int").alias("a_blocks"),
        F.max("asks").alias("any"),
    )
    wide = rows.join(sizes.where("any").select(anew("bucket").alias("b"), "g_blocks", "a_blocks"), anew("bucket") == F.col("b"))
    own = F.xxhash64("node")
    asked = wide.where(asks).withColumn("i", F.pmod(own, F.col("a_blocks")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("g_blocks") - 1)))
    given = wide.withColumn("j", F.pmod(own, F.col("g_blocks")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("a_blocks") - 1)))
    names = ["bucket", "i", "j", *(c for c in rows.columns if c not in ("bucket", "asks"))]
    both = asked.select(*names, F.lit(True).alias("asks")).union(given.select(*names, F.lit(False).alias("asks")))
    both = both.join(sets.withColumnRenamed("node", "s"), F.col("node") == F.col("s")).drop("s")
    # dealt anew: else cells would stay with a task of the join
    return both.repartition("bucket", "i", "j")


def possible(open_rows: DataFrame, sets: DataFrame, ratio: tuple[int, int], hashes: int) -> DataFrame:
    """(bucket, node, n_shingles): nodes with a partner in their bucket, in another component, that signatures and sketches do not rule out.

    Two nodes are compared in the least of the buckets they share only.  That one
    is there, as of buckets with the same nodes the least is kept.
    """

    def run(cell: pa.Table) -> pa.Table:
        test = Pairs(ratio, hashes)
        asks = np.array(cell.column("asks").to_pylist())
        sigs, counts, sizes = _signatures(cell.column("signature")), _sketches(cell.column("sketch")), _sizes(cell.column("n_shingles"))
        bucket = cell.column("bucket")[0].as_py()
        bands = cell.column("bands").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(sigs), -1)
        parts = cell.column("part").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        given, hit = np.flatnonzero(~asks), np.zeros(len(asks), bool)
        for i in np.flatnonzero(asks):
            others = given[parts[given] != parts[i]]
            least = np.where(bands[others] == bands[i], bands[others], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
            others = others[least == bucket]
            others = others[test.left(sigs[i], counts[i], sizes[i], sigs[others], counts[others], sizes[others])]
            hit[others] = True
            hit[i] |= bool(len(others))
        return cell.select(["bucket", "node", "n_shingles"]).filter(pa.array(hit))

    kind = open_rows.schema["node"].dataType.simpleString()
    dealt = cells(open_rows, lambda total: F.ceil(total(F.lit(1)) / BLOCK_SIGNATURES), sets.select("node", "n_shingles", "bands", "signature", "sketch"))
    found = dealt.groupBy("bucket", "i", "j").applyInArrow(run, f"bucket long, node {kind}, n_shingles long")
    return found.groupBy("bucket", "node").agg(F.max("n_shingles").alias("n_shingles"))


def block_links(rows: DataFrame, sets: DataFrame, ratio: tuple[int, int], hashes: int) -> DataFrame:
    """(a, b): confirmed links of nodes that ask with nodes of other components of their bucket; rows: (bucket, node, part, asks, n_shingles)."""

    def run(cell: pa.Table) -> pa.Table:
        test, found = Pairs(ratio, hashes), []
        nodes, items, sizes = cell.column("node").to_pylist(), _sets(cell.column("items")), _sizes(cell.column("size"))
        sigs, counts = _signatures(cell.column("signature")), _sketches(cell.column("sketch"))
        asks = np.array(cell.column("asks").to_pylist())
        part = cell.column("part").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).copy()
        given = np.flatnonzero(~asks)
        for i in np.flatnonzero(asks):
            others = given[part[given] != part[i]]
            others = others[test.left(sigs[i], counts[i], sizes[i], sigs[others], counts[others], sizes[others])]
            hits = others[test.linked(items[i], [items[k] for k in others])] if len(others) else others
            for other, k in dict(zip(part[hits].tolist(), hits.tolist(), strict=True)).items():  # one link to each component
                found.append((nodes[i], nodes[k]))
                part[part == other] = part[i]
        kind = cell.schema.field("node").type
        return pa.table([pa.array([a for a, _ in found], kind), pa.array([b for _, b in found], kind)], ["a", "b"])

    kind = rows.schema["node"].dataType.simpleString()
    sets = sets.select("node", F.col("n_shingles").alias("size"), "signature", "sketch", "items")
    dealt = cells(rows, lambda total: F.greatest(F.ceil(total(F.lit(1)) / BLOCK_SETS), F.ceil(total(F.col("n_shingles")) / BLOCK_SHINGLES)), sets)
    return dealt.groupBy("bucket", "i", "j").applyInArrow(run, f"a {kind}, b {kind}")


def remaining_links(groups: DataFrame, found: DataFrame, sets: DataFrame, ratio: tuple[int, int], hashes: int) -> tuple[DataFrame, int]:
    """(a, b): links between the components `found` so far, within buckets; and how many."""
    wide = groups.where("n > 2").join(found.withColumnRenamed("node", "f"), F.col("node") == F.col("f"), "left")  # of two nodes one is the centre
    wide = written(wide.select("bucket", "node", "centre", F.coalesce("component", "node").alias("part")), "labelled")
    heads = wide.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.max(F.when(F.col("node") == F.col("centre"), F.col("part"))).alias("main"))
    heads = heads.where("low <> high").select(anew("bucket").alias("b"), "main")
    rows = wide.join(heads, anew("bucket") == F.col("b")).select("bucket", "node", "part", (F.col("part") != F.col("main")).alias("asks"))
    rows, seen = measured(rows, "open")
    if not seen["n"]:
        return rows.select(F.col("node").alias("a"), F.col("part").alias("b")), 0
    chosen, few = measured(possible(rows, sets, ratio, hashes).withColumnsRenamed({"bucket": "b", "node": "o"}), "possible")
    asked = rows.join(chosen, (F.col("bucket") == F.col("b")) & (F.col("node") == F.col("o"))).drop("b", "o")
    sets = sets.join(small(chosen.select("o").distinct(), few["n"]), F.col("node") == F.col("o"), "left_semi")
    links, seen = measured(block_links(asked, sets, ratio, hashes), "links")
    for table in (wide, rows, chosen):
        released(table)
    return links, seen["n"]


def sets_of(docs: DataFrame, nodes: DataFrame, count: int, size: int, threshold: float) -> DataFrame:
    """(node, n_shingles, bands, signature, sketch, items) of the texts of nodes; docs: (doc_id, body)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.join(F.broadcast(nodes) if count <= BROADCAST_ROWS else nodes, F.col("doc_id") == F.col("node")).select("node", "body")

    def run(batches):
        hashing = MinHash(bands_for(threshold), ROWS)
        for b in batches:
            items = [shingles(t, size) for t in b.column("body").to_pylist()]
            least = [hashing.minima(x) if len(x) else None for x in items]
            bands, sig, counts = ([f(x) if x is not None and len(x) else None for x in of] for f, of in ((hashing.bands_of, least), (hashing.signature, least), (sketch, items)))
            columns = {"n_shingles": pa.array([len(x) for x in items], pa.int64()), "bands": pa.array(bands, pa.list_(pa.int64())), "signature": pa.array(sig, pa.binary())}
            columns |= {"sketch": pa.array(counts, pa.binary()), "items": pa.array([x.tobytes() for x in items], pa.binary())}
            yield pa.RecordBatch.from_arrays([b.column("node"), *columns.values()], ["node", *columns])

    return texts.mapInArrow(run, f"node {kind}, n_shingles long, bands array<long>, signature binary, sketch binary, items binary").where("n_shingles > 0")


def near_duplicates(docs: DataFrame, size: int = 5, ratio: tuple[int, int] = (4, 5), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; ratio: the least similarity of a link."""
    threshold = ratio[0] / ratio[1]
    hashes = bands_for(threshold) * ROWS
    signatures = written(signed(docs, size, threshold, key, text), "signatures")
    rows = signatures.where("doc_id is not null")
    classes = rows.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    classes = written(classes, "classes")
    # doc_ids of several rows, and those of them whose rows have different texts
    repeated, seen = measured(
        rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high"), F.count("digest").alias("texts")).where("n > 1"), "repeated",
        F.count(F.lit(1)).alias("n"), F.count_if((F.col("low") != F.col("high")) | (F.col("texts").between(1, F.col("n") - 1))).alias("mixed"),
    )
    groups = buckets(classes.select("node", "bands"), seen["n"] > 0)
    nodes, of_nodes = measured(groups.select("node").distinct(), "nodes")
    sets = sets_of(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("body")), nodes, of_nodes["n"], size, threshold)
    sets = written(sets.dropDuplicates(["node", "items"]) if seen["n"] else sets, "sets")
    links, linked = measured(centre_links(groups, sets, ratio, hashes), "centre-links")
    total = linked["n"]
    if seen["mixed"]:  # a document with several texts is linked with the nodes of all of them
        same = repeated.where("low <> high or texts between 1 and n - 1").select(F.col("doc_id").alias("r"))
        named = rows.join(same, F.col("doc_id") == F.col("r")).select("doc_id", "digest").join(classes.select(F.col("digest").alias("d"), "node"), F.col("digest") == F.col("d"))
        more, extra = measured(named.where("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b")), "id-links")
        links, total = links.union(more), total + extra["n"]
    found = components(links, total)
    late, more = remaining_links(groups, found, sets, ratio, hashes)
    released(groups)
    released(sets)
    if more:
        found = components(found.select(F.col("component").alias("a"), F.col("node").alias("b")).union(late), total + more)
    # classes of one text that is linked with nothing need no join
    of_class = classes.select("digest", "node", "copies").join(found.withColumnRenamed("node", "f"), F.col("node") == F.col("f"), "left")
    of_class = of_class.where("copies > 1 or component is not null").select(F.col("digest").alias("d"), F.coalesce("component", "node").alias("component"))
    result = signatures.select("doc_id", "n_shingles", "digest").join(of_class, F.col("digest") == F.col("d"), "left")
    component = F.col("component")
    if seen["mixed"]:
        by_id = found.select(F.col("node").alias("i"), F.col("component").alias("by_id")).join(repeated.select(F.col("doc_id").alias("r")), F.col("i") == F.col("r"))
        result = result.join(by_id.select("i", "by_id"), F.col("doc_id") == F.col("i"), "left")
        component = F.least("component", "by_id")
    return result.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce(component, "doc_id")).alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")) | F.col("doc_id").isNull()
    )


def deduplicated(docs: DataFrame, size: int = 5, ratio: tuple[int, int] = (4, 5), key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, all columns, with one row for each component; where rows repeat the doc_id that is kept, any one of them."""
    found = written(near_duplicates(docs, size, ratio, key, text).select("doc_id", "kept"), "verdicts")
    gone, of = fresh(docs, "gone_id"), F.col(key)
    named = found.where("not kept").select(F.col("doc_id").alias(gone)).distinct()
    named, seen = measured(named, "duplicates")
    left = docs.join(F.broadcast(named) if seen["n"] <= BROADCAST_ROWS else named, of == F.col(gone), "left_anti")
    again, seen = measured(found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(gone)), "repeated")
    if not seen["n"]:
        return left
    again = F.broadcast(again) if seen["n"] <= BROADCAST_ROWS else again
    once = left.join(again, of == F.col(gone), "left_semi").dropDuplicates([key])
    return left.join(again, of == F.col(gone), "left_anti").union(once)


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, (85, 100))


#: The same result in SQL, for tables small enough to compare all shingles.
SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
  ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: concat(words[i], ' ', words[i + 1], ' ', words[i + 2]))) END AS items FROM w),
e AS (SELECT doc_id, len(items) AS n, unnest(items) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * shared >= 85 * (na + nb - shared)),
near AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, near.b FROM reach JOIN near ON reach.b = near.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT s.doc_id, CAST(len(items) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""
