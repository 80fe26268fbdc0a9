"""A toxicity classifier: boosted trees over dense features, calibrated.

The lexicon is learnt: beginnings of words (and whole words) that labelled
toxic documents hold far more often than others, weighted by their log odds.
A document's features are densities of the lexicon at several strengths, how
near its hits stand to the second person, capitals, punctuation, and rates of
disguised spelling (digits and signs for letters, signs between letters, letters
set apart, letters repeated); words are looked up as they stand and with the
disguise taken off.  Shallow regression trees are boosted on the logistic loss
over binned features, and an isotonic regression of labels on scores gives
probabilities.

Labelled documents are sampled by hash up to `SAMPLE_ROWS`, a bound on what
training sees.  Near copies would make each other's words look telling, so of
documents with the same sketch (least hash of their three-word runs) and label
one trains.  Lexicon, trees and calibration never see a document they are used
on while training: everything is done by folds of the sketch, and the
calibration is fitted on scores from the other folds.  The model is then fitted
on all of the sample, and every document is scored in one pass.

Labels are learnt from documents with crc32(doc_id as text) mod HELD_OUT <> 0.

Defined results: null and empty texts are scored by the features of no words;
texts of any length are read in full; rows without doc_id are scored and not
held out; labels without doc_id or value are passed over, of several labels of a
document the greatest counts; repeated rows get equal results; without labels
of both kinds every score is the share of toxic ones (0 of none); a score of
exactly 0.5 counts as toxic; an empty table gives no rows; other columns are
dropped, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_limits, released, written

#: Labelled documents that train, about; folds of the sample; documents of one residue of crc32 are held out.
SAMPLE_ROWS, FOLDS, HELD_OUT = 30_000, 5, 5
#: Lengths of the beginnings of words that can be in the lexicon; entries, and candidates whose counts come to the driver, at most.
STEMS, LEXICON, CANDIDATES = range(4, 9), 2000, 40_000
#: Least z of an entry's log odds, and least number of toxic documents.
LEAST_Z, LEAST_DOCS = 2.4, 2
#: Words around a hit within which the second person is near; words remembered by a worker, and their length.
NEAR, MEMO_WORDS, MEMO_CHARS = 5, 1 << 18, 64
#: Trees, their depth, the step, bins of a feature, least weight of a leaf.
TREES, DEPTH, STEP, BINS, LEAF = 60, 3, 0.15, 48, 2.0

# Second persons in four languages, and signs and digits that stand for letters.
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur du dich dir dein deine deinen deinem deiner ihr euch euer eure "
    "tu te toi ton ta tes vous votre vos usted ustedes tú ti tuyo tuya vosotros vosotras vuestro vuestra".split()
)
DISGUISE = str.maketrans({"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "|": "i", "0": "o", "$": "s", "5": "s", "7": "t", "+": "t", "8": "b", "9": "g"})

PERSON, CAPITALS, DISGUISED, UNMASKED, DRAWN, SINGLE = (1 << i for i in range(6))
_EDGES = re.compile(r"^[^\w@$*]+|[^\w@$*]+$")
_SIGNS = re.compile(r"[^\w]|_")
_WITHIN = re.compile(r"[^\W\d_][\d@$!|+*._~^-]+[^\W\d_]")
_DRAWN = re.compile(r"(.)\1{2,}")
_RUNS = re.compile(r"([!?])[!?]+")
_SYMBOLS = re.compile(r"[#*$%&<>@^~=_+|\\]")


def stems(word: str) -> list[str]:
    """What of a word can be in the lexicon: its beginnings, and the whole with an end mark."""
    return [*(word[:k] for k in STEMS if k <= len(word)), word + "$"] if len(word) > 2 else []


def forms(word: str) -> tuple[str, list[str]]:
    """(the word without signs at its ends, in small letters; the forms it may have been before a disguise)."""
    plain = _EDGES.sub("", word).lower()
    if plain.isalpha() and not _DRAWN.search(plain):
        return plain, []
    bare = plain.strip("!?.,;:*")
    undone = [_SIGNS.sub("", bare), _SIGNS.sub("", bare.translate(DISGUISE))]
    undone += [_DRAWN.sub(r"\1", x) for x in undone] + [_DRAWN.sub(r"\1\1", x) for x in undone]
    return plain, [x for x in dict.fromkeys(undone) if x != plain]


@dataclass
class Lexicon:
    """Weights of stems; `blanked` has the whole words with one letter starred out."""

    weights: dict[str, float]
    blanked: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.ids = {s: i + 1 for i, s in enumerate(self.weights)}
        for s, w in self.weights.items():
            if s.endswith("$"):
                for i in range(1, len(s) - 2):
                    self.blanked.setdefault(s[:i] + "*" + s[i + 1 : -1], w)

    def hit(self, word: str) -> tuple[float, int]:
        """(weight, number) of the strongest entry for a word, (0, 0) if none."""
        return max(((self.weights[s], self.ids[s]) for s in stems(word) if s in self.weights), default=(0.0, 0))


class Words(dict):
    """A word as a number: its flags, the thousandfold weight of its hit, and the number of the entry."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon

    def __missing__(self, word: str) -> int:
        plain, undone = forms(word)
        weight, entry = self.lexicon.hit(plain)
        flags = PERSON * (plain in SECOND_PERSON) | CAPITALS * (len(plain) > 1 and word.isupper()) | SINGLE * (len(plain) == 1 and plain.isalpha())
        if undone:
            flags |= DISGUISED * bool(_WITHIN.search(plain)) | DRAWN * bool(_DRAWN.search(plain))
            other = max([self.lexicon.hit(x) for x in undone] + [(self.lexicon.blanked.get(plain, 0.0), 0)])
            if other[0] > weight:
                (weight, entry), flags = other, flags | UNMASKED
        code = flags | min(int(weight * 1000), 0xFFFF) << 8 | entry << 24
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = code
        return code


FEATURES = (
    "weight", "weight_log", "hits_weak", "hits_middle", "hits_strong", "count", "distinct", "greatest", "second", "near_person", "person", "hit_capitals", "capitals", "capital_letters",
    "exclamations", "questions", "runs", "points", "symbols", "digits", "disguised", "unmasked", "drawn", "apart", "words", "word_length", "lines",
)


def features(text: str | None, known: Words) -> list[float]:
    """Dense features of a whole text."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    codes = np.fromiter(map(known.__getitem__, words), np.int64, n)
    flags, weight, entry = codes & 0xFF, (codes >> 8 & 0xFFFF) / 1000, codes >> 24
    single, apart = (flags & SINGLE) > 0, 0
    if single.sum() > 3:  # letters set apart, put together again
        edge = np.flatnonzero(np.diff(np.concatenate([[False], single, [False]])))
        for first, last in zip(edge[::2], edge[1::2], strict=True):
            if last - first > 3:
                got, number = known.lexicon.hit("".join(_EDGES.sub("", w) for w in words[first:last]).lower())
                apart += 1
                weight[first] = max(weight[first], got)
                entry[first] = number
                flags[first] |= UNMASKED * (got > 0)
    hits = np.flatnonzero(weight)
    persons = np.flatnonzero(flags & PERSON)
    if len(hits) and len(persons):
        after = np.searchsorted(persons, hits)
        gap = np.minimum(np.abs(persons[np.minimum(after, len(persons) - 1)] - hits), np.abs(persons[np.maximum(after - 1, 0)] - hits))
        near = float((weight[hits] * (gap <= NEAR)).sum())
    else:
        near = 0.0
    top = np.sort(weight[hits])[::-1]
    total, chars = float(top.sum()), len(text)
    share = lambda flag: float(np.count_nonzero(flags & flag)) / n
    upper = sum(map(str.isupper, text)) if chars < 1 << 16 else sum(sum(map(str.isupper, text[k : k + 4096])) for k in range(0, chars, 4096))
    return [
        total / n, math.log1p(total), *(float((top >= t).sum()) / n for t in (0.5, 2.0, 3.5)), math.log1p(len(hits)), math.log1p(len(np.unique(entry[hits]))),
        float(top[0]) if len(top) else 0.0, float(top[1]) if len(top) > 1 else 0.0, near / n, share(PERSON), float(np.count_nonzero(flags[hits] & CAPITALS)) / n, share(CAPITALS), upper / chars,
        text.count("!") / n, text.count("?") / n, len(_RUNS.findall(text)) / n, (text.count(".") + text.count(",")) / n, len(_SYMBOLS.findall(text)) / chars,
        sum(map(text.count, "0123456789")) / chars, share(DISGUISED), share(UNMASKED), share(DRAWN), apart / n, math.log1p(n), chars / n, text.count("\n") / n,
    ]


def sketch(text: str | None) -> int:
    """The least hash of a text's three-word runs: the same for most near copies."""
    words = [xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) & 0xFFFFFFFF for w in (text or "").lower().split()]
    if len(words) < 3:
        return xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass")) >> 1
    w = np.array(words, np.uint64)
    h = (w[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (w[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (w[2:] * np.uint64(0x165667B19E3779F9))
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return int(h.min()) >> 1


# --- trees ---


@dataclass
class Trees:
    """Boosted trees of one depth over binned features: cut points by feature, and for each tree the feature and bin of every inner node and the values of its leaves."""

    cuts: list[np.ndarray]
    base: float
    nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1) if len(x) else np.empty((0, len(self.cuts)), np.int64)

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = self.binned(x)
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, bound, leaf in self.nodes:
            at = np.zeros(len(x), np.int64)
            while (at < len(feature)).any():
                at = 2 * at + 1 + (bins[rows, feature[at]] > bound[at])
                if at[0] >= len(feature):  # all leaves are equally deep
                    break
            out += leaf[at - len(feature)]
        return out


def _split(bins: np.ndarray, node: np.ndarray, g: np.ndarray, h: np.ndarray, width: int, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The best feature and bound of every node of a level; bound past all bins where no split helps."""
    gain, feature, bound = np.full(width, 1e-9), np.zeros(width, np.int64), np.full(width, BINS, np.int64)
    for j, size in enumerate(sizes):
        if size < 2:
            continue
        key = node * size + bins[:, j]
        gs, hs = (np.bincount(key, v, width * size).reshape(width, size) for v in (g, h))
        left_g, left_h = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
        all_g, all_h = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
        right_g, right_h = all_g - left_g, all_h - left_h
        score = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - all_g**2 / (all_h + 1)
        score[(left_h < LEAF) | (right_h < LEAF)] = 0
        best = score.argmax(1)
        value = score[np.arange(width), best]
        more = value > gain
        gain[more], feature[more], bound[more] = value[more], j, best[more]
    return feature, bound


def boosted(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, step: float = STEP) -> Trees:
    """Trees fitted by Newton steps on the logistic loss."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) if len(x) else np.empty(0) for j in range(x.shape[1])]
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Trees(cuts, math.log(share / (1 - share)), [])
    bins = model.binned(x)
    sizes = [len(c) + 1 for c in cuts]
    margin = np.full(len(x), model.base)
    inner = (1 << depth) - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, bound = np.zeros(inner, np.int64), np.full(inner, BINS, np.int64)
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            feature[first : first + width], bound[first : first + width] = _split(bins, node, g, h * 4, width, sizes)
            node = 2 * node + (bins[np.arange(len(x)), feature[first + node]] > bound[first + node])
        total_g, total_h = (np.bincount(node, v, 1 << depth) for v in (g, h))
        leaf = -step * total_g / (total_h + 1)
        margin += leaf[node]
        model.nodes.append((feature, bound, leaf))
    return model


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(margins, probabilities), both rising: the means of pooled neighbours at the middle of their margins."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, rows, sum of margins
    for m, label in zip(margin[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([label, 1.0, m])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    # half a label of each kind keeps the ends off 0 and 1
    return np.array([b[2] / b[1] for b in blocks]), np.array([(b[0] + 0.5 * y.mean()) / (b[1] + 0.5) for b in blocks])


# --- the model ---


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    steps: tuple[np.ndarray, np.ndarray]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities that texts with these features are toxic; the same for equal rows, wherever they stand."""
        if self.trees is None:
            return np.full(len(x), self.steps[1][0])
        margin = self.trees.margin(x)
        # between blocks by a straight line; a trace of the margin keeps the order within blocks
        return np.clip(np.interp(margin, *self.steps) + 1e-6 * np.tanh(margin / 10), 0, 1)


def chosen(counts: dict[str, np.ndarray], toxic: int, others: int, most: int = LEXICON) -> Lexicon:
    """The lexicon from (toxic, other) numbers of documents by stem; of beginnings of one word that stand in equal numbers of documents, the longest."""
    names = list(counts)
    if not names or not toxic:
        return Lexicon({})
    a, b = np.array([counts[s] for s in names], float).reshape(-1, 2).T
    odds = np.log((a + 0.5) / (np.maximum(toxic - a, 0) + 0.5)) - np.log((b + 0.5) / (np.maximum(others - b, 0) + 0.5))
    z = odds / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    weight = np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (others + 1))
    longer = {(s[:-1], *counts[s]) for s in names if not s.endswith("$")}
    told = [i for i in np.flatnonzero((z >= LEAST_Z) & (a >= LEAST_DOCS)).tolist() if (names[i], *counts[names[i]]) not in longer]
    return Lexicon({names[i]: float(weight[i]) for i in sorted(told, key=lambda i: (-z[i], len(names[i]), names[i]))[:most]})


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


def sampled(docs: DataFrame, labels: DataFrame, sample_rows: int, key: str, text: str, label: str) -> DataFrame:
    """(text, toxic, sketch) of the documents that train: one of each sketch and label; written."""
    told = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("toxic")).where(F.col("id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("id")))
    share = min(1.0, sample_rows / max(told.count(), 1))
    some = told.where(F.pmod(F.xxhash64(F.lit("toxic"), F.col("id").cast("string")), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    some = some.groupBy("id").agg(F.max("toxic").alias("toxic")).limit(2 * sample_rows)

    @F.arrow_udf("long")
    def sketches(texts: pa.Array) -> pa.Array:
        return pa.array(map(sketch, texts.to_pylist()), pa.int64())

    # the ids are bounded by the sample: no text is moved for the join
    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).join(F.broadcast(some), F.col("doc") == F.col("id")).select("text", (F.col("toxic") > 0).cast("int").alias("toxic"))
    rows = written(rows.withColumn("sketch", sketches("text")), "toxic-sample")
    once = rows.groupBy("sketch", "toxic").agg(F.min("text").alias("text"))
    found = written(once.select("text", "toxic", "sketch"), "toxic-sample")
    released(rows)
    return found


def stem_counts(sample: DataFrame) -> dict[str, np.ndarray]:
    """Numbers of documents by stem, fold and label, an array of FOLDS x 2 for each, of stems that LEAST_DOCS toxic documents hold: the CANDIDATES whose share in them is most above that in the others."""

    def run(batches):
        for b in batches:
            seen: Counter = Counter()
            for body, toxic, mark in zip(*(b.column(j).to_pylist() for j in range(3)), strict=True):
                words = {f for w in set((body or "").split()) for f in (lambda x: (x[0], *x[1]))(forms(w))}
                seen.update((s, mark % FOLDS, toxic) for s in {s for w in words for s in stems(w)})
            names = list(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in names], pa.string()), pa.array([x[1] * 2 + (1 - x[2]) for x in names], pa.int32()), pa.array(list(seen.values()), pa.int64())],
                ["stem", "cell", "n"],
            )

    # stems of toxic documents first, so that those of the others are only counted where they matter
    kind = "stem string, cell int, n long"
    toxic = sample.where("toxic = 1").select("text", "toxic", "sketch").mapInArrow(run, kind)
    others = sample.where("toxic = 0").select("text", "toxic", "sketch").mapInArrow(run, kind)
    cells = lambda name: [F.sum(F.when(F.col("cell") == c, F.col("n")).otherwise(0)).alias(f"{name}{c}") for c in range(2 * FOLDS)]
    a = toxic.groupBy("stem").agg(F.sum("n").alias("a"), *cells("c")).where(F.col("a") >= LEAST_DOCS)
    b = others.groupBy(F.col("stem").alias("other")).agg(F.sum("n").alias("b"), *cells("d"))
    n = sample.agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    both = a.join(b, F.col("stem") == F.col("other"), "left").na.fill(0, ["b", *(f"d{c}" for c in range(2 * FOLDS))])
    above = F.col("a") / max(n["t"] or 0, 1) - F.col("b") / max((n["n"] or 0) - (n["t"] or 0), 1)
    rows = both.where(above > 0).orderBy(F.desc(above / F.sqrt(F.col("a") + F.col("b"))), "stem").limit(CANDIDATES)
    rows = rows.select("stem", *((F.col(f"c{c}") + F.col(f"d{c}")).alias(f"n{c}") for c in range(2 * FOLDS))).toArrow().to_pydict()
    table = np.array([rows[f"n{c}"] for c in range(2 * FOLDS)]).T.reshape(-1, FOLDS, 2)
    return dict(zip(rows["stem"], table, strict=True))


def described(sample: DataFrame, lexicons: list[Lexicon]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, labels, folds) of the sample: each document by its fold's lexicon."""

    def run(batches):
        known = [Words(x) for x in lexicons]
        for b in batches:
            texts, toxic, marks = (b.column(j).to_pylist() for j in range(3))
            found = [features(t, known[m % FOLDS]) for t, m in zip(texts, marks, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), pa.array(toxic, pa.int32()), pa.array([m % FOLDS for m in marks], pa.int32()), pa.array(marks, pa.int64())], ["x", "y", "fold", "mark"])

    got = sample.select("text", "toxic", "sketch").mapInArrow(run, "x array<double>, y int, fold int, mark long").toArrow()  # a few numbers for each row of the sample
    got = got.sort_by([("mark", "ascending"), ("y", "ascending")])
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return x, got.column("y").to_numpy().astype(float), got.column("fold").to_numpy()


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    batch_limits(docs.sparkSession)
    sample = sampled(docs, labels, sample_rows, key, text, label)
    sizes = {(r["f"], r["toxic"]): r["n"] for r in sample.groupBy(F.pmod("sketch", F.lit(FOLDS)).alias("f"), "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, others = (sum(n for (_, t), n in sizes.items() if t == y) for y in (1, 0))
    if not toxic or not others:
        return Model(Lexicon({}), None, (np.zeros(1), np.array([toxic / max(toxic + others, 1)])))
    counts = stem_counts(sample)
    without = lambda f: chosen({s: c.sum(0) - c[f] for s, c in counts.items()}, toxic - sizes.get((f, 1), 0), others - sizes.get((f, 0), 0))
    x, y, fold = described(sample, [without(f) for f in range(FOLDS)])
    released(sample)
    margin = np.zeros(len(x))
    for f in range(FOLDS):
        own = fold == f
        if own.any() and 0 < y[~own].sum() < (~own).sum():
            margin[own] = boosted(x[~own], y[~own]).margin(x[own])
    return Model(chosen({s: c.sum(0) for s, c in counts.items()}, toxic, others), boosted(x, y), isotonic(margin, y))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) of every row."""
    batch_limits(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        known = Words(model.lexicon)
        for b in batches:
            x = np.array([features(t, known) for t in b.column(1).to_pylist()], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(x), pa.float64())], ["id", "score"])

    rows = docs.select(key, text).mapInArrow(run, f"id {kind}, score double")
    return rows.select(F.col("id").alias(key), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    return score(docs, train(docs, labels, sample_rows, key, text, label), key, text)


def query(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
