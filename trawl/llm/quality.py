"""A quality classifier learnt from weak labels.

Heuristic labellers each vote bad, good or nothing on every document.  Their
votes overlap, so their accuracies can be estimated without any truth:
expectation-maximisation over the counts of vote patterns, which are counted
over all documents and of which there are at most 3 to the number of labellers,
gives each labeller's rates and each pattern's posterior.  The posteriors of a
bounded sample of documents (`SAMPLE_ROWS`, chosen by hash) train a linear
scorer over hashed features: words and pairs of neighbouring words, which no
labeller looks at, shapes of words, and steps of the labellers' ratios.  The
scorer then judges every document.

Labellers: symbols, words that are not plainly words, capitals, exclamation
marks, bars, words equal to the one before, few
distinct words, repeated lines, unusual punctuation.

Defined results: null and empty texts get no votes and are judged by an empty
feature vector, that is kept unless most documents are bad; texts of any length
are read in full, words of any length too; a score equal to the limit is kept;
repeated rows get equal results, rows without doc_id like any other; an empty
table gives no rows.  `documents_kept` keeps all columns, whatever their names;
`classify` returns its own columns only.
"""

from __future__ import annotations

import math
import operator
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_limits, written

SYMBOL = re.compile(r"[#*$%&<>@^~=_+\\]")
LABELLERS = ("symbols", "odd_words", "capitals", "exclamations", "bars", "neighbours", "few_words", "repeated_lines", "punctuation")
NOTHING, GOOD, BAD = 0, 1, 2
#: Documents that train the scorer, about; a bound on what the driver sees.
SAMPLE_ROWS = 20_000
#: Words within which the labeller for few distinct words counts.
BLOCK = 500
#: Sizes of the hashed feature spaces of shapes and ratios, of words, and of pairs of words; words that one worker remembers.
FEATURES, WORDS, PAIRS, MEMO_WORDS = 1 << 12, 1 << 13, 1 << 13, 1 << 18
ALL_FEATURES = FEATURES + WORDS + PAIRS
#: Longer words are described each time they occur.
MEMO_CHARS = 64


def _vote(value: float, good_below: float, bad_above: float) -> int:
    return BAD if value > bad_above else GOOD if value < good_below else NOTHING


def ratios(text: str, words: list[str], odd: float) -> tuple[float, ...]:
    """Measures in which junk is high, for LABELLERS in order; odd: share of words that are not plainly words."""
    n, chars = len(words), len(text)
    lines = [x for x in text.split("\n") if x.strip()]
    stops = sum(map(text.count, (". ", ", ", ".\n", ",\n"))) / n
    return (
        len(SYMBOL.findall(text)) / chars,
        odd,
        sum(map(str.isupper, words)) / n,
        text.count("!") / n,
        text.count("|") / n,
        sum(map(operator.eq, words, words[1:])) / n,
        1 - sum(len(set(words[k : k + BLOCK])) for k in range(0, n, BLOCK)) / n if n >= 20 else 0.75,
        1 - len(set(lines)) / len(lines) if len(lines) >= 4 else 0.0,
        (1 - min(stops / 0.05, 1.0) if stops < 0.05 else max(stops - 0.35, 0.0) / 0.25) if n >= 20 else 0.5,
    )


#: Good below the first, bad above the second; for LABELLERS in order.
LIMITS = ((0.02, 0.08), (0.15, 0.3), (0.15, 0.4), (0.05, 0.25), (0.02, 0.12), (0.05, 0.3), (0.7, 0.8), (0.1, 0.3), (0.2, 0.6))


class Kinds(dict):
    """Code point to the kind of its character."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        got = self[code] = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "w" if c.isalpha() else c
        return got


class Shapes(dict):
    """Word to a number: its hash, its shape's feature (runs of small, capital, digit and other characters, hashed), and in the lowest bit if it is plainly a word."""

    def __init__(self):
        self.by_shape: dict[str, int] = {}
        self.kinds = Kinds()

    def __missing__(self, word: str) -> int:
        shape = RUN.sub(r"\1", word.translate(self.kinds))
        own = xxhash.xxh3_64_intdigest(word.lower().encode("utf-8", "replace")) >> 32 << 16
        if len(word) > MEMO_CHARS:  # a whole text without spaces, say: read in full, not remembered
            return own | self.feature(shape)
        if len(self) >= MEMO_WORDS:
            self.clear()
        got = self.by_shape.get(shape)
        if got is None:
            got = self.by_shape[shape] = self.feature(shape)
        self[word] = own | got
        return own | got

    def feature(self, shape: str) -> int:
        if len(self.by_shape) >= MEMO_WORDS:
            self.by_shape.clear()
        return xxhash.xxh3_64_intdigest(shape.encode("utf-8", "replace")) % FEATURES * 2 + bool(PLAIN_SHAPE.fullmatch(shape))


RUN = re.compile(r"(.)\1+")
PLAIN_SHAPE = re.compile(r"(?!A[.,;:?!]?$)[(\"'“]?[Aaw0'’-]+[.,;:?!)\"'”]?")
_shapes = Shapes()


def described(text: str | None) -> tuple[np.ndarray, tuple[float, ...]] | None:
    """Features of the words and of their pairs, one for each occurrence, the ratios, and the number of words; None without a word."""
    words = text.split() if text else []
    if not words:
        return None
    ids = np.fromiter(map(_shapes.__getitem__, words), np.int64, len(words))
    own = ids >> 16
    pairs = (own[:-1] * 0x9E3779B1 + own[1:]) & 0x7FFFFFFF
    found = np.concatenate([(ids & 0xFFFF) >> 1, FEATURES + own % WORDS, FEATURES + WORDS + (pairs >> 8) % PAIRS])
    return found, ratios(text, words, 1 - float((ids & 1).mean())), len(words)


def votes_on(values: tuple[float, ...]) -> tuple[int, ...]:
    return tuple(_vote(v, *limit) for v, limit in zip(values, LIMITS, strict=True))


def votes(text: str | None) -> tuple[int, ...]:
    found = described(text)
    return votes_on(found[1]) if found else (NOTHING,) * len(LABELLERS)


def pattern(found: tuple[int, ...]) -> int:
    code = 0
    for v in found:
        code = code * 3 + v
    return code


def unpacked(code: int) -> tuple[int, ...]:
    out = []
    for _ in LABELLERS:
        code, v = divmod(code, 3)
        out.append(v)
    return tuple(reversed(out))


@dataclass
class LabelModel:
    """rates[l, y, v]: probability that labeller l's vote, if any, is v on a document of class y (0 good, 1 bad)."""

    prior: float
    rates: np.ndarray
    posterior: dict[int, float]

    def accuracies(self) -> dict[str, float]:
        """Of each labeller, over the documents it votes on."""
        p = np.array([1 - self.prior, self.prior])
        return dict(zip(LABELLERS, (self.rates[:, 0, GOOD] * p[0] + self.rates[:, 1, BAD] * p[1]).tolist(), strict=True))


def expectation_maximisation(counts: dict[int, int], rounds: int = 60) -> LabelModel:
    """Classes start from any bad vote against good ones; 1 is added to each count.  A labeller that doesn't vote says nothing."""
    codes = sorted(counts)
    cast = np.array([unpacked(c) for c in codes], int).reshape(len(codes), len(LABELLERS))
    weight = np.array([counts[c] for c in codes], float)
    bad = np.where((cast == BAD).any(axis=1), 0.9, 0.05)
    one_hot = np.eye(3)[cast]
    prior, rates = 0.5, np.full((len(LABELLERS), 2, 3), 1 / 3)
    for _ in range(rounds if codes else 0):
        prior = float(np.clip((weight @ bad) / weight.sum(), 1e-6, 1 - 1e-6))
        for y, share in enumerate((1 - bad, bad)):
            seen = np.tensordot(weight * share, one_hot, 1) + 1
            rates[:, y] = seen / seen[:, 1:].sum(axis=1, keepdims=True)
        rates[:, :, NOTHING] = 1.0
        log = np.log(rates)
        score = np.tensordot(one_hot, log[:, 1] - log[:, 0], 2) + np.log(prior / (1 - prior))
        bad = 1 / (1 + np.exp(-np.clip(score, -50, 50)))
    return LabelModel(prior, rates, dict(zip(codes, bad.tolist(), strict=True)))


def features(got: tuple | None) -> tuple[np.ndarray, int]:
    """(features, words) of a described text: shapes, words and pairs, each worth one part in `words`, and last the step of each ratio, worth STEP."""
    if not got:
        return np.empty(0, np.int16), 0
    steps = [STEPS[i, min(int(4 * v / limit[1]), 8)] for i, (v, limit) in enumerate(zip(got[1], LIMITS, strict=True))]
    return np.concatenate([got[0], steps]).astype(np.int16), got[2]


#: Value of a ratio's feature.
STEP = 0.25
#: Feature of each step of each ratio.
STEPS = np.array([[xxhash.xxh3_64_intdigest(f"{name}:{k}".encode()) % FEATURES for k in range(9)] for name in LABELLERS])


#: Steps of the fit; features that a step looks at together, about.
ROUNDS, HELD_FEATURES = 60, 250_000


def fit(sizes: np.ndarray, words: np.ndarray, col: np.ndarray, target: np.ndarray, rounds: int = ROUNDS, penalty: float = 1e-4) -> np.ndarray:
    """Weights (last: intercept) of a logistic regression on soft targets, by gradient steps with per-weight rates.

    sizes, words: number of features and of words of each row; col: features of all rows, one after the other, as `features` gives them.
    """
    w = np.zeros(ALL_FEATURES + 1)
    if not len(sizes):
        return w
    ends, seen = np.concatenate([[0], np.cumsum(sizes)]), np.zeros_like(w)
    cuts = [0, *np.searchsorted(ends, np.arange(HELD_FEATURES, ends[-1], HELD_FEATURES)), len(sizes)]
    for _ in range(rounds):
        step = penalty * w
        step[-1] = 0.0
        for first, last in zip(cuts, cuts[1:], strict=False):
            if first == last:
                continue
            of = slice(ends[first], ends[last])
            row, val = np.repeat(np.arange(last - first), sizes[first:last]), values(sizes[first:last], words[first:last])
            margin = np.bincount(row, val * w[col[of]], last - first) + w[-1]
            error = (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - target[first:last]) / len(sizes)
            step += np.bincount(col[of], val * error[row], ALL_FEATURES + 1)
            step[-1] += error.sum()
        seen += step * step
        w -= 0.5 * step / (np.sqrt(seen) + 1e-8)
    return w


def values(sizes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Values of the features of rows, one after the other."""
    found = np.repeat(1 / np.maximum(words, 1), sizes)
    ends = np.cumsum(sizes)[sizes > 0]
    found[(ends[:, None] - np.arange(1, len(LABELLERS) + 1)).ravel()] = STEP
    return found


def described_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pattern, words, features) of every row: the one pass over the texts."""
    batch_limits(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            both = [described(t) for t in b.column(1).to_pylist()]
            rows = [features(x) for x in both]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([pattern(votes_on(x[1])) if x else 0 for x in both], pa.int64()),
                    pa.array([n for _, n in rows], pa.int64()),
                    pa.array([f for f, _ in rows], pa.list_(pa.int16())),
                ],
                ["doc_id", "pattern", "words", "features"],
            )

    return docs.select(key, text).mapInArrow(run, f"doc_id {kind}, pattern long, words long, features array<short>")


def train(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[LabelModel, np.ndarray]:
    """Label model from the vote patterns of all described documents, scorer from a sample of them."""
    counts = {r["pattern"]: r["n"] for r in rows.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 3 ** len(LABELLERS)
    model = expectation_maximisation(counts)
    share = min(1.0, sample_rows / max(sum(counts.values()), 1))
    chosen = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "pattern", "features"), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    sample = chosen.select("pattern", "words", "features").limit(2 * sample_rows).toArrow()
    target = np.array([model.posterior[c] for c in sample.column("pattern").to_pylist()])
    sizes = pc.list_value_length(sample.column("features")).to_numpy().astype(np.int64)
    col = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in sample.column("features").chunks] or [np.empty(0, np.int16)])
    words = sample.column("words").to_numpy()
    del sample
    return model, fit(sizes, words, col, target)


def margins(weights: np.ndarray, sizes: np.ndarray, words: np.ndarray, col: np.ndarray) -> np.ndarray:
    """How much speaks against each row; the same for equal rows, wherever they stand."""
    return np.bincount(np.repeat(np.arange(len(sizes)), sizes), values(sizes, words) * weights[col], len(sizes)) + weights[-1]


def probability(margin: np.ndarray) -> np.ndarray:
    """That a text with this margin is good."""
    return 1 / (1 + np.exp(np.clip(margin, -50, 50)))


def classify(docs: DataFrame, least: float = 0.5, sample_rows: int = SAMPLE_ROWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, kept): score is the probability that the text is good; kept from `least` up."""
    rows = written(described_documents(docs, key, text), "features")
    weights = train(rows, sample_rows)[1]
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            found = b.column(2)
            margin = margins(weights, np.diff(found.offsets.to_numpy()), b.column(1).to_numpy(zero_copy_only=False), found.flatten().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(probability(margin), pa.float64())], ["doc_id", "score"])

    return rows.select("doc_id", "words", "features").mapInArrow(run, f"doc_id {kind}, score double").withColumn("kept", F.col("score") >= least)


def documents_kept(docs: DataFrame, least: float = 0.5, sample_rows: int = SAMPLE_ROWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, all columns, without the rows that are rejected.  The texts are not moved: they are described twice."""
    weights = train(written(described_documents(docs, key, text), "features"), sample_rows)[1]

    @F.arrow_udf("double")
    def good(texts: pa.Array) -> pa.Array:
        found = [features(described(t)) for t in texts.to_pylist()]
        sizes, words = (np.array(x, np.int64) for x in ([len(f) for f, _ in found], [n for _, n in found]))
        return pa.array(probability(margins(weights, sizes, words, np.concatenate([f for f, _ in found] or [np.empty(0, np.int16)]))), pa.float64())

    return docs.where(good(F.col(text)) >= least)


def query(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
