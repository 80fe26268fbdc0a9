"""The label model on votes of known accuracy; the classifier against labels it has not seen."""

import os
import random

import numpy as np
import pytest
import xxhash

from trawl.llm import quality as Q

SF = "/root/testdata/sf0.01"


def test_em_recovers_accuracies():
    rng = random.Random(6)
    right = [0.95, 0.9, 0.85, 0.8, 0.9, 0.85, 0.7, 0.75, 0.8]
    counts = {}
    for _ in range(40000):
        bad = rng.random() < 0.3
        cast = tuple((Q.BAD if bad == (rng.random() < p) else Q.GOOD) if rng.random() < 0.8 else Q.NOTHING for p in right)
        code = Q.pattern(cast)
        assert Q.unpacked(code) == cast
        counts[code] = counts.get(code, 0) + 1
    model = Q.expectation_maximisation(counts)
    assert abs(model.prior - 0.3) < 0.03
    assert np.abs(np.array(list(model.accuracies().values())) - right).max() < 0.03


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")
def test_accuracy_on_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = Q.classify(docs).join(labels, "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    print(len(good), sum(good), len(bad), sum(bad))
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_rows(spark):
    texts = ["Plain words make a sentence here, as they should."] * 30 + ["JUNK!! WORDS!! SHOUT!! MORE!!"] * 5 + [None, "", " \n", "x" * 300000]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    out = {r.doc_id: r.kept for r in Q.classify(df).collect()}
    assert len(out) == len(texts) and out[0] and not out[31] and out[35] and out[36]
    kept = Q.documents_kept(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, k in out.items() if k}
    assert Q.classify(df.limit(0)).count() == 0


def test_the_whole_of_a_long_word_counts():
    shapes = Q.Shapes()
    word, junk = "a" * 64, "a" * 64 + "%$#{}" * 20_000
    assert shapes[word] & 1 and not shapes[junk] & 1 and shapes[word] >> 16 != shapes[junk] >> 16
    assert shapes[junk] == shapes[junk] and junk not in shapes and word in shapes
    assert shapes["a" * 1000] & 0xFFFF == shapes[word] & 0xFFFF


def plain_shape(word):
    kinds = ["a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "w" if c.isalpha() else c for c in word]
    return "".join(k for i, k in enumerate(kinds) if i == 0 or kinds[i - 1] != k)


def plain_features(text):
    """Feature to value, one word and pair at a time."""
    words, found = (text or "").split(), {}
    if not words:
        return found

    def add(feature, value):
        found[feature] = found.get(feature, 0.0) + value

    own = [xxhash.xxh3_64_intdigest(w.lower().encode()) >> 32 for w in words]
    for w, h in zip(words, own, strict=True):
        add(xxhash.xxh3_64_intdigest(plain_shape(w).encode()) % Q.FEATURES, 1 / len(words))
        add(Q.FEATURES + h % Q.WORDS, 1 / len(words))
    for one, two in zip(own, own[1:], strict=False):
        add(Q.FEATURES + Q.WORDS + (((one * 0x9E3779B1 + two) & 0x7FFFFFFF) >> 8) % Q.PAIRS, 1 / len(words))
    odd = sum(not Q.PLAIN_SHAPE.fullmatch(plain_shape(w)) for w in words) / len(words)
    for name, value, (_, bad_above) in zip(Q.LABELLERS, Q.ratios(text, words, odd), Q.LIMITS, strict=True):
        add(xxhash.xxh3_64_intdigest(f"{name}:{min(int(4 * value / bad_above), 8)}".encode()) % Q.FEATURES, 0.25)
    return found


def plain_scores(texts):
    """Features, label model's posteriors, fit and scores, by dictionaries and loops."""
    codes = [Q.pattern(Q.votes(t)) for t in texts]
    # the label model: expectation-maximisation with one document at a time
    bad = {c: 0.9 if Q.BAD in Q.unpacked(c) else 0.05 for c in set(codes)}
    for _ in range(60):
        prior = min(max(sum(bad[c] for c in codes) / len(codes), 1e-6), 1 - 1e-6)
        rates = [[[1.0, 1.0, 1.0], [1.0, 1.0, 1.0]] for _ in Q.LABELLERS]
        for c in codes:
            for of, v in zip(rates, Q.unpacked(c), strict=True):
                of[0][v] += 1 - bad[c]
                of[1][v] += bad[c]
        for of in rates:
            for y in (0, 1):
                total = of[y][Q.GOOD] + of[y][Q.BAD]
                of[y] = [1.0, of[y][Q.GOOD] / total, of[y][Q.BAD] / total]
        odds = {c: np.log(prior / (1 - prior)) + sum(np.log(of[1][v] / of[0][v]) for of, v in zip(rates, Q.unpacked(c), strict=True)) for c in bad}
        bad = {c: 1 / (1 + np.exp(-min(max(o, -50), 50))) for c, o in odds.items()}
    # the scorer
    rows, weights, seen = [plain_features(t) for t in texts], {"all": 0.0}, {}
    for _ in range(Q.ROUNDS):
        step = {f: 1e-4 * w for f, w in weights.items()}
        step["all"] = 0.0
        for found, code in zip(rows, codes, strict=True):
            error = 1 / (1 + np.exp(-(weights["all"] + sum(weights.get(f, 0.0) * v for f, v in found.items())))) - bad[code]
            step["all"] += error / len(rows)
            for f, v in found.items():
                step[f] = step.get(f, 0.0) + error * v / len(rows)
        for f, g in step.items():
            seen[f] = seen.get(f, 0.0) + g * g
            weights[f] = weights.get(f, 0.0) - 0.5 * g / (seen[f] ** 0.5 + 1e-8)
    return [1 / (1 + np.exp(weights["all"] + sum(weights.get(f, 0.0) * v for f, v in found.items()))) for found in rows]


@pytest.mark.parametrize("held", [300, 10**6])
def test_scores_equal_a_plain_computation(spark, monkeypatch, held):
    monkeypatch.setattr(Q, "HELD_FEATURES", held)
    rng = random.Random(11)
    words = ["house", "Tree", "é", "x9", "$$", "GO!", "a|b", "well,", "done."]
    texts = [" ".join(rng.choice(words[: rng.randint(2, 9)]) for _ in range(rng.randint(1, 40))) for _ in range(60)] + [None, "", "one"]
    got = {r.doc_id: r.score for r in Q.classify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, score in enumerate(plain_scores(texts)):
        assert abs(got[i] - score) < 1e-3
