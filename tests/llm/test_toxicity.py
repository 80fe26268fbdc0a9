"""The toxicity classifier: its parts against plain re-computations, the whole by held-out labels."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trawl.llm import toxicity as T

BAD = ["grumbleface", "snotter", "wortless", "dunderhead"]


def texts(seed, n):
    rng = random.Random(seed)
    base = ["the", "of", "river", "stone", "you", "house", "walks", "green", "slowly", "and", "path"]
    base += ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 9))) for _ in range(300)]
    rows = []
    for i in range(n):
        words = [rng.choice(base) for _ in range(rng.randint(20, 120))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "", "s", "!"]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    rows = texts(1, 1500)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return rows, T.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))


def test_held_out_labels(spark, model):
    rows, made = model
    got = {r.doc_id: r for r in T.score(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), made).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    own = [(got[i], t) for i, _, t in rows if got[i].held_out]
    assert len(own) > 200 and sum(g.predicted != t for g, t in own) <= 2
    assert all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.5) for g, _ in own)
    assert sum((g.score - t) ** 2 for g, t in own) / len(own) < 0.02


def test_disguised_words_are_found(spark, model):
    _, made = model
    plain = "the river stone house walks green slowly and the path of stone walks on and on to the green house of stone "
    odd = ["sn0tt3r you gr*mbleface", "s-n-o-t-t-e-r you dund3rhe@d", "SNOTTER!!! you snotterrrr", "s n o t t e r you grumbleface"]
    df = spark.createDataFrame([(0, plain), *((k, plain + o) for k, o in enumerate(odd, 1))], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in T.score(df, made).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1}


def test_odd_rows(spark, model):
    _, made = model
    rows = [(1, None), (2, ""), (None, "snotter you grumbleface"), (3, "word " * 400_000 + "snotter"), (4, "x" * 2_000_000), (5, "A" * 70_000), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("id", F.lit("y")).withColumn("toxic", F.lit(1))
    got = T.score(df, made)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    by = {r.doc_id: r for r in got.collect()}
    assert got.count() == 7 and by[None].held_out is False and by[1].score == by[2].score
    assert T.score(df.limit(0), made).count() == 0


def test_labels_of_one_kind_and_of_none(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    some = spark.createDataFrame([(i, 1) for i in range(20)] + [(None, 0), (3, None)], "doc_id long, toxic int")
    assert {r.score for r in T.classify(docs, some).collect()} == {1.0}
    assert {(r.score, r.predicted) for r in T.classify(docs, some.limit(0)).collect()} == {(0.0, 0)}
    assert T.classify(docs.limit(0), some).count() == 0


def test_training_sees_no_held_out_row_and_one_of_near_copies(spark):
    body = " ".join(f"w{k}" for k in range(200))
    docs = [(i, body + f" end{i}") for i in range(60)] + [(100 + i, f"t{i} u{i} v{i} w{i}") for i in range(60)]
    labels = [(i, 1) for i in range(60)] + [(100 + i, 0) for i in range(60)] + [(100, 1)]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = T.sampled(d, lab, 10_000, "doc_id", "text", "toxic").collect()
    told = {t: i for i, t in docs}
    assert all(zlib.crc32(str(told[r.text]).encode()) % 5 for r in got)
    assert sum(told[r.text] < 60 for r in got) <= 3 and sum(told[r.text] >= 100 for r in got) > 30
    assert T.sampled(d, lab, 20, "doc_id", "text", "toxic").count() < 40


def test_trees_isotonic_and_features():
    rng = np.random.default_rng(3)
    x = rng.random((4000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    trees = T.boosted(x, y)
    assert ((trees.margin(x) > 0) == y).mean() > 0.97
    bins = trees.binned(x[:50])
    for row, got in zip(bins, trees.margin(x[:50]), strict=True):  # every tree walked node by node
        total = trees.base
        for feature, bound, leaf in trees.nodes:
            at = 0
            while at < len(feature):
                at = 2 * at + 1 + int(row[feature[at]] > bound[at])
            total += leaf[at - len(feature)]
        assert abs(total - got) < 1e-9
    m, p = T.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert (np.diff(m) > 0).all() and (np.diff(p) >= 0).all() and len(p) == 3
    lexicon = T.chosen({"rude": np.array([50, 0]), "rudeword": np.array([50, 0]), "rudeword$": np.array([50, 0]), "the$": np.array([60, 600]), "rare": np.array([1, 0])}, 60, 600)
    assert set(lexicon.weights) == {"rude", "rudeword", "rudeword$"}
    got = dict(zip(T.FEATURES, T.features("You RUDEWORD! the sky is blue.\nIs it?!", T.Words(lexicon)), strict=True))
    assert got["near_person"] > 0 and got["capitals"] > 0 and got["distinct"] > 0 and got["exclamations"] == 2 / 8 and got["lines"] == 1 / 8
    assert T.features(None, T.Words(lexicon)) == T.features(" \n", T.Words(lexicon)) == [0.0] * len(T.FEATURES)
