"""Ranked search against scores of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trawl.llm import ranking as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, most):
    held = [(d, Counter(split(t))) for d, t in docs if split(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    out = []
    for item, text in items:
        scores = []
        for d, c in held:
            m = 100 - 25 + 25 * sum(c.values()) * n // total
            s = 0
            for t, k in Counter(split(text)).items():
                if c[t]:
                    df = sum(t in x for _, x in held)
                    s += k * math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:most], 1)]
    return out


def words(rng, n):
    return " ".join(rng.choice(["the", "The", "of", "a1", "é", "ÄÖ", "x_y", "漢字"] + [f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(8)]) for _ in range(n))


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.mark.parametrize(("shard", "items", "wave"), [(16_384, 1000, 0.5), (7, 2, 0.9)])
def test_ranks_are_those_of_whole_scores(spark, monkeypatch, shard, items, wave):
    monkeypatch.setattr(R, "SHARD_DOCS", shard)
    monkeypatch.setattr(R, "BLOCK_ITEMS", items)
    monkeypatch.setattr(R, "WAVE", wave)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    rng = random.Random(4)
    docs = [(i, words(rng, rng.randint(1, 60))) for i in range(150)] + [(150 + i, "the copy of w1 w2") for i in range(30)]
    docs += [(500, None), (501, ""), (502, "?! __"), (None, "the w1 w2 w3"), (7, "the w1 w2 w3"), (7, "the w1 w2 w3")]
    asked = [(i, words(rng, rng.randint(1, 30))) for i in range(8)] + [(100, None), (101, ""), (102, "nowhere"), (None, "the the W1"), (3, "of w2")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("score", F.lit("x")).withColumn("k", F.lit(1)).withColumn("n", F.lit(1))
    q = spark.createDataFrame(asked, "item_id long, text string").withColumn("doc_id", F.lit("x"))
    got = R.search(d, q, 6)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows(got) == sorted(plain(docs, asked, 6), key=str)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_terms_are_maximal_runs():
    text = "Foo_bar—x1 É\x7fZ[a]\tÀé2;𝒳Q\n" * 3
    assert [t.decode() for piece in R.terms(text) for t in piece] == split(text)
    R.PIECE_BYTES, kept = 10, R.PIECE_BYTES
    assert [t.decode() for piece in R.terms(text) for t in piece] == split(text)
    R.PIECE_BYTES = kept


def test_segments_of_common_terms_are_not_read():
    rng = np.random.default_rng(2)
    n, n_terms = 5000, 40
    holds = rng.random((n, n_terms)) < np.where(np.arange(n_terms) < 4, 0.9, 0.01)
    term = np.nonzero(holds)[1]
    sizes = holds.sum(1)
    df = holds.sum(0)
    shard = R.Shard(sizes, term, rng.integers(1, 4, len(term)), 75 + rng.integers(0, 100, n), n_terms)
    asked = {t: R.weight(n, int(df[t])) for t in range(n_terms)}
    found, scores, read = shard.best(asked, 10, 0)
    every = shard.scores(np.arange(n), asked)
    order = np.lexsort((np.arange(n), -every))[:10]
    assert set(order.tolist()) <= set(found.tolist())
    assert (every[found] == scores).all()
    assert read < 0.5 * len(term) and len(found) < 0.1 * n
    assert (shard.best(asked, 10, int(every.max()) + 1)[1] <= every.max()).all()
    assert shard.best({}, 10, 0)[0].size == 0


def test_odd_tables(spark):
    d = spark.createDataFrame([(1, "a " * 1_500_000 + "b"), (2, "x" * 2_000_000), (3, "b c")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "b"), (2, "x" * 2_000_000)], "item_id int, text string")
    got = R.search(d, q)
    assert [(r.item_id, r.doc_id) for r in got.orderBy("item_id", "rank").collect()] == [(1, 3), (1, 1), (2, 2)] or rows(got) == sorted(plain([tuple(r) for r in d.collect()], [tuple(r) for r in q.collect()], 20), key=str)
    assert R.search(d.limit(0), q).count() == 0 and R.search(d, q.limit(0)).count() == 0
    assert R.search(d, q.limit(0)).columns == got.columns
