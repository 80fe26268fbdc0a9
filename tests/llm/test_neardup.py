"""Near-duplicates against brute force over all pairs; components against union-find."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trawl.llm import components as C
from trawl.llm import neardup
from trawl.llm.components import components


def find(p, x):
    while p[x] != x:
        x = p[x]
    return x


def brute(rows, size, num, den):
    sets = {}
    for i, t in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    p = {i: i for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(p, a), find(p, b)))
                    p[y] = x
    return {i: (len(sets[i]), find(p, i)) for i in ids}


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)] + ["É", "A", "a"]
    rows = []
    for family in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 25)):
            t = list(base)
            for _ in range(rng.randint(0, 6)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            rows.append(" ".join(t))
            if rng.random() < 0.3:
                rows.append(rows[-1].upper())
    rows += ["", None, "  ", "one", "One", "two words", "two words", "x y"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("size,ratio,block", [(3, (85, 100), 1000), (5, (4, 5), 7), (3, (85, 100), 3)])
def test_components_equal_brute_force(spark, monkeypatch, size, ratio, block):
    monkeypatch.setattr(neardup, "BLOCK_SIGNATURES", block)
    monkeypatch.setattr(neardup, "BLOCK_SETS", block)
    rows = corpus(block)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("x"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, size, ratio).collect()}
    assert got == brute(rows, size, *ratio)


def test_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "k"), (1, "a b c d e f", "k"), (2, "a b c d e f", "k"), (None, "a b c d e f", "k"), (3, None, "k")], "doc_id long, text string, component_id string")
    out = neardup.near_duplicates(df).collect()
    assert len(out) == 5 and {(r.doc_id, r.kept) for r in out} == {(1, True), (2, False), (None, True), (3, True)}
    kept = neardup.deduplicated(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {1, None, 3}
    assert neardup.near_duplicates(df.limit(0)).count() == 0


A, B, D = "a b c d e f g", "h i j k l m n o", "p q r s t u v"


def test_texts_of_one_id_are_one_document(spark):
    rows = [(1, A), (2, A), (0, B), (1, B), (1, ""), (7, D), (7, D), (7, D), (9, D), (None, D)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.component_id, r.kept) for r in got) == [
        (-1, None, True), (0, 0, True), (1, 0, False), (1, 0, False), (1, 0, False), (2, 0, False), (7, 7, True), (7, 7, True), (7, 7, True), (9, 7, False)
    ]
    one = spark.createDataFrame([(3, A), (3, B), (4, B), (5, A), (6, D)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in neardup.near_duplicates(one).collect()} == {(3, 3), (4, 3), (5, 3), (6, 6)}
    empty = spark.createDataFrame([(0, A), (1, A), (1, ""), (1, None), (2, ""), (2, "")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(empty).collect()) == [(0, 0, True), (1, 0, False), (1, 0, False), (1, 0, False), (2, 2, True), (2, 2, True)]


def test_one_row_of_a_component_stays_whatever_the_names(spark):
    rows = [(7, D, 1), (7, D, 2), (9, D, 3), (1, A, 4), (2, None, 5), (None, D, 6), (None, D, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone_id int").withColumn("Gone_ID_", F.lit(1)).withColumn("kept", F.lit("x"))
    kept = neardup.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "7", "None", "None"]


def test_very_long_texts(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300_000)]
    other = list(words)
    for k in range(0, len(other), 100):
        other[k] = "changed"
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, "x" * 3_000_000), (4, " " * 2_000_000), (5, "x" * 3_000_000 + " ")]
    got = {r.doc_id: r for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, (85, 100)).collect()}
    assert [got[i].component_id for i in range(1, 6)] == [1, 1, 3, 4, 3]
    assert got[1].n_shingles == len({tuple(words[k : k + 3]) for k in range(len(words) - 2)}) and got[4].n_shingles == 0


def test_signatures_of_large_sets_tell_sets_apart():
    hashes = neardup.MinHash(30, 6)
    rng = np.random.default_rng(1)
    one, two = (np.frombuffer(hashes.signature(hashes.minima(rng.integers(0, 2**64, 200_000, np.uint64))), np.uint8) for _ in range(2))
    assert (one == two).mean() < 0.05


@pytest.mark.parametrize("hub_rows,chunk", [(3, 7), (1000, 10**6)])
def test_star_rounds_find_components(spark, monkeypatch, hub_rows, chunk):
    monkeypatch.setattr(C, "HUB_ROWS", hub_rows)
    monkeypatch.setattr(C, "CHUNK", chunk)
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(5001, 5080)]
    p = {x: x for e in edges for x in e}
    for a, b in edges:
        x, y = sorted((find(p, a), find(p, b)))
        p[y] = x
    want = {x: find(p, x) for e in edges if e[0] != e[1] for x in e}
    got = components(spark.createDataFrame(edges, "a long, b long"), len(edges)).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)


def test_sets_are_fetched_only_for_pairs_that_signatures_leave(spark):
    words = [f"w{k}" for k in range(200)]
    texts = {1: words, 2: [*words[:-1], "other"], 3: [f"v{k}" for k in range(200)]}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, body string")
    sets = neardup.sets_of(docs, spark.createDataFrame([(i,) for i in texts], "node long"), 3, 3, 0.85)
    groups = spark.createDataFrame([(7, 1, 1), (7, 2, 1), (7, 3, 1)], "bucket long, node long, centre long")
    hashes = neardup.bands_for(0.85) * neardup.ROWS
    pairs = groups.where("node <> centre").select("node", "centre")
    assert [tuple(r) for r in neardup.signed_pairs(pairs, sets, (85, 100), hashes).collect()] == [(2, 1)]
    assert [tuple(r) for r in neardup.centre_links(groups, sets, (85, 100), hashes).collect()] == [(1, 2)]


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(3)
    for n, changed in ((1, 1), (40, 5), (500, 60), (60_000, 9_000)):  # counts of the last go round
        one = np.unique(rng.integers(0, 2**64, n, np.uint64))
        two = np.unique(np.concatenate([one[changed:], rng.integers(0, 2**64, changed, np.uint64)]))
        counts = [neardup._sketches(pa.chunked_array([[neardup.sketch(x)]])) for x in (one, two)]
        assert 0 <= neardup.apart(counts[0][0], counts[1])[0] <= len(np.setxor1d(one, two))
        assert neardup.apart(*counts)[0] == neardup.apart(*counts[::-1])[0]


def test_sketches_rule_out_pairs_that_signatures_leave(spark):
    words = [f"w{k}" for k in range(500)]
    changed = {2: range(0, 500, 16), 3: range(0, 500, 30), 4: range(0, 500, 40)}  # likeness 0.67 to 0.86
    texts = {1: words} | {i: [f"other{k}" if k in at else w for k, w in enumerate(words)] for i, at in changed.items()}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, body string")
    sets = neardup.sets_of(docs, spark.createDataFrame([(i,) for i in texts], "node long"), 4, 3, 0.85)
    hashes = neardup.bands_for(0.85) * neardup.ROWS
    pairs = spark.createDataFrame([(i, 1) for i in changed], "node long, centre long")
    assert [tuple(r) for r in neardup.signed_pairs(pairs, sets, (85, 100), hashes).collect()] == [(4, 1)]


def test_signatures_stay_with_the_nodes_of_buckets(spark):
    docs = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    assert neardup.signed(docs, 3, 0.85).columns == ["doc_id", "n_shingles", "digest", "bands"]
    sets = neardup.sets_of(docs.withColumnRenamed("text", "body"), spark.createDataFrame([(1,)], "node long"), 1, 3, 0.85)
    assert sets.first().bands == neardup.signed(docs, 3, 0.85).first().bands
