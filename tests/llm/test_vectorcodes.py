"""Vector codes against plain Lloyd rounds with every distance taken."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trawl.llm import vectorcodes as V


def plain(rows, parts, entries, rounds):
    """rows: (id, vector, label) in the order of ids.  {id: (code, error)}, the codebooks' digest, errors by label."""
    whole = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = len(whole[0][1]) // parts
    cut = lambda v, p: v[p * size : (p + 1) * size]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    books = [[cut(v, p) for _, v, _ in whole[:entries]] for p in range(parts)]
    assign = lambda: [[min((gap(cut(v, p), c), e) for e, c in enumerate(books[p])) for p in range(parts)] for _, v, _ in whole]
    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), c in zip(whole, codes, strict=True) if c[p][1] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = assign()
    by_label = {}
    for (_, _, lab), c in zip(whole, last, strict=True):
        by_label[lab] = by_label.get(lab, 0) + sum(d for d, _ in c)
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for _, e in c), sum(d for d, _ in c), by_label[lab]) for (i, _, lab), c in zip(whole, last, strict=True)], digest


SCHEMA = "vec_id long, embedding array<float>, label int"


def made(n, seed, ties):
    rng = random.Random(seed)
    draw = (lambda: rng.randint(-2, 2) / 256) if ties else (lambda: float(np.float32(rng.gauss(0, 1))))
    rows = [(i, [draw() for _ in range(8)], rng.choice([0, 1, None])) for i in range(n)]
    rows[5] = (5, None, 1)
    rows[6] = (6, [None] * 8, 1)
    rows[7] = (7, [1.0] * 7 + [float("nan")], 1)
    rows[9] = (9, [float("inf")] + [0.0] * 7, 1)
    return rows


@pytest.mark.parametrize(("ties", "broadcast"), [(False, 10), (True, 0)])
def test_codes_are_those_of_plain_rounds(spark, monkeypatch, ties, broadcast):
    import trawl.llm.common as common

    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    rows = made(400, 3, ties)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("id", F.lit("x")).withColumn("code", F.lit(1)).withColumn("part", F.lit(1))
    got = V.digests(df, 4, 12, 2)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    want, digest = plain(rows, 4, 12, 2)
    assert sorted(tuple(r)[:4] for r in got.collect()) == sorted(want)
    assert {r.codebooks_sha256 for r in got.collect()} == {digest}


def test_bounds_rule_out_and_stay_right():
    rng = np.random.default_rng(1)
    x = rng.integers(-300, 300, (3000, 4))
    book = x[:64].copy()
    group = V.grouped(book)
    code, own, low = V.first_codes(x, book, group)
    for _ in range(6):
        before = book
        book = np.array([x[code == e].sum(0) // max((code == e).sum(), 1) if (code == e).any() else book[e] for e in range(64)])
        code, own, low, looked = V.next_codes(x, code, low, before, book, group)
        every = V.distances(x, book)
        assert (code == every.argmin(1)).all() and (own == every.min(1)).all()
        every[np.arange(len(x)), code] = V.FAR
        for g in range(V.GROUPS):
            assert (low[:, g].astype(float) <= np.sqrt(every[:, group == g].min(1).astype(float))).all()
    assert looked < 0.4 * len(x) * V.GROUPS  # most groups are ruled out by their bounds


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert V.digests(empty).count() == 0
    assert V.digests(spark.createDataFrame([(1, None, 2), (2, [None], 3)], SCHEMA)).count() == 0
    few = [(3, [0.5] * 16, None), (3, [0.5] * 16, None), (None, [-0.25] * 16, 7), (1, [1e30] * 16, 7), (2, [0.5] * 3, 7)]
    got = V.digests(spark.createDataFrame(few, SCHEMA)).collect()
    assert sorted((str(r.vec_id), r.code[:2]) for r in got) == [("1", "00"), ("3", "01"), ("3", "01"), ("None", "03")]
    assert all(r.error == 0 for r in got)  # four entries for three different vectors
    long = [(i, [float(i + k) / 999 for k in range(20_000)], 0) for i in range(8)]
    assert V.digests(spark.createDataFrame(long, SCHEMA), 16, 4).count() == 8


def test_codes_restore_vectors(spark):
    rows = [(i, [float(np.float32(math.sin(i * k))) for k in range(32)], i % 3) for i in range(200)]
    codes, books = V.compress(spark.createDataFrame(rows, SCHEMA), 8, 64, 2)
    back = {r.id: r.vector for r in V.restored(codes, books).collect()}
    loss = sum((a - b) ** 2 for i, v, _ in rows for a, b in zip(v, back[i], strict=True))
    assert loss < 0.5 * sum(a * a for _, v, _ in rows for a in v)
    assert codes.where("code is null").count() == 0 and V.compress(spark.createDataFrame(rows[:1], SCHEMA))[0].count() == 1
