"""Fingerprints: neighbours and edits against a plain loop, collision rates against exact generalised Jaccard."""

import hashlib
import math
import random
from collections import Counter

import pytest

from trawl.llm import fingerprints as FP


def jaccard(a, b):
    x, y = Counter(a.lower().split()), Counter(b.lower().split())
    return sum((x & y).values()) / max(1, sum((x | y).values()))


@pytest.mark.parametrize("rows,bucket", [(1, 500), (150, 500), (150, 7), (900, 1)])
def test_neighbours_edits_and_likeness(spark, monkeypatch, rows, bucket):
    monkeypatch.setattr(FP, "BUCKET_ROWS", bucket)
    if bucket == 1:
        monkeypatch.setattr(FP, "QUANTILES", 64)
    rng = random.Random(rows)
    vocab = ["le", "été", "The", "漢", "x", *(f"w{k}" for k in range(40))]
    ids = rng.sample(range(0, 10**6, 7), rows)
    if rows > 100:
        ids[3] = 10**12
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60))) for _ in ids]
    texts[0] = None if rows > 1 else texts[0]
    df = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts)], "doc_id long, text string, next string")
    got = {r.doc_id: r for r in FP.fingerprints(df, hashes=16).collect()}
    order = sorted(zip(ids, texts))
    assert len(got) == rows
    off = []
    for n, (i, t) in enumerate(order):
        t, follow = t or "", order[(n + 1) % rows][1] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + follow[:cut]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        if t.split():
            off += [(r.near_edited, jaccard(t, edited)), (r.near_next, jaccard(t, follow))]
    if rows > 100:
        assert abs(sum(a - b for a, b in off) / len(off)) < 0.03
        assert (sum((a - b) ** 2 for a, b in off) / len(off)) ** 0.5 < 0.15


def test_rows(spark):
    df = spark.createDataFrame([(1, "a b", 1), (1, "a b", 1), (2, None, 1), (3, "", 1), (None, "A\tb", 1), (5, "word " * 30000, 1)], "doc_id long, text string, k long")
    out = FP.fingerprints(df).collect()
    assert len(out) == 6
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert len(by[1]) == 2 and by[1][0].fingerprint == by[1][1].fingerprint == by[None][0].fingerprint
    assert by[2][0].fingerprint == by[3][0].fingerprint == "0" * 128 and by[2][0].near_next == 1.0 and by[3][0].near_next == 0.0
    assert by[None][0].near_next == 1.0
    assert FP.fingerprints(df.limit(0)).count() == 0


@pytest.mark.parametrize("quantiles,bucket", [(16, 3), (16, 1), (4096, 500)])
def test_one_key_may_hold_many_rows(spark, monkeypatch, quantiles, bucket):
    monkeypatch.setattr(FP, "QUANTILES", quantiles)
    monkeypatch.setattr(FP, "BUCKET_ROWS", bucket)
    rows = [(None, f"none {k}") for k in range(90)] + [(5, f"five {k}") for k in range(90)] + [(k, f"one {k}") for k in range(6, 60)] + [(10**15 + k, "far") for k in range(20)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = FP.fingerprints(df, hashes=8).collect()
    assert sorted(r.doc_id or -1 for r in got) == sorted(i or -1 for i, _ in rows)
    mark = {t: (m >> 1) & (2**63 - 1) for t, m in df.selectExpr("text", "xxhash64(text) as m").distinct().collect()}
    order = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], mark[r[1]], r[1]))
    want = []
    for n, (i, t) in enumerate(order):
        cut, follow = len(t) // 4, order[(n + 1) % len(order)][1]
        want.append((i or -1, hashlib.sha256((t[: len(t) - cut] + follow[:cut]).encode()).hexdigest()))
    assert sorted((r.doc_id or -1, r.edited_sha256) for r in got) == sorted(want)
    keys = df.selectExpr("coalesce(doc_id, -9223372036854775808) as k", "shiftrightunsigned(xxhash64(text), 1) as mark")
    from pyspark.sql import functions as F

    sizes = [r["count"] for r in keys.select(FP.buckets_of(F.col("k"), F.col("mark"), keys.select("k"), len(rows)).alias("b")).groupBy("b").count().collect()]
    assert bucket == 500 or max(sizes) <= 60


def plain_fingerprint(spark, texts, hashes):
    """Samples from the formulas, one term at a time; only hash values come from Spark."""
    words = sorted({w for t in texts for w in t.lower().split()})
    table = spark.createDataFrame([(w,) for w in words], "w string").selectExpr("w", "xxhash64(w) as term")
    drawn = table.selectExpr("w", f"explode(sequence(0, {hashes - 1})) as k", "term").selectExpr("w", "k", "xxhash64(k, term) as g", "xxhash64(term, k) as h").collect()
    part = lambda x, low, bits: (((x & (2**64 - 1)) >> low & (1 << bits) - 1) + 0.5) * 2.0**-bits
    known = {(r.w, r.k): (-math.log(part(r.g, 0, 32) * part(r.g, 32, 32)), math.log(-math.log(part(r.h, 0, 24) * part(r.h, 24, 24))), part(r.h, 48, 16)) for r in drawn}
    out = []
    for t in texts:
        best = []
        for k in range(hashes):
            a = {}
            for w, n in Counter(t.lower().split()).items():
                r, log_c, beta = known[w, k]
                step = math.floor(math.log(n) / r + beta)
                a[w, step] = log_c - r * (step - beta) - r
            best.append(min(a, key=a.get) if a else None)
        out.append(best)
    return out


def test_samples_equal_the_formulas(spark):
    rng = random.Random(12)
    texts = [" ".join(rng.choice("a b c d e f g h i j".split()) for _ in range(rng.randint(1, 40))) for _ in range(40)]
    got = sorted(FP.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), hashes=16).collect(), key=lambda r: r.doc_id)
    plain = plain_fingerprint(spark, texts, 16)
    for i, r in enumerate(got):
        same = sum(x == y for x, y in zip(plain[i], plain[(i + 1) % 40], strict=True)) / 16
        assert r.near_next == same
    for one in range(40):
        for two in range(40):
            marks = [got[i].fingerprint[4 * k : 4 * k + 4] for i in (one, two) for k in range(16)]
            assert [x == y for x, y in zip(marks[:16], marks[16:], strict=True)] == [x == y for x, y in zip(plain[one], plain[two], strict=True)]


@pytest.mark.parametrize("words", [200, 100_000])
def test_collisions_of_long_texts_equal_the_likeness(spark, words):
    from pyspark.sql import functions as F

    # every word once, against the same words with ten of weight words / 10: generalised Jaccard n / (n - 10 + n)
    terms = spark.range(words).select(F.xxhash64("id").alias("term"), F.lit(0.0).alias("w0"), F.when(F.col("id") < 10, math.log(words / 10)).otherwise(0.0).alias("w1"))
    hashes = 400
    drawn = [F.min(a).alias(f"w{i}_{k}") for k in range(hashes // 50) for i, a in enumerate(FP.sample_of(F.col("term"), [F.col("w0"), F.col("w1")], F.col("turn") * (hashes // 50) + k))]
    rows = terms.withColumn("turn", F.explode(F.array(*map(F.lit, range(50))))).groupBy("turn").agg(*drawn).collect()
    same = [r[f"w0_{k}"] == r[f"w1_{k}"] for r in rows for k in range(hashes // 50)]
    true = words / (2 * words - 10)
    assert len(same) == hashes and abs(sum(same) / hashes - true) < 3.5 * (true * (1 - true) / hashes) ** 0.5


def test_query_has_the_stated_error(spark, tmp_path):
    rng = random.Random(6)
    texts = [" ".join(rng.choice([f"w{k}" for k in range(60)]) for _ in range(60)) for _ in range(300)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in FP.query(spark, str(tmp_path)).collect()}
    off = [(got[i].near_next, jaccard(t, texts[(i + 1) % 300])) for i, t in enumerate(texts)]
    stated = (sum(p * (1 - p) / 64 for _, p in off) / 300) ** 0.5
    assert (sum((a - p) ** 2 for a, p in off) / 300) ** 0.5 < 1.2 * stated
    assert all(len(r.fingerprint) == 256 for r in got.values())
