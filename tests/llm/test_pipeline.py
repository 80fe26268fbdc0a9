"""The pipeline against its operators, stage by stage, and against plain loops, on small corpora; and its decisions."""

import random
from collections import defaultdict

import corpus_pipeline as P
import public_tokenizers
import pytest
import test_neardup
import test_packing
import test_quality
import test_rules
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trawl.llm import neardup, quality, rules


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(3)
    words = [f"word{k}" for k in range(200)]

    def text(n):
        return "".join(rng.choice(words) + (". " if k % 8 == 7 else ", " if k % 8 == 3 else " ") for k in range(n))

    good = [text(rng.randint(40, 300)) for _ in range(120)]
    rows = [(i, t, "en", f"s{i % 5}", len(t)) for i, t in enumerate(good)]
    rows += [(1000 + i, good[i], "en", "s1", len(good[i])) for i in range(20)]
    rows += [(2000 + i, text(60).replace(" ", "$$$ "), "en", "s2", 1) for i in range(20)]
    rows += [(3000, "too short", "en", "s1", 9), (3001, None, "en", "s1", 0), (3002, "same five words right here " * 30, "en", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality classifier", "quality rules", "minhash near-dedup", "best-fit packing"]
    ids = {r.doc_id for r in docs.collect()}
    for k, (want, stage) in enumerate(zip(
        (
            lambda d: {r.doc_id for r in quality.classify(d).where("kept").collect()},
            lambda d: {r.doc_id for r in rules.judge(d).where("kept").collect()},
            lambda d: {r.doc_id for r in neardup.near_duplicates(d).where("kept").collect()},
        ),
        P.STAGES[:3],
        strict=True,
    )):
        out = stage[1](spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        keep = {r.doc_id for r in out.collect()}
        assert keep == want(docs) and keep < ids
        ids, docs = keep, P.written(out, f"t{k}")
    assert ids == set(range(120))
    packed = P.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == ids
    used = packed.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in used) <= 1024


def plain_rules(rows):
    """Rows (doc_id, text, host) that stay: rules one by one, hosts with a beta prior by moments."""
    verdicts, hosts = {}, defaultdict(list)
    for i, text, host in rows:
        n_words, chars, symbols, dup_lines, repeat = test_rules.plain(text or "")
        lines = sum(bool(x.strip(" \t\n\v\f\r")) for x in (text or "").split("\n"))
        verdicts[i] = n_words < 10 or 100 * repeat > 20 * n_words
        if host is not None:
            hosts[host].append(verdicts[i] or 100 * symbols > 10 * chars or 100 * dup_lines > 30 * lines)
    rates = [sum(x) / len(x) for x in hosts.values()]
    mean = min(max(sum(rates) / len(rates), 1e-6), 1 - 1e-6)
    between = sum((r - sum(rates) / len(rates)) ** 2 for r in rates) / len(rates) - mean * (1 - mean) * sum(1 / len(x) for x in hosts.values()) / len(hosts)
    weight = min(max(mean * (1 - mean) / between - 1, 1.0), 1e6) if between > 0 else 1e6
    bad = {h for h, x in hosts.items() if (sum(x) + mean * weight) / (len(x) + weight) > 0.5}
    return [r for r in rows if not verdicts[r[0]] and r[2] not in bad]


def test_pipeline_equals_plain_loops(spark, tmp_path):
    rng = random.Random(21)
    words = [f"word{k}" for k in range(120)]

    def text(n):
        return "".join(rng.choice(words) + (". " if k % 8 == 7 else ", " if k % 8 == 3 else " ") for k in range(n))

    rows = [(i, text(rng.randint(5, 150)), f"h{i % 4}") for i in range(60)]
    for i in range(12):
        changed = rows[i][1].split(" ")
        changed[rng.randrange(len(changed))] = "changed"
        rows.append((100 + i, " ".join(changed), "h1"))
    rows += [(200 + i, text(40).replace(" ", " %%% "), "h2") for i in range(8)] + [(300 + i, "too short", "poor") for i in range(9)] + [(310, text(90), "poor"), (320, None, None), (321, text(1500), None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    left = [r for r, score in zip(rows, test_quality.plain_scores([r[1] for r in rows]), strict=True) if score >= 0.5]
    assert 0 < len(left) < len(rows)
    ruled = plain_rules(left)
    assert 0 < len(ruled) < len(left) and 310 not in {r[0] for r in ruled}
    groups = test_neardup.brute([r[:2] for r in ruled], 5, 4, 5)
    kept = [r for r in ruled if groups[r[0]][1] == r[0]]
    assert 0 < len(kept) < len(ruled)
    lib, pieces, spans = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}, defaultdict(list)
    for r in P.run(spark, str(tmp_path)).collect():
        pieces[r.doc_id, r.piece] = (r.start, r.length)
        spans[r.sequence_id].append((r.offset, r.length))
    want, lengths = {}, []
    for i, t, _ in kept:
        n, at = len(lib.encode(t or "", add_special_tokens=False).ids) + 1, 0
        cuts = [n % 1024 or 1024] + [1024] * ((n - 1) // 1024) if n > 1024 else [n]
        for k, size in enumerate(cuts):
            want[i, k] = (at, size)
            at += size
        lengths += cuts
    assert pieces == want
    for s in spans.values():
        assert [o for o, _ in sorted(s)] == [sum(n for _, n in sorted(s)[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 1024
    assert len(spans) <= len(test_packing.plain_best_fit(lengths, 1024)) + 1


@pytest.mark.parametrize("stage", range(3))
def test_stages_keep_any_columns_and_take_empty_tables(spark, stage):
    names = ["verdict_host", "trawl_m", "gone_id", "bad_host", "kept", "score", "features", "node", "digest", "m"]
    rows = [(i, "plain words make a sentence here, as they should, again and again " + f"w{i} " * 3, f"h{i % 3}") for i in range(12)] + [(None, None, None), (3, "", "h1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for n in names:
        df = df.withColumn(n, F.lit("x"))
    out = P.STAGES[stage][1](spark, df, "")
    assert out.columns == df.columns and out.count() <= len(rows)
    assert P.STAGES[stage][1](spark, df.limit(0), "").count() == 0
    assert P.STAGES[3][1](spark, df.limit(0), "").count() == 0
