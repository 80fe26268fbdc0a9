"""Packing against plain best fit on small inputs, and its invariants on rows."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trawl.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [(g, i) for i, g in enumerate(bins) if g >= n]
        if fits:
            bins[min(fits)[1]] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


@pytest.mark.parametrize("seed,fan,kind", [(1, 4, "any"), (2, 32, "any"), (3, 8, "short"), (4, 8, "equal"), (5, 16, "long"), (6, 4, "middle")])
def test_rounds_pack_like_plain_best_fit(spark, monkeypatch, seed, fan, kind):
    monkeypatch.setattr(packing, "FAN", fan)
    rng = random.Random(seed)
    capacity = rng.randint(20, 60)
    low, high = {"any": (1, capacity), "short": (1, capacity // 6), "equal": (7, 7), "long": (capacity // 2, capacity), "middle": (capacity // 4, capacity // 3)}[kind]
    lengths = [rng.randint(low, high) for _ in range(400)]
    counts = [(n, lengths.count(n)) for n in sorted(set(lengths))]
    plan, rows = packing.rounds(spark.createDataFrame(counts, "length long, n long"), capacity)
    used, placed = defaultdict(list), defaultdict(set)
    found = plan.collect()
    assert len(found) == rows
    for r in found:
        for k in range(r.last - r.first + 1):
            used[r.sequence0 + k // r.each].append((r.offset0 + k % r.each * r.to_length, r.to_length))
            assert r.first + k not in placed[r.to_length]
            placed[r.to_length].add(r.first + k)
    assert {n: set(range(k)) for n, k in counts} == placed
    for spans in used.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(used) <= len(plain_best_fit(lengths, capacity)) + 1


def test_runs_of_white_space_and_of_one_letter(spark):
    """Longer than what the usual pattern can take."""
    texts = [" " * 2_000_000, "\n" * 2_000_000 + "a", "-" * 2_000_000, "ab" * 1_000_000, "x <|endoftext|>" + " \t" * 600_000 + "y<|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = packing.pieces(df, PATH, 1024, 2, keep_ids=True).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("piece", "ids"))).alias("p")).collect()
    lib = Tokenizer.from_file(PATH)
    for r in got:
        assert sum((x.ids for x in r.p), []) == lib.encode(texts[r.doc_id], add_special_tokens=False).ids + [2]


def test_rows_and_ids(spark):
    texts = [None, "", "a b c", "Hello <|endoftext|> é漢😀", "word " * 3000, "x" * 5000, "a b c", "\n\n  \t"]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)] + [(0, None, 7), (None, "a b c", 7), (None, "a b c", 7)], "doc_id long, text string, length int")
    got = packing.pack_documents(df, PATH, 64, 2, keep_ids=True).collect()
    lib = Tokenizer.from_file(PATH)
    by_doc = defaultdict(dict)
    spans = defaultdict(list)
    for r in got:
        if r.doc_id:
            by_doc[r.doc_id][r.piece] = r
        spans[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
    for i, t in enumerate(texts[1:], 1):
        want = lib.encode(t, add_special_tokens=False).ids + [2]
        rows = [by_doc[i][k] for k in range(len(by_doc[i]))]
        assert sum((r.ids for r in rows), []) == want
        assert all(r.length == 64 for r in rows[1:]) and [r.start for r in rows] == [sum(x.length for x in rows[:k]) for k in range(len(rows))]
    assert sum(r.doc_id == 0 for r in got) == 2 and sum(r.doc_id is None for r in got) == 2
    for s in spans.values():
        assert [o for o, _ in sorted(s)] == [sum(n for _, n in sorted(s)[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 64


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(df, PATH).count() == 0
