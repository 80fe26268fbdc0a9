"""Rules against a plain re-count, host shrinkage on a small corpus."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trawl.llm import rules


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    win = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times, covered = Counter(win), set()
    for i, w in enumerate(win):
        if times[w] > 1:
            covered |= set(range(i, i + 5))
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_measures_match_plain_counts():
    rng = random.Random(2)
    for n in range(400):
        text = "".join(rng.choice(["a", "b", "é", "漢", " ", " ", "\n", "\t", "\x1c", "\x85", "#", "<", "\r", "\v"]) for _ in range(rng.randint(0, 300)))
        m = rules.measure(text)
        assert (m[0], m[1], m[2], m[4], m[5]) == plain(text)
        words = text.encode().split()
        short = rules.repeated_words(words)
        rules.LONG_TEXT, kept = 0, rules.LONG_TEXT
        assert rules.repeated_words(words) == short
        rules.LONG_TEXT = kept


GOOD = "one two three four five six seven eight nine ten eleven {}"


def test_hosts_are_judged_together(spark):
    rows = [(i, GOOD.format(i), "good", "x") for i in range(60)]
    rows += [(100 + i, GOOD.format(i) if i % 10 == 0 else "short", "bad", "x") for i in range(60)]
    rows += [(200, "short", "single", "x"), (201, GOOD, None, "x"), (202, None, "good", "x"), (203, "", None, "x"), (201, GOOD, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, host string")
    got = {r.doc_id: r.kept for r in rules.judge(df).collect()}
    assert all(got[i] for i in range(60)) and not any(got[100 + i] for i in range(60))
    assert got[201] and not got[200] and not got[202] and not got[203]
    kept = rules.documents_kept(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [*range(60), 201, 201]
    assert rules.judge(df.limit(0)).count() == 0 and rules.documents_kept(df.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast", [0, 100_000])
def test_any_names_and_any_number_of_hosts(spark, monkeypatch, broadcast):
    monkeypatch.setattr(rules, "BROADCAST_ROWS", broadcast)
    rows = [(i, GOOD.format(i), "good") for i in range(40)] + [(100 + i, GOOD.format(i) if i % 10 == 0 else "short", "bad") for i in range(40)] + [(200, GOOD.format(0) + " x" * 3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in ("verdict_host", "bad_host", "BAD_HOST_", "trawl_m", "host", "n_words", "kept", "m"):
        df = df.withColumn(name, F.lit("x"))
    kept = rules.documents_kept(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [*range(40), 200]
    assert sorted(r.doc_id for r in rules.judge(df).where("kept").collect()) == [*range(40), 200]


def test_very_long_texts(spark):
    words = [f"w{k}" for k in range(400_000)]
    rows = [(1, " ".join(words), "a"), (2, "x" * 3_000_000, "a"), (3, " ".join(words + words[:7]), "a"), (4, "\n" * 1_000_000, "b")]
    got = {r.doc_id: r for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert [(got[i].n_words, got[i].n_repeat_words) for i in (1, 2, 3, 4)] == [(400_000, 0), (1, 0), (400_007, 14), (0, 0)]
    assert got[2].word_chars == 3_000_000


def test_few_documents_are_shrunk_to_the_corpus(spark):
    rows = [(i, 20, 100, 0, 5, 0, 0, f"h{i % 40}") for i in range(4000)] + [(9999, 3, 9, 0, 1, 0, 0, "one")]
    df = spark.createDataFrame(rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, host string")
    rates = {r.host: r.rate for r in rules.host_rates(df).collect()}
    assert rates["one"] < 1 and rates["h0"] < 0.05
