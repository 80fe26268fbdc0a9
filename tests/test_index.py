"""Blocks, positions, look-ups by keys, questions as a table, greedy keeping, exact ranks, long conversations."""

import json
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trawl import scratch
from trawl.functions import intent as I
from trawl.functions import lexicon as L
from trawl.functions import pytext, questions
from trawl.operators import batch, blocks, duplicates, fetch, inverted, packets, sessions, statistics
from trawl.plans import registry
from trawl.plans.engine import Archive, archive_parts
from trawl.sources import exports, jsonlist, store


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    words = ["the"] * 30 + ["of"] * 10 + [f"w{k}" for k in range(60)]
    return [(i, f"c{i % 37}", i % 11, rng.choice(["user", "assistant"]), float(i % 50), rng.choice(["alpha", "beta note"]), " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(1, n + 1)]


@pytest.fixture(scope="module")
def index(spark):
    df = spark.createDataFrame(corpus(), "chunk_id long, conversation_id string, turn_index int, role string, create_time double, title string, text string").repartition(3)
    chunks = inverted.with_tokens(df).cache()
    stats = inverted.corpus_stats(chunks).cache()
    terms = inverted.postings(chunks, stats).cache()
    return {"chunks": chunks, "stats": stats, "terms": terms, "at": inverted.positions(chunks).cache(), "blocks": blocks.blocks(terms, stats).cache()}


def every_score(t, searches):
    return {(r.search, r.chunk_id): r.bm25 for r in inverted.bm25(t["chunks"], t["terms"], t["stats"], searches, t["at"]).collect()}


def first(scores, s, k, allowed=None):
    return [c for _, c in sorted((round(v, 12), c) for (q, c), v in scores.items() if q == s and (allowed is None or c in allowed))[:k]]


SEARCHES = {0: ["the", "w3"], 1: ["the"], 2: ["of", "the", "w1", "w2", "w2"], 3: ["nowhere"], 4: ["alpha", "w5", "nowhere"]}


@pytest.mark.parametrize(("few", "looked_up"), [(0, 4000), (0, 3), (10**9, 4000)])
def test_the_best_by_blocks_are_the_best_of_all(index, monkeypatch, few, looked_up):
    monkeypatch.setattr(blocks, "LOOKED_UP", looked_up)
    scores = every_score(index, [([[t] for t in each], False) for each in SEARCHES.values()])
    users = {r.chunk_id for r in index["chunks"].where("role = 'user' and create_time < 7").collect()}
    held = blocks.held(index["blocks"], sorted({t for each in SEARCHES.values() for t in each}))
    stats = index["stats"].first()
    for condition, allowed in ((None, None), ((F.col("role") == "user") & (F.col("create_time") < 7), users)):
        rows = blocks.best(index["chunks"], index["terms"], (stats["n"], stats["avgdl"]), SEARCHES, held, 7, condition, few=few)
        for s in SEARCHES:
            got = [c for _, c in sorted((round(r["bm25"], 12), r["chunk_id"]) for r in rows if r["search"] == s)]
            assert got == first(scores, s, 7, allowed)
            assert all(abs(r["bm25"] - scores[s, r["chunk_id"]]) < 1e-9 for r in rows if r["search"] == s)


def test_fewer_than_a_tenth_of_a_common_terms_postings_are_read(index):
    held = blocks.held(index["blocks"], ["the", "w7"])
    number = sum(b.n for b in held["the"])
    assert number > 300 and all(a.level > b.level and a.least >= b.most - 1e-12 for a, b in zip(held["the"], held["the"][1:], strict=False))
    told = []
    stats = index["stats"].first()
    blocks.best(index["chunks"], index["terms"], (stats["n"], stats["avgdl"]), {0: ["the"]}, held, 5, few=0, seen=lambda planned, k: told.append(planned[0]))
    read = sum(b.n for b in held["the"] if b.level >= told[0].levels["the"])
    assert len(told) == 1 and 5 <= read < number / 10
    planned = blocks.cuts({"the": inverted.LEAST_IDF, "w7": 3.0}, held, 3, few=0)
    assert planned.levels["the"] == max(b.level for b in held["the"]) + 1 and planned.unread["the"] < planned.floor  # it weighs nothing: none of it is read


def test_phrases_are_joins_of_positions(index):
    phrases = [["the", "of"], ["the", "the"], ["w1", "the", "of"], ["beta", "note"], ["note", "beta"], ["of", "nowhere"]]
    counts = {r["term"]: r["n"] for r in index["terms"].groupBy("term").agg(F.count("*").alias("n")).collect()}
    told = {}
    for r in index["chunks"].collect():
        for i, p in enumerate(phrases):
            n = [sum(list(t[k : k + len(p)]) == p for k in range(len(t))) for t in (r.title_tokens, r.text_tokens)]
            if sum(n):
                told[i, r.chunk_id] = (*n, r.doc_len)
    for known in (None, counts):
        rows = inverted.phrase_hits(index["at"], index["terms"], phrases, known)
        assert {(r.phrase, r.chunk_id): (r.tf_title, r.tf_text, r.doc_len) for r in rows.collect()} == told


def test_many_searches_at_once(spark, index):
    asked = [(s, [t]) for s, each in SEARCHES.items() for t in each] + [(5, ["the", "of"]), (5, ["w1"]), (6, ["of", "of"]), (7, ["nowhere", "the"])]
    df = spark.createDataFrame(asked, "search int, phrase array<string>")
    scores = every_score(index, [([list(p) for q, p in asked if q == s], False) for s in range(8)])
    for few in (0, 10**9):
        got = {}
        for r in batch.best(index["terms"], index["at"], index["blocks"], index["stats"], df, 6, few).orderBy("search", "rank").collect():
            got.setdefault(r.search, []).append(r.chunk_id)
        assert got == {s: f for s in range(8) if (f := first(scores, s, 6))}


@pytest.mark.parametrize(("terms", "chunks"), [(100_000, 1_000_000), (0, 0)])
def test_an_index_of_what_is_asked_ranks_as_the_whole_index(spark, index, monkeypatch, terms, chunks):
    monkeypatch.setattr(batch, "SENT_TERMS", terms)
    monkeypatch.setattr(batch, "SENT_CHUNKS", chunks)
    asked = spark.createDataFrame([(s, [t]) for s, each in SEARCHES.items() for t in each] + [(5, ["the", "of"]), (5, ["w1"]), (7, ["of", "w2", "the"])], "search int, phrase array<string>").cache()
    own = batch.index_of(index["chunks"], asked)
    tokens = {t for r in asked.collect() for t in r.phrase}
    assert {r.term for r in own[0].select("term").distinct().collect()} == tokens - {"nowhere"}
    ranked = lambda *tables: sorted(tuple(r) for r in batch.best(*tables, asked, 6, 0).select("search", "rank", "chunk_id", F.round("bm25", 9)).collect())
    found = ranked(*own)
    assert found == ranked(index["terms"], index["at"], index["blocks"], index["stats"])
    scores = every_score(index, [([list(r.phrase) for r in asked.collect() if r.search == s], False) for s in range(8)])
    for s in range(8):
        assert [c for q, _, c, _ in found if q == s] == first(scores, s, 6)


def test_question_ranks_writes_the_postings_it_asks_for(spark):
    """Of a corpus without a stored index neither other terms' postings, nor positions, nor forms for comparison are made; and only pairs that reach the floor are kept."""
    before = set(scratch._files)
    rows = registry.QUERIES["question_ranks"](spark, "/root/testdata/sf0.001").collect()
    made = {path.rsplit("/", 1)[1].rsplit("-", 1)[0]: path for path in scratch._files if path not in before}
    assert rows and not {"positions", "chunks"} & set(made)
    tokens = {t for r in spark.read.parquet(made["asked"]).collect() for t in r.phrase}
    assert {r.term for r in spark.read.parquet(made["postings"]).select("term").distinct().collect()} <= tokens
    scored, floors = spark.read.parquet(made["scored"]), spark.read.parquet(made["searches"]).groupBy(F.col("search").alias("s")).agg(F.max("floor").alias("floor"))
    assert scored.join(floors, F.col("search") == F.col("s")).where("high < floor * (1 - 2e-9)").count() == 0


def test_short_texts_need_no_python_and_texts_are_cut_once(spark):
    texts = ["one", "two words", "  odd\t\tspaces ", "\u00a0", "long " * 30, "x" * 59, "x" * 60, "x" * 61, "", None]
    messages = spark.createDataFrame([("c", f"m{i}", i, True, "user", 1.0 + i, t) for i, t in enumerate(texts)], "conversation_id string, message_id string, active_position int, is_active boolean, role string, create_time double, text string")
    heads = spark.createDataFrame([("c", "title", "f", 0)], "conversation_id string, title string, source_file string, position int")
    found = sessions.chunks(heads, messages, 60, 10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "UDTF" not in plan and "Python" not in plan  # what is numbered has been cut and written
    got = [(r.chunk_id, r.message_id, r.chunk_index, r.text) for r in found.orderBy("chunk_id").collect()]
    told = [(f"m{i}", n, p) for i, t in enumerate(texts) if t for n, p in enumerate(pytext.pieces(t, 60, 10))]
    assert got == [(k, *row) for k, row in enumerate(told, 1)]


def test_questions_as_columns_are_those_of_one(spark):
    asked = ["when did I first start building Nova", "how has the plan changed over time", 'he said "of the thon" once to Erin2, Erin2 and "Zoë"', "that was wrong, what instead", "what is the latest", "final position now", "", "the", "Straße “ab cd” X-Ray currently", "exact phrase"]
    rows = questions.interpreted(spark.createDataFrame(list(enumerate([*asked, None])), "i int, q string"), "i", "q").cache()
    got = {r.question: r for r in rows.collect()}
    assert set(got) == set(range(len(asked)))
    made = {}
    for r in questions.searches(rows).orderBy("question", "n").collect():
        made.setdefault(r.question, []).append((r.kind, r.text, r.weight, list(r.phrases), r.needs_all))
    for i, q in enumerate(asked):
        intent = I.interpret(q)
        assert (got[i].mode, tuple(got[i].flags), tuple(got[i].quoted), tuple(got[i].names)) == (intent.primary_mode, intent.flags, intent.quoted, intent.identifiers)
        assert made.get(i, []) == [(v.kind, v.text, v.weight, *I.search_terms(v)) for v in I.variants(q, intent)]


def scanned(df):
    """Rows that come out of the plan's scans."""
    df.collect()
    def rows(p):
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            return rows(p.executedPlan())
        own = p.metrics().apply("numOutputRows").value() if name.startswith("Scan") else 0
        found = [p.plan()] if "QueryStage" in name else [p.children().apply(i) for i in range(p.children().size())]
        return own + sum(map(rows, found))
    return rows(df._jdf.queryExecution().executedPlan())


def test_look_ups_skip_what_lies_elsewhere(spark, tmp_path):
    table = spark.range(200_000).select(F.col("id").alias("chunk_id"), F.concat(F.lit("c"), F.lpad(F.floor(F.col("id") / 10).cast("string"), 6, "0")).alias("conversation_id"), F.repeat(F.lit("x"), 20).alias("text"))
    path = str(tmp_path / "t")
    fetch.in_id_order(table.orderBy(F.rand(3))).write.option("parquet.page.row.count.limit", "500").option("parquet.block.size", str(256 << 10)).parquet(path)
    ids = [5, 6, 7, 70_000, 70_003, 199_999]
    near = spark.read.parquet(path).where(fetch.near("chunk_id", ids))
    keys = spark.createDataFrame([(i,) for i in ids], "k long")
    assert sorted(r.chunk_id for r in near.join(F.broadcast(keys), F.col("chunk_id") == F.col("k")).collect()) == ids
    assert scanned(near) < 20_000
    assert scanned(spark.read.parquet(path).where(fetch.near("conversation_id", ["c000001", "c010000"]))) < 20_000
    assert spark.read.parquet(path).where(fetch.near("chunk_id", [])).count() == 0
    assert fetch.ranges([9, 1, 2, 50, 51], 2) == [(1, 9), (50, 51)] and fetch.ranges([4], 3) == [(4, 4)] and len(fetch.ranges(map(str, range(100)), 7)) <= 7


def test_answers_scan_no_table_in_one_task(spark, tmp_path):
    rng = random.Random(8)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", " ".join(rng.choice(["the", "of", f"w{rng.randint(0, 300)}"]) for _ in range(20))) for c in range(60) for t in range(10)]
    store.save(spark, str(tmp_path), archive_parts(*exports.from_flat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))
    archive = Archive.open(spark, str(tmp_path))
    found, near, counts = archive.candidates("how has the w5 changed", I.variants("how has the w5 changed", I.interpret("how has the w5 changed")), L.DEPTHS["light"], None, None)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" not in plan and "PushedFilters: [IsNotNull(chunk_id), Or(" in plan.replace("PushedFilters: [Or(", "PushedFilters: [IsNotNull(chunk_id), Or(")
    assert counts["unique_chunks"] == found.count() > 0 and counts["semantic_rows"] == 0
    assert archive.context("how has the w5 changed", "light")["trace"]["candidate_counts"]["unique_chunks"] == counts["unique_chunks"]
    manifest = store.read_manifest(spark, str(tmp_path))
    told = manifest["statistics"]["turns"]
    assert told["rows"] == 300 and told["bytes"] > 0 and told["columns"]["turn_index"]["greatest"] == "4" and "user_text" not in told["columns"]
    (next((tmp_path / manifest["version"] / "turns").glob("*.parquet"))).unlink()
    with pytest.raises(ValueError, match="turns has"):
        Archive.open(spark, str(tmp_path))


def test_keeping_in_order_is_the_walk(spark):
    rng = random.Random(9)
    for n, links in ((1, 0), (30, 20), (60, 200), (40, 0)):
        nodes = [(i, rng.random()) for i in range(n)]
        pairs = [tuple(rng.sample(range(n), 2)) for _ in range(links)] if n > 1 else [(0, 0)]
        pairs += [(0, 999), (0, 0)]
        kept = []
        for i, _ in sorted(nodes, key=lambda x: x[1]):
            if not any((i, k) in pairs or (k, i) in pairs for k in kept if k != i):
                kept.append(i)
        got = duplicates.kept_in_order(spark.createDataFrame(pairs, "one long, two long"), spark.createDataFrame(nodes, "id long, place double"), "id", "place")
        assert sorted(r.id for r in got.collect()) == sorted(kept)
    chain = [(i, i + 1) for i in range(6)]
    got = duplicates.kept_in_order(spark.createDataFrame(chain, "one long, two long"), spark.range(7).withColumn("place", F.col("id")), "id", "place")
    assert sorted(r.id for r in got.collect()) == [0, 2, 4, 6]


@pytest.mark.parametrize("most", [0, 16])
def test_whole_tables_are_kept_greedily(spark, monkeypatch, most):
    monkeypatch.setattr(duplicates, "PAIRS_A_ROW", most)
    rng = random.Random(15)
    vocab, texts = [f"w{k}" for k in range(80)], []
    for _ in range(8):
        base = [rng.choice(vocab) for _ in range(rng.randint(20, 90))]
        for _ in range(9):
            t = list(base)
            for _ in range(rng.randint(0, 1)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            texts.append(" ".join(t))
        texts.append(" ".join(base[: len(base) * 2 // 3]))
    texts += ["x" * 130, "y " + "x" * 200 + " z", "x" * 130 + " " + "q" * 20, "", "one", "one"]
    rng.shuffle(texts)
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)
    kept = []
    for t, i in sorted(((t, i) for t, i in first.items() if t), key=lambda x: x[1]):
        if not any(pytext.near_duplicate(texts[k], t) for k in kept):
            kept.append(i)
    got = duplicates.near_kept(spark.createDataFrame(list(enumerate(texts)), "doc_id long, form string"), "doc_id").collect()
    assert sorted(r.doc_id for r in got) == kept and len(kept) < len(first) - 10
    if most:
        assert duplicates.near_kept(spark.createDataFrame([], "doc_id long, form string"), "doc_id").count() == 0


@pytest.mark.parametrize("few", [10, 100_000])
def test_exact_ranks(spark, monkeypatch, few):
    monkeypatch.setattr(statistics, "FEW", few)
    monkeypatch.setattr(statistics, "RANGES", 8)
    rng = random.Random(10)
    for values in ([rng.choice([0.0, 1.5, rng.gauss(0, 1e6), rng.random()]) for _ in range(700)], [3.0] * 90, [1.0, float("inf"), float("-inf")] * 30, [None, 2.0], [None], [float("nan")] * 3 + [1.0] * 40):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        known = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v))
        for share in (0.001, 0.5, 0.95, 1.0):
            got = statistics.nearest_rank(df, "x", share).first()["value"]
            want = known[max(math.ceil(share * len(known)), 1) - 1] if known else None
            assert got == want or (math.isnan(got) and math.isnan(want))
    whole = statistics.nearest_rank(spark.range(5000).select(F.col("id").alias("x")), "x", 0.3)
    assert whole.first()["value"] == 1499 and whole.schema["value"].dataType.simpleString() == "bigint"
    assert "percentile_disc" not in whole._jdf.queryExecution().toString()


def test_conversations_of_any_length(spark, monkeypatch):
    rng = random.Random(11)
    rows = []
    for c in range(6):
        for t in range(rng.randint(0, 120)):
            rows.append((f"conv-{c}", t, rng.choice(["user", "assistant", "system"]), rng.random() > 0.1, f"m{c}-{t}", rng.choice(["nah", "exactly", "", f"text {t}", "long words " * 30]), float(t)))
    df = spark.createDataFrame(rows, "conversation_id string, active_position int, role string, is_active boolean, message_id string, text string, create_time double")
    heads = spark.createDataFrame([(f"conv-{c}", f"T{c}", "f", 0) for c in range(6)], "conversation_id string, title string, source_file string, position int")
    found = {}
    for size in (4096, 5):
        monkeypatch.setattr(sessions, "BLOCK", size)
        found[size] = (sorted(tuple(r) for r in sessions.turns(df).select("conversation_id", "turn_index", "user_text", "assistant_text", "acceptance", "previous_acceptance").collect()), sorted(tuple(r) for r in sessions.chunks(heads, df, 60, 10).collect()))
    assert found[4096] == found[5]
    turns, chunks = found[5]
    assert [r[0] for r in chunks] == list(range(1, len(chunks) + 1)) and chunks == sorted(chunks, key=lambda r: (r[1], r[2], r[5] != "user", int(r[3].split("-")[1]), r[4]))
    by = {(r[0], r[1]): r for r in turns}
    for (c, t), r in by.items():
        following = by.get((c, t + 1))
        assert r[4] == ("unknown" if following is None else {"nah": "rejected", "exactly": "accepted"}.get(following[2], "unknown"))
        assert r[5] == (by[c, t - 1][4] if t else "unknown")
    near = {(r.conversation_id, r.turn_index): r for r in sessions.neighbours(sessions.turns(df)).collect()}
    assert all((r.previous is None) == (t == 0) and (r.following is None) == ((c, t + 1) not in by) for (c, t), r in near.items())


def test_one_conversation_of_very_many_messages_meets_in_no_task(spark):
    n = 300_000
    rows = spark.range(0, n, 1, 4).select(F.lit("one").alias("conversation_id"), F.col("id").cast("int").alias("active_position"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.lit(True).alias("is_active"), F.lit("x").alias("text"))
    got = sessions.in_turns(rows)
    assert got.agg(F.max("turn_index")).first()[0] == n // 3 - 1 and got.where(F.col("turn_index") != F.floor(F.col("active_position") / 3)).count() == 0
    sizes = sessions.in_turns(rows).groupBy(F.floor(F.col("active_position") / sessions.BLOCK)).count().agg(F.max("count")).first()[0]
    assert sizes <= sessions.BLOCK


def test_pieces_leave_one_by_one(spark):
    rng = random.Random(12)
    for _ in range(200):
        text = "".join(rng.choice(["a", "bc", " ", "\n", ". ", "\n\n"]) for _ in range(rng.randint(0, 200)))
        most = rng.choice([5, 20, 60])
        got = pytext.split_points(text, most, 3)
        assert all(0 < len(p) <= most for p in got)
        assert "".join("".join(got).split()).startswith("".join(pytext.clean(text)[: most // 2].split())[:1] or "")
    seen = pytext.pieces("word " * 1_000_000, 100, 10)
    assert len(next(seen)) < 101
    df = spark.createDataFrame([(1, "a b c d"), (2, None), (3, ""), (4, "x" * 30)], "i int, body string")
    rows = df.lateralJoin(pytext.split_pieces(F.col("body").outer(), 4, 1)).collect()
    assert sorted({r.i for r in rows}) == [1, 4] and all(len(r.text) <= 4 for r in rows)
    spark.udtf.register("pieces_of", pytext.split_function())
    df.createOrReplaceTempView("bodies")
    assert spark.sql("SELECT i, p.* FROM bodies, LATERAL pieces_of(body, 4, 1) p").count() == len(rows)


def test_lists_are_read_by_splits(spark, tmp_path, monkeypatch):
    rng = random.Random(13)

    def value(depth=0):
        kind = rng.randint(0, 6 if depth < 3 else 3)
        if kind < 3:
            return "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", "é", "x", "\n", "\\u"]) for _ in range(rng.randint(0, 30)))
        return rng.choice([1, None, True, 2.5]) if kind == 3 else [value(depth + 1) for _ in range(rng.randint(0, 3))] if kind == 4 else {f"k{i}": value(depth + 1) for i in range(rng.randint(0, 4))}

    lists = {f"conversations-{k}.json": [rng.choice([{"id": i, "v": value()}, "noise", 5, [1, {"a": "}"}]]) for i in range(rng.randint(0, 25))] for k in range(3)}
    lists["conversations-8.json"] = [{"id": i, "v": "}" * 50} for i in range(30)]
    lists["conversations-9.json"] = [{"id": 0, "v": "x" * 1000}, {"id": 1}]
    for name, items in lists.items():
        indent = rng.choice([None, 1])
        (tmp_path / name).write_text(("﻿" if name.endswith("1.json") else "") + json.dumps(items, indent=indent, ensure_ascii=rng.random() < 0.5), encoding="utf-8")
    want = {(n, i): x for n, items in lists.items() for i, x in enumerate(items)}
    try:
        for size, chunk in (("128m", 4 << 20), ("900b", 100), ("170b", 1)):
            monkeypatch.setattr(jsonlist, "CHUNK", chunk)
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            got = jsonlist.read_items(spark, str(tmp_path), "conversations-*.json").where("trim(item) <> ''").collect()
            assert {(r.source_file, r.position): json.loads(r.item) for r in got} == want and len(got) == len(want)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for k, bad in enumerate(['{"a": 1}', "", '[{"a": 1}', '[{"a": "x]', "5", '[1], {"b": 2}', "x[1]"]):
        folder = tmp_path / f"bad{k}"
        folder.mkdir()
        (folder / "conversations-1.json").write_text(bad)
        with pytest.raises(ValueError, match="JSON list"):
            jsonlist.read_items(spark, str(folder), "conversations-*.json")


def test_one_large_file_is_many_partitions(spark, tmp_path):
    items = [{"conversation_id": f"c{i}", "mapping": {"n": {"id": "n", "parent": None, "message": {"id": f"m{i}", "author": {"role": "user"}, "content": {"parts": ["word } \" " * 200]}}}}} for i in range(4000)]
    (tmp_path / "conversations-1.json").write_text(json.dumps(items))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        raw = exports.read_exports(spark, str(tmp_path))
        assert raw.select(F.spark_partition_id()).distinct().count() > 4
        assert [r.conversation_id for r in raw.orderBy("position").select("conversation_id").collect()] == [f"c{i}" for i in range(4000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_driver_texts_are_cleaned_as_columns_are(spark):
    from trawl.functions.text import sanitize_text

    odd = ["a‮b", "x\x00\x07  \ty\n", "  plain ", "‏\x85z\x1c", "ok"]
    got = [r.s for r in spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string").orderBy("i").select(sanitize_text(F.col("t")).alias("s")).collect()]
    assert [pytext.sanitized(t) for t in odd] == got
    told = packets.told_searches([I.Variant("lexical_or", "y" * 600, 0.5)])
    assert len(told[0]["text"]) == 501 and len(told[0]["sha256"]) == 64


def test_neighbours_by_clusters_are_those_of_all(spark, tmp_path):
    import numpy as np

    from trawl.operators import clusters, vectors

    rng = np.random.default_rng(14)
    heads = rng.normal(size=(40, 24)) * 3
    grouped = vectors.unit(heads[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 24)) * 0.2)
    even = vectors.unit(rng.normal(size=(600, 24)))
    for name, x, most in (("grouped", grouped, 10), ("even", even, 10), ("few", even[:5], 10)):
        df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x.astype(np.float32))], "chunk_id long, embedding array<float>, turn_index int")
        rows, sizes = clusters.clustered(df)
        path = str(tmp_path / name)
        rows.write.option("parquet.page.row.count.limit", "100").option("parquet.block.size", "65536").parquet(path)
        known, stored = clusters.held(sizes), spark.read.parquet(path)
        assert sum(c.n for c in known) == len(x)
        for q in (x[0], x[3], vectors.unit(rng.normal(size=(1, 24)))[0]):
            got = clusters.nearest(stored, known, q.tolist(), most, "chunk_id", "turn_index").orderBy("rank")
            want = vectors.nearest(df, q.tolist(), most, "chunk_id", "turn_index").orderBy("rank")
            assert [(r.chunk_id, r.turn_index, r.rank) for r in got.collect()] == [(r.chunk_id, r.turn_index, r.rank) for r in want.collect()]
        if name == "grouped":
            q = x[0].tolist()
            read = scanned(stored.where(F.col("cluster").isin([c.number for c in known if np.sqrt(((c.centre - x[0]) ** 2).sum()) - c.radius < 0.5])))
            assert read < len(x) / 2 and clusters.nearest(stored, known, q, most).count() == most
    assert clusters.nearest(stored.limit(0), [], [0.0] * 24, 3).count() == 0


def test_texts_longer_than_a_models_window_are_encoded_whole():
    import numpy as np

    from trawl.operators.vectors import ModelEncoder

    class Told:
        def __init__(self, **values):
            self.__dict__.update(values)

    class Lengths:
        def encode_batch(self, texts):
            return [Told(ids=[len(w) for w in t.split()]) for t in texts]

    class Session:
        def get_inputs(self):
            return [Told(name="input_ids"), Told(name="attention_mask")]

        def run(self, _, given):
            assert given["input_ids"].shape[1] <= 3
            return [np.stack([given["input_ids"], given["input_ids"] * 2.0], -1)]

    encoder = ModelEncoder.__new__(ModelEncoder)
    encoder.window, encoder._model = 3, (Lengths(), None, Session())
    assert encoder.encode(["a bb ccc dddd eeeee", "", "x"]).tolist() == [[3, 6], [0, 0], [1, 2]]


def test_texts_inside_others_are_found_at_every_length(spark):
    rng = random.Random(31)
    vocab = [f"{rng.choice('abcdefgh')}{k:07d}" for k in range(400)]
    texts = []
    for m in range(9, 24):  # from fewer words than a run of inner shingles has to more
        base = " ".join(rng.choice(vocab) for _ in range(m))
        around = [" ".join(rng.choice(vocab) for _ in range(40)) for _ in range(2)]
        texts += [base, around[0] + base + around[1], base + around[0], f"{around[1]} {base}"]
    texts += [None, ""]
    reps = list(enumerate(texts))[:-2]
    want = sorted((min(i, j), max(i, j)) for i, a in reps for j, b in reps if i < j and pytext.near_duplicate(a, b))
    forms = spark.createDataFrame(list(enumerate(texts)), "doc_id long, form string")
    got = duplicates.near_pairs(forms, "doc_id").collect()
    assert sorted((r.one, r.two) for r in got) == want and len(want) >= 30
    kept = []
    for i, t in reps:
        if not any(pytext.near_duplicate(texts[k], t) for k in kept):
            kept.append(i)
    assert sorted(r.doc_id for r in duplicates.near_kept(forms, "doc_id").collect()) == kept


def test_texts_of_common_parts_are_not_compared_in_full(spark):
    """Texts that share prefixes but are not alike are ruled out by their sketches, before their texts are fetched."""
    parts = [" ".join(f"p{p}w{w}" for w in range(30)) for p in range(8)]
    texts = [" ".join(parts[p] for p in sorted({i % 8, (i + 1) % 8, (i + 3) % 8, (i // 8 + 5) % 8})) + f" own{i}" for i in range(32)]
    near = texts[0] + " and one word more"
    forms = spark.createDataFrame(list(enumerate([*texts, near])), "doc_id long, form string")
    pairs = sorted((r.one, r.two) for r in duplicates.near_pairs(forms, "doc_id").collect())
    every = [*texts, near]
    assert pairs == [(i, j) for i in range(33) for j in range(i + 1, 33) if pytext.near_duplicate(every[i], every[j])]
    assert (0, 32) in pairs
    rows = duplicates._buckets(forms, "doc_id")[1]
    met = sorted((r.one, r.two) for r in duplicates._met(rows.where("bucket >= 0")).collect())
    assert set(met) <= set(pairs)


def test_forms_are_made_once_and_shingles_of_the_same_texts_are_one_bucket(spark):
    made = spark.sparkContext.accumulator(0)

    def form(column):
        made.add(len(column))
        return column

    words = [f"word{k}" for k in range(600)]
    texts = [" ".join(words), " ".join(words + ["more"]), " ".join(w + "x" for w in words), "", None]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    forms = table.select("doc_id", F.arrow_udf(form, "string")("text").alias("form"))
    bodies, rows, _ = duplicates._buckets(forms, "doc_id")
    assert made.value == len(texts)
    assert sorted(r.id for r in bodies.collect()) == [0, 1, 2]
    found = rows.select("id", "bucket").collect()
    assert {r.id for r in found} == {0, 1} and len(found) <= 6  # seventy shared shingles of a prefix
    assert sorted((r.one, r.two) for r in duplicates.near_pairs(forms, "doc_id").collect()) == [(0, 1)]
    assert sorted(r.doc_id for r in duplicates.near_kept(forms, "doc_id").collect()) == [0, 2]


def test_no_pass_over_texts_where_nothing_is_looked_for(spark):
    forms = spark.createDataFrame([(1, "some text")], "doc_id long, form string")
    none = spark.createDataFrame([("a", ""), ("b", None)], "id string, needle string")
    found = duplicates.contained(forms, "doc_id", none)
    assert found.schema.simpleString() == "struct<doc_id:bigint,id:string>" and found.count() == 0
    assert "MapInArrow" not in found._jdf.queryExecution().toString()


def test_digests_of_a_batch_are_those_of_each_text():
    texts = ["", "a", " a b  c d e f ", "x" * 100 + " y z u v w " + "q" * 33 + " r", "a b c d e", "é " * 7, "a b c d e f", " ", "b c d e f 12345678 123456789 " + "w" * 32]
    digests, places, words = duplicates._digests(pa.array(["before", *texts, "after this"]).slice(1, len(texts)))
    shingles = {}
    for text, low, high, n in zip(texts, places[:-1], places[1:], words, strict=True):
        w = text.split(" ")
        assert n == len(w) and digests[low:high].tolist() == duplicates._digests(pa.array([text]))[0].tolist()
        for k, d in enumerate(digests[low:high].tolist()):
            assert shingles.setdefault(tuple(w[k : k + 5]), d) == d
        assert high - low == max(len(w) - 4, 0)
    assert len(set(shingles.values())) == len(shingles) > 15
    assert [x.size for x in duplicates._digests(pa.array([], pa.string()))] == [0, 1, 0]


def test_levels_count_texts_by_cells(spark):
    texts = [f"a b c d e f{i // 4}" for i in range(40)] + ["a b c d e " * 3]
    levels = duplicates._levels(spark.createDataFrame([(t,) for t in texts], "form string").repartition(7))
    cells = {}
    for text in texts:
        for cell in {int(d) >> (64 - duplicates.CELL_BITS) for d in duplicates._digests(pa.array([text]))[0]}:
            cells[cell] = cells.get(cell, 0) + 1
    assert {c: int(levels[c]) for c in cells} == {c: n.bit_length() for c, n in cells.items()} and np.count_nonzero(levels) == len(cells)


def test_texts_of_one_bucket_that_are_not_alike_are_not_waited_for(spark, monkeypatch):
    rounds, several = [], duplicates._several
    monkeypatch.setattr(duplicates, "_several", lambda rows: rounds.append(1) or several(rows))
    parts = [" ".join(f"p{p}w{w}" for w in range(30)) for p in range(8)]
    texts = [" ".join(parts[p] for p in sorted({i % 8, (i + 1) % 8, (i + 3) % 8, (i // 8 + 5) % 8})) + f" own{i}" for i in range(96)]
    texts += [f"{texts[0]} and one more", f"{texts[5]} and one more"]
    kept = duplicates.near_kept(spark.createDataFrame(list(enumerate(texts)), "doc_id long, form string"), "doc_id").collect()
    want = []
    for i, text in enumerate(texts):
        if not any(pytext.near_duplicate(texts[k], text) for k in want):
            want.append(i)
    assert sorted(r.doc_id for r in kept) == want and not rounds
