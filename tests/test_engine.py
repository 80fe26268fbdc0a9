"""The engine end to end: ingest of trees, BM25 against an independent full-text engine, ranking, packets."""

import json
import os
import pickle
import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from trawl import cli
from trawl.functions import intent as I
from trawl.functions import lexicon as L
from trawl.evaluation import evaluate, nearest_rank
from trawl.functions.pytext import near_duplicate
from trawl.integrity import verify
from trawl.operators import duplicates, fusion, inverted, ordering, packets, scoring, sessions
from trawl.operators.vectors import HashingEncoder, ModelEncoder, nearest
from trawl.plans import registry
from trawl.plans.engine import Archive, archive_parts, day_end, day_start
from trawl.sources import exports, store


def message(mid, role, text, t=None, **more):
    return {"id": mid, "author": {"role": role}, "create_time": t, "content": {"content_type": "text", "parts": [text]}, **more}


def tree(cid, nodes, current, **more):
    return {"conversation_id": cid, "title": f"About {cid}", "current_node": current, "mapping": {k: {"id": k, "parent": p, "message": m} for k, p, m in nodes}, **more}


def exported():
    one = tree(
        "c1",
        [
            ("root", None, None), ("s", "root", message("s", "system", "hidden")), ("u1", "s", message("u1", "user", "Tell me about Nova engines", 1000)),
            ("bad", "u1", message("bad", "assistant", "Nova is a band", 1001)), ("a1", "u1", message("a1", "assistant", "Nova engines burn slowly", 1002)),
            ("u2", "a1", message("u2", "user", "Nah, Nova engines burn fast instead", "2000.0")), ("a2", "u2", message("a2", "assistant", "Right, they burn fast", 2001)),
            ("u3", "a2", message("u3", "user", "exactly, this works", 3000)), ("a3", "u3", message("a3", "assistant", "Good", 0)),
        ],
        "a3",
    )
    two = tree("c2", [("r", None, None), ("x", "r", message("x", "user", "Nova engines and gardens", 1500, metadata={"k": [1]})), ("y", "x", message("y", "assistant", "Gardens are green", 1501))], "missing", title="")
    return [one, "noise", two, {"title": "no id", "mapping": {}}]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    raw = tmp_path_factory.mktemp("raw")
    (raw / "conversations-001.json").write_text(json.dumps(exported()))
    root = str(tmp_path_factory.mktemp("built"))
    return Archive.build(spark, str(raw), root, HashingEncoder()).cached()


def test_ingest(archive):
    t = archive.tables
    c = {r.conversation_id: r for r in t["conversations"].collect()}
    assert set(c) == {"c1", "c2"} and c["c2"].title == "Untitled conversation" and c["c1"].total_message_count == 8 and c["c1"].active_message_count == 7
    m = {r.message_id: r for r in t["messages"].collect()}
    assert not m["bad"].is_active and m["a1"].is_active and m["u2"].create_time == 2000.0 and m["x"].metadata_json == '{"k":[1]}'
    turns = {(r.conversation_id, r.turn_index): r for r in t["turns"].collect()}
    assert [turns["c1", k].acceptance for k in range(3)] == ["rejected", "accepted", "unknown"] and turns["c1", 1].previous_acceptance == "rejected"
    chunks = t["chunks"].orderBy("chunk_id").collect()
    assert [r.chunk_id for r in chunks] == list(range(1, 9)) and [r.role for r in chunks[:2]] == ["user", "assistant"]
    assert {r.create_time for r in chunks if r.message_id == "a3"} == {3000.0}


def test_repeated_conversations_and_bad_files(spark, tmp_path):
    (tmp_path / "conversations-1.json").write_text(json.dumps(exported()))
    (tmp_path / "conversations-2.json").write_text(json.dumps(exported()[:1]))
    raw = exports.read_exports(spark, str(tmp_path))
    with pytest.raises(ValueError):
        exports.conversations_and_messages(raw)
    assert exports.conversations_and_messages(raw, "latest")[0].where("conversation_id = 'c1'").first().source_file == "conversations-2.json"
    (tmp_path / "conversations-3.json").write_text('{"a": 1}')
    with pytest.raises(Exception, match="JSON list"):
        exports.read_exports(spark, str(tmp_path)).count()
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        exports.read_exports(spark, str(tmp_path / "none"))


def slow_path(nodes, current):
    by = {k: (p, t) for k, p, t in nodes}
    if current not in by:
        parents = {p for p, _ in by.values()}
        leaves = [k for k in by if k not in parents] or list(by)
        current = max(leaves, key=lambda k: by[k][1] or -1) if leaves else None
    out = []
    while current and current in by and current not in out:
        out.append(current)
        current = by[current][0]
    return out[::-1]


def test_active_paths(spark):
    rng = random.Random(7)
    trees = []
    for n in range(200):
        names = [f"n{k}" for k in range(rng.randint(0, 7))]
        nodes = [(k, rng.choice([None, "gone", *names]), rng.choice([None, 0.0, 1.0, 2.0, 2.0])) for k in names]
        trees.append((n, rng.choice([None, "gone", *names]), nodes))
    df = spark.createDataFrame(trees, "i int, cur string, nodes array<struct<k:string,par:string,t:double>>")
    got = {r.i: r.p for r in df.select("i", exports.active_path(F.col("nodes"), F.col("cur")).alias("p")).collect()}
    for n, cur, nodes in trees:
        assert got[n] == slow_path(nodes, cur)


def test_bm25_equals_an_independent_engine(spark):
    rng = random.Random(3)
    vocab = ["alpha", "beta", "gamma", "delta", "Élan", "x1"]
    rows = [(i, "", i, rng.choice(["alpha", "beta note", "other"]), " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 12)))) for i in range(1, 61)]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(title, text, tokenize='unicode61 remove_diacritics 2')")
    con.executemany("insert into f(rowid, title, text) values (?, ?, ?)", [(r[0], r[3], r[4]) for r in rows])
    df = inverted.with_tokens(spark.createDataFrame(rows, "chunk_id long, conversation_id string, turn_index int, title string, text string")).cache()
    searches = [([["alpha"], ["elan"]], False), ([["alpha", "beta"]], False), ([["alpha"], ["gamma"], ["x1"]], True), ([["nowhere"], ["beta"]], True), ([[], ["beta"]], True)]
    got = {(r.search, r.chunk_id): r.bm25 for r in inverted.bm25(df, inverted.postings(df), inverted.corpus_stats(df), searches).collect()}
    want = {}
    for s, q in enumerate(['"alpha" OR "elan"', '"alpha beta"', '"alpha" AND "gamma" AND "x1"']):
        want |= {(s, r[0]): r[1] for r in con.execute("select rowid, bm25(f, 2.0, 5.0) from f where f match ?", (q,))}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_user_beats_assistant_on_the_same_text(spark):
    rows = [(1, 0, "user", "crimson lighthouse"), (1, 1, "assistant", "crimson lighthouse")]
    found = Archive.from_conversations(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).lexical("crimson lighthouse", 10)
    assert [r.role for r in found.orderBy(F.desc("score")).collect()] == ["user", "assistant"]


def test_fusion_prefers_what_both_lists_have(spark):
    lists = [spark.createDataFrame(r, "chunk_id long, role string, rank int") for r in ([(1, "user", 1), (2, "user", 2)], [(2, "user", 1)])]
    assert fusion.fuse_lists(*lists).orderBy(F.desc("score")).first().chunk_id == 2


def test_searches(archive):
    top = archive.search("Nova engines burn fast").orderBy("place").collect()
    assert (top[0].conversation_id, top[0].turn_index) == ("c1", 1)
    assert [r.turn_index for r in archive.search("first time Nova", lexical_only=True).orderBy("place").collect() if r.conversation_id == "c1"][0] == 0
    assert {r.conversation_id for r in archive.search("Nova", conversation_id="c2").collect()} == {"c2"}
    assert archive.search("Nova", date_from="1970-01-02").count() == 0 and archive.search("Nova", date_to="1970-01-01").count() > 0
    assert archive.search("Nova", timeline=True).count() == archive.search("Nova").count()
    assert archive.search("Nova", semantic_only=True, limit=3).count() == 3
    assert [r.turn_index for r in archive.open_context("c1", 1, 1, 1).collect()] == [0, 1, 2]
    assert archive.stats().first().turns == 4


def test_packets(archive):
    packet = archive.context("what did I actually mean about Nova, corrected")
    assert packet["intent"]["primary_mode"] == "correction"
    first = packet["episodes"][0]
    assert (first["conversation_id"], first["turn_index"]) == ("c1", 1)
    assert [c["status"] for c in first["context"] if c["relation"] == "preceding_assistant"] == ["rejected_context_unverified"]
    assert packet == archive.context("what did I actually mean about Nova, corrected")
    size = len(json.dumps(packet, ensure_ascii=False, separators=(",", ":")))
    assert packet["limits"]["serialized_characters"] == size <= packet["limits"]["character_limit"]
    assert all(abs(sum(c["contribution"] for c in e["score"]["components"]) - e["score"]["total"]) < 1e-6 or e["score"]["total"] in (0, 1) for e in packet["episodes"])
    assert archive.context("Nova", date_from="1971-01-01")["episodes"] == []
    for bad in (("", "light"), ("x", "huge")):
        with pytest.raises(ValueError):
            archive.context(*bad)
    with pytest.raises(ValueError):
        archive.context("x", "light", "2026-02-02", "2026-02-01")


def test_evaluation(archive):
    case = {"name": "n", "query": "Nova engines burn fast", "expected_sources": [{"conversation_id": "c1", "turn_index": 1}]}
    s = evaluate(archive, [case])["summary"]
    assert s["recall_at_5"] == 1.0 and s["all_deterministic"] and s["all_within_budget"] and s["rejected_leakage"] == 0
    assert nearest_rank([3, 1, 2], 0.5) == 2 and nearest_rank([], 0.5) is None


def episode(cid, turn, text, context=()):
    return {"rank": 0, "conversation_id": cid, "turn_index": turn, "title": "t", "context": [{"text": c} for c in context], "primary_evidence": {"role": "user", "text": text, "message_ids": []}}


def test_selection():
    intent, depth = I.interpret("x"), L.DEPTHS["light"]
    texts = [" ".join(f"{c}{k}" for k in range(30)) for c in "abcdefgh"]
    found = [episode("c", k, t) for k, t in enumerate(texts[:4])] + [episode("d", 9, texts[0].upper()), episode("d", 10, texts[1] + " z"), episode("d", 11, texts[5])]
    chosen, trace = packets.select(found, depth, intent)
    assert [(e["conversation_id"], e["turn_index"]) for e in chosen] == [("c", 0), ("c", 1), ("d", 11), ("c", 2), ("c", 3)]
    assert [e["rank"] for e in chosen] == [1, 2, 3, 4, 5]
    assert trace == {"exact_duplicates_removed": 1, "near_duplicates_removed": 1, "conversation_cap_skips": 2}


def test_shrinking_order():
    found = [episode("a", 0, "x" * 501, ["one"]), episode("b", 0, "y" * 400, ["two"])]
    assert packets.shrink(found) and not found[1]["context"] and found[0]["context"]
    assert packets.shrink(found) and not found[0]["context"]
    assert packets.shrink(found) and len(found[0]["primary_evidence"]["text"]) == 500
    assert packets.shrink(found) and len(found) == 1 and not packets.shrink(found)
    with pytest.raises(RuntimeError):
        packets.pack(I.interpret("x"), [], [episode("a", 0, "x" * 300)], L.Depth("tiny", 1, 100, 1, 1, 1, 1), {})


def test_temporal_orders(spark):
    rows = [("a", 0, 100.0, 0.8), ("b", 0, 50.0, 0.1), ("c", 0, None, 0.7), ("d", 0, 1e8, 0.5), ("e", 0, 1e8 + 5, 0.6)]
    df = spark.createDataFrame(rows, "conversation_id string, turn_index int, create_time double, score double").withColumns({"exact": F.lit(0.0), "matched_role": F.lit("user"), "first_chunk": F.lit(1)})
    order = lambda mode: [r.conversation_id for r in ordering.temporal_order(df, mode).orderBy("place").collect()]
    assert order("earliest") == ["a", "d", "e"] and order("latest") == ["e", "d", "a"]
    assert order("longitudinal") == ["a", "e", "d"] and order("recall") == ["a", "c", "e", "d", "b"]


def test_longitudinal_places_of_a_whole_table(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(f"c{k % 7}", k, rng.choice(["2020", "2021", None]), rng.choice([0.3, 0.5, rng.random()])) for k in range(600)]
    df = spark.createDataFrame(rows, "conversation_id string, turn_index int, year string, score double").withColumns({"create_time": F.lit(1.0), "exact": F.lit(0.0), "matched_role": F.lit("user"), "first_chunk": F.lit(1)})
    rank = sorted(rows, key=lambda r: (-r[3], r[0], r[1]))
    firsts = [next(r for r in rank if r[2] == year) for year in (None, "2020", "2021")]
    expected = {r[1]: n for n, r in enumerate(firsts + [r for r in rank if r not in firsts], 1)}
    for most in (20, 5000):
        monkeypatch.setattr(ordering, "PLACE_ROWS", most)
        got = ordering.longitudinal_places(df, F.col("year"), scoring.rank_order("matched_role", "first_chunk"))
        assert {r.turn_index: r.place for r in got.collect()} == expected and got.count() == 600
    assert ordering.longitudinal_places(df.limit(0), F.col("year"), scoring.rank_order("matched_role", "first_chunk")).count() == 0


def test_longitudinal_places_every_order_above_the_floor(spark):
    sf = "/root/testdata/sf0.1"
    if not os.path.exists(sf):
        return
    rows = registry.orders(spark, sf)
    floor = max(0.25, rows.agg(F.max("score")).first()[0] * 0.4)
    got = registry.QUERIES["longitudinal"](spark, sf).agg(F.count("*").alias("n"), F.countDistinct("place").alias("places"), F.max("place").alias("last")).first()
    assert got.n == got.places == got.last == rows.where(F.col("score") >= floor).count() > 3000


def test_dates_and_store(spark, tmp_path):
    assert day_start("2026-02-01") < day_end("2026-02-01") == day_start("2026-02-02")
    t = spark.createDataFrame([(day_end("2026-02-01") - 0.5,)], "t double")
    assert t.where(sessions.dated_half_open(F.col("t"), None, day_end("2026-02-01"))).count() == 1
    assert t.where(sessions.dated_inclusive(F.col("t"), None, day_end("2026-02-01") - 1)).count() == 0
    root = str(tmp_path / "a")
    store.save(spark, root, {"t": t})
    store.save(spark, root, {"t": t.union(t)})
    assert store.load(spark, root)["t"].count() == 2
    with pytest.raises(FileNotFoundError):
        store.load(spark, str(tmp_path / "none"))


def test_integrity(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.json").write_text("1")
        (tmp_path / name / "y.json").write_text("22" if name == "a" else "23")
    found = verify(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert {k: found[k] for k in ("files", "equal", "all_match", "differ")} == {"files": 2, "equal": 1, "all_match": False, "differ": ["y.json"]}
    assert found["total_bytes"] == sum(f.stat().st_size for f in (tmp_path / "a").iterdir()) and [e["equal"] for e in found["entries"]] == [True, False]


def test_nearest_ties_by_id(spark):
    df = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "chunk_id long, embedding array<float>")
    assert [(r.chunk_id, r.rank) for r in nearest(df, [1.0, 0.0], 2).orderBy("rank").collect()] == [(1, 1), (3, 2)]


def test_exact_strength_order(spark):
    i = I.Intent("exact", ("exact_phrase",), "", ("red fox",), ("Nova",))
    df = spark.createDataFrame([("a red fox",), ("nova one",), ("find verbatim text",), ("none",)], "h string")
    assert [r.v for r in df.select(scoring.exact_strength(F.col("h"), i, "verbatim text").cast("double").alias("v")).collect()] == [1.0, 0.75, 0.9, 0.0]


def test_places_of_a_whole_table(spark, monkeypatch):
    monkeypatch.setattr(ordering, "PLACE_ROWS", 20)
    rng = random.Random(5)
    rows = [(k, rng.choice([0.5, rng.random()])) for k in range(500)]
    got = ordering.places(spark.createDataFrame(rows, "id int, score double"), "score", [F.desc("score"), F.col("id").asc()]).collect()
    assert {r.id: r.place for r in got} == {i: n for n, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}


def test_paths_of_long_branches():
    nodes = [{"k": str(i), "par": str(i - 1) if i else None, "t": float(i)} for i in range(200_000)]
    assert exports.path_to(nodes, "199999") == [str(i) for i in range(200_000)]
    assert exports.path_to([], "a") == [] and exports.path_to([{"k": "a", "par": "b", "t": 1.0}, {"k": "b", "par": "a", "t": 1.0}], "a") == ["b", "a"]
    assert exports.path_to([{"k": "a", "par": None, "t": None}, {"k": "b", "par": "a", "t": 5.0}, {"k": "c", "par": "a", "t": 7.0}], None) == ["a", "c"]


def test_needles_are_found_in_any_number_of_passes(spark, monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abé ") for _ in range(rng.randint(0, 40))) for _ in range(80)] + [None]
    needles = [(100 + i, "".join(rng.choice("abé ") for _ in range(rng.randint(1, 3)))) for i in range(30)] + [(200, ""), (201, "zz"), (202, "ab"), (203, "ab")]
    forms, given = spark.createDataFrame(list(enumerate(texts)), "k long, form string"), spark.createDataFrame(needles, "id long, needle string")
    want = sorted((k, i) for k, t in enumerate(texts) for i, n in needles if n and t and n in t)
    for most in (50, 10**6):
        monkeypatch.setattr(duplicates, "PASS_CHARS", most)
        assert sorted((r.k, r.id) for r in duplicates.contained(forms, "k", given).collect()) == want


def test_near_pairs_equal_all_pairs(spark):
    rng = random.Random(7)
    vocab, texts = [f"w{k}" for k in range(60)], []
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(3, 90))]
        for _ in range(6):
            t = list(base)
            for _ in range(rng.randint(0, 2)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            texts.append(" ".join(t))
        texts.append(" ".join(base[: len(base) * 2 // 3]))
    texts += ["x" * 130, "y " + "x" * 200 + " z", "x" * 130 + " " + "q" * 20, "", "one", "one"]
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)
    reps = [(i, t) for t, i in first.items() if t]
    want = sorted((min(i, j), max(i, j)) for i, a in reps for j, b in reps if i < j and near_duplicate(a, b))
    got = duplicates.near_pairs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, form string"), "doc_id").collect()
    assert sorted((r.one, r.two) for r in got) == want and len(want) > 10


def test_a_local_model_encodes(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).save(str(tmp_path / "tokenizer.json"))
    table = np.random.default_rng(1).normal(size=(49_408, 8)).astype(np.float32)
    np.save(tmp_path / "embeddings.npy", table)
    encoder = ModelEncoder(str(tmp_path))
    assert encoder.size == 8 and pickle.loads(pickle.dumps(encoder)).encode(["a b"]).shape == (1, 8)
    ids = Tokenizer.from_file(str(tmp_path / "tokenizer.json")).encode("a small house").ids
    assert np.allclose(encoder.encode(["a small house", ""])[0], table[ids].mean(axis=0))
    rows = spark.createDataFrame([(0, 0, "user", "a small house"), (0, 1, "assistant", "yes"), (1, 0, "user", "gardens")], "conv_id long, turn long, role string, text string")
    root = str(tmp_path / "archive")
    store.save(spark, root, archive_parts(*exports.from_flat(rows), encoder), store.about(encoder))
    assert Archive.open(spark, root, encoder).search("a small house", semantic_only=True).first().conversation_id == "0"
    assert store.read_manifest(spark, root)["embedding"] == {"encoder": encoder.name, "dimension": 8}
    with pytest.raises(ValueError):
        Archive.open(spark, root, HashingEncoder())


def test_commands_write_their_results(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "conversations-001.json").write_text(json.dumps(exported()))
    root, out = str(tmp_path / "archive"), lambda n: str(tmp_path / f"{n}.json")
    assert cli.main(["build", "--raw", str(tmp_path / "raw"), "--archive", root, "--semantic"]) == 0
    assert cli.main(["validate", "--archive", root, "--needles", "Nova engines", "--expect", "conversations=2", "--output", out("v")]) == 0
    assert json.load(open(out("v")))["checks"]["conversations has 2 rows"] and json.load(open(out("v")))["semantic"]
    assert cli.main(["validate", "--archive", root, "--expect", "messages=1"]) == 1
    assert cli.main(["verify", "--source", str(tmp_path / "raw"), "--copy", str(tmp_path / "raw"), "--output", out("c")]) == 0
    assert len(json.load(open(out("c")))["entries"][0]["sha256"]) == 64
    (tmp_path / "cases.json").write_text(json.dumps({"cases": [{"name": "one", "query": "Nova engines", "expected_sources": [{"conversation_id": "c1", "turn_index": 1}, {"conversation_id": "no", "turn_index": 1}]}]}))
    assert cli.main(["evaluate", "--archive", root, "--cases", str(tmp_path / "cases.json"), "--output", out("e")]) == 0
    case = json.load(open(out("e")))["cases"][0]
    assert case["expected_ranks"][0] == case["best_expected_rank"] and case["expected_ranks"][1] is None and case["expected_source_count"] == 2
    assert case["conversation_count"] >= 1 and case["serialized_characters"] <= case["character_limit"] and case["depth"] == "medium"


def test_needles_meet_batches_of_bounded_size(spark):
    for name in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{name}")
    forms = spark.range(2500).select(F.col("id").alias("k"), F.concat(F.lit("a text of number "), "id").alias("form"))
    given = spark.createDataFrame([(1, "text of"), (2, "number 24")], "id long, needle string")
    found = duplicates.contained(forms, "k", given).groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in found} == {1: 2500, 2: 1 + 10 + 100}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == str(duplicates.BATCH_ROWS)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(duplicates.BATCH_BYTES)
