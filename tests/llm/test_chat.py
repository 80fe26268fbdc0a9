"""Preference spans against a plain loop over pairs."""

import os
import random
from collections import defaultdict

from trawl.llm import chat


def plain(convs, pairs):
    out = set()
    for pid, c, r in pairs:
        a, b = convs.get(c, []), convs.get(r, [])
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        for part, turns, start in (("prompt", a[:n], 0), ("chosen", a[n:], n), ("rejected", b[n:], n)):
            for k, (role, text) in enumerate(turns):
                out.add((pid, part, start + k, role, f"<|{role or ''}|>\n{text or ''}\n<|end|>\n", part != "prompt" and role == "assistant"))
    return out


def test_spans_match_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(chat, "TURN_BLOCK", 3)
    rng = random.Random(5)
    rows, convs = [], defaultdict(list)
    for c in range(40):
        for t in range(rng.randint(0, 9)):
            turn = (["user", "assistant"][t % 2], rng.choice(["hi", "yes", None])) if t else ("user", rng.choice(["one", "two"]))
            rows.append((c, t * 2, *turn, "x"))
            convs[c].append(turn)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos string")
    pairs = [(1000 + k, rng.randrange(42), rng.choice([None, *range(42)])) for k in range(80)]
    pdf = spark.createDataFrame(pairs, "pair_id long, chosen long, rejected long")
    got = chat.spans(df, pdf)
    assert {tuple(r) for r in got.collect()} == plain(convs, pairs) and got.count() == len(plain(convs, pairs))
    one = {r.pair_id: r for r in chat.assembled(got).collect()}
    for pid, c, r in pairs:
        if convs.get(c):
            assert one[pid].prompt + one[pid].chosen == "".join(chat_text(*t) for t in convs[c])
    own = chat.paired_by_opening(df).collect()
    assert {p.chosen for p in own} == {c for c in convs if convs[c]}
    assert all(convs[p.chosen][0] == convs[p.rejected][0] for p in own if p.rejected is not None)
    assert chat.spans(df.limit(0), pdf).count() == 0


def chat_text(role, text):
    return f"<|{role or ''}|>\n{text or ''}\n<|end|>\n"


def test_sql(spark):
    sf = "/root/testdata/sf0.01"
    if not os.path.exists(sf):
        return
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf}/conversations.parquet'")
    assert {tuple(r.asDict()[k] for k in sorted(r.asDict())) for r in chat.query(spark, sf).collect()} == {tuple(r) for r in con.sql(f"select mask, pair_id, part, pos, role, text from ({chat.SQL})").fetchall()}


def test_pairs_do_not_depend_on_the_distance_of_ids(spark, monkeypatch):
    rng = random.Random(8)
    ids = rng.sample(range(0, 10**7, 13), 300)
    opening = {c: rng.choice(["often"] * 5 + ["seldom", f"once {c}"]) for c in ids}
    rows = [(c, t, "user", f"{opening[c]}" if t == 0 else f"{c}") for c in ids for t in range(2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    after = {}
    for c in sorted(ids, reverse=True):
        after[c], after[opening[c]] = after.get(opening[c]), c
    for rows_of_a_range in (7, 5000):
        monkeypatch.setattr(chat, "RANK_ROWS", rows_of_a_range)
        got = {(r.chosen, r.rejected) for r in chat.paired_by_opening(df).collect()}
        assert got == {(c, after[c]) for c in ids}
    assert chat.paired_by_opening(df.limit(0)).count() == 0


def test_sql_where_openings_repeat(spark, tmp_path):
    import duckdb

    rng = random.Random(9)
    rows = [(c, t, ["user", "assistant"][t % 2], rng.choice(["one", "two"]) if t < 2 else f"{c} {t}") for c in range(60) for t in range(rng.randint(1, 5))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    got = {tuple(r.asDict()[k] for k in sorted(r.asDict())) for r in chat.query(spark, str(tmp_path)).collect()}
    assert got == {tuple(r) for r in con.sql(f"select mask, pair_id, part, pos, role, text from ({chat.SQL})").fetchall()}
    assert {r[2] for r in got} == {"prompt", "chosen", "rejected"}


def test_odd_rows(spark):
    long = "long " * 400_000
    rows = [
        (1, None, None, "a", 0), (1, 1, "user", None, 0), (1, 1, "user", None, 0), (1, 2, "assistant", long, 0), (1, 2, "assistant", "b", 0),
        (2, None, None, "a", 0), (2, 1, "user", None, 0), (2, 1, "user", "", 0), (2, 5, "assistant", long, 0),
        (None, 0, "user", "lost", 0), (None, 0, "user", "lost", 0), (3, 0, "user", "alone", 0),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, block int")
    convs = {1: [(None, "a"), ("user", None), ("user", None), ("assistant", "b"), ("assistant", long)], 2: [(None, "a"), ("user", None), ("user", ""), ("assistant", long)], 3: [("user", "alone")]}
    pairs = chat.paired_by_opening(df)
    assert {tuple(r) for r in pairs.collect()} == {(1, 1, 2), (2, 2, None), (3, 3, None)}
    got = chat.spans(df, pairs).collect()
    want = plain(convs, [(1, 1, 2), (2, 2, None), (3, 3, None)])
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    empty = [r for r in got if r.pair_id == 1 and r.part == "prompt"]
    assert [r.pos for r in sorted(empty, key=lambda r: r.pos)] == [0, 1]


def test_texts_are_shuffled_once(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    plan = chat.spans(df, spark.createDataFrame([(1, 1, None)], "pair_id long, chosen long, rejected long"))
    list(plan.collect())
    text = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert text.count("ReusedExchange") >= 1


def replies_and_sql(spark, folder, files):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{files}'")
    rows = chat.query_replies(spark, folder).collect()
    got = sorted((tuple(r.asDict()[k] for k in sorted(r.asDict())) for r in rows), key=repr)
    assert got == sorted((tuple(r) for r in con.sql(f"select mask, pair_id, part, pos, role, text from ({chat.REPLIES_SQL})").fetchall()), key=repr)
    return rows


def test_every_reply_has_a_pair(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(chat, "RANK_ROWS", 7)
    rng = random.Random(10)
    rows = [(c * 3000, t, ["user", "assistant"][t % 2], rng.choice(["one", "two", None, "", f"{c} {t}"])) for c in range(60) for t in range(rng.randint(1, 6))]
    rows += [(-5, 0, "assistant", "starts"), (-4, 0, None, None), (-4, 1, "assistant", "one"), (None, 0, "assistant", "nobody")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = replies_and_sql(spark, str(tmp_path), f"{tmp_path}/conversations.parquet/*.parquet")
    replied = {c for c, _, role, _ in rows if role == "assistant" and c is not None}
    sides = {part: {r.pair_id: r.text for r in got if r.part == part} for part in ("chosen", "rejected")}
    assert set(sides["chosen"]) == set(sides["rejected"]) == replied
    assert all(sides["chosen"][c] != sides["rejected"][c] for c in replied)
    df = spark.createDataFrame([(1, 0, "assistant", "a"), (2, 0, "assistant", "a")], "conv_id long, turn long, role string, text string")
    assert [r.part for r in chat.reply_spans(df).collect()] == ["chosen", "chosen"] and chat.reply_spans(df.limit(0)).count() == 0


def test_replies_of_the_given_table(spark):
    sf = "/root/testdata/sf0.01"
    if not os.path.exists(sf):
        return
    got = replies_and_sql(spark, sf, f"{sf}/conversations.parquet")
    parts = {part: len({r.pair_id for r in got if r.part == part}) for part in ("prompt", "chosen", "rejected")}
    assert parts == {"prompt": 98, "chosen": 98, "rejected": 98}  # two of the 100 conversations have no reply
