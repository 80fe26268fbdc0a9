"""Queries of the retrieval engine by name, with equivalent SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import intent as I
from ..functions import lexicon as L
from ..functions import pytext, questions
from ..functions import text as X
from ..operators import batch, blocks, clusters, duplicates, fusion, inverted, ordering, scoring, sessions, statistics, vectors
from ..scratch import written
from ..sources import exports
from . import sql as S
from .engine import Archive, archive_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

QUESTION = "the erin and thon of ther"
PHRASES = [["of", "the"], ["the"], ["and", "the"], ["der"]]
MOMENT = 1704067200.0


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flat(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return exports.from_flat(read(spark, sf_dir, "conversations"))


def chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inverted.with_tokens(sessions.chunks(*flat(spark, sf_dir)))


def invented_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.turns(flat(spark, sf_dir)[1], S.ACCEPT, S.REJECT)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as scored turns: the customer is the conversation, the price the score."""
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").cast("string").alias("conversation_id"),
        F.col("o_orderkey").cast("int").alias("turn_index"),
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double").alias("create_time"),
        F.round(F.col("o_totalprice") / 600000.0, 8).alias("score"),
        F.lit(0.0).alias("exact"),
        F.lit("user").alias("matched_role"),
        F.col("o_orderkey").alias("first_chunk"),
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain search over the conversations: the ten best turns for a question."""
    return Archive.from_conversations(spark, read(spark, sf_dir, "conversations")).search(QUESTION, limit=10)


# --- turns ---


@query("turns_sessionized", f"WITH {S.turns()} SELECT conversation_id, turn_index, create_time, user_text, assistant_text, CAST(1 AS INT) AS n_user, CAST(n_assistant AS INT) AS n_assistant FROM turns")
def _(spark, d):
    return invented_turns(spark, d).select("conversation_id", "turn_index", "create_time", "user_text", "assistant_text", F.size("user_message_ids").alias("n_user"), F.size("assistant_message_ids").alias("n_assistant"))


@query("turn_acceptance", f"WITH {S.turns()} SELECT conversation_id, turn_index, acceptance FROM turns")
def _(spark, d):
    return invented_turns(spark, d).select("conversation_id", "turn_index", "acceptance")


@query("turn_acceptance_default", f"WITH {S.turns('this is perfect|nailed it', 'nah|nope')} SELECT acceptance, count(*) AS n FROM turns GROUP BY 1")
def _(spark, d):
    return sessions.turns(flat(spark, d)[1], "this is perfect|nailed it", "nah|nope").groupBy("acceptance").agg(F.count(F.lit(1)).alias("n"))


@query("previous_acceptance", f"WITH {S.turns()} SELECT c.conversation_id, c.turn_index, coalesce(p.acceptance, 'unknown') AS previous_acceptance FROM turns c LEFT JOIN turns p ON p.conversation_id = c.conversation_id AND p.turn_index = c.turn_index - 1")
def _(spark, d):
    return invented_turns(spark, d).select("conversation_id", "turn_index", "previous_acceptance")


@query(
    "user_signal_counts",
    f"""WITH {S.MESSAGES}, s AS (SELECT CASE WHEN regexp_matches(text, '(?i){S.REJECT}') THEN 'possible_rejection' WHEN regexp_matches(text, '(?i){S.REFINE}') THEN 'possible_correction_or_refinement'
    WHEN regexp_matches(text, '(?i){S.ACCEPT}') THEN 'possible_adoption_or_confirmation' ELSE 'none' END AS signal FROM msg WHERE role = 'user') SELECT signal, count(*) AS n FROM s GROUP BY 1""",
)
def _(spark, d):
    users = flat(spark, d)[1].where("role = 'user'")
    return users.groupBy(F.coalesce(X.user_signal(F.col("text"), S.REJECT, S.REFINE, S.ACCEPT), F.lit("none")).alias("signal")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "turn_window",
    f"""WITH {S.turns()}, seeds AS (SELECT conversation_id, max(turn_index) // 2 AS seed FROM turns GROUP BY 1)
    SELECT t.conversation_id, CAST(s.seed AS INT) AS seed, t.turn_index, t.user_text, t.acceptance FROM seeds s JOIN turns t ON t.conversation_id = s.conversation_id AND t.turn_index BETWEEN s.seed - 1 AND s.seed + 1""",
)
def _(spark, d):
    t = invented_turns(spark, d)
    seeds = t.groupBy("conversation_id").agg(F.floor(F.max("turn_index") / 2).cast("int").alias("turn_index"))
    return sessions.turn_window(t, seeds, 1, 1).select("conversation_id", "seed", "turn_index", "user_text", "acceptance")


@query(
    "turn_neighbours",
    f"""WITH {S.turns()} SELECT conversation_id, turn_index, lag(user_text) OVER w AS previous_user, lead(user_text) OVER w AS following_user FROM turns WINDOW w AS (PARTITION BY conversation_id ORDER BY turn_index)""",
)
def _(spark, d):
    return sessions.neighbours(invented_turns(spark, d)).select("conversation_id", "turn_index", F.col("previous.user_text").alias("previous_user"), F.col("following.user_text").alias("following_user"))


@query("source_uri", f"WITH {S.turns()} SELECT concat('archive://conversation/', conversation_id, '/turn/', turn_index) AS uri, strftime(make_timestamp(CAST(create_time * 1000000 AS BIGINT)), '%Y-%m-%d') AS day FROM turns")
def _(spark, d):
    return invented_turns(spark, d).select(X.source_uri(F.col("conversation_id"), F.col("turn_index")).alias("uri"), X.timestamp_iso(F.col("create_time")).alias("day"))


# --- counts ---


@query(
    "archive_stats",
    f"""WITH {S.turns()}, c AS (SELECT count(*) AS chunks FROM spoken WHERE text <> '')
    SELECT count(DISTINCT conversation_id) AS conversations, count(*) AS messages, count(*) AS active_messages, count(*) FILTER (WHERE role = 'user') AS user_messages, count(*) FILTER (WHERE role = 'assistant') AS assistant_messages,
    min(create_time) AS first_time, max(create_time) AS last_time, (SELECT count(*) FROM turns) AS turns, (SELECT count(*) FROM turns WHERE acceptance = 'accepted') AS accepted_turns,
    (SELECT count(*) FROM turns WHERE acceptance = 'rejected') AS rejected_turns, (SELECT chunks FROM c) AS chunks,
    (SELECT count(*) FROM spoken WHERE text <> '' AND role = 'user') AS user_chunks, (SELECT count(*) FROM spoken WHERE text <> '' AND role = 'assistant') AS assistant_chunks FROM msg""",
)
def _(spark, d):
    conversations, messages = flat(spark, d)
    return statistics.archive_stats({"conversations": conversations, "messages": messages, "turns": invented_turns(spark, d), "chunks": sessions.chunks(conversations, messages)})


@query("role_counts", f"WITH {S.MESSAGES} SELECT role, count(*) AS n FROM msg GROUP BY role")
def _(spark, d):
    return statistics.role_counts(flat(spark, d)[1])


@query(
    "build_counters",
    f"""WITH {S.MESSAGES}, k AS (SELECT *, CASE WHEN active_position % 3 = 0 THEN 'code' END AS content_type, active_position % 4 <> 3 AS is_active FROM msg),
    c AS (SELECT concat('role_', role) AS counter FROM k UNION ALL SELECT concat('content_', coalesce(content_type, 'unknown')) FROM k UNION ALL SELECT 'active_messages' FROM k WHERE is_active UNION ALL SELECT 'messages' FROM k)
    SELECT counter, count(*) AS n FROM c GROUP BY counter UNION ALL SELECT 'skipped_without_id', count(*) FROM conversations WHERE turn % 7 = 6""",
)
def _(spark, d):
    messages = flat(spark, d)[1].withColumn("content_type", F.when(F.col("active_position") % 3 == 0, "code")).withColumn("is_active", F.col("active_position") % 4 != 3)
    entries = read(spark, d, "conversations").select(F.when(F.col("turn") % 7 == 6, "").otherwise("x").alias("conversation_id"), F.lit(None).cast("string").alias("id"))
    return statistics.build_counters(messages, entries)


@query("file_stats", "SELECT 'flat' AS source_file, count(DISTINCT conv_id) AS conversations, count(*) AS messages FROM conversations")
def _(spark, d):
    return statistics.file_stats(flat(spark, d)[0])


@query("date_window_inclusive", f"WITH {S.MESSAGES} SELECT message_id FROM msg WHERE create_time >= {MOMENT} AND create_time <= {MOMENT + 20 * 432000}")
def _(spark, d):
    return flat(spark, d)[1].where(sessions.dated_inclusive(F.col("create_time"), MOMENT, MOMENT + 20 * 432000)).select("message_id")


@query("date_window_halfopen", f"WITH {S.MESSAGES} SELECT message_id FROM msg WHERE create_time >= {MOMENT} AND create_time < {MOMENT + 20 * 432000}")
def _(spark, d):
    return flat(spark, d)[1].where(sessions.dated_half_open(F.col("create_time"), MOMENT, MOMENT + 20 * 432000)).select("message_id")


# --- index ---


@query("chunk_ids", f"WITH {S.CHUNKS} SELECT chunk_id, conversation_id, turn_index, message_id, role, create_time, title, sha256(text) AS content_hash FROM chunks")
def _(spark, d):
    return sessions.chunks(*flat(spark, d)).select("chunk_id", "conversation_id", "turn_index", "message_id", "role", "create_time", "title", "content_hash")


@query("term_df", f"WITH {S.CHUNKS} SELECT term, count(DISTINCT chunk_id) AS df, count(*) AS cf FROM (SELECT chunk_id, unnest(list_concat(title_tokens, text_tokens)) AS term FROM docs) GROUP BY term")
def _(spark, d):
    terms = inverted.postings(chunked(spark, d))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.col("tf_title") + F.col("tf_text")).alias("cf"))


@query("corpus_stats", f"WITH {S.CHUNKS} SELECT n, round(avgdl, 6) AS avgdl FROM stats")
def _(spark, d):
    return inverted.corpus_stats(chunked(spark, d)).select("n", F.round("avgdl", 6).alias("avgdl"))


def scored(spark, d, searches):
    rows = chunked(spark, d)
    return inverted.bm25(rows, inverted.postings(rows), inverted.corpus_stats(rows), searches).select("search", "chunk_id", F.round("bm25", 6).alias("bm25"))


OR, AND, PHRASE = [([["the"], ["thon"], ["der"]], False)], [([["the"], ["of"], ["and"]], True)], [([["of", "the"]], False)]


def scored_sql(searches) -> str:
    return f"WITH {S.bm25(searches)} SELECT search, chunk_id, round(bm25, 6) AS bm25 FROM ranked"


@query("bm25_or", scored_sql(OR))
def _(spark, d):
    return scored(spark, d, OR)


@query("bm25_and", scored_sql(AND))
def _(spark, d):
    return scored(spark, d, AND)


@query("bm25_phrase", scored_sql(PHRASE))
def _(spark, d):
    return scored(spark, d, PHRASE)


@query("prefix_match", f"WITH {S.CHUNKS} SELECT chunk_id FROM docs WHERE len(list_filter(list_concat(title_tokens, text_tokens), lambda t: starts_with(t, 'tho'))) > 0")
def _(spark, d):
    return inverted.prefix_match(inverted.postings(chunked(spark, d)), "tho")


@query(
    "variant_rank",
    f"""WITH {S.bm25([*OR, *PHRASE])}, r AS (SELECT search, chunk_id, row_number() OVER (PARTITION BY search ORDER BY round(bm25, 12), chunk_id) AS rank FROM ranked)
    SELECT search, chunk_id, CAST(rank AS INT) AS rank FROM r WHERE rank <= 25""",
)
def _(spark, d):
    rows = chunked(spark, d)
    hits = inverted.bm25(rows, inverted.postings(rows), inverted.corpus_stats(rows), [*OR, *PHRASE])
    return inverted.top_ranks(hits, 25, [F.round("bm25", 12).asc(), F.col("chunk_id").asc()]).select("search", "chunk_id", "rank")


#: The searches that QUESTION stands for and their weights, written out: all terms as a phrase, every term, any term.
SEARCH_TOKENS = [([["erin", "thon", "ther"]], False), ([["erin"], ["thon"], ["ther"]], True), ([["erin"], ["thon"], ["ther"]], False)]
SEARCH_WEIGHTS = [1.7, 1.35, 1.0]
LEXICAL = f"""{S.bm25(SEARCH_TOKENS)},
r AS (SELECT search, chunk_id, row_number() OVER (PARTITION BY search ORDER BY round(bm25, 12), chunk_id) AS rank FROM ranked),
weights(search, weight) AS (VALUES {", ".join(f"({i}, {w}::DOUBLE)" for i, w in enumerate(SEARCH_WEIGHTS))}),
lex AS (SELECT r.chunk_id, round(sum(weight * CASE WHEN role = 'user' THEN 1.35 ELSE 0.45 END / (60.0 + rank)), 12) AS score, min(rank) AS lexical_rank
  FROM r JOIN weights USING (search) JOIN chunks c ON c.chunk_id = r.chunk_id WHERE rank <= 250 GROUP BY r.chunk_id)"""


@query("lexical_search", f"WITH {LEXICAL} SELECT chunk_id, round(score, 8) AS score, CAST(lexical_rank AS INT) AS lexical_rank FROM lex")
def _(spark, d):
    return Archive.from_conversations(spark, read(spark, d, "conversations")).lexical(QUESTION, 250).select("chunk_id", F.round("score", 8).alias("score"), "lexical_rank")


@query(
    "search_turns",
    f"""WITH {LEXICAL}, t AS (SELECT c.conversation_id, c.turn_index, min_by(l.chunk_id, (-l.score, l.chunk_id)) AS chunk_id, round(max(l.score) + 0.2 * (sum(l.score) - max(l.score)), 12) AS score FROM lex l JOIN chunks c USING (chunk_id) GROUP BY 1, 2)
    SELECT conversation_id, turn_index, chunk_id, round(score, 8) AS score, CAST(row_number() OVER (ORDER BY score DESC, chunk_id) AS INT) AS place FROM t ORDER BY score DESC, chunk_id LIMIT 12""",
)
def _(spark, d):
    found = Archive.from_conversations(spark, read(spark, d, "conversations")).search(QUESTION)
    return found.select("conversation_id", "turn_index", "chunk_id", F.round("score", 8).alias("score"), "place")


TERM_SQL = ", ".join(f"'{w}'" for w in L.STOP_WORDS)


@query(
    "searchable_terms",
    f"""WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}\\p{{M}}_’'']+')) AS word FROM conversations), t AS (SELECT conv_id, turn, trim(word, '’''') AS word FROM w)
    SELECT conv_id, turn, count(DISTINCT word) AS n, max(word) AS last_word FROM t WHERE length(word) > 1 AND word NOT IN ({TERM_SQL}) GROUP BY ALL""",
)
def _(spark, d):
    rows = read(spark, d, "conversations").select("conv_id", "turn", X.searchable_terms(F.col("text")).alias("t")).where(F.size("t") > 0)
    return rows.select("conv_id", "turn", F.size("t").cast("long").alias("n"), F.array_max("t").alias("last_word"))


# --- vectors and fusion ---

DOT = "list_sum(list_transform(list_zip(e.embedding, q.v), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
NEAR = f"q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, label, {DOT} AS similarity FROM embeddings e, q)"


def probe(spark, d) -> tuple[DataFrame, list[float]]:
    e = read(spark, d, "embeddings")
    return e, list(e.where("vec_id = 0").first()["embedding"])


@query("cosine_topk", f"WITH {NEAR} SELECT vec_id, round(similarity, 6) AS similarity, CAST(row_number() OVER (ORDER BY similarity DESC, vec_id) AS INT) AS rank FROM s ORDER BY similarity DESC, vec_id LIMIT 20")
def _(spark, d):
    return vectors.nearest(*probe(spark, d), 20, "vec_id").select("vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@query("cosine_topk_clusters", f"WITH {NEAR} SELECT vec_id, label, round(similarity, 6) AS similarity, CAST(row_number() OVER (ORDER BY similarity DESC, vec_id) AS INT) AS rank FROM s ORDER BY similarity DESC, vec_id LIMIT 20")
def _(spark, d):
    e, v = probe(spark, d)
    rows, sizes = clusters.clustered(e, "vec_id")
    rows = written(rows, "clustered")
    return clusters.nearest(rows, clusters.held(sizes), v, 20, "vec_id", "label").withColumn("similarity", F.round("similarity", 6))


@query(
    "cosine_topk_filtered",
    f"""WITH {NEAR}, t AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, vec_id) AS raw FROM s), k AS (SELECT * FROM t WHERE raw <= 60 AND vec_id % 3 = 0 ORDER BY raw LIMIT 20)
    SELECT vec_id, round(similarity, 6) AS similarity, CAST(row_number() OVER (ORDER BY raw) AS INT) AS rank FROM k""",
)
def _(spark, d):
    e, v = probe(spark, d)
    return vectors.nearest_filtered(e, v, 20, F.col("vec_id") % 3 == 0, "vec_id").select("vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@query(
    "hybrid_rrf",
    f"""WITH {NEAR}, sem AS (SELECT vec_id AS id, row_number() OVER (ORDER BY similarity DESC, vec_id) AS rank FROM s), lex AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
    u AS (SELECT id, rank, 1.0 AS w, 's' AS l FROM sem WHERE rank <= 100 UNION ALL SELECT id, rank, 1.6, 'l' FROM lex WHERE rank <= 100)
    SELECT id AS chunk_id, round(sum(w * CASE WHEN id % 2 = 0 THEN 1.15 ELSE 0.70 END / (60.0 + rank)), 8) AS score, CAST(min(rank) FILTER (WHERE l = 'l') AS INT) AS lexical_rank, CAST(min(rank) FILTER (WHERE l = 's') AS INT) AS semantic_rank FROM u GROUP BY id""",
)
def _(spark, d):
    role = lambda df: df.withColumn("role", F.when(F.col("chunk_id") % 2 == 0, "user").otherwise("assistant"))
    near = role(vectors.nearest(*probe(spark, d), 100, "vec_id").withColumnRenamed("vec_id", "chunk_id"))
    long = read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "n_chars").orderBy(F.desc("n_chars"), "chunk_id").limit(100)
    long = role(vectors.with_rank(long, [F.desc("n_chars"), F.col("chunk_id")]))
    return fusion.fuse_lists(long, near, 1.6, 1.0).withColumn("score", F.round("score", 8))


@query("semantic_only_ids", f"WITH {NEAR} SELECT vec_id FROM s WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def _(spark, d):
    labelled = read(spark, d, "labels").select("doc_id").where("doc_id is not null")
    return read(spark, d, "embeddings").join(labelled, F.col("vec_id") == F.col("doc_id"), "left_anti").select("vec_id")


@query("id_membership", "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def _(spark, d):
    ids = read(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("wanted"))
    return read(spark, d, "documents").join(ids, F.col("doc_id") == F.col("wanted"), "left_semi").select("doc_id", "n_chars")


# --- totals of turns and score components, on scores made from the text's length ---

MADE = "round((length(text) % 97) / 97.0, 8)"


def made_scores(spark, d) -> DataFrame:
    return sessions.chunks(*flat(spark, d)).withColumn("score", F.round((F.char_length("text") % 97) / 97.0, 8)).withColumn("exact", F.lit(0.0))


@query(
    "turn_aggregate_plain",
    f"WITH {S.CHUNKS}, m AS (SELECT *, {MADE} AS score FROM chunks) SELECT conversation_id, turn_index, min_by(chunk_id, (-score, chunk_id)) AS chunk_id, round(max(score) + 0.2 * (sum(score) - max(score)), 8) AS score FROM m GROUP BY 1, 2",
)
def _(spark, d):
    return fusion.hits_to_turns(made_scores(spark, d)).select("conversation_id", "turn_index", "chunk_id", F.round("score", 8).alias("score"))


@query(
    "turn_aggregate_context",
    f"""WITH {S.CHUNKS}, m AS (SELECT *, {MADE} AS score FROM chunks), r AS (SELECT *, row_number() OVER (PARTITION BY conversation_id, turn_index ORDER BY score DESC, CASE WHEN role = 'user' THEN 0 ELSE 1 END, create_time, chunk_id) AS place FROM m)
    SELECT conversation_id, turn_index, min(chunk_id) AS first_chunk, round(least(1.0, max(score) FILTER (WHERE place = 1) + round(least(0.08, 0.03 * coalesce(sum(score) FILTER (WHERE place BETWEEN 2 AND 5), 0)), 8)), 8) AS score FROM r GROUP BY 1, 2""",
)
def _(spark, d):
    empty = F.array().cast("array<struct<name:string,raw:double,weight:double,contribution:double>>")
    rows = made_scores(spark, d).withColumn("components", empty).withColumn("correction_signal", F.lit(0.0))
    for name in ("user_text", "assistant_text", "acceptance", "previous_acceptance"):
        rows = rows.withColumn(name, F.lit(""))
    return scoring.turn_totals(rows, 1_000_000).select("conversation_id", "turn_index", "first_chunk", "score")


@query("corroboration", f"WITH {S.CHUNKS} SELECT conversation_id, round(least(1.0, log2(1 + count(DISTINCT turn_index)) / 3.0), 8) AS corroboration FROM chunks GROUP BY 1")
def _(spark, d):
    spread = sessions.chunks(*flat(spark, d)).groupBy("conversation_id").agg(F.countDistinct("turn_index").alias("n"))
    return spread.select("conversation_id", F.round(scoring.corroboration(F.col("n")), 8).alias("corroboration"))


@query("recency_normalised", f"WITH {S.CHUNKS}, b AS (SELECT min(create_time) AS a, max(create_time) AS z FROM chunks) SELECT chunk_id, round((create_time - a) / (z - a), 8) AS recency FROM chunks, b")
def _(spark, d):
    rows = sessions.chunks(*flat(spark, d))
    span = rows.agg(F.min("create_time").alias("a"), F.max("create_time").alias("z"))
    return rows.join(F.broadcast(span)).select("chunk_id", F.round(scoring.normalized_time(F.col("create_time"), F.col("a"), F.col("z")), 8).alias("recency"))


@query(
    "title_jaccard",
    """WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(strip_accents(text)), '[a-z]+')) AS words FROM conversations), q AS (SELECT ['the', 'and', 'of', 'erin', 'der'] AS asked)
    SELECT conv_id, turn, CASE WHEN len(words) = 0 THEN 0.0 ELSE round(len(list_intersect(words, asked)) / len(list_distinct(list_concat(words, asked))), 8) END AS overlap FROM t, q""",
)
def _(spark, d):
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.translate("text", *X.accents())), F.lit("([a-z]+)"), F.lit(1)))
    asked = F.array(*map(F.lit, ["the", "and", "of", "erin", "der"]))
    return read(spark, d, "conversations").select("conv_id", "turn", F.round(X.jaccard(words, asked), 8).alias("overlap"))


@query(
    "lexical_strength",
    f"""WITH {S.bm25([*OR, *AND, *PHRASE])}, r AS (SELECT search, chunk_id, row_number() OVER (PARTITION BY search ORDER BY round(bm25, 12), chunk_id) AS rank FROM ranked),
    v AS (SELECT chunk_id, (0.5 + 0.25 * search) * 61.0 / (60.0 + rank) AS value FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY value DESC) AS n FROM v)
    SELECT chunk_id, round(least(1.0, max(value) FILTER (WHERE n = 1) + 0.12 * coalesce(sum(value) FILTER (WHERE n BETWEEN 2 AND 3), 0)), 8) AS strength FROM k GROUP BY 1""",
)
def _(spark, d):
    rows = chunked(spark, d)
    hits = inverted.bm25(rows, inverted.postings(rows), inverted.corpus_stats(rows), [*OR, *AND, *PHRASE])
    ranked = inverted.top_ranks(hits, 1_000_000, [F.round("bm25", 12).asc(), F.col("chunk_id").asc()])
    matches = ranked.groupBy("chunk_id").agg(F.collect_list(F.struct((0.5 + 0.25 * F.col("search")).alias("weight"), "rank")).alias("matches"))
    return matches.select("chunk_id", F.round(scoring.lexical_strength(F.col("matches")), 8).alias("strength"))


@query(
    "weighted_score",
    f"""WITH {S.CHUNKS}, m AS (SELECT chunk_id, role, {MADE} AS a, round((length(text) % 31) / 31.0, 8) AS b FROM chunks)
    SELECT chunk_id, round(greatest(0.0, least(1.0, round(a * 0.22, 8) + round(b * 0.22, 8) + round(a * 0.10, 8) + round(b * 0.05, 8) + CASE WHEN role = 'user' THEN 0.15 ELSE 0 END + round(b * 0.15, 8) + round(a * 0.06, 8) + round(b * 0.05, 8)
    - CASE WHEN role = 'assistant' THEN 0.20 ELSE 0 END)), 6) AS score FROM m""",
)
def _(spark, d):
    a, b = F.col("score"), F.round((F.char_length("text") % 31) / 31.0, 8)
    user = F.when(F.col("role") == "user", 1.0).otherwise(0.0)
    raw = dict(zip(L.COMPONENTS, (a, b, a, b, user, b, a, b), strict=True))
    total, _parts = scoring.weighted_total(raw, "correction")
    total = total + scoring.adjustment(F.col("role"), F.lit("rejected"))
    return made_scores(spark, d).select("chunk_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 6).alias("score"))


@query(
    "exact_strength",
    """WITH m AS (SELECT doc_id, regexp_replace(lower(replace(text, 'ß', 'ss')), '\\s+', ' ', 'g') AS hay FROM documents)
    SELECT doc_id, CAST(CASE WHEN contains(hay, 'released under the mit license') THEN 1.0 WHEN contains(hay, 'apache') THEN 0.75 WHEN contains(hay, 'of the') THEN 0.9 ELSE 0.0 END AS DOUBLE) AS strength FROM m""",
)
def _(spark, d):
    intent = I.Intent("exact", (), "", ("Released  under the MIT License",), ("Apache",))
    hay = pytext.match_form_udf(F.col("text"))
    return read(spark, d, "documents").select("doc_id", scoring.exact_strength(hay, intent, "Of  the").cast("double").alias("strength"))


#: Questions, and the mode that each asks for: written out, so that the SQL does not rest on the patterns it checks.
ASKED = {
    "what is the latest plan": "latest", "when did i first start it": "earliest", "how has it changed over time": "longitudinal", "what did we decide about the roadmap": "decision",
    "give me the exact quote": "exact", "that was wrong, what instead": "correction", "tell me about thon": "recall", "where are we now": "latest", "early days and recent ones": "longitudinal",
    'he said "of the thon" once': "exact", "not this but that": "correction", "verbatim please": "exact", "final position on plans": "correction", "incorrectly": "recall", "currently": "latest",
}


def frames_sql() -> str:
    return ", ".join(f"({n}, '" + q.replace("'", "''") + f"', '{mode}')" for n, (q, mode) in enumerate(ASKED.items()))


@query("intent_modes", f"SELECT item_id, mode FROM benchmark JOIN (VALUES {frames_sql()}) t(n, q, mode) ON item_id % {len(ASKED)} = n")
def _(spark, d):
    """The mode of a question about every benchmark text: one of the questions above, then the text."""
    frame = F.element_at(F.array(*map(F.lit, ASKED)), (F.col("item_id") % len(ASKED) + 1).cast("int"))
    asked = read(spark, d, "benchmark").select("item_id", F.concat(frame, F.lit(" "), "text").alias("q"))
    return questions.interpreted(asked, "item_id", "q").select(F.col("question").alias("item_id"), "mode")


def ordered_terms_sql(rows: str, key: str, words: str) -> str:
    """(key, terms): the searchable terms of a list of words, in order, each once."""
    return f"""SELECT {key}, list(word ORDER BY pos) AS terms FROM (SELECT {key}, word, min(pos) AS pos FROM (SELECT {key}, trim(unnest({words}), '’''') AS word, generate_subscripts({words}, 1) AS pos FROM {rows})
  WHERE length(word) > 1 AND word NOT IN ({TERM_SQL}) GROUP BY {key}, word) GROUP BY {key}"""


WORDS = r"regexp_extract_all(lower(q), '[\p{L}\p{N}\p{M}_’'']+')"
STOPS = ", ".join(f"'{w}'" for w in L.IDENTIFIER_STOPS)


@query(
    "query_variants",
    rf"""WITH q AS (SELECT item_id, concat('how has ', text, ' changed over time') AS q FROM benchmark), w AS (SELECT item_id, q, {WORDS} AS words FROM q),
    t AS ({ordered_terms_sql("w", "item_id", "words")}),
    m AS (SELECT item_id, list(name ORDER BY pos)[1:3] AS names FROM (SELECT item_id, name, min(pos) AS pos FROM (SELECT item_id, unnest(x) AS name, generate_subscripts(x, 1) AS pos FROM (SELECT item_id, regexp_extract_all(q, '[\p{{L}}\p{{N}}\p{{M}}_-]+') AS x FROM q))
      WHERE regexp_full_match(name, '[A-Z][A-Za-z0-9_-]{{2,}}') AND name NOT IN ({STOPS}) GROUP BY item_id, name) GROUP BY item_id),
    a AS (SELECT item_id, q, terms, coalesce(names, []) AS names, CASE WHEN len(coalesce(names, [])) > 0 THEN names ELSE terms[1:3] END AS anchors FROM q JOIN t USING (item_id) LEFT JOIN m USING (item_id)),
    l AS (SELECT item_id, [{{'kind': 'semantic_original', 'text': q, 'weight': 1.0}}] || list_transform(names, lambda n: {{'kind': 'identifier', 'text': n, 'weight': 0.9}})
      || [{{'kind': 'lexical_and', 'text': array_to_string(terms[1:12], ' '), 'weight': 0.85}}, {{'kind': 'lexical_or', 'text': array_to_string(terms[1:16], ' '), 'weight': 0.55}},
      {{'kind': 'temporal_earliest', 'text': array_to_string(anchors[1:2], ' '), 'weight': 0.35}}, {{'kind': 'temporal_latest', 'text': array_to_string(anchors[1:2], ' '), 'weight': 0.35}},
      {{'kind': 'change_terms', 'text': array_to_string(anchors, ' ') || ' changed evolved', 'weight': 0.6}}] AS v FROM a),
    s AS (SELECT item_id, unnest(v) AS v, generate_subscripts(v, 1) - 1 AS n FROM l), k AS (SELECT item_id, n, v.kind AS kind, v.text AS text, v.weight AS weight, lower(v.text) AS q FROM s WHERE n < 8),
    p AS ({ordered_terms_sql("(SELECT concat(item_id, ':', n) AS key_n, " + WORDS + " AS words FROM k)", "key_n", "words")})
    SELECT item_id, CAST(n AS INT) AS n, kind, text, CAST(weight AS DOUBLE) AS weight, CASE WHEN kind = 'identifier' THEN q ELSE coalesce(array_to_string(terms, '|'), '') END AS phrases, kind = 'lexical_and' AS needs_all
    FROM k LEFT JOIN p ON key_n = concat(item_id, ':', n)""",
)
def _(spark, d):
    """The searches for a question of change about every benchmark text."""
    asked = read(spark, d, "benchmark").select("item_id", F.concat(F.lit("how has "), "text", F.lit(" changed over time")).alias("q"))
    found = questions.searches(questions.interpreted(asked, "item_id", "q"))
    return found.select(F.col("question").alias("item_id"), "n", "kind", "text", "weight", F.array_join("phrases", "|").alias("phrases"), "needs_all")


@query(
    "question_ranks",
    rf"""WITH {S.CHUNKS}, q AS (SELECT item_id, text AS q FROM benchmark), w AS (SELECT item_id, {WORDS} AS words FROM q), t AS ({ordered_terms_sql("w", "item_id", "words")}),
    asked AS (SELECT item_id, token, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(lower(strip_accents(x)), '[\p{{L}}\p{{N}}]+')) AS token FROM (SELECT item_id, unnest(terms[1:16]) AS x FROM t)) GROUP BY ALL),
    tf AS (SELECT chunk_id, token, sum(in_title) AS tf_title, sum(1 - in_title) AS tf_text FROM (SELECT chunk_id, unnest(title_tokens) AS token, 1 AS in_title FROM docs UNION ALL SELECT chunk_id, unnest(text_tokens), 0 FROM docs) GROUP BY ALL),
    idf AS (SELECT token, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 0.000001 END AS idf FROM (SELECT token, count(*) AS df FROM tf GROUP BY token), stats),
    s AS (SELECT item_id, chunk_id, -sum(times * idf * (2.0 * tf_title + 5.0 * tf_text) * 2.2 / (2.0 * tf_title + 5.0 * tf_text + 1.2 * (0.25 + 0.75 * doc_len / avgdl))) AS bm25 FROM asked JOIN tf USING (token) JOIN idf USING (token) JOIN docs USING (chunk_id), stats GROUP BY item_id, chunk_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(bm25, 12), chunk_id) AS rank FROM s) SELECT item_id, CAST(rank AS INT) AS rank, chunk_id, round(bm25, 6) AS bm25 FROM r WHERE rank <= 10""",
)
def _(spark, d):
    """The ten best chunks for every benchmark text, all texts in one join with the postings of the tokens they ask for."""
    asked = questions.interpreted(read(spark, d, "benchmark"), "item_id", "text").select("question", F.explode(F.slice("terms", 1, 16)).alias("p"))
    asked = written(asked.select(F.col("question").alias("search"), X.tokens(F.col("p")).alias("phrase")).where(F.size("phrase") > 0), "asked")
    tokenized = written(chunked(spark, d).select("chunk_id", "title_tokens", "text_tokens", "doc_len"), "tokens")
    found = batch.best(*batch.index_of(tokenized, asked), asked, 10, few=0)
    return found.select(F.col("search").alias("item_id"), "rank", "chunk_id", F.round("bm25", 6).alias("bm25"))


BEST = [(["the", "thon", "der"], "any role"), (["de", "que", "of", "and"], "users")]


@query(
    "bm25_best",
    f"""WITH {S.bm25([([[t] for t in each], False) for each, _ in BEST])}, k AS (SELECT search, chunk_id, round(bm25, 12) AS bm25, 'any role' AS among FROM ranked UNION ALL SELECT search, chunk_id, round(bm25, 12), 'users' FROM ranked JOIN chunks USING (chunk_id) WHERE role = 'user'),
    r AS (SELECT *, row_number() OVER (PARTITION BY search, among ORDER BY bm25, chunk_id) AS rank FROM k) SELECT search, among, CAST(rank AS INT) AS rank, chunk_id, round(bm25, 6) AS bm25 FROM r WHERE rank <= 20""",
)
def _(spark, d):
    """The twenty best chunks for any of some terms, by blocks: of all roles, then of users."""
    archive = Archive.from_conversations(spark, read(spark, d, "conversations"))
    t, searches = archive.tables, {s: each for s, (each, _) in enumerate(BEST)}
    held = blocks.held(t["blocks"], sorted({x for each in searches.values() for x in each}))
    rows = []
    for among, condition in (("any role", None), ("users", F.col("role") == "user")):
        found = blocks.best(t["chunks"], t["postings"], archive.size, searches, held, 20, condition, few=0)
        for s in searches:
            own = sorted((round(r["bm25"], 12), r["chunk_id"]) for r in found if r["search"] == s)
            rows += [(s, among, n, chunk, round(score, 6)) for n, (score, chunk) in enumerate(own, 1)]
    return spark.createDataFrame(rows, "search int, among string, rank int, chunk_id long, bm25 double")


@query(
    "correction_signal",
    f"""WITH {S.turns()} SELECT conversation_id, turn_index, CAST(CASE WHEN previous_acceptance = 'rejected' THEN 1.0 WHEN regexp_matches(user_text, '(?i){S.REJECT}') OR regexp_matches(user_text, '(?i){S.REFINE}') THEN 0.75 ELSE 0.0 END AS DOUBLE) AS signal FROM turns""",
)
def _(spark, d):
    said = X.user_signal(F.col("user_text"), S.REJECT, S.REFINE, S.ACCEPT)
    return invented_turns(spark, d).select("conversation_id", "turn_index", scoring.correction_signal(F.col("previous_acceptance"), said).cast("double").alias("signal"))


# --- orders by time ---


def placed(rows: DataFrame) -> DataFrame:
    return rows.select("conversation_id", "turn_index", "place")


def longitudinal(rows: DataFrame) -> DataFrame:
    """Places of the rows above the floor."""
    best = rows.agg(F.max("score").alias("best_score"))
    kept = rows.join(F.broadcast(best)).where(F.col("score") >= ordering.relevance_floor(F.col("best_score"), True))
    return placed(ordering.longitudinal_places(kept, X.quarter(F.col("create_time")), scoring.rank_order("matched_role", "first_chunk")))


@query("earliest", f"WITH {S.ORDERS}, k AS (SELECT * FROM o, best WHERE score >= greatest(0.25, best * 0.55)) SELECT conversation_id, turn_index, score FROM k ORDER BY create_time, score DESC, conversation_id, turn_index LIMIT 50")
def _(spark, d):
    rows = ordering.qualified(orders(spark, d), False)
    return rows.orderBy(*ordering.by_time(rows, "earliest")).limit(50).select("conversation_id", "turn_index", "score")


@query("latest", f"WITH {S.ORDERS}, k AS (SELECT * FROM o, best WHERE score >= greatest(0.25, best * 0.55)) SELECT conversation_id, turn_index, score FROM k ORDER BY create_time DESC, score DESC, conversation_id, turn_index LIMIT 50")
def _(spark, d):
    rows = ordering.qualified(orders(spark, d), False)
    return rows.orderBy(*ordering.by_time(rows, "latest")).limit(50).select("conversation_id", "turn_index", "score")


@query("search_earliest", f"WITH {S.ORDERS} SELECT conversation_id, turn_index, create_time FROM o ORDER BY create_time, score DESC, turn_index LIMIT 30")
def _(spark, d):
    return orders(spark, d).where("create_time is not null").orderBy("create_time", F.desc("score"), "turn_index").limit(30).select("conversation_id", "turn_index", "create_time")


RANK_SQL = "score DESC, create_time, conversation_id, turn_index"


@query("quarter_representatives", f"WITH {S.ORDERS}, r AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY {RANK_SQL}) AS n FROM o) SELECT period, conversation_id, turn_index, score FROM r WHERE n = 1")
def _(spark, d):
    rows = ordering.representatives_first(orders(spark, d), X.quarter(F.col("create_time")), scoring.rank_order("matched_role", "first_chunk"))
    return rows.where(~F.col("backfill")).select("period", "conversation_id", "turn_index", "score")


@query(
    "longitudinal",
    f"""WITH {S.ORDERS}, k AS (SELECT * FROM o, best WHERE score >= greatest(0.25, best * 0.4)), r AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY {RANK_SQL}) > 1 AS backfill FROM k)
    SELECT conversation_id, turn_index, row_number() OVER (ORDER BY backfill, CASE WHEN NOT backfill THEN period END NULLS FIRST, {RANK_SQL}) AS place FROM r""",
)
def _(spark, d):
    return longitudinal(orders(spark, d))


@query(
    "timeline_round_robin",
    f"WITH {S.ORDERS}, r AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY score DESC, turn_index) AS n FROM o) SELECT period AS bucket, CAST(n AS INT) AS turn, conversation_id, turn_index FROM r ORDER BY n, period LIMIT 40",
)
def _(spark, d):
    rows = fusion.round_robin(orders(spark, d), X.quarter(F.col("create_time")), [F.desc("score"), F.col("turn_index").asc()], 40)
    return rows.select("bucket", "turn", "conversation_id", "turn_index")


@query(
    "conversation_cap_backfill",
    f"""WITH {S.ORDERS}, t AS (SELECT * FROM o ORDER BY score DESC, turn_index LIMIT 60), k AS (SELECT *, row_number() OVER (ORDER BY score DESC, turn_index) AS rk FROM t),
    c AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY rk) > 2 AS over_cap FROM k) SELECT conversation_id, turn_index, over_cap, CAST(row_number() OVER (ORDER BY over_cap, rk) AS INT) AS place FROM c ORDER BY over_cap, rk LIMIT 50""",
)
def _(spark, d):
    top = orders(spark, d).orderBy(F.desc("score"), "turn_index").limit(60)
    ranked = top.withColumn("rk", F.row_number().over(Window.orderBy(F.desc("score"), "turn_index")))
    return ordering.cap_with_backfill(ranked, "conversation_id", "rk", 2, 50).select("conversation_id", "turn_index", "over_cap", "place")


@query("temporal_topk_nulls_last", "SELECT event_id, ts_or_null FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE epoch(ts) END AS ts_or_null FROM events) ORDER BY ts_or_null DESC NULLS LAST, event_id LIMIT 40")
def _(spark, d):
    exact = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, None).otherwise(exact).alias("ts_or_null"))
    return rows.orderBy(F.desc_nulls_last("ts_or_null"), "event_id").limit(40)


@query("quarter_key", f"WITH {S.ORDERS} SELECT period, count(*) AS n FROM o GROUP BY 1")
def _(spark, d):
    return orders(spark, d).groupBy(X.quarter(F.col("create_time")).alias("period")).agg(F.count(F.lit(1)).alias("n"))


# --- texts ---


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))


DIRTY = "concat('  ', chr(9), text, chr(13), chr(10), chr(13), 'x', chr(9), ' y', chr(10), chr(10), chr(10), chr(10), chr(10), 'z ', chr(10))"


def dirty():
    return F.concat(F.lit("  \t"), F.col("text"), F.lit("\r\n\rx\t y\n\n\n\n\nz \n"))


@query(
    "clean_text",
    f"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(replace({DIRTY}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \\t]+', ' ', 'g'), '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS cleaned FROM documents""",
)
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", X.clean_text(dirty()).alias("cleaned"))


@query(
    "sanitize_text",
    """SELECT doc_id, trim(regexp_replace(replace(concat('a', chr(8238), 'b', text, chr(7), '  ', chr(9), 'c'), chr(8238), '<U+202E>'), '[ \\t\\x07]+', ' ', 'g'), ' ' || chr(10)) AS shown FROM documents""",
)
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", X.sanitize_text(F.concat(F.lit("a‮b"), F.col("text"), F.lit("\x07  \tc"))).alias("shown"))


@query("shorten", "SELECT doc_id, CASE WHEN length(text) > 300 THEN regexp_replace(substr(text, 1, 299), '\\s+$', '') || '…' ELSE text END AS short FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", X.shorten(F.col("text"), 300).alias("short"))


@query(
    "shingle_counts",
    """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS words FROM documents)
    SELECT doc_id, CAST(CASE WHEN len(words) = 0 THEN 0 WHEN len(words) < 5 THEN 1 ELSE len(list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')))) END AS INT) AS n FROM w""",
)
def _(spark, d):
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return read(spark, d, "documents").select("doc_id", F.size(X.word_shingles(words)).alias("n"))


@query(
    "exact_dedup",
    """WITH f AS (SELECT doc_id, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS form FROM documents)
    SELECT sha256(form) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM f GROUP BY 1""",
)
def _(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.sha2(pytext.evidence_form_udf(F.col("text")), 256).alias("digest"))
    return rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query("duplicate_rate", "WITH f AS (SELECT regexp_replace(lower(replace(text, 'ß', 'ss')), '\\s+', ' ', 'g') AS form FROM documents), g AS (SELECT count(*) AS n FROM f GROUP BY form) SELECT round(sum(n - 1) / sum(n), 6) AS rate FROM g")
def _(spark, d):
    copies = read(spark, d, "documents").groupBy(pytext.match_form_udf(F.col("text")).alias("form")).agg(F.count(F.lit(1)).alias("n"))
    return copies.agg(F.round(F.sum(F.col("n") - 1) / F.sum("n"), 6).alias("rate"))


@query(
    "chunk_documents",
    """WITH RECURSIVE d AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \\t]+', ' ', 'g'), '\\n{4,}', chr(10) || chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM documents),
    w AS (
      SELECT doc_id, text, 0 AS start, NULL::VARCHAR AS piece, -1 AS n, false AS done FROM d WHERE text <> ''
      UNION ALL
      SELECT doc_id, text, greatest(start + 1, stop - 240), piece, n + CASE WHEN piece <> '' THEN 1 ELSE 0 END, stop >= length(text) FROM (
        SELECT *, regexp_replace(substr(text, start + 1, stop - start), '^\\s+|\\s+$', '', 'g') AS piece FROM (
          SELECT doc_id, text, start, n, CASE WHEN start + 2400 >= length(text) THEN length(text) WHEN brk IS NULL THEN start + 2400 ELSE start + 1200 + brk + CASE WHEN substr(text, start + 1200 + brk + 1, 1) = '.' THEN 1 ELSE 0 END END AS stop FROM (
            SELECT doc_id, text, start, n, greatest(length(regexp_extract(half, '(?s)^(.*)\\n\\n', 1)) + CASE WHEN contains(half, chr(10) || chr(10)) THEN 0 ELSE NULL END, length(regexp_extract(half, '(?s)^(.*)\\n', 1)) + CASE WHEN contains(half, chr(10)) THEN 0 ELSE NULL END,
              length(regexp_extract(half, '(?s)^(.*)\\. ', 1)) + CASE WHEN contains(half, '. ') THEN 0 ELSE NULL END, length(regexp_extract(half, '(?s)^(.*) ', 1)) + CASE WHEN contains(half, ' ') THEN 0 ELSE NULL END) AS brk
            FROM (SELECT doc_id, text, start, n, substr(text, start + 1201, 1200) AS half FROM w WHERE NOT done))))
    ) SELECT doc_id, CAST(n AS INT) AS chunk_index, piece AS text, sha256(piece) AS content_hash FROM w WHERE piece <> ''""",
)
def _(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.col("text").alias("body"))
    found = docs.lateralJoin(pytext.split_pieces(F.col("body").outer())).select("doc_id", "chunk_index", "text")
    return found.withColumn("content_hash", X.content_hash(F.col("text")))


@query(
    "exact_match",
    """WITH f AS (SELECT doc_id, trim(regexp_replace(lower(replace(text, 'ß', 'ss')), '\\s+', ' ', 'g')) AS form FROM documents), i AS (SELECT item_id, trim(regexp_replace(lower(replace(text, 'ß', 'ss')), '\\s+', ' ', 'g')) AS item FROM benchmark)
    SELECT item_id, doc_id FROM f JOIN i ON contains(form, item) WHERE item <> ''""",
)
def _(spark, d):
    items = read(spark, d, "benchmark").select(F.col("item_id").alias("id"), pytext.match_form_udf(F.col("text")).alias("needle"))
    forms = read(spark, d, "documents").select("doc_id", pytext.match_form_udf(F.col("text")).alias("form"))
    return duplicates.contained(forms, "doc_id", items).select(F.col("id").alias("item_id"), "doc_id")


NEAR_PAIRS = """f AS (SELECT doc_id, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS form FROM documents),
    r AS (SELECT min(doc_id) AS id, form, string_split(form, ' ') AS words FROM f WHERE form <> '' GROUP BY form),
    s AS (SELECT id, list_distinct(CASE WHEN len(words) < 5 THEN [form] ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS items FROM r),
    e AS (SELECT id, len(items) AS n, unnest(items) AS x FROM s),
    j AS (SELECT a.id AS one, b.id AS two FROM e a JOIN e b ON a.x = b.x AND a.id < b.id GROUP BY 1, 2 HAVING count(*) >= 0.88 * (any_value(a.n) + any_value(b.n) - count(*))),
    c AS (SELECT least(a.id, b.id) AS one, greatest(a.id, b.id) AS two FROM r a JOIN r b ON a.id <> b.id AND length(a.form) >= 120 AND length(b.form) >= length(a.form) AND contains(b.form, a.form))"""


@query("near_dup_pairs", f"WITH {NEAR_PAIRS} SELECT one, two FROM j UNION SELECT one, two FROM c")
def _(spark, d):
    return duplicates.near_pairs(evidence_forms(spark, d), "doc_id")


def evidence_forms(spark, d) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", pytext.evidence_form_udf(F.col("text")).alias("form"))


@query(
    "near_dup_kept",
    f"""WITH RECURSIVE {NEAR_PAIRS}, pairs AS MATERIALIZED (SELECT one, two FROM j UNION SELECT one, two FROM c), node AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS i FROM r),
    better AS MATERIALIZED (SELECT two AS id, list(one) AS ones FROM pairs GROUP BY two),
    walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS kept
      UNION ALL SELECT w.i + 1, CASE WHEN b.ones IS NOT NULL AND list_has_any(w.kept, b.ones) THEN w.kept ELSE list_append(w.kept, n.id) END FROM walk w JOIN node n ON n.i = w.i + 1 LEFT JOIN better b ON b.id = n.id)
    SELECT unnest(kept) AS doc_id FROM walk WHERE i = (SELECT max(i) FROM node)""",
)
def _(spark, d):
    """Which of the different texts a walk in the order of ids keeps, each that is nearly the same as none kept before."""
    return duplicates.near_kept(evidence_forms(spark, d), "doc_id")


# --- checks and evaluation ---


@query(
    "integrity_diff",
    """WITH s AS (SELECT doc_id, length(text) AS bytes, sha256(text) AS hash FROM documents WHERE doc_id % 7 <> 0), c AS (SELECT doc_id, length(text) AS bytes, sha256(CASE WHEN doc_id % 11 = 0 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 5 <> 0)
    SELECT coalesce(s.doc_id, c.doc_id) AS name, s.doc_id IS NOT NULL AS in_source, c.doc_id IS NOT NULL AS in_copy, coalesce(s.bytes = c.bytes AND s.hash = c.hash, false) AS equal FROM s FULL OUTER JOIN c ON s.doc_id = c.doc_id""",
)
def _(spark, d):
    from ..integrity import compare

    docs = read(spark, d, "documents")
    made = lambda text: docs.select(F.col("doc_id").alias("name"), F.char_length("text").alias("bytes"), F.sha2(text, 256).alias("hash"))
    changed = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return compare(made(F.col("text")).where("name % 7 <> 0"), made(changed).where("name % 5 <> 0"))


@query(
    "eval_recall_mrr",
    f"""WITH {NEAR}, r AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, vec_id) AS rank FROM s), c AS (SELECT label, min(rank) AS best FROM r GROUP BY label)
    SELECT round(avg(CASE WHEN best <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_at_5, round(avg(CASE WHEN best <= 10 THEN 1.0 ELSE 0 END), 6) AS recall_at_10, round(avg(1.0 / best), 6) AS mrr FROM c""",
)
def _(spark, d):
    from ..evaluation import summary

    e, v = probe(spark, d)
    scores = e.select("vec_id", "label", vectors.dot(F.col("embedding"), v).alias("similarity"))
    ranked = ordering.places(scores, "similarity", [F.desc("similarity"), F.col("vec_id")])
    return summary(ranked.groupBy("label").agg(F.min("place").alias("best_rank")))


@query("latency_percentile", "SELECT quantile_disc(value, 0.95) AS value FROM events")
def _(spark, d):
    return statistics.nearest_rank(read(spark, d, "events"), "value", 0.95)


# --- whole answers ---


@query("context_turns")
def _(spark, d):
    found = Archive.from_conversations(spark, read(spark, d, "conversations"), vectors.HashingEncoder()).ranked_turns("how has the thon changed over time", "light")
    return found.select("place", "conversation_id", "turn_index", "matched_role", "score", "chunk_ids")


#: A question of change, its searches written out (all terms, any, two by time, those of change), with their kinds' weights.
CHANGE = "how has thon ther erin changed over time"
CHANGE_SEARCHES = [([["thon"], ["ther"], ["erin"], ["changed"], ["over"], ["time"]], True), ([["thon"], ["ther"], ["erin"], ["changed"], ["over"], ["time"]], False), ([["thon"], ["ther"]], False), ([["thon"], ["ther"]], False), ([["thon"], ["ther"], ["erin"], ["changed"], ["evolved"]], False)]
CHANGE_WEIGHTS = [0.85, 0.55, 0.35, 0.35, 0.6]
TURN_RANK = "score DESC, CASE WHEN role = 'user' THEN 0 ELSE 1 END, create_time, conversation_id, turn_index, chunk_id"


@query(
    "context_ranks",
    f"""WITH {S.bm25(CHANGE_SEARCHES)}, weights(search, weight) AS (VALUES {", ".join(f"({i}, {w}::DOUBLE)" for i, w in enumerate(CHANGE_WEIGHTS))}),
    r AS (SELECT search, chunk_id, row_number() OVER (PARTITION BY search ORDER BY CASE search WHEN 2 THEN create_time WHEN 3 THEN -create_time ELSE round(bm25, 12) END, chunk_id) AS rank FROM ranked JOIN chunks USING (chunk_id)),
    v AS (SELECT chunk_id, weight * 61.0 / (60.0 + rank) AS value FROM r JOIN weights USING (search) WHERE rank <= 160),
    n AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY value DESC) AS n FROM v),
    l AS (SELECT chunk_id, least(1.0, max(value) FILTER (WHERE n = 1) + 0.12 * coalesce(sum(value) FILTER (WHERE n BETWEEN 2 AND 3), 0)) AS lexical FROM n GROUP BY chunk_id),
    cw AS (SELECT conversation_id, least(1.0, log2(1 + count(DISTINCT turn_index)) / 3.0) AS spread FROM l JOIN chunks USING (chunk_id) GROUP BY conversation_id),
    s AS (SELECT chunk_id, conversation_id, turn_index, role, create_time, round(least(1.0, round(lexical * 0.28, 8) + CASE WHEN role = 'user' THEN 0.12 ELSE 0 END + round(spread * 0.06, 8)), 8) AS score FROM l JOIN chunks USING (chunk_id) JOIN cw USING (conversation_id)),
    p AS (SELECT *, row_number() OVER (PARTITION BY conversation_id, turn_index ORDER BY {TURN_RANK}) AS p FROM s),
    t AS (SELECT conversation_id, turn_index, min(chunk_id) AS chunk_id, min_by(role, p) AS role, min_by(create_time, p) AS create_time,
      round(least(1.0, max(score) FILTER (WHERE p = 1) + round(least(0.08, 0.03 * coalesce(sum(score) FILTER (WHERE p BETWEEN 2 AND 5), 0)), 8)), 8) AS score, string_agg(chunk_id, ',' ORDER BY chunk_id) AS chunk_ids FROM p GROUP BY 1, 2),
    k AS (SELECT *, max(score) OVER () AS best FROM (SELECT * FROM t ORDER BY {TURN_RANK} LIMIT 80)),
    q AS (SELECT *, concat(year(make_timestamp(CAST(create_time * 1000000 AS BIGINT))), '-Q', quarter(make_timestamp(CAST(create_time * 1000000 AS BIGINT)))) AS period FROM k WHERE score >= greatest(0.25, 0.4 * best)),
    f AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY {TURN_RANK}) > 1 AS backfill FROM q)
    SELECT CAST(row_number() OVER (ORDER BY backfill, CASE WHEN NOT backfill THEN period END, {TURN_RANK}) AS INT) AS place, conversation_id, turn_index, role AS matched_role, round(score, 6) AS score, chunk_ids FROM f""",
)
def _(spark, d):
    """The turns for a question of change in their order, by words alone: searches, components, totals of turns, floor, quarters."""
    found = Archive.from_conversations(spark, read(spark, d, "conversations")).ranked_turns(CHANGE, "light")
    return found.select("place", "conversation_id", "turn_index", "matched_role", F.round("score", 6).alias("score"), F.array_join(F.transform("chunk_ids", lambda c: c.cast("string")), ",").alias("chunk_ids"))


@query(
    "active_path",
    """WITH RECURSIVE n AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN NULL WHEN turn % 4 = 2 THEN turn - 2 ELSE turn - 1 END AS par FROM conversations),
    leaf AS (SELECT conv_id, max(turn) AS leaf FROM n WHERE NOT EXISTS (SELECT 1 FROM n c WHERE c.conv_id = n.conv_id AND c.par = n.turn) GROUP BY conv_id),
    start AS (SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN leaf WHEN 1 THEN last ELSE last // 2 END AS turn FROM leaf JOIN (SELECT conv_id, max(turn) AS last FROM n GROUP BY conv_id) USING (conv_id)),
    walk AS (SELECT conv_id, turn, 0 AS up FROM start UNION ALL SELECT w.conv_id, n.par, up + 1 FROM walk w JOIN n ON n.conv_id = w.conv_id AND n.turn = w.turn WHERE n.par IS NOT NULL)
    SELECT conv_id, string_agg(turn, ',' ORDER BY up DESC) AS path FROM walk GROUP BY conv_id""",
)
def _(spark, d):
    t = F.col("turn")
    parent = F.when(t == 0, None).when(t % 4 == 2, t - 2).otherwise(t - 1).cast("string")
    nodes = F.array_sort(F.collect_list(F.struct("turn", t.cast("string").alias("k"), parent.alias("par"), (t * 60.0).alias("t"))))
    trees = read(spark, d, "conversations").groupBy("conv_id").agg(nodes.alias("nodes"), F.max("turn").alias("last"))
    current = F.when(F.col("conv_id") % 3 == 0, "missing").when(F.col("conv_id") % 3 == 1, F.col("last").cast("string")).otherwise(F.floor(F.col("last") / 2).cast("string"))
    path = exports.active_path(F.transform("nodes", lambda n: F.struct(n["k"].alias("k"), n["par"].alias("par"), n["t"].alias("t"))), current)
    return trees.select("conv_id", F.array_join(path, ",").alias("path"))


@query(
    "export_messages",
    """WITH RECURSIVE n AS (SELECT conv_id, turn, role, text, CASE WHEN turn = 0 THEN NULL WHEN turn % 4 = 2 THEN turn - 2 ELSE turn - 1 END AS par FROM conversations),
    walk AS (SELECT conv_id, max(turn) AS turn, 0 AS up FROM n GROUP BY conv_id UNION ALL SELECT w.conv_id, n.par, up + 1 FROM walk w JOIN n ON n.conv_id = w.conv_id AND n.turn = w.turn WHERE n.par IS NOT NULL),
    p AS (SELECT conv_id, turn, max(up) OVER (PARTITION BY conv_id) - up AS pos FROM walk)
    SELECT CAST(n.conv_id AS VARCHAR) AS conversation_id, CASE WHEN n.turn % 6 = 5 THEN concat('k', n.turn) ELSE concat(n.conv_id, ':', n.turn) END AS message_id, concat('k', n.turn) AS node_id, 'k' || par AS parent_id,
      CAST(pos AS INT) AS active_position, pos IS NOT NULL AS is_active, role, CASE WHEN n.turn % 7 = 3 THEN NULL ELSE CAST(1000 + n.turn AS DOUBLE) END AS create_time,
      concat(trim(text, ' ' || chr(10)), CASE WHEN n.turn % 9 = 4 THEN chr(10) || chr(10) || 'and more' ELSE '' END) AS text FROM n LEFT JOIN p ON p.conv_id = n.conv_id AND p.turn = n.turn""",
)
def _(spark, d):
    """An export made from the conversations, as trees with branches, and read like any other."""
    t, json = F.col("turn"), F.to_json
    parent = F.when(t == 0, None).when(t % 4 == 2, t - 2).otherwise(t - 1)
    parts = F.when(t % 9 == 4, F.array("text", F.lit("and more"))).otherwise(F.array("text"))
    content = F.struct(F.lit("text").alias("content_type"), F.lit("file").alias("asset_pointer"), parts.alias("parts"))
    message = F.struct(
        F.when(t % 6 == 5, "").otherwise(F.concat("conv_id", F.lit(":"), "turn")).alias("id"), F.struct(F.when(t % 5 == 0, F.upper("role")).otherwise(F.col("role")).alias("role")).alias("author"),
        F.when(t % 7 == 3, "NaN").otherwise((t + 1000).cast("string")).alias("create_time"), content.alias("content"),
    )
    node = json(F.struct(F.concat(F.lit("k"), "turn").alias("id"), F.concat(F.lit("k"), parent.cast("string")).alias("parent"), message.alias("message")))
    entries = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("k"), "turn").alias("k"), node.alias("v"))))
    trees = read(spark, d, "conversations").groupBy("conv_id").agg(entries.alias("e"), F.max("turn").alias("last"))
    raw = trees.select(
        F.col("conv_id").cast("string").alias("conversation_id"), F.lit("").alias("id"), F.lit("").alias("title"), F.lit("1").alias("create_time"), F.lit("2").alias("update_time"), F.concat(F.lit("k"), "last").alias("current_node"),
        F.lit(None).cast("string").alias("default_model_slug"), F.lit("false").alias("is_archived"), F.lit("true").alias("is_starred"), F.map_from_entries(F.transform("e", lambda x: F.struct(x["k"], x["v"]))).alias("mapping"),
        F.lit("made").alias("source_file"), F.lit(0).alias("position"),
    )
    return exports.conversations_and_messages(raw)[1].select("conversation_id", "message_id", "node_id", "parent_id", "active_position", "is_active", "role", "create_time", "text")


@query("context_packet")
def _(spark, d):
    """The whole answer to a question as one row for each episode, with the packet's limits and trace."""
    packet = Archive.from_conversations(spark, read(spark, d, "conversations"), vectors.HashingEncoder()).context(QUESTION, "light")
    rows = [
        (e["rank"], e["conversation_id"], e["turn_index"], e["matched_role"], e["score"]["total"], len(e["context"]), len(e["signals"]), e["primary_evidence"]["text"], packet["limits"]["serialized_characters"], packet["trace"]["candidate_counts"]["turns"])
        for e in packet["episodes"]
    ]
    return X.local(spark, rows, "rank int, conversation_id string, turn_index int, matched_role string, score double, contexts int, signals int, text string, characters int, turns long")


__all__ = ["ORACLE_SQL", "QUERIES", "archive_tables", "flagship"]
