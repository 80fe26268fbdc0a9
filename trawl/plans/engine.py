"""The engine: build an archive, search it, answer with context packets."""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterable, Mapping
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import intent as I
from ..functions import lexicon as L
from ..functions import text as X
from ..functions.pytext import match_form_udf
from ..operators import blocks, fetch, fusion, inverted, ordering, packets, scoring, sessions, vectors
from ..scratch import released, written
from ..sources import exports, store


def day_start(day: str | None) -> float | None:
    return None if day is None else datetime.combine(date.fromisoformat(day), datetime.min.time(), UTC).timestamp()


def day_end(day: str | None) -> float | None:
    return None if day is None else day_start((date.fromisoformat(day) + timedelta(days=1)).isoformat())


def archive_parts(conversations: DataFrame, messages: DataFrame, encoder: vectors.Encoder | None = None, chunk_chars: int = L.CHUNK_CHARS, chunk_overlap: int = L.CHUNK_OVERLAP, **embedding) -> dict:
    """Tables by name, each as a function of those before it, so that a stored table can serve what is made from it; in the order in which look-ups want them."""

    def chunks(t: dict) -> DataFrame:
        rows = inverted.with_tokens(sessions.chunks(t["conversations"], t["messages"], chunk_chars, chunk_overlap))
        return fetch.in_id_order(rows.withColumn("match_form", match_form_udf(F.concat("title", F.lit("\n"), "text"))))

    parts = {
        "conversations": lambda t: conversations,
        "messages": lambda t: messages,
        "turns": lambda t: sessions.turns(t["messages"]).sortWithinPartitions("conversation_id", "turn_index"),
        "chunks": chunks,
        "corpus_stats": lambda t: inverted.corpus_stats(t["chunks"]),
        "postings": lambda t: inverted.laid_out(inverted.postings(t["chunks"], t["corpus_stats"])),
        "positions": lambda t: inverted.positions(t["chunks"]).repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id"),
        "blocks": lambda t: blocks.blocks(t["postings"], t["corpus_stats"]).repartitionByRange("term").sortWithinPartitions("term"),
    }
    if encoder is not None:
        parts["vectors"] = lambda t: vectors.embed(t["chunks"], encoder, **embedding)
    return parts


#: What answers read again and again, and what is made from messages at some cost.
KEPT = ("turns", "chunks", "postings", "positions", "blocks", "corpus_stats", "vectors")


class Made(Mapping):
    """Tables by name that are made when first asked for; chunks and index, which all answers read, are written to scratch space then."""

    def __init__(self, parts: dict):
        self._parts, self._made = parts, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            table = self._parts[name](self)
            self._made[name] = written(table, name) if name in KEPT else table
        return self._made[name]

    def __iter__(self):
        return iter(self._parts)

    def __len__(self) -> int:
        return len(self._parts)

    def released(self) -> None:
        for table in self._made.values():
            released(table)
        self._made = {}


def archive_tables(conversations: DataFrame, messages: DataFrame, encoder: vectors.Encoder | None = None, **options) -> Made:
    return Made(archive_parts(conversations, messages, encoder, **options))


class Archive:
    """A built archive: tables by name, and the encoder its vectors were made with, if it has any."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame], encoder: vectors.Encoder | None = None):
        self.spark, self.tables = spark, tables
        self.encoder = encoder if "vectors" in tables else None

    @classmethod
    def build(cls, spark: SparkSession, folder: str, root: str, encoder: vectors.Encoder | None = None, **options) -> Archive:
        """Read an export folder and store its tables in root, vectors too if there is an encoder."""
        conversations, messages = exports.conversations_and_messages(exports.read_exports(spark, folder))
        store.save(spark, root, archive_parts(conversations, messages, encoder, **options), store.about(encoder))
        return cls.open(spark, root, encoder)

    @classmethod
    def open(cls, spark: SparkSession, root: str, encoder: vectors.Encoder | None = None, whole: bool = False) -> Archive:
        """whole: check every row of what is stored, as validation does, not only its size."""
        return cls(spark, store.load(spark, root, encoder, whole), encoder)

    @classmethod
    def from_conversations(cls, spark: SparkSession, rows: DataFrame, encoder: vectors.Encoder | None = None) -> Archive:
        """An archive in scratch space, from flat rows (conv_id, turn, role, text); a table is made when it is first needed."""
        return cls(spark, archive_tables(*exports.from_flat(rows), encoder), encoder)

    def cached(self) -> Archive:
        """Keep what searches read in memory."""
        return Archive(self.spark, {n: (t.cache() if n in KEPT else t) for n, t in self.tables.items()}, self.encoder)

    def released(self) -> None:
        """Let go of what is kept in memory or scratch space."""
        if isinstance(self.tables, Made):
            self.tables.released()
        else:
            for name in KEPT:
                if name in self.tables:
                    self.tables[name].unpersist()

    @property
    def semantic_ready(self) -> bool:
        return self.encoder is not None

    @functools.cached_property
    def size(self) -> tuple[int, float]:
        """(chunks, their average length)."""
        row = self.tables["corpus_stats"].first()
        return row["n"], row["avgdl"] or 0.0

    def _tokens(self, phrases: list[list[str]]) -> list[list[list[str]]]:
        """Search tokens of phrases, by the same expression that made the index."""
        flat = sorted({p for each in phrases for p in each})
        # an inline table: the expression is worked out while the plan is made, without a job
        rows = self.spark.sql(f"SELECT p FROM VALUES {', '.join(['(?)'] * len(flat))} AS t(p)", args=flat).select("p", X.tokens(F.col("p")).alias("t")).collect() if flat else []
        found = {r["p"]: list(r["t"]) for r in rows}
        return [[found[p] for p in each] for each in phrases]

    def _ranked(self, searches: list[tuple[list[str], bool]], condition, most: int, temporal: dict[int, str] | None = None) -> list:
        """(search, chunk_id, FILTERS, rank) of the first `most` chunks of each search that meet the condition on FILTERS.  No chunk is scanned for it.

        Searches for any of some tokens read the blocks that can matter; those for phrases, for all tokens, or by time, the postings of their tokens.
        """
        tokens, temporal = self._tokens([p for p, _ in searches]), temporal or {}
        known = blocks.held(self.tables["blocks"], sorted({x for each in tokens for p in each for x in p}))
        some = {s: [p[0] for p in each if p] for s, (each, (_, needs_all)) in enumerate(zip(tokens, searches, strict=True)) if s not in temporal and (not needs_all or len(each) == 1) and all(len(p) <= 1 for p in each)}
        chunks, terms = self.tables["chunks"], self.tables["postings"]
        rows = [(r["search"], round(r["bm25"], 12), r["chunk_id"], r) for r in blocks.best(chunks, terms, self.size, some, known, most, condition)]
        rest = [s for s in range(len(searches)) if s not in some]
        if rest:
            counts = {t: sum(b.n for b in held) for t, held in known.items()}
            hits = inverted.bm25(chunks, terms, self.tables["corpus_stats"], [(tokens[s], searches[s][1]) for s in rest], self.tables["positions"], counts).where(condition)
            time, key = F.col("create_time"), F.round("bm25", 12)
            for number, s in enumerate(rest):
                if s in temporal:
                    by_time = time if temporal[s] == "temporal_earliest" else -time
                    key = F.when(F.col("search") == number, F.coalesce(by_time, F.lit(float("inf")))).otherwise(key)
            top = inverted.top_ranks(hits.withColumn("key", key), most, [F.col("key").asc(), F.col("chunk_id").asc()])
            rows += [(rest[r["search"]], r["key"], r["chunk_id"], r) for r in top.collect()]  # `most` of each search
        places: Counter = Counter()
        out = []
        for s, _, _, r in sorted(rows, key=lambda x: x[:3]):
            places[s] += 1
            out.append((s, r["chunk_id"], *(r[c] for c in inverted.FILTERS), places[s]))
        return out

    def _with_texts(self, found: DataFrame, ids: Iterable[int], *more: str) -> DataFrame:
        """found, a bounded number of rows whose ids are known, with the columns of its chunks: looked up by the ids."""
        rows = self.tables["chunks"].where(fetch.near("chunk_id", ids)).select(F.col("chunk_id").alias("id"), "conversation_id", "turn_index", "message_id", "role", "title", "create_time", "text", *more)
        return rows.join(F.broadcast(found), F.col("id") == F.col("chunk_id")).drop("id")

    def _lexical(self, query: str, most: int, condition=None) -> DataFrame:
        """(chunk_id, score, lexical_rank, role) from the searches of a query, held by the plan."""
        searches = I.weighted_searches(query)
        ranked = self._ranked([(p, a) for p, a, _ in searches], F.lit(True) if condition is None else condition, most)
        rows = self.spark.createDataFrame([(r[0], r[1], r[2], r[-1]) for r in ranked], "search int, chunk_id long, role string, rank int")
        return fusion.fuse_searches(rows, [w for _, _, w in searches])

    def lexical(self, query: str, most: int, condition=None) -> DataFrame:
        rows = self._lexical(query, most, condition).collect()  # `most` for each of at most ten searches
        found = self.spark.createDataFrame(rows, "chunk_id long, score double, lexical_rank int")
        return self._with_texts(found, [r["chunk_id"] for r in rows])

    def semantic(self, query: str, most: int, condition=None) -> DataFrame:
        """(chunk_id, FILTERS, similarity, rank); the condition is on FILTERS."""
        return vectors.nearest_filtered(self.tables["vectors"], vectors.query_vector(self.encoder, query), most, F.lit(True) if condition is None else condition, "chunk_id", *inverted.FILTERS)

    def search(
        self, query: str, limit: int = 12, candidates: int = 250, date_from: str | None = None, date_to: str | None = None, conversation_id: str | None = None,
        timeline: bool = False, order: str = "auto", lexical_only: bool = False, semantic_only: bool = False,
        weights: tuple[float, float] | None = None,
    ) -> DataFrame:
        """The best turns for a query: place, score and the best hit's columns.  weights: of lexical and similar hits."""
        most = max(candidates, 10 * limit)
        last = day_end(date_to)
        condition = sessions.dated_inclusive(F.col("create_time"), day_start(date_from), None if last is None else last - 1)
        if conversation_id:
            condition = condition & (F.col("conversation_id") == conversation_id)
        hits = None if semantic_only else self.lexical(query, most, condition)
        if self.semantic_ready and not lexical_only:
            near = self.semantic(query, most, condition)
            if hits is None:
                ranked = near.limit(0).select("chunk_id", "role", "rank")
            else:
                # the list is bounded by the searches' limits
                ranked = hits.select("chunk_id", "role", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")).alias("rank"))
            weights = weights or ((0.9, 1.4) if timeline else (1.6, 1.0))
            fused = fusion.fuse_lists(ranked, near, *weights).collect()
            found = self.spark.createDataFrame(fused, "chunk_id long, score double, lexical_rank int, semantic_rank int")
            hits = self._with_texts(found, [r["chunk_id"] for r in fused])
        if hits is None:
            hits = self._with_texts(self.spark.createDataFrame([], "chunk_id long, score double"), [])
        by_score = [F.desc("score"), F.col("chunk_id").asc()]
        grouped = fusion.hits_to_turns(hits).orderBy(*by_score).limit(max(25 * limit, 250))
        order = I.search_order(query) if order == "auto" else order
        if timeline:
            chosen = fusion.round_robin(grouped, X.quarter(F.col("create_time")), by_score, limit)
            return chosen.withColumn("place", F.row_number().over(Window.orderBy("turn", "bucket"))).drop("turn", "bucket")
        if order in ("earliest", "latest"):
            keys = [F.col("create_time").asc() if order == "earliest" else F.desc("create_time"), *by_score]
            grouped = grouped.where("create_time is not null")
        else:
            keys = by_score
        return grouped.orderBy(*keys).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*keys)))

    def candidates(self, query: str, searches: list[I.Variant], depth: L.Depth, start: float | None, end: float | None) -> tuple[DataFrame, DataFrame, dict]:
        """(chunks found by any search or by similarity, with their matches and their turn; the turns around them; counts).  Both are looked up by their keys and bounded by the searches' limits."""
        dated = sessions.dated_half_open(F.col("create_time"), start, end)
        lexical = [(v, *I.search_terms(v)) for v in searches if v.kind != "semantic_original"]
        lexical = [(v, p, a) for v, p, a in lexical if p]
        times = {i: v.kind for i, (v, _, _) in enumerate(lexical) if v.kind.startswith("temporal_")}
        found: dict[int, list] = {}
        turns: set[tuple[str, int]] = set()
        for s, chunk, _, _, conversation, turn, rank in self._ranked([(p, a) for _, p, a in lexical], dated, depth.candidates, times):
            found.setdefault(chunk, [chunk, [], None, None])[1].append((s, lexical[s][0].kind, lexical[s][0].weight, rank))
            turns.add((conversation, turn))
        if self.semantic_ready:
            near = vectors.nearest(self.tables["vectors"], vectors.query_vector(self.encoder, query), depth.candidates, "chunk_id", *inverted.FILTERS)
            for r in near.collect():
                t = r["create_time"]
                if (start is not None or end is not None) and (t is None or (start is not None and t < start) or (end is not None and t >= end)):
                    continue
                found.setdefault(r["chunk_id"], [r["chunk_id"], [], None, None])[2:] = [r["similarity"], r["rank"]]
                turns.add((r["conversation_id"], r["turn_index"]))
        kinds = "chunk_id long, matches array<struct<search:int,kind:string,weight:double,rank:int>>, similarity double, semantic_rank int"
        rows = self._with_texts(self.spark.createDataFrame(list(found.values()), kinds), found, "match_form")
        wanted = self.spark.createDataFrame(sorted({(c, t + d) for c, t in turns for d in (-1, 0, 1)}), "wc string, wt int")
        near = self.tables["turns"].where(fetch.near("conversation_id", {c for c, _ in turns}))
        near = near.join(F.broadcast(wanted), (F.col("conversation_id") == F.col("wc")) & (F.col("turn_index") == F.col("wt"))).drop("wc", "wt")
        # from here on everything is bounded by the searches' limits: in one partition nothing is shuffled any more, and the look-ups before stay parallel
        near = packets.around(near.repartition(1))
        own = F.col("own")
        said = rows.repartition(1).join(F.broadcast(near), (F.col("conversation_id") == F.col("ac")) & (F.col("turn_index") == F.col("at")))
        said = said.select(*rows.columns, *(own[c].alias(c) for c in ("user_text", "assistant_text", "acceptance", "previous_acceptance")))
        counts = {"lexical_rows": sum(len(f[1]) for f in found.values()), "semantic_rows": sum(f[3] is not None for f in found.values()), "unique_chunks": len(found)}
        return said, near, counts

    def ranked_turns(self, query: str, depth: str = "medium", date_from: str | None = None, date_to: str | None = None) -> DataFrame:
        """Turns for a question in the order of its mode, `place` from 1."""
        intent, size = I.interpret(query), L.DEPTHS[depth]
        found, _, _ = self.candidates(query, I.variants(query, intent), size, day_start(date_from), day_end(date_to))
        totals = scoring.turn_totals(scoring.score_candidates(found, query, intent), size.turns)
        return ordering.temporal_order(totals, intent.primary_mode)

    def context(self, query: str, depth: str = "medium", date_from: str | None = None, date_to: str | None = None) -> dict:
        """The packet for a question: episodes with their evidence, within the depth's limits."""
        if depth not in L.DEPTHS:
            raise ValueError("depth must be light, medium or deep")
        if not query or not query.strip():
            raise ValueError("the query is blank")
        start, end = day_start(date_from), day_end(date_to)
        if start is not None and end is not None and start >= end:
            raise ValueError("date_from is after date_to")
        size, intent = L.DEPTHS[depth], I.interpret(query)
        searches = I.variants(query, intent)
        found, near, counts = self.candidates(query, searches, size, start, end)
        ranked = ordering.temporal_order(scoring.turn_totals(scoring.score_candidates(found, query, intent), size.turns), intent.primary_mode)
        ranked = ranked.withColumn("turns", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))  # of at most size.turns rows
        pool = ranked.where(F.col("place") <= 4 * size.episodes)
        rows = sorted(packets.episodes(pool, near, intent, size.seeds, "turns").collect(), key=lambda r: r["place"])  # at most 60
        n_turns = rows[0]["turns"] if rows else 0
        built = [packets.as_episode(r, intent) for r in rows]
        chosen, removed = packets.select(built, size, intent)
        trace = {
            "candidate_counts": {**counts, "turns": n_turns, "episode_pool": len(built)},
            **removed,
        }
        return packets.pack(intent, packets.told_searches(searches), chosen, size, trace)

    def open_context(self, conversation_id: str, turn: int, before: int = 2, after: int = 2) -> DataFrame:
        seed = self.spark.createDataFrame([(conversation_id, turn)], "conversation_id string, turn_index int")
        own = self.tables["turns"].where((F.col("conversation_id") == conversation_id) & F.col("turn_index").between(turn - before, turn + after))
        return sessions.turn_window(own, seed, before, after).orderBy("turn_index")

    def stats(self) -> DataFrame:
        from ..operators.statistics import archive_stats

        return archive_stats(self.tables)
