"""The inverted index and ranking by BM25 with weights for title and text.

Statistics are those of the whole corpus whatever a search filters.  The index
is two tables: postings (a row for each term of a chunk, with how much it can
add to a score) and positions (a row for each token).  A phrase is a run of
tokens: one of a single token is read off the postings, a longer one is an
equi-join of its tokens' positions.  No chunk is read to rank.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.text import local

TITLE_WEIGHT, TEXT_WEIGHT = 2.0, 5.0
K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
#: Steps of the share of a score that is possible at all; postings of a term and a level are a block.
LEVELS = 256
#: What searches filter and sort by, and where a hit stands: kept with postings and vectors.
FILTERS = ("role", "create_time", "conversation_id", "turn_index")
#: Positions of a token that are sent to all tasks that hold the phrase's other tokens, at most.
SENT_POSITIONS = 100_000


def with_tokens(chunks: DataFrame) -> DataFrame:
    rows = chunks.withColumn("title_tokens", X.tokens(F.col("title"))).withColumn("text_tokens", X.tokens(F.col("text")))
    return rows.withColumn("doc_len", F.size("title_tokens") + F.size("text_tokens"))


def kept(table: DataFrame) -> list[str]:
    return [c for c in FILTERS if c in table.columns]


def _each_token(tokenized: DataFrame, *more: str, only: DataFrame | None = None) -> DataFrame:
    """(chunk_id, more, term, in_title, at): a row for each token, or for those that `only` (wanted) holds."""
    rows = tokenized.select("chunk_id", *more, F.size("title_tokens").alias("titled"), F.posexplode(F.concat("title_tokens", "text_tokens")).alias("at", "term"))
    if only is not None:
        rows = rows.join(only, F.col("term") == F.col("wanted"), "left_semi")
    in_title = F.col("at") < F.col("titled")
    return rows.select("chunk_id", *more, "term", in_title.alias("in_title"), F.when(in_title, F.col("at")).otherwise(F.col("at") - F.col("titled")).alias("at"))


def corpus_stats(tokenized: DataFrame) -> DataFrame:
    return tokenized.agg(F.count(F.lit(1)).alias("n"), F.avg("doc_len").alias("avgdl"))


def share(tf_title: Column, tf_text: Column, doc_len: Column, avgdl: Column) -> Column:
    """A term's part of a score before its weight: from 0 up to but not including K1 + 1."""
    f = TITLE_WEIGHT * tf_title + TEXT_WEIGHT * tf_text
    return f * (K1 + 1) / (f + K1 * (1 - B + B * doc_len / avgdl))


def postings(tokenized: DataFrame, stats: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """(term, chunk_id, tf_title, tf_text, doc_len, level, and FILTERS), to be written as laid_out does, so that a look-up reads few row groups and nothing else.

    only: (wanted), a row for each term whose postings are made; all terms' without it.
    """
    more = ["doc_len", *kept(tokenized)]
    rows = _each_token(tokenized, *more, only=only).groupBy("term", "chunk_id", *more)
    counts = rows.agg(F.sum(F.col("in_title").cast("int")).cast("int").alias("tf_title"), F.sum((~F.col("in_title")).cast("int")).cast("int").alias("tf_text"))
    average = (corpus_stats(tokenized) if stats is None else stats).select("avgdl")
    level = F.floor(share(F.col("tf_title"), F.col("tf_text"), F.col("doc_len"), F.col("avgdl")) / (K1 + 1) * LEVELS).cast("int")
    return counts.join(F.broadcast(average)).withColumn("level", F.least(level, F.lit(LEVELS - 1))).drop("avgdl")




def laid_out(terms: DataFrame) -> DataFrame:
    """Postings in the order they are written in: blocks of a term from the most they can add downwards; a frequent term spreads over files."""
    order = [F.col("term").asc(), F.desc("level"), F.col("chunk_id").asc()]
    return terms.repartitionByRange(*order).sortWithinPartitions(*order)


def positions(tokenized: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(term, chunk_id, in_title, at): a row for each token; only: as for postings."""
    return _each_token(tokenized, only=only).select("term", "chunk_id", "in_title", "at")


def runs(at: DataFrame, phrase: list[str], counts: dict[str, int] | None = None) -> DataFrame:
    """(chunk_id, in_title, start) where the tokens of a phrase stand one after another: an equi-join for each token, the rarest first where counts are known."""
    counts = counts or {}
    order = sorted(range(len(phrase)), key=lambda i: (counts.get(phrase[i], 1 << 62), i))
    found = None
    for i in order:
        own = at.where(F.col("term") == phrase[i]).select("chunk_id", "in_title", (F.col("at") - i).alias("start"))
        if found is None:
            found = F.broadcast(own) if counts.get(phrase[i], 1 << 62) <= SENT_POSITIONS else own
        else:
            found = own.join(found, ["chunk_id", "in_title", "start"])
    return found


def phrase_hits(at: DataFrame, terms: DataFrame, phrases: list[list[str]], counts: dict[str, int] | None = None) -> DataFrame:
    """(phrase, chunk_id, tf_title, tf_text, doc_len, and FILTERS): where each phrase (numbered) occurs."""
    more = ["doc_len", *kept(terms)]
    found = []
    single = {p[0]: i for i, p in enumerate(phrases) if len(p) == 1}
    if single:
        number = F.create_map(*(x for t, i in single.items() for x in (F.lit(t), F.lit(i))))
        found.append(terms.where(F.col("term").isin(list(single))).select(F.element_at(number, F.col("term")).alias("phrase"), "chunk_id", "tf_title", "tf_text", *more))
    for i, p in enumerate(phrases):
        if len(p) > 1:
            stands = runs(at, p, counts).groupBy(F.col("chunk_id").alias("h")).agg(F.count_if("in_title").cast("int").alias("in_title"), F.count_if(~F.col("in_title")).cast("int").alias("in_text"))
            rarest = min(p, key=lambda t: (counts or {}).get(t, 1 << 62))
            rows = terms.where(F.col("term") == rarest).join(stands, F.col("chunk_id") == F.col("h"))
            found.append(rows.select(F.lit(i).alias("phrase"), "chunk_id", F.col("in_title").alias("tf_title"), F.col("in_text").alias("tf_text"), *more))
    if not found:
        return terms.limit(0).select(F.lit(0).alias("phrase"), "chunk_id", "tf_title", "tf_text", *more)
    return functools.reduce(DataFrame.unionByName, found)


def idf(n_docs: Column, with_phrase: Column) -> Column:
    value = F.log((n_docs - with_phrase + 0.5) / (with_phrase + 0.5))
    return F.when(value <= 0, LEAST_IDF).otherwise(value)


def bm25(tokenized: DataFrame, terms: DataFrame, stats: DataFrame, searches: list[tuple[list[list[str]], bool]], at: DataFrame | None = None, counts: dict[str, int] | None = None) -> DataFrame:
    """(search, chunk_id, FILTERS, bm25) of every hit of numbered searches (phrases, whether all are needed); the best have the least bm25.

    at: positions, if they are stored; counts: of the postings of terms, where known.
    """
    spark = tokenized.sparkSession
    numbers: dict[tuple[str, ...], int] = {}
    wanted = []
    for s, (phrases, needs_all) in enumerate(searches):
        real = [tuple(p) for p in phrases if p]
        if needs_all and len(real) < len(phrases):  # a phrase without a token is nowhere
            continue
        each = list(dict.fromkeys(real))
        for p in each:
            wanted.append((s, numbers.setdefault(p, len(numbers)), len(each) if needs_all else 1, real.count(p)))
    more = kept(terms)
    hits = phrase_hits(positions(tokenized) if at is None else at, terms, [list(p) for p in numbers], counts)
    if not wanted:
        return hits.select(F.col("phrase").alias("search"), "chunk_id", *more, F.lit(0.0).alias("bm25"))
    of_search = local(spark, wanted, "search int, p int, least int, times int")
    totals = hits.groupBy("phrase").agg(F.count(F.lit(1)).alias("n_p"))
    weights = totals.join(F.broadcast(stats)).select(F.col("phrase").alias("w"), idf(F.col("n"), F.col("n_p")).alias("idf"), "avgdl")
    scored = hits.join(F.broadcast(weights), F.col("phrase") == F.col("w"))
    part = F.col("idf") * share(F.col("tf_title"), F.col("tf_text"), F.col("doc_len"), F.col("avgdl"))
    joined = scored.select("phrase", "chunk_id", *more, part.alias("part")).join(F.broadcast(of_search), F.col("phrase") == F.col("p"))
    out = joined.groupBy("search", "chunk_id", *more).agg((-F.sum(F.col("part") * F.col("times"))).alias("bm25"), F.count(F.lit(1)).alias("k"), F.max("least").alias("least"))
    return out.where("k >= least").select("search", "chunk_id", *more, "bm25")


def top_ranks(hits: DataFrame, most: int, order: list[Column], by: str = "search") -> DataFrame:
    """The first `most` of each search with their ranks from 1."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= most)


def prefix_match(terms: DataFrame, prefix: str) -> DataFrame:
    """Chunks with a token that begins with prefix: an operation of its own, no search uses it."""
    return terms.where(F.col("term").startswith(prefix)).select("chunk_id").distinct()
