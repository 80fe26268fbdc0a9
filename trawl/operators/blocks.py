"""The best hits of searches for any of some terms, without scoring every hit.

Postings of a term that add about as much to a score are a block; a small table
tells how many each block holds and the most that one of them adds.  From that
table alone a floor is known that at least k chunks reach, and for each term the
blocks that can be left unread: together they add less than the floor, so a
chunk that stands in unread blocks only is not among the best.  What is read
gives each chunk a least and a greatest score; the few whose greatest score
reaches the k-th least one are looked up by their ids and scored whole.

A filter may let too few chunks reach the floor: then the floor is lowered and
more blocks are read, all of them in the end.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import local
from . import fetch, inverted

#: With fewer postings than this, all are read: it is less work than a look-up.
FEW_POSTINGS = 20_000
#: Part of the floor that the unread blocks of searches for several terms may add: the less, the fewer chunks are looked up.
UNREAD_PART = 0.5
#: Chunks that are looked up by their ids, at most; more are joined.
LOOKED_UP = 4000
#: How much lower the next floor is, by the number of chunks that reach it.
STEP = 8


@dataclass(frozen=True)
class Block:
    level: int
    n: int
    least: float
    most: float


@dataclass(frozen=True)
class Cuts:
    """Of one search: from which level each term's blocks are read, the floor, and what each term's unread blocks add at most."""

    levels: dict[str, int]
    floor: float
    unread: dict[str, float]

    @property
    def whole(self) -> bool:
        return not any(self.unread.values())


def blocks(terms: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, level, n, least, most) from postings."""
    rows = terms.join(F.broadcast(stats.select("avgdl"))).select("term", "level", inverted.share(F.col("tf_title"), F.col("tf_text"), F.col("doc_len"), F.col("avgdl")).alias("s"))
    return rows.groupBy("term", "level").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("least"), F.max("s").alias("most"))


def held(table: DataFrame, terms: list[str]) -> dict[str, list[Block]]:
    """Blocks of terms from the highest level down: at most LEVELS for each."""
    found: dict[str, list[Block]] = {t: [] for t in terms}
    if terms:
        for r in table.where(F.col("term").isin(terms)).collect():
            found[r["term"]].append(Block(r["level"], r["n"], r["least"], r["most"]))
    return {t: sorted(b, key=lambda x: -x.level) for t, b in found.items()}


def idf(n_docs: int, with_term: int) -> float:
    value = math.log((n_docs - with_term + 0.5) / (with_term + 0.5))
    return value if value > 0 else inverted.LEAST_IDF


def cuts(weights: dict[str, float], found: dict[str, list[Block]], k: int, few: int = FEW_POSTINGS, part: float = UNREAD_PART) -> Cuts:
    """Which blocks a search for the k best must read; all of them, where they hold no more than `few` postings."""
    number = {t: sum(b.n for b in found[t]) for t in weights}
    nothing = Cuts(dict.fromkeys(weights, 0), 0.0, dict.fromkeys(weights, 0.0))
    if sum(number.values()) <= few:
        return nothing
    floor = 0.0
    for t, w in weights.items():
        so_far = 0
        for b in found[t]:
            so_far += b.n
            if so_far >= k:
                floor = max(floor, w * b.least)
                break
    if not floor:
        return nothing
    left = floor * (1 - 1e-9) * (1.0 if len(weights) == 1 else part)
    levels, unread = {}, {}
    for t in sorted(weights, key=lambda t: (-number[t], t)):  # common terms weigh little: they are left unread first
        levels[t], unread[t] = 0, 0.0
        for b in reversed(found[t]):
            if weights[t] * b.most >= left:
                break
            levels[t], unread[t] = b.level + 1, weights[t] * b.most
        left -= unread[t]
    return Cuts(levels, floor, unread)


def best(
    chunks: DataFrame, terms: DataFrame, stats: tuple[int, float], searches: dict[int, list[str]], found: dict[str, list[Block]], k: int, condition: Column | None = None,
    few: int = FEW_POSTINGS, seen: Callable[[dict[int, Cuts], int], None] | None = None,
) -> list:
    """(search, chunk_id, FILTERS, bm25) of the k best chunks of each search for any of its terms, in no order.

    stats: number of chunks, average length; found: the terms' blocks; condition: on FILTERS; seen: is told what each round reads.
    """
    n_docs, avgdl = stats
    weights = {s: {t: each.count(t) * idf(n_docs, sum(b.n for b in found[t])) for t in each if found[t]} for s, each in searches.items()}
    weights = {s: w for s, w in weights.items() if w}
    out, target = [], k
    while weights:
        planned = {s: cuts(w, found, target, few) for s, w in weights.items()}
        if seen:
            seen(planned, target)
        rows = _scored(chunks, terms, avgdl, weights, planned, k, condition)
        for s in list(weights):
            own = [r for r in rows if r["search"] == s]
            reached = sum(-r["bm25"] >= planned[s].floor * (1 - 1e-9) for r in own)
            if planned[s].whole or reached >= k:
                out += sorted(own, key=lambda r: (round(r["bm25"], 12), r["chunk_id"]))[:k]
                del weights[s]
        target *= STEP
    return out


def _scored(chunks: DataFrame, terms: DataFrame, avgdl: float, weights: dict[int, dict[str, float]], planned: dict[int, Cuts], k: int, condition: Column | None) -> list:
    """Whole scores of the chunks that can be among the k best, by what is read."""
    spark, more = terms.sparkSession, inverted.kept(terms)
    lowest: dict[str, int] = {}
    for c in planned.values():
        for t, level in c.levels.items():
            lowest[t] = min(level, lowest.get(t, inverted.LEVELS))
    wanted = F.lit(False)
    for t, level in lowest.items():
        wanted = wanted | ((F.col("term") == t) & (F.col("level") >= level))
    table = local(spark, [(s, t, w, planned[s].levels[t], planned[s].unread[t]) for s, each in weights.items() for t, w in each.items()], "search int, t string, w double, cut int, unread double")
    rest = F.element_at(F.create_map(*(x for s, c in planned.items() for x in (F.lit(s), F.lit(float(sum(c.unread.values())))))), F.col("search"))
    rows = terms.where(wanted) if condition is None else terms.where(wanted).where(condition)
    joined = rows.join(F.broadcast(table), (F.col("term") == F.col("t")) & (F.col("level") >= F.col("cut")))
    part = inverted.share(F.col("tf_title"), F.col("tf_text"), F.col("doc_len"), F.lit(avgdl))
    scored = joined.groupBy("search", "chunk_id", *more).agg(F.sum(F.col("w") * part).alias("low"), F.sum("unread").alias("known"))
    whole = all(c.whole for c in planned.values())
    top = inverted.top_ranks(scored, k, [F.round("low", 12).desc(), F.col("chunk_id").asc()])
    if whole:
        return top.select("search", "chunk_id", *more, (-F.col("low")).alias("bm25")).collect()  # k for each search
    last = top.groupBy(F.col("search").alias("of")).agg(F.when(F.count(F.lit(1)) >= k, F.min("low")).otherwise(0.0).alias("last"))
    possible = scored.join(F.broadcast(last), F.col("search") == F.col("of")).where(F.col("low") + rest - F.col("known") >= F.col("last") * (1 - 1e-9))
    possible = possible.select("search", "chunk_id", *more)
    some = possible.limit(LOOKED_UP + 1).collect()
    if len(some) > LOOKED_UP:
        near, texts = possible, chunks
    else:
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in possible.schema)
        near, texts = F.broadcast(spark.createDataFrame(some, kinds)), chunks.where(fetch.near("chunk_id", [r["chunk_id"] for r in some]))
    bodies = texts.select(F.col("chunk_id").alias("c"), "title_tokens", "text_tokens", "doc_len")
    rows = bodies.join(near, F.col("c") == F.col("chunk_id"))
    total = F.lit(0.0)
    for t in sorted({t for each in weights.values() for t in each}):
        weight = F.element_at(F.create_map(*(x for s, each in weights.items() for x in (F.lit(s), F.lit(each.get(t, 0.0))))), F.col("search"))
        times = lambda column, t=t: F.size(F.filter(column, lambda x: x == t))
        total = total + weight * inverted.share(times("title_tokens"), times("text_tokens"), F.col("doc_len"), F.lit(avgdl))
    whole = rows.select("search", "chunk_id", *more, (-total).alias("bm25"))
    return inverted.top_ranks(whole, k, [F.round("bm25", 12).asc(), F.col("chunk_id").asc()]).drop("rank").collect()  # k for each search
