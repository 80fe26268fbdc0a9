"""The context ranking: eight weighted components, corrections, totals of turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from ..functions.intent import Intent, searchable_terms
from ..functions.pytext import match_form


def lexical_strength(matches: Column) -> Column:
    """From an array of (weight, rank): the best match, and an eighth or so of the next two."""
    values = F.sort_array(F.transform(matches, lambda m: m["weight"] * (61.0 / (60.0 + m["rank"]))), asc=False)
    rest = F.aggregate(F.slice(values, 2, 2), F.lit(0.0), lambda total, v: total + v)
    return F.when(F.size(values) < 1, 0.0).otherwise(F.least(F.lit(1.0), F.element_at(values, 1) + 0.12 * rest))


def exact_strength(haystack: Column, intent: Intent, query: str) -> Column:
    """Of a text in match form: a quoted phrase, a name, or the whole question in it."""

    def holds(needles) -> Column:
        out = F.lit(False)
        for n in needles:
            out = out | F.contains(haystack, F.lit(match_form(n)))
        return out

    whole = match_form(query)
    asks = intent.primary_mode == "exact" and 2 <= len(whole.split()) <= 18
    return F.when(holds(intent.quoted), 1.0).when(holds(intent.identifiers), 0.75).when(holds([whole]) if asks else F.lit(False), 0.9).otherwise(0.0)


def correction_signal(previous: Column, signal: Column) -> Column:
    return F.when(previous == "rejected", 1.0).when(signal.isin("possible_rejection", "possible_correction_or_refinement"), 0.75).otherwise(0.0)


def corroboration(turns_in_conversation: Column) -> Column:
    return F.least(F.lit(1.0), F.log2(1 + turns_in_conversation) / 3.0)


def normalized_time(seconds: Column, oldest: Column, newest: Column) -> Column:
    return F.when(seconds.isNotNull() & (newest > oldest), (seconds - oldest) / (newest - oldest)).otherwise(0.0)


def weighted_total(raw: dict[str, Column], profile: str) -> tuple[Column, Column]:
    """(sum of contributions, array of components) with contributions rounded to eight digits each."""
    parts, total = [], F.lit(0.0)
    for name, weight in zip(L.COMPONENTS, L.PROFILES[profile], strict=True):
        share = F.round(raw[name] * weight, 8)
        total = total + share
        parts.append(component(name, F.round(raw[name], 8), weight, share))
    return total, F.array(*parts)


def component(name: str, raw: Column, weight: float, contribution: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), raw.cast("double").alias("raw"), F.lit(float(weight)).alias("weight"), contribution.cast("double").alias("contribution"))


def adjustment(role: Column, acceptance: Column) -> Column:
    """What the next message says about an answer counts, if the answer is what matched."""
    return F.when((role == "assistant") & (acceptance == "rejected"), -0.20).when((role == "assistant") & (acceptance == "accepted"), 0.02).otherwise(0.0)


def score_candidates(rows: DataFrame, query: str, intent: Intent) -> DataFrame:
    """rows: the candidates of one question, chunks with matches, similarity and their turn's columns; adds score, exact, correction_signal, components."""
    every = Window.partitionBy(F.lit(0))  # of as many rows as the searches' limits let through
    spread = F.size(F.collect_set("turn_index").over(Window.partitionBy("conversation_id")))
    rows = rows.select("*", F.min("create_time").over(every).alias("oldest"), F.max("create_time").over(every).alias("newest"), spread.alias("spread"))
    asked = F.array(*map(F.lit, searchable_terms(query))).cast("array<string>")
    zero = F.lit(0.0)
    raw = {
        "lexical": lexical_strength("matches"),
        "semantic": F.greatest(zero, F.least(F.lit(1.0), F.coalesce("similarity", zero))),
        "exact": exact_strength(F.col("match_form"), intent, query),
        "title": X.jaccard(X.searchable_terms(F.col("title")), asked),
        "user": F.when(F.col("role") == "user", 1.0).otherwise(0.0),
        "correction": correction_signal(F.col("previous_acceptance"), X.user_signal(F.col("user_text"))),
        "corroboration": corroboration(F.col("spread")),
        "current": normalized_time(F.col("create_time"), F.col("oldest"), F.col("newest")) if "current_state" in intent.flags else zero,
    }
    rows = rows.select("*", *(value.alias(f"raw_{name}") for name, value in raw.items()))
    total, parts = weighted_total({n: F.col(f"raw_{n}") for n in raw}, intent.profile)
    change = adjustment(F.col("role"), F.col("acceptance"))
    extra = F.when(change < 0, F.array(component("rejected_assistant", F.lit(1.0), -0.20, F.lit(-0.20)))).when(change > 0, F.array(component("possible_acceptance", F.lit(1.0), 0.02, F.lit(0.02)))).otherwise(F.array().cast("array<struct<name:string,raw:double,weight:double,contribution:double>>"))
    rows = rows.withColumn("components", F.concat(parts, extra)).withColumn("score", F.round(F.greatest(zero, F.least(F.lit(1.0), total + change)), 8))
    return rows.withColumn("correction_signal", F.col("raw_correction")).withColumn("exact", F.round("raw_exact", 8)).drop(*(f"raw_{n}" for n in raw), "oldest", "newest", "spread")


def rank_order(role: str = "role", last: str = "chunk_id") -> list[Column]:
    """Score, exact matches, user first, early first, then ids: a total order."""
    return [F.desc("score"), F.desc("exact"), F.when(F.col(role) == "user", 0).otherwise(1).asc(), F.asc_nulls_last("create_time"), F.col("conversation_id").asc(), F.col("turn_index").asc(), F.col(last).asc()]


def turn_totals(rows: DataFrame, most: int) -> DataFrame:
    """The best chunk of each turn; the next four support it a little."""
    place = F.row_number().over(Window.partitionBy("conversation_id", "turn_index").orderBy(*rank_order()))
    ranked = rows.withColumn("place", place)
    best = F.struct("place", "chunk_id", "message_id", "role", "title", "create_time", "text", "user_text", "assistant_text", "acceptance", "previous_acceptance", "score", "exact", "components")
    others = F.sum(F.when(F.col("place").between(2, 5), F.col("score")))
    grouped = ranked.groupBy("conversation_id", "turn_index").agg(
        F.min(best).alias("b"), F.coalesce(others, F.lit(0.0)).alias("others"), F.sort_array(F.collect_list("chunk_id")).alias("chunk_ids"), F.max("correction_signal").alias("correction_signal")
    )
    support = F.round(F.least(F.lit(0.08), 0.03 * F.col("others")), 8)
    added = F.when(support > 0, F.array(component("aggregation_support", F.round("others", 8), 0.03, support))).otherwise(F.slice("b.components", 1, 0))
    rows = grouped.select(
        "conversation_id", "turn_index", "b.title", "b.create_time", F.col("b.role").alias("matched_role"), F.col("b.message_id").alias("matched_message_id"), F.col("b.text").alias("matched_text"),
        "b.user_text", "b.assistant_text", "b.acceptance", "b.previous_acceptance", "chunk_ids", F.element_at("chunk_ids", 1).alias("first_chunk"), "correction_signal", "b.exact",
        F.round(F.least(F.lit(1.0), F.col("b.score") + support), 8).alias("score"), F.concat("b.components", added).alias("components"),
    )
    return rows.orderBy(*rank_order("matched_role", "first_chunk")).limit(most)
