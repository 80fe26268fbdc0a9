"""What many questions ask for and the searches made for them, as columns: the same rules as `intent` has for one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import lexicon as L
from . import text as X
from .intent import FLAGS, MODES, mode_column
from .pytext import casefold_udf, match_form_udf

#: Searches of a question, and terms of its searches for all and for any of them.
MOST, ALL_TERMS, ANY_TERMS = 8, 12, 16


def quoted(question: Column) -> Column:
    found = F.transform(F.regexp_extract_all(question, F.lit(L.QUOTED), F.lit(1)), X.strip)
    return F.slice(F.array_distinct(F.filter(found, lambda p: p != "")), 1, 2)


def identifiers(question: Column) -> Column:
    found = F.regexp_extract_all(question, F.lit(f"(?U)({L.NAME}|{L.IDENTIFIER})"), F.lit(1))
    return F.slice(F.array_distinct(F.filter(found, lambda n: ~n.isin(L.IDENTIFIER_STOPS))), 1, 3)


def flags(question: Column) -> Column:
    found = [F.when(question.rlike(X.java(pattern)) | (F.size(quoted(question)) > 0 if flag == "exact_phrase" else F.lit(False)), flag) for flag, pattern in FLAGS]
    return F.array_compact(F.array(*found, F.when(F.size(identifiers(question)) > 0, "named_identifier")))


def interpreted(questions: DataFrame, key: str, text: str) -> DataFrame:
    """(question, text, mode, flags, quoted, names, terms) of every question."""
    q = F.col(text)
    rows = questions.select(F.col(key).alias("question"), q.alias("text"), mode_column(q).alias("mode"), flags(q).alias("flags"), quoted(q).alias("quoted"), identifiers(q).alias("names"), X.searchable_terms(q).alias("terms"))
    return rows.where("text is not null")


def searches(asked: DataFrame) -> DataFrame:
    """(question, n, kind, text, weight, phrases, needs_all): the searches for interpreted questions, the most telling first, equal ones once."""
    mode, terms, names = F.col("mode"), F.col("terms"), F.col("names")
    anchors = F.when(F.size(names) > 0, names).otherwise(F.slice(terms, 1, 3))
    join = lambda words: F.array_join(words, " ")

    def search(kind: str, text: Column, weight: float) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"), F.lit(weight).alias("weight"))

    def when(condition: Column, kind: str, text: Column, weight: float) -> Column:
        return F.when(condition, F.array(search(kind, text, weight)))

    current = ~mode.isin("longitudinal", "earliest", "latest") & F.array_contains("flags", "current_state")
    some = F.size(anchors) > 0
    parts = [
        F.array(search("semantic_original", X.strip(F.col("text")), 1.0)),
        F.transform("quoted", lambda p: search("quoted_phrase", p, 1.0)),
        F.transform("names", lambda n: search("identifier", n, 0.9)),
        F.array(search("lexical_and", join(F.slice(terms, 1, ALL_TERMS)), 0.85), search("lexical_or", join(F.slice(terms, 1, ANY_TERMS)), 0.55)),
        when(mode.isin("longitudinal", "earliest"), "temporal_earliest", join(F.slice(anchors, 1, 2)), 0.35),
        when(mode.isin("longitudinal", "latest") | current, "temporal_latest", join(F.slice(anchors, 1, 2)), 0.35),
        when((mode == "correction") & some, "correction_terms", F.concat_ws(" ", join(anchors), F.lit("actually instead correction")), 0.6),
        when((mode == "longitudinal") & some, "change_terms", F.concat_ws(" ", join(anchors), F.lit("changed evolved")), 0.6),
    ]
    empty = F.array().cast("array<struct<kind:string,text:string,weight:double>>")
    spread = asked.select("question", F.posexplode(F.concat(*(F.coalesce(p, empty) for p in parts))).alias("at", "s")).select("question", "at", "s.*")
    formed = spread.withColumn("form", match_form_udf(F.col("text"))).where("form <> ''")
    # at most a dozen rows of a question meet
    once = formed.withColumn("again", F.row_number().over(Window.partitionBy("question", "kind", "form").orderBy("at"))).where("again = 1")
    numbered = once.withColumn("n", F.row_number().over(Window.partitionBy("question").orderBy("at")) - 1).where(F.col("n") < MOST)
    whole = F.col("kind").isin("quoted_phrase", "identifier")
    phrases = F.when(whole, F.array(casefold_udf(F.col("text")))).otherwise(X.searchable_terms(F.col("text")))
    return numbered.select("question", "n", "kind", "text", "weight", phrases.alias("phrases"), (F.col("kind") == "lexical_and").alias("needs_all"))


__all__ = ["FLAGS", "MODES", "flags", "identifiers", "interpreted", "quoted", "searches"]
