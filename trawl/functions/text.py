"""Text functions as Column expressions: they stay in the JVM and in generated code."""

from __future__ import annotations

import functools
import json
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lexicon as L

#: Control characters that change the direction of text.
BIDI = [*range(0x202A, 0x202F), *range(0x2066, 0x206A), 0x061C, 0x200E, 0x200F]
NEWLINE = "\n"


def java(pattern: str) -> str:
    """A Python pattern for the JVM: case ignored, Unicode classes, a line ends at a line feed only."""
    return "(?iUd)" + pattern


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def clean_text(c: Column) -> Column:
    """NUL to a space, line ends to \\n, blanks to one space, at most three line feeds together, trimmed."""
    out = F.replace(F.replace(F.replace(c, F.lit("\0"), F.lit(" ")), F.lit("\r\n"), F.lit(NEWLINE)), F.lit("\r"), F.lit(NEWLINE))
    out = strip(F.regexp_replace(F.regexp_replace(out, "[ \t]+", " "), "\n{4,}", NEWLINE * 3))
    # most texts are clean: plain searches tell so at a quarter of what the patterns cost
    unclean = F.concat(F.left(c, F.lit(1)), F.right(c, F.lit(1))).rlike(r"(?U)[\s\x1c-\x1f]")
    for part in ("\0", "\r", "\t", "  ", NEWLINE * 4):
        unclean = unclean | F.contains(c, F.lit(part))
    return F.when(unclean, out).otherwise(c)


def sanitize_text(c: Column) -> Column:
    """Direction marks spelled out, other control characters to spaces, blanks to one, trimmed."""
    c = F.replace(c, F.lit("\0"), F.lit(""))
    for code in BIDI:
        c = F.replace(c, F.lit(chr(code)), F.lit(f"<U+{code:04X}>"))
    return strip(F.regexp_replace(F.regexp_replace(c, r"[\p{Cc}&&[^\n\t]]", " "), "[ \t]+", " "))


def shorten(c: Column, most: int) -> Column:
    """Cleaned; if longer than `most` characters, cut and ended with an ellipsis."""
    c = clean_text(c)
    cut = F.regexp_replace(F.substring(c, 1, most - 1), r"(?U)[\s\x1c-\x1f]+$", "")
    return F.when(F.char_length(c) > most, F.concat(cut, F.lit("…"))).otherwise(c)


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def acceptance(following_user: Column, accept: str = L.ACCEPT, reject: str = L.REJECT) -> Column:
    """What the next user message says about the answer before it."""
    sample = F.substring(clean_text(F.coalesce(following_user, F.lit(""))), 1, 1000)
    return F.when(sample == "", "unknown").when(sample.rlike(java(reject)), "rejected").when(sample.rlike(java(accept)), "accepted").otherwise("unknown")


def user_signal(c: Column, rejection: str = L.REJECTION, refinement: str = L.REFINEMENT, adoption: str = L.ADOPTION) -> Column:
    sample = F.substring(c, 1, 4000)
    return (
        F.when(sample.rlike(java(rejection)), "possible_rejection")
        .when(sample.rlike(java(refinement)), "possible_correction_or_refinement")
        .when(sample.rlike(java(adoption)), "possible_adoption_or_confirmation")
    )


def assistant_status(c: Column) -> Column:
    return (
        F.when(c == "rejected", "rejected_by_following_user_heuristic")
        .when(c == "accepted", "possibly_accepted_by_following_user")
        .otherwise("assistant_context_unverified")
    )


def source_uri(conversation: Column, turn: Column) -> Column:
    return F.concat(F.lit("archive://conversation/"), conversation, F.lit("/turn/"), turn.cast("string"))


def timestamp_iso(seconds: Column) -> Column:
    return F.coalesce(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd"), F.lit("unknown-date"))


def quarter(seconds: Column) -> Column:
    ts = F.timestamp_seconds(seconds)
    return F.coalesce(F.concat(F.year(ts).cast("string"), F.lit("-Q"), F.quarter(ts).cast("string")), F.lit("unknown"))


def safe_double(c: Column) -> Column:
    """A number from its text, null where it is none or not finite."""
    v = c.try_cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


@functools.cache
def accents() -> tuple[str, str]:
    """Letters with marks and the letters they are without them."""
    found = {}
    for code in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and all(unicodedata.combining(x) for x in base[1:]):
            found[chr(code)] = base[0]
    return "".join(found), "".join(found.values())


def tokens(c: Column) -> Column:
    """Search tokens: marks off, lower case, runs of letters and digits."""
    plain = F.when(F.octet_length(c) == F.char_length(c), c).otherwise(F.regexp_replace(F.translate(c, *accents()), r"\p{Mn}", ""))
    return F.regexp_extract_all(F.lower(plain), F.lit(r"([\p{L}\p{N}\p{Co}]+)"), F.lit(1))


def searchable_terms(c: Column) -> Column:
    """Words worth searching for, in order, each once."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"(?U)([\w’']+)"), F.lit(1))
    words = F.transform(words, lambda w: F.regexp_replace(w, "^[’']+|[’']+$", ""))
    return F.array_distinct(F.filter(words, lambda w: (F.char_length(w) > 1) & ~w.isin(L.STOP_WORDS)))


def jaccard(one: Column, two: Column) -> Column:
    """Of two sets as arrays; 0 where either is empty."""
    both = F.size(F.array_intersect(one, two))
    return F.when((F.size(one) == 0) | (F.size(two) == 0), 0.0).otherwise(both / F.size(F.array_union(one, two)))


def bound(c: Column, f) -> Column:
    """f of c, with c evaluated once: inside a lambda an expression would be evaluated for every element."""
    return F.element_at(F.transform(F.array(c), f), 1)


def word_shingles(words: Column, size: int = 5) -> Column:
    """Distinct runs of `size` words joined by spaces; the whole if there are fewer; none of nothing."""

    def runs(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1)))
        found = F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(w, i, size), " ")))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(found)

    return bound(words, runs)


def phrase_count(words: Column, phrase: list[str]) -> Column:
    """How often a run of words occurs in an array."""
    k, wanted = len(phrase), F.array(*map(F.lit, phrase))

    def count(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1)))
        return F.size(F.filter(starts, lambda i: F.slice(w, i, k) == wanted))

    return bound(words, count)


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows from the driver as a literal in the plan, without a Python worker."""
    names = [field.strip().split(" ", 1)[0] for field in schema.split(",")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    kind = ", ".join(field.strip().replace(" ", ": ", 1) for field in schema.split(","))
    return spark.sql(f"SELECT inline(from_json(?, 'array<struct<{kind}>>'))", args=[text])
