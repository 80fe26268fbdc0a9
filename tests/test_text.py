"""Text functions: Column expressions against plain Python re-derivations, and fixed behaviours."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from trawl.functions import intent as I
from trawl.functions import pytext as P
from trawl.functions import text as X

ALPHABET = list("ab. ,\n\r\t\0éß½ŉ") + ["‮", "‏", "\x85", "\x07", "\r\n", "\n\n\n\n", "İ", "ﬁ", "Straße", "漢"]


def samples(n=300, seed=1):
    rng = random.Random(seed)
    return ["", " ", *("".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(n))]


def plain_sanitize(value):
    marked = "".join(f"<U+{ord(c):04X}>" if ord(c) in X.BIDI else c for c in value.replace("\0", ""))
    spaced = "".join(" " if unicodedata.category(c) == "Cc" and c not in "\n\t" else c for c in marked)
    return re.sub("[ \t]+", " ", spaced).strip()


def test_columns_match_python(spark):
    texts = samples()
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(
        "i", "t", X.clean_text(F.col("t")).alias("clean"), X.sanitize_text(F.col("t")).alias("safe"), X.shorten(F.col("t"), 10).alias("short"), P.evidence_form_udf(F.col("t")).alias("form")
    ).collect()
    for r in rows:
        assert r.clean == P.clean(r.t)
        assert r.safe == plain_sanitize(r.t)
        cleaned = P.clean(r.t)
        assert r.short == (cleaned if len(cleaned) <= 10 else cleaned[:9].rstrip() + "…")
        assert r.form == P.evidence_form(r.t)


def test_control_characters_are_shown(spark):
    text = "safe\x00\x07\x85\u200f\u202eevil"
    assert plain_sanitize(text) == spark.range(1).select(X.sanitize_text(F.lit(text)).alias("t")).first().t == "safe <U+200F><U+202E>evil"


def test_local_rows(spark):
    rows = [(3, "it's \\ \"x\" ? :a\n漢", None, 2.5), (-1, "", True, None)] + [(i, str(i), False, float(i)) for i in range(20)]
    got = X.local(spark, rows, "i int, t string, b boolean, d double")
    assert [tuple(r) for r in got.collect()] == rows and X.local(spark, [], "i int").count() == 0


def test_tokens(spark):
    got = spark.createDataFrame([("foo_bar don’t STRASSE straße Ⅻ Élan İx naïve Ångström",)], "t string").select(X.tokens(F.col("t")).alias("k")).first().k
    assert got == ["foo", "bar", "don", "t", "strasse", "straße", "ⅻ", "elan", "ix", "naive", "angstrom"]


def slow_split(text, most, overlap):
    text = P.clean(text)
    out, start = [], 0
    while start < len(text):
        end = min(len(text), start + most)
        if end < len(text):
            low = start + most // 2
            ends = [i for mark in ("\n\n", "\n", ". ", " ") for i in range(low, end - len(mark) + 1) if text[i : i + len(mark)] == mark]
            if ends:
                end = max(ends)
        if piece := P.clean(text[start:end]):
            out.append(piece)
        if end >= len(text):
            break
        start = max(start + 1, end - overlap)
    return out


def test_splitting():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice("abc  .\n") for _ in range(rng.randint(0, 200)))
        most = rng.randint(4, 60)
        overlap = rng.randint(0, most // 3)
        got = P.split_points(text, most, overlap)
        assert got == slow_split(text, most, overlap)
        assert all(len(p) <= most for p in got)
    assert len(P.split_points("Paragraph one. " * 200, 300, 30)) > 2


def test_content_text():
    assert P.content_text({"content_type": "multimodal_text", "parts": ["Look at this", {"asset_pointer": "file://x", "content_type": "image"}]}) == "Look at this"
    assert P.content_text({"text": "a", "parts": ["b", "b", ["c"]], "other": "z"}) == "b\n\nc\n\na"
    assert P.content_text({"url": "x", "note": "kept", "n": 3}) == "kept"
    assert P.content_text(None) == P.content_text(5) == ""
    deep = "x"
    for _ in range(20):
        deep = [deep]
    assert P.content_text(deep) == ""


@pytest.mark.parametrize("text,want", [("Yeah bro, this is tuff", "accepted"), ("Nah, this is not it", "rejected"), ("", "unknown"), ("go on", "unknown"), ("éno way", "unknown")])
def test_acceptance(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(X.acceptance(F.col("t")).alias("a")).first().a == want


def test_intents():
    i = I.interpret('What is the final position, I said "exact words here"')
    assert i.primary_mode == "correction" and "exact_phrase" in i.flags and i.quoted == ("exact words here",)
    assert I.interpret("how has the latest plan changed over time").primary_mode == "longitudinal"
    assert I.interpret("When did I first start Harbour").primary_mode == "earliest" and I.interpret("When did I first start Harbour").identifiers == ("Harbour",)
    assert I.interpret("tell me").primary_mode == "recall"
    for q in ("Alpha Beta2 Gamma changed over time \"one two\" 'x' and “three four” first", "a", "Nova wrong instead"):
        v = I.variants(q, I.interpret(q))
        assert 1 <= len(v) <= 8 and v[0].kind == "semantic_original" and len({(x.kind, x.text.casefold()) for x in v}) == len(v)


def test_anchor_comes_first():
    found = I.weighted_searches("When did I first start building Harbour")
    assert found[0] == (["harbour"], False, 2.0) and [w for _, _, w in found] == [2.0, 1.7, 1.35, 1.0]
    assert I.weighted_searches("?!") == []
    assert I.search_order("the first time we met") == "earliest" and I.search_order("most recent one") == "latest" and I.search_order("x") == "relevance"


def test_near_duplicates():
    words = [f"w{k}" for k in range(100)]
    base = " ".join(words)
    assert P.near_duplicate(base, " ".join(words[:-1])) and not P.near_duplicate(base, " ".join(reversed(words)))
    assert not P.near_duplicate("a" * 119, "a" * 119 + "b" * 900) and P.near_duplicate("a" * 120, "a" * 120 + "b" * 900)
    assert not P.near_duplicate("", "x")


def test_forms_of_long_texts():
    rng = random.Random(3)
    plain = lambda text: " ".join(re.findall(r"\w+", unicodedata.normalize("NFKC", text).casefold()))
    for letters in ("ab C_-9\x00\n.", "ab cé_-ß ½ﬁ́\u200b漢퟿😀\x00\n ١"):
        for n in (199, 200, 201, 1000):
            for edge in ("", " - ", "é", "a"):
                text = edge + "".join(rng.choice(letters) for _ in range(n)) + edge
                assert P.evidence_form(text) == plain(text)
    assert P.evidence_form(" -." * 200) == P.evidence_form("—" * 200) == ""
    for start in range(0, 0x110000, 997):
        text = "".join(chr(c) for c in range(start, min(start + 997, 0x110000)) if not 0xD800 <= c < 0xE000)
        assert P.evidence_form(text) == plain(text)


def test_safe_double(spark):
    rows = spark.createDataFrame([("12.5",), ("nan",), ("inf",), ("x",), (None,)], "t string").select(X.safe_double(F.col("t")).alias("v")).collect()
    assert [r.v for r in rows] == [12.5, None, None, None, None]
    assert re.match("archive", spark.range(1).select(X.source_uri(F.lit("c"), F.lit(3)).alias("u")).first().u)


def test_clean_texts_are_told_from_others(spark):
    edges = ["\0", "\r", "\r\n", "\t", " ", "  ", "\n", "\n" * 3, "\n" * 4, "\xa0", "\u2028", "\u3000", "\x1c", "\x1f", "\x85", "\u200b", "\ufeff", "\xe9", "e\u0301", "\U0001f600"]
    texts = ["", None, "a", *edges, *(f"{e}a" for e in edges), *(f"a{e}" for e in edges), *(f"a{e}b" for e in edges), *(f"a {e} b\n{e}c" for e in edges)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.clean_text(F.col("t")).alias("clean"), X.tokens(F.col("t")).alias("tokens"))
    for r in rows.collect():
        assert r.clean == (None if r.t is None else P.clean(r.t))
        plain = None if r.t is None else "".join(c for c in unicodedata.normalize("NFD", r.t) if unicodedata.category(c) != "Mn").lower()
        assert r.tokens == (None if plain is None else re.findall(r"[a-z]+", plain))
