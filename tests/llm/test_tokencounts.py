"""Token counts against the library, with every split of hot and rare pre-tokens."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trawl.llm import tokencounts

PATH = public_tokenizers.path("byte_bpe_50k.json")
CHARS = ["abc DEF", "the it's we'll", "éÈüßİΣ", "0123½²Ⅻ١ ", "  \t\n\x0b\x1c\x85\xa0　x", "漢字😀👩‍👧", "!?.,'’--__ ", "éa"]


def texts():
    rng = random.Random(8)
    out = [None, "", " ", "a <|endoftext|> b<|endoftext|>", "word " * 400, "x" * 3000, "\n" * 50]
    for _ in range(400):
        chars = "".join(rng.sample(CHARS, 3))
        out.append("".join(rng.choice(chars) for _ in range(rng.randint(0, 80))))
    return out


@pytest.mark.parametrize("hot", [0, 20, 1 << 18])
def test_counts_match_the_library(spark, hot):
    lib, all_texts = Tokenizer.from_file(PATH), texts()
    rows = [(i, t, 1) for i, t in enumerate(all_texts)] + [(0, None, 1), (None, "the the", 1)]
    got = tokencounts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n long"), PATH, hot=hot).collect()
    want = sorted((r[0] if r[0] is not None else -1, len((r[1] or "").encode()), len(lib.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in got) == want


@pytest.mark.parametrize("hot", [0, 1 << 18])
def test_long_runs_hot_or_not(spark, hot):
    long = [" " * 2_000_000, "\n" * 2_000_000, "-" * 2_000_000, "ab" * 1_000_000, "a" + " " * 1_500_000 + "b", "-" * 80, "- " + "-" * 80, "\0" + "a" * 64, "😀" * 100]
    lib, rows = Tokenizer.from_file(PATH), list(enumerate(long + long[-4:] * 20))
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in tokencounts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), PATH, hot=hot).collect()}
    assert got == {i: (len(t.encode()), len(lib.encode(t, add_special_tokens=False).ids)) for i, t in rows}


def test_a_long_frequent_word_is_hot(spark):
    words = tokencounts.piece_table(tokencounts.corpus_words(spark.createDataFrame([("-" * 80,)] * 9 + [("x",)], "text string"), PATH), PATH)
    known = tokencounts.hot_words(words, 1)
    assert list(known) == [tokencounts.hot_key("-" * 80)] and len(tokencounts.hot_key("-" * 80)) == 65


def test_empty(spark):
    assert tokencounts.count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
