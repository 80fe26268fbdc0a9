"""The transducer against the tokenizers library: random words, very long words, special strings, scripts."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trawl.llm import bpe, encoding

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(text):
    return memoryview(encoding.ids_of(text, PATH)).cast("I").tolist()


ALPHABETS = ["abcdefghij", "the anding of", "aA'sS tTllLL ", "éÈüßİΣσǺ̧ ", "0123½²Ⅻ١ 　\x1c\x85\xa0", "漢字かな😀👩‍👩‍👧 \n\t", "<|endoftext|> start", "!?.,'’“” --__"]


def test_random_texts_match_the_library(library):
    rng = random.Random(3)
    for n in range(1500):
        chars = "".join(rng.sample(ALPHABETS, rng.randint(1, 3)))
        text = "".join(rng.choice(chars) for _ in range(rng.randint(0, 60)))
        if n % 9 == 0:
            text += "<|endoftext|>" + text + "<|startoftext|>"
        want = library.encode(text, add_special_tokens=False).ids
        assert ids(text) == want, repr(text)
        d = bpe.decoder(PATH, "library")
        cut = rng.randint(0, len(want))
        assert d.feed(want[:cut]) + d.feed(want[cut:]) + d.finish() == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("letters", ["a", "ab", "thean", "abcdefghijklmnopqrstuvwxyz", "é", "!?.", "ing"])
def test_long_words_stream_through_a_window(library, letters):
    rng = random.Random(5)
    for n in (1, 100, 5000):
        word = "".join(rng.choice(letters) for _ in range(n))
        assert ids(word) == library.encode(word, add_special_tokens=False).ids
        m = bpe.encoder(PATH).merges
        assert list(m.stream(m.symbols(word.encode()))) == m.merge(list(m.symbols(word.encode())))


def test_lookahead_is_found_and_short():
    m = bpe.encoder(PATH).merges
    assert m.one_way and 0 < m.lookahead < 1000


def test_text_form_keeps_words():
    d = bpe.decoder(PATH, "text")
    got = d.feed(ids("Größe déjà vu 漢字!"))
    assert (got + d.finish()).split() == "größe déjà vu 漢字 !".split()


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "The end<|endoftext|>", "x"), (3, "The end<|endoftext|>", "x"), (None, "a" * 70000, "x")], "doc_id long, text string, ids string")
    got = {(r.doc_id, r.n_tokens) for r in encoding.digests(df, PATH).collect()}
    assert {(1, 0), (2, 0), (3, 3)} < got and encoding.digests(df, PATH).count() == 5
    back = encoding.decode(encoding.encode(df, PATH), PATH)
    assert {r.text for r in back.where("doc_id = 3").collect()} == {"the</w> end</w> <|endoftext|>"}
    assert encoding.digests(df.limit(0), PATH).count() == 0
