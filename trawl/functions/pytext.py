"""Text functions that no built-in expression covers: plain Python, and Arrow functions over them for ingest."""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lexicon as L
from .text import BIDI

MAX_NESTING = 12
#: Characters up to which a text's words are looked for one by one.
SHORT_CHARS = 200
#: Bytes of words as they are, all others as spaces.
ASCII_WORDS = bytes(i if re.match(r"\w", chr(i)) else 32 for i in range(128)) + b" " * 128


def clean(text: str) -> str:
    unified = text.translate({0: " "}).replace("\r\n", "\n").replace("\r", "\n")
    return re.sub("\n{4,}", "\n" * 3, re.sub("[ \t]+", " ", unified)).strip()


def sanitized(text: str) -> str:
    """For one short text what `text.sanitize_text` is for a column."""
    spelled = text.replace("\0", "").translate({code: f"<U+{code:04X}>" for code in BIDI})
    plain = "".join(" " if unicodedata.category(c) == "Cc" and c not in "\n\t" else c for c in spelled)
    return re.sub("[ \t]+", " ", plain).strip()


def content_text(value) -> str:
    """All text in a message's content, whatever its nesting; a part equal to the one before it is dropped."""
    parts: list[str] = []
    todo = [(value, 0)]
    while todo:
        item, level = todo.pop()
        if level > MAX_NESTING:
            continue
        if isinstance(item, str):
            if (text := clean(item)) and parts[-1:] != [text]:
                parts.append(text)
        elif isinstance(item, list):
            todo += [(x, level + 1) for x in reversed(item)]
        elif isinstance(item, dict):
            keys = [k for k in L.TEXT_KEYS if k in item] or [k for k in item if k not in L.IGNORED_KEYS]
            todo += [(item[k], level + 1) for k in reversed(keys)]
    return clean("\n\n".join(parts))


def pieces(text: str, most: int, overlap: int) -> Iterator[str]:
    """Overlapping pieces of at most `most` characters, one after the other, each ended at the last blank or line end of its second half, if there is one."""
    text = clean(text)

    def stop_of(start: int) -> int:
        last = max(text.rfind(" ", start + most // 2, start + most), text.rfind("\n", start + most // 2, start + most))
        return last if last >= 0 else start + most

    start = 0
    while True:
        stop = stop_of(start) if start + most < len(text) else len(text)
        if piece := clean(text[start:stop]):
            yield piece
        if stop == len(text) and start + most >= len(text):
            return
        start = max(start + 1, stop - overlap)


def split_points(text: str, most: int, overlap: int) -> list[str]:
    return list(pieces(text, most, overlap))


def match_form(value: str) -> str:
    """For comparison: compatibility forms and case folded, spaces to one, trimmed."""
    return " ".join(unicodedata.normalize("NFKC", value).casefold().split())


@functools.cache
def _word_characters() -> np.ndarray:
    """Whether a character is one of words, for all there are."""
    found = np.zeros(sys.maxunicode + 1, bool)
    for run in re.finditer(r"\w+", "".join(map(chr, range(sys.maxunicode + 1)))):
        found[run.start() : run.end()] = True
    return found


def evidence_form(value: str) -> str:
    """As match_form, with every run of other than word characters as one space."""
    folded = unicodedata.normalize("NFKC", value).casefold()
    if len(folded) < SHORT_CHARS:
        return " ".join(re.findall(r"\w+", folded))
    if folded.isascii():
        coding, characters = "ascii", np.frombuffer(folded.encode("ascii").translate(ASCII_WORDS), np.uint8)
    else:
        coding, characters = "utf-32-le", np.frombuffer(folded.encode("utf-32-le", "surrogatepass"), "<u4")
        characters = np.where(_word_characters().take(characters), characters, np.uint32(32))
    word = characters != 32
    kept = word.copy()
    kept[:-1] |= word[1:]  # of a run of others, the one before a word
    kept[: word.argmax()] = False
    return characters[kept].tobytes().decode(coding, "surrogatepass")


def shingle_set(text: str, size: int = 5) -> set[tuple[str, ...]]:
    words = text.split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def near_duplicate(one: str, two: str, least: float = 0.88, inside: int = 120) -> bool:
    """One contains the other (both of some length), or their shingles are alike."""
    if not one or not two:
        return False
    short, long = sorted((one, two), key=len)
    if len(short) >= inside and short in long:
        return True
    a, b = shingle_set(one), shingle_set(two)
    return len(a & b) >= least * len(a | b)


def _strings(f):
    return lambda column: pa.array([None if x is None else f(x) for x in column.to_pylist()], pa.string())


def match_form_udf(column):
    return F.arrow_udf(_strings(match_form), "string")(column)


def evidence_form_udf(column):
    return F.arrow_udf(_strings(evidence_form), "string")(column)


def content_text_udf(column):
    """Text of a content value given as JSON."""
    return F.arrow_udf(_strings(lambda x: content_text(json.loads(x))), "string")(column)


def split_text_udf(column, most: int = L.CHUNK_CHARS, overlap: int = L.CHUNK_OVERLAP):
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([split_points(t, most, overlap) if t else [] for t in texts.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(run, T.ArrayType(T.StringType()))(column)


def casefold_udf(column):
    return F.arrow_udf(_strings(str.casefold), "string")(column)


class Pieces:
    """Table function (text, most, overlap): a row (chunk_index, text) for each piece.

    Rows leave as they are made, so a text of any length never becomes one array.  Spark
    joins no table function that takes Arrow data laterally, so this one takes plain rows.
    """

    def eval(self, text: str, most: int, overlap: int) -> Iterator[tuple[int, str]]:
        yield from enumerate(pieces(text, most, overlap) if text else ())


def split_function():
    return F.udtf(Pieces, returnType="chunk_index int, text string", useArrow=False)


def split_pieces(text, most: int = L.CHUNK_CHARS, overlap: int = L.CHUNK_OVERLAP):
    """Pieces of an outer column, for lateralJoin; in SQL, register `split_function()` and use LATERAL."""
    return split_function()(text, F.lit(most), F.lit(overlap))
