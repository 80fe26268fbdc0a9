"""Ids of byte-level vocabularies, for texts of any length.

Usual texts go through a fast library in one step.  Its pattern for white space
backtracks, and runs of about a million characters exhaust its stack; a text
longer than `SAFE_CHARS` with such a run is split into pre-tokens here, by
patterns that don't, and merged pre-token by pre-token.  The ids are the same.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import regex

from .bpe import ABOVE_PLAIN, WHITE, char_class, symbol_bytes

#: GPT-style pre-tokens of byte-level vocabularies (fixed value: the tokenizer's own pattern).
PRETOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a text that needs no look at its runs of white space; a run from which it is split here.
SAFE_CHARS = 200_000
LONG_RUN = re.compile(r"\s{100000}")

_L, _N, _W = char_class("L"), char_class("N"), re.escape(WHITE)
PLAIN_PATTERN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_W}{_L}{_N}]+|[{_W}]+(?![^{_W}])|[{_W}]+")
FULL_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


@functools.cache
def byte_level(path: str):
    """A fast encoder over the vocabulary of a byte-level tokenizer file; the same ids as the file's own library."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    known = symbol_bytes()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(known[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding(path, pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens=special)


@functools.cache
def specials(path: str) -> re.Pattern:
    """Matches the vocabulary's special strings, as one group."""
    names = sorted(byte_level(path).special_tokens_set, key=len, reverse=True)
    return re.compile("(" + ("|".join(map(re.escape, names)) or r"(?!)") + ")")


def pretokens(plain: str) -> list[str]:
    """Pre-tokens of a text without special strings."""
    return (FULL_PATTERN if ABOVE_PLAIN.search(plain) else PLAIN_PATTERN).findall(plain)


def split(text: str, path: str) -> tuple[list[str], int]:
    """Pre-tokens of a text, and how many special strings it has."""
    parts = specials(path).split(text)
    words = pretokens(parts[0]) if len(parts) == 1 else [w for p in parts[::2] for w in pretokens(p)]
    return words, len(parts) // 2


def piece_ids(word: str, path: str) -> list[int]:
    """Ids of one pre-token."""
    return byte_level(path)._encode_single_piece(word.encode())


def ids_of(text: str | None, path: str) -> np.ndarray:
    """Ids of a text; special strings in it are single ids."""
    if not text:
        return np.empty(0, np.uint32)
    enc = byte_level(path)
    if len(text) <= SAFE_CHARS or not LONG_RUN.search(text):
        return enc.encode_to_numpy(text, allowed_special="all")
    found: list[int] = []
    for k, part in enumerate(specials(path).split(text)):
        if k % 2:
            found.append(enc.encode_single_token(part))
        else:
            for w in pretokens(part):
                found += piece_ids(w, path)
    return np.array(found, np.uint32)
