"""Byte-pair encoding as a bounded-lookahead streaming transducer, and incremental decoding.

`Merges` reads a tokenizer file and computes the lookahead that its merge list
needs.  A merge (a, b) can move the frontier between what later input may
still change and what it can't by the length of a to the left, but only after a
lower-ranked merge has put a token there that b starts with; the longest such
chain, weighed by lengths, is a number of symbols beyond which nothing that
follows has any effect.  `Merges.stream` therefore emits every token that ends
at least that many symbols before the end of its window, drops it and goes on:
its memory is one window however long a word is.

Text is taken in pieces cut where no word, composition or special string can
span the cut.  Finished words are remembered in a bounded table.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import regex

#: Words remembered by one worker, and the longest of them in characters.
MEMO_WORDS, MEMO_CHARS = 1 << 18, 48
#: Characters taken from a text at a time.
PIECE_CHARS = 1 << 16
#: Below this code point a text is split with classes spelled out; above it by Unicode properties.
PLAIN = 0x250


@functools.cache
def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names = {b: chr(b) for b in shown}
    spare = 256
    for b in range(256):
        if b not in names:
            names[b] = chr(spare)
            spare += 1
    return [names[b] for b in range(256)]


@functools.cache
def symbol_bytes() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_symbols())}


def char_class(*kinds: str) -> str:
    """Body of a character class with the code points under PLAIN whose category starts with one of kinds."""
    return "".join(re.escape(chr(c)) for c in range(PLAIN) if unicodedata.category(chr(c))[0] in kinds)


#: Rank and result of a pair that no merge is for.
NO_MERGE = (1 << 30, None)
#: Code points under PLAIN with the Unicode property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0"
ABOVE_PLAIN = re.compile(f"[^\x00-{chr(PLAIN - 1)}]")


class Merges:
    """A BPE model: vocabulary, merge ranks, word-end suffix, special strings, sufficient lookahead."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.tokens: dict[int, str] = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        v = self.vocab
        self.rank = {(v[a], v[b]): (r, v[a + b]) for r, (a, b) in enumerate(pairs)}
        self.byte_id = [v[c] for c in byte_symbols()]
        self.last_id = [v[c + self.suffix] for c in byte_symbols()] if self.suffix else self.byte_id
        made = [ab for _, ab in self.rank.values()]
        self.one_way = len(set(made)) == len(pairs)
        self.lookahead = self._lookahead() if self.one_way else None
        self.longest = max(self._width(t) for t in self.vocab)

    def _width(self, token: str) -> int:
        return len(token.removesuffix(self.suffix)) if self.suffix else len(token)

    def _lookahead(self) -> int:
        left = {ab: a for (a, _), (_, ab) in self.rank.items()}
        width = {i: self._width(t) for t, i in self.vocab.items()}
        reach: dict[int, int] = {}  # longest chain so far whose last merge consumed this symbol as its left part
        most = 0
        for (a, b), _ in self.rank.items():
            before, start = 0, b
            while start is not None:  # every symbol that b begins with
                before = max(before, reach.get(start, 0))
                start = left.get(start)
            chain = width[a] + before
            reach[a] = max(reach.get(a, 0), chain)
            most = max(most, chain)
        return most

    def merge(self, ids: list[int]) -> list[int]:
        """All merges of one finite run of symbols, lowest rank first, leftmost first."""
        rank = self.rank
        if len(ids) < 48:
            ids = list(ids)
            ranks = [(rank.get(p) or NO_MERGE)[0] for p in zip(ids, ids[1:], strict=False)]
            while ranks and (best := min(ranks)) != NO_MERGE[0]:
                i = ranks.index(best)
                ids[i : i + 2] = (made,) = (rank[ids[i], ids[i + 1]][1],)
                del ranks[i]
                if i:
                    ranks[i - 1] = (rank.get((ids[i - 1], made)) or NO_MERGE)[0]
                if i < len(ranks):
                    ranks[i] = (rank.get((made, ids[i + 1])) or NO_MERGE)[0]
            return ids
        n = len(ids)
        sym, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := rank.get((sym[i], sym[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = rank[a, b][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if r := rank.get((sym[i], sym[k])):
                    heapq.heappush(heap, (r[0], i, sym[i], sym[k]))
            if (h := before[i]) >= 0 and (r := rank.get((sym[h], sym[i]))):
                heapq.heappush(heap, (r[0], h, sym[h], sym[i]))
        return [s for s in sym if s >= 0]

    def stream(self, symbols: Iterable[int], window: int | None = None) -> Iterator[int]:
        """Tokens of one word from its symbols, each emitted once no further symbol can change it."""
        ahead = self.lookahead
        if ahead is None:
            yield from self.merge(list(symbols))
            return
        window = max(window or 0, 2 * (ahead + self.longest))
        held: list[int] = []
        widths = self.token_width
        for s in symbols:
            held.append(s)
            if len(held) == window:
                at = 0
                for token in self.merge(held):
                    if at + widths[token] > window - ahead:
                        break
                    at += widths[token]
                    yield token
                del held[:at]
        yield from self.merge(held)

    @functools.cached_property
    def token_width(self) -> dict[int, int]:
        return {i: self._width(t) for t, i in self.vocab.items()}

    def symbols(self, word: bytes) -> Iterator[int]:
        """The starting symbols of a word; its last byte carries the word-end suffix."""
        for b in word[:-1]:
            yield self.byte_id[b]
        yield self.last_id[word[-1]]

    def word(self, word: str) -> list[int]:
        """Tokens of a word.  One that fits the lookahead is a single window and goes through in one step."""
        data = word.encode("utf-8")
        symbols = self.symbols(data)
        return self.merge(list(symbols)) if len(data) <= (self.lookahead or 0) else list(self.stream(symbols))


class Memo(dict):
    """Ids of words as bytes.  Two generations of at most MEMO_WORDS each: frequent words stay, memory is bounded."""

    def __init__(self, merges: Merges):
        self.merges, self.old = merges, {}

    def __missing__(self, word: str) -> bytes:
        got = self.old.get(word)
        if got is None:
            got = array("I", self.merges.word(word)).tobytes()
            if len(word) > MEMO_CHARS:
                return got
        if len(self) >= MEMO_WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = got
        return got


class Encoder:
    """Text to ids for a vocabulary with word ends, lower case and composed characters."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.memo = Memo(self.merges)
        names = sorted(self.merges.special, key=len, reverse=True)
        self.specials = re.compile("|".join(map(re.escape, names))) if names else None
        self.margin = max(map(len, names), default=1)
        ends = "'s|'t|'re|'ve|'m|'ll|'d"
        letters, digits = char_class("L"), char_class("N")
        self.plain = re.compile(f"{ends}|[{letters}]+|[{digits}]|[^{re.escape(WHITE)}{letters}{digits}]+")
        self.full = regex.compile(ends + r"|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")

    def normal(self, piece: str) -> str:
        if piece.isascii():
            return piece.lower()
        piece = unicodedata.normalize("NFC", piece)
        return piece.replace("Σ", "σ").lower()  # character by character: a last sigma is no exception

    def pieces(self, text: str) -> Iterator[str | int]:
        """Ids of special strings, and the text between them."""
        at = 0
        for m in self.specials.finditer(text) if self.specials else ():
            if m.start() > at:
                yield text[at : m.start()]
            yield self.merges.special[m.group()]
            at = m.end()
        if at < len(text):
            yield text[at:]

    def blocks(self, text: str) -> Iterator[str]:
        """text in blocks that end before a space or line end; a block without one grows until it has one."""
        at = 0
        while len(text) - at > PIECE_CHARS:
            cuts = [i for c in " \n" if (i := text.rfind(c, at + 1, at + PIECE_CHARS)) > 0]
            if not cuts:
                cuts = [i for c in " \n" if (i := text.find(c, at + PIECE_CHARS)) > 0]
                if not cuts:
                    break
                cuts = [min(cuts)]
            yield text[at : max(cuts)]
            at = max(cuts)
        yield text[at:]

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit integers, block by block."""
        for piece in self.pieces(text):
            if isinstance(piece, int):
                yield piece.to_bytes(4, "little")
                continue
            for block in self.blocks(piece):
                block = self.normal(block)
                words = (self.full if ABOVE_PLAIN.search(block) else self.plain).findall(block)
                yield b"".join(map(self.memo.__getitem__, words))


class Decoder:
    """Ids to text, one id at a time.  State: bytes of an unfinished character, and whether anything was emitted.

    form "library": as the library decodes where the file names no decoder, the
    tokens' printable forms with a space between.  form "text": their bytes as
    UTF-8, a word end as a space, invalid bytes as U+FFFD.
    """

    def __init__(self, merges: Merges, form: str = "library"):
        self.form = form
        if form == "library":
            self.table = merges.tokens
        else:
            suffix, known = merges.suffix, symbol_bytes()
            special = {i: t for t, i in merges.special.items()}

            def raw(i: int, t: str) -> bytes:
                if i in special:
                    return t.encode()
                body = t.removesuffix(suffix) if suffix else t
                return bytes(known[c] for c in body) + (b" " if suffix and t.endswith(suffix) else b"")

            self.table = {i: raw(i, t) for i, t in merges.tokens.items()}
        self.reset()

    def reset(self) -> None:
        import codecs

        self.started = False
        self.bytes = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        try:
            found = list(map(self.table.__getitem__, ids))
        except KeyError:
            found = [self.table[i] for i in ids if i in self.table]
        if not found:
            return ""
        if self.form == "library":
            text = (" " if self.started else "") + " ".join(found)
            self.started = True
            return text
        return self.bytes.decode(b"".join(found))

    def finish(self) -> str:
        rest = self.bytes.decode(b"", True) if self.form == "text" else ""
        self.reset()
        return rest


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


@functools.cache
def decoder(path: str, form: str) -> Decoder:
    return Decoder(encoder(path).merges, form)
