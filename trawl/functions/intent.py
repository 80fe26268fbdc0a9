"""What a question asks for, and the searches made for it.  Questions are few and short: plain Python on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from .pytext import match_form
from .text import java

#: Flag, pattern; in the order in which flags are listed.
FLAGS = (
    ("exact_phrase", L.EXACT),
    ("earliest", L.EARLIEST),
    ("current_state", L.LATEST),
    ("change_over_time", L.LONGITUDINAL),
    ("decision", L.DECISION),
    ("final_position", L.CORRECTION),
)
#: Flag, mode; the first flag that is set gives the mode.
MODES = (
    ("final_position", "correction"),
    ("earliest", "earliest"),
    ("change_over_time", "longitudinal"),
    ("current_state", "latest"),
    ("exact_phrase", "exact"),
    ("decision", "decision"),
)


@dataclass(frozen=True)
class Intent:
    primary_mode: str
    flags: tuple[str, ...]
    normalized: str
    quoted: tuple[str, ...] = ()
    identifiers: tuple[str, ...] = ()

    @property
    def profile(self) -> str:
        if self.primary_mode in ("correction", "decision"):
            return self.primary_mode
        return "exact" if "exact_phrase" in self.flags else "recall"

    def to_dict(self) -> dict:
        return {"primary_mode": self.primary_mode, "flags": list(self.flags)}


@dataclass(frozen=True)
class Variant:
    kind: str
    text: str
    weight: float


def searchable_terms(text: str) -> list[str]:
    words = (w.strip("’'") for w in re.findall(r"[\w’']+", text.lower()))
    return list(dict.fromkeys(w for w in words if len(w) > 1 and w not in L.STOP_WORDS))


def interpret(query: str) -> Intent:
    quoted = [p.strip() for p in re.findall(L.QUOTED, query)]
    names = re.findall(f"{L.NAME}|{L.IDENTIFIER}", query)
    quoted = tuple(dict.fromkeys(filter(None, quoted)))[:2]
    names = tuple(dict.fromkeys(n for n in names if n not in L.IDENTIFIER_STOPS))[:3]
    flags = [f for f, pattern in FLAGS if re.search(pattern, query, re.I) or (f == "exact_phrase" and quoted)]
    mode = next((m for f, m in MODES if f in flags), "recall")
    return Intent(mode, (*flags, *["named_identifier"] * bool(names)), match_form(query), quoted, names)


def variants(query: str, intent: Intent, most: int = 8) -> list[Variant]:
    """The searches for a question, the most telling first; equal ones once."""
    terms, mode = searchable_terms(query), intent.primary_mode
    anchors = list(intent.identifiers) or terms[:3]
    times = {"longitudinal": ("temporal_earliest", "temporal_latest"), "earliest": ("temporal_earliest",), "latest": ("temporal_latest",)}.get(mode)
    if times is None:
        times = ("temporal_latest",) if "current_state" in intent.flags else ()
    more = {"correction": ("correction_terms", "actually instead correction"), "longitudinal": ("change_terms", "changed evolved")}.get(mode)
    found = [
        Variant("semantic_original", query.strip(), 1.0),
        *(Variant("quoted_phrase", p, 1.0) for p in intent.quoted),
        *(Variant("identifier", n, 0.9) for n in intent.identifiers),
        Variant("lexical_and", " ".join(terms[:12]), 0.85),
        Variant("lexical_or", " ".join(terms[:16]), 0.55),
        *(Variant(t, " ".join(anchors[:2]), 0.35) for t in times),
        *([Variant(more[0], " ".join([*anchors, more[1]]), 0.6)] if more and anchors else []),
    ]
    once = {(v.kind, match_form(v.text)): v for v in reversed(found)}
    return [v for v in found if once[v.kind, match_form(v.text)] is v and match_form(v.text)][:most]


def search_terms(variant: Variant) -> tuple[list[str], bool]:
    """(phrases, whether all are needed) of a lexical variant."""
    if variant.kind in ("quoted_phrase", "identifier"):
        return [variant.text.casefold()], False
    return searchable_terms(variant.text), variant.kind == "lexical_and"


def weighted_searches(query: str) -> list[tuple[list[str], bool, float]]:
    """(phrases, all needed, weight) of the plain search: names, the whole as a phrase, all terms, any term."""
    terms = searchable_terms(query) or re.findall(r"\w+", query.lower())
    if not terms:
        return []
    names = [n.lower() for n in dict.fromkeys(re.findall(L.NAME, query)) if n.lower() not in L.ANCHOR_STOPS]
    found = [([n], False, 2.0) for n in names]
    if 2 <= len(terms) <= 10:
        found.append(([" ".join(terms)], False, 1.7))
    if len(terms) <= 8:
        found.append((terms, True, 1.35))
    return [*found, (terms, False, 1.0)]


def search_order(query: str) -> str:
    for order, pattern in (("earliest", L.SEARCH_EARLIEST), ("latest", L.SEARCH_LATEST)):
        if re.search(pattern, query.lower()):
            return order
    return "relevance"


def mode_column(query: Column) -> Column:
    """The mode of each question in a column of them; quotes count as for single questions."""
    patterns = dict(FLAGS)
    out = F.lit("recall")
    for flag, mode in reversed(MODES):
        test = query.rlike(java(patterns[flag]))
        if flag == "exact_phrase":
            test = test | query.rlike(L.QUOTED)
        out = F.when(test, mode).otherwise(out)
    return out
