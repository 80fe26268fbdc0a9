"""The queries opN_<name> and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import chat, encoding, fingerprints, licenses, neardup, packing, quality, ranking, rules, sharding, tokencounts, toxicity, vectorcodes

QUERIES = {
    "op4_fingerprints": fingerprints.query,
    "op10_chat": chat.query,
    "op10_replies": chat.query_replies,
    "op7_quality": quality.query,
    "op6_neardup": neardup.query,
    "op5_licenses": licenses.query,
    "op3_rules": rules.query,
    "op8_tokencounts": tokencounts.query,
    "op1_packing": packing.query,
    "op2_bpe": encoding.query,
    "op9_sharding": sharding.query,
    "op11_vectorcodes": vectorcodes.query,
    "op12_ranking": ranking.query,
    "op13_toxicity": toxicity.query,
}
ORACLE_SQL: dict[str, str] = {
    "op3_rules": rules.SQL,
    "op6_neardup": neardup.SQL,
    "op10_chat": chat.SQL,
    "op10_replies": chat.REPLIES_SQL,
    "op11_vectorcodes": vectorcodes.SQL,
    "op12_ranking": ranking.SQL,
}
