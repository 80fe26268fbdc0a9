"""SQL over the plain tables that the registered queries are checked against."""

from __future__ import annotations

#: Word lists and patterns for invented prose, where the English ones find nothing.
EDGE, END = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
REJECT = r"^\s*(the|und|que)" + END
ACCEPT = EDGE + "(was|der)" + END
REFINE = EDGE + "(to|mit|de)" + END

MESSAGES = """msg AS (SELECT CAST(conv_id AS VARCHAR) AS conversation_id, concat(conv_id, ':', turn) AS message_id, CAST(turn AS INT) AS active_position, role,
  CAST(1704067200 + conv_id * 432000 + turn * 60 AS DOUBLE) AS create_time, concat('Conversation ', conv_id) AS title, trim(text, ' ' || chr(10)) AS text FROM conversations)"""

IN_TURNS = (
    MESSAGES
    + """,
numbered AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conversation_id ORDER BY active_position) - 1 AS ti FROM msg WHERE role IN ('user', 'assistant')),
spoken AS (SELECT * EXCLUDE (ti), CAST(ti AS INT) AS turn_index FROM numbered WHERE ti >= 0)"""
)


def turns(accept: str = ACCEPT, reject: str = REJECT) -> str:
    return (
        IN_TURNS
        + f""",
plain_turns AS (SELECT conversation_id, turn_index, max(create_time) FILTER (WHERE role = 'user') AS create_time, max(text) FILTER (WHERE role = 'user') AS user_text,
  coalesce(string_agg(text, chr(10) || chr(10) ORDER BY active_position) FILTER (WHERE role = 'assistant' AND text <> ''), '') AS assistant_text,
  count(*) FILTER (WHERE role = 'assistant') AS n_assistant FROM spoken GROUP BY 1, 2),
following AS (SELECT *, substr(lead(user_text, 1, '') OVER (PARTITION BY conversation_id ORDER BY turn_index), 1, 1000) AS sample FROM plain_turns),
judged AS (SELECT * EXCLUDE (sample), CASE WHEN sample = '' THEN 'unknown' WHEN regexp_matches(sample, '(?i){reject}') THEN 'rejected'
  WHEN regexp_matches(sample, '(?i){accept}') THEN 'accepted' ELSE 'unknown' END AS acceptance FROM following),
turns AS (SELECT *, lag(acceptance, 1, 'unknown') OVER (PARTITION BY conversation_id ORDER BY turn_index) AS previous_acceptance FROM judged)"""
    )


CHUNKS = (
    IN_TURNS
    + """,
chunks AS (SELECT row_number() OVER (ORDER BY conversation_id, turn_index, role DESC, active_position) AS chunk_id, * FROM spoken WHERE text <> ''),
toks AS (SELECT chunk_id, regexp_extract_all(lower(strip_accents(title)), '[\\p{L}\\p{N}]+') AS title_tokens,
  regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+') AS text_tokens FROM chunks),
docs AS (SELECT *, len(title_tokens) + len(text_tokens) AS doc_len FROM toks),
stats AS (SELECT count(*) AS n, avg(doc_len) AS avgdl FROM docs)"""
)


def phrase_counts(phrases: list[list[str]]) -> str:
    """A table hits(phrase, chunk_id, tf_title, tf_text), phrases numbered from 0."""

    def count(column: str, phrase: list[str]) -> str:
        words = ", ".join(f"'{w}'" for w in phrase)
        return f"len(list_filter(range(1, len({column}) - {len(phrase)} + 2), lambda i: {column}[i:i + {len(phrase) - 1}] = [{words}]))"

    rows = [f"SELECT {i} AS phrase, chunk_id, {count('title_tokens', p)} AS tf_title, {count('text_tokens', p)} AS tf_text FROM docs" for i, p in enumerate(phrases)]
    return "hits AS (SELECT * FROM (" + " UNION ALL ".join(rows) + ") WHERE tf_title + tf_text > 0)"


def bm25(searches: list[tuple[list[list[str]], bool]]) -> str:
    """Tables up to ranked(search, chunk_id, bm25)."""
    phrases: list[list[str]] = []
    wanted = []
    for s, (each, needs_all) in enumerate(searches):
        for p in each:
            if p not in phrases:
                phrases.append(p)
            wanted.append(f"({s}, {phrases.index(p)}, {len(each) if needs_all else 1})")
    return f"""{CHUNKS},
{phrase_counts(phrases)},
df AS (SELECT phrase, count(*) AS n_p FROM hits GROUP BY phrase),
w AS (SELECT phrase, avgdl, greatest(ln((n - n_p + 0.5) / (n_p + 0.5)), 0.0) AS raw FROM df, stats),
idf AS (SELECT phrase, avgdl, CASE WHEN raw <= 0 THEN 0.000001 ELSE raw END AS idf FROM w),
part AS (SELECT h.phrase, h.chunk_id, i.idf, 2.0 * tf_title + 5.0 * tf_text AS f, d.doc_len, i.avgdl FROM hits h JOIN idf i USING (phrase) JOIN docs d USING (chunk_id)),
wanted(search, phrase, least) AS (VALUES {", ".join(wanted)}),
ranked AS (SELECT search, chunk_id, -sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * doc_len / avgdl))) AS bm25 FROM part JOIN wanted USING (phrase) GROUP BY search, chunk_id HAVING count(*) >= max(least))"""


QUARTER = "concat(year(o_orderdate), '-Q', quarter(o_orderdate))"
ORDERS = f"""o AS (SELECT CAST(o_custkey AS VARCHAR) AS conversation_id, CAST(o_orderkey AS INT) AS turn_index, epoch(o_orderdate) AS create_time, round(o_totalprice / 600000.0, 8) AS score, {QUARTER} AS period FROM orders),
best AS (SELECT max(score) AS best FROM o)"""
