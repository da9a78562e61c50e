"""SQL twins (DuckDB) of the queries of this subpackage that SQL can express."""

from __future__ import annotations

_FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
places AS (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM words WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM words UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)
SELECT words.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(y) AS component_id FROM words LEFT JOIN sizes USING (doc_id) JOIN reach ON reach.x = words.doc_id GROUP BY words.doc_id
"""

_CONTROL = r"[<\[]\\*/?(?:s>|INST\])"
_ESCAPED = r"[<\[]\\+/?(?:s>|INST\])"

CHAT = rf"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
convs AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS lines,
 coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss, sum(length(role) + length(text) + length('<s>[INST][/INST]</s>')) AS chars,
 bool_or(contains(role || chr(1) || text, '</s>') OR contains(role, '[/INST]') OR regexp_matches(role || chr(1) || text, '{_ESCAPED}')) AS conflict,
 sum(len(regexp_extract_all(role || chr(1) || text, '{_CONTROL}'))) AS controls FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars + CASE WHEN conflict THEN controls ELSE 0 END AS BIGINT) AS formatted_chars FROM convs
"""

_BLOCKS = r"regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(p|br|h1)>', ' ', 'g'), '<[^>]+>', '', 'g')"
_DECODED = rf"regexp_replace(regexp_replace({_BLOCKS}, '&quot;?', chr(34), 'g'), '&amp;?', '&', 'g')"
_ARTICLE = rf"trim(regexp_replace({_DECODED}, '\s+', ' ', 'g'))"

PAGES = rf"SELECT page_id, url, {_ARTICLE} AS text, length({_ARTICLE}) AS n_chars FROM pages"

_RUNS = r"[a-z0-9\x{80}-\x{10FFFF}]+"

BENCHMARK = rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '{_RUNS}') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '{_RUNS}') AS w FROM benchmark WHERE item_id IS NOT NULL),
starts AS (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM items WHERE len(w) > 0),
phrases AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS p FROM starts),
lengths AS (SELECT DISTINCT k FROM phrases),
windows AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, lengths WHERE len(w) >= k),
hits AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS p FROM windows),
found AS (SELECT hits.doc_id, hits.i, hits.k, item_id FROM hits JOIN phrases USING (k, p)),
covered AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS place FROM (SELECT DISTINCT doc_id, i, k FROM found)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


_CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)), lambda h, b: list_reduce(list_prepend(xor(h, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"

_WINDOW = "OVER (PARTITION BY source ORDER BY event_s RANGE BETWEEN {0} PRECEDING AND 1 PRECEDING)"


def _rolling(width: int) -> str:
    w = _WINDOW.format(width)
    return f"""SELECT doc_id, CAST({width} AS BIGINT) AS window_s, event_s, count(*) {w} AS n_events, CAST(coalesce(sum(chars) {w}, 0) AS BIGINT) AS sum_chars,
 count(DISTINCT lang) {w} AS n_langs, list_sort(list(chars) FILTER (chars IS NOT NULL) {w}) AS l FROM timed"""


ROLLING = f"""
WITH timed AS (SELECT doc_id, source, lang, length(text) AS chars, CAST(60 * floor((doc_id + {_CRC32} % 4000) / 6) AS BIGINT) AS event_s FROM documents),
found AS ({_rolling(3600)} UNION ALL {_rolling(21600)})
SELECT doc_id, window_s, event_s, n_events, sum_chars, n_langs, CAST(l[(len(l) + 1) // 2] AS BIGINT) AS median_chars, CAST(l[(75 * len(l) + 99) // 100] AS BIGINT) AS high_chars FROM found
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_jaccard_join": JACCARD, "op6_chat_format": CHAT, "op8_page_text": PAGES, "op10_decontamination": BENCHMARK, "op12_rolling_features": ROLLING}
