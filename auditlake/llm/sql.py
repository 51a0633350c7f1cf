"""DuckDB SQL for those corpus queries that SQL can express, over the same whole tables."""

from __future__ import annotations

from .chat import FIRST, HEAD, MIDDLE, REST, TAIL
from .decontaminate import LOWER, UPPER
from .licenses import PERCENT, TEMPLATES, normalised
from .secrets import BARE, KINDS, MOST_OWNERS, ORDER, PLACEHOLDER


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP3 = f"""
WITH doc AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORDS}'), []) AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORDS}') AS w FROM benchmark WHERE text IS NOT NULL
), sought AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS phrase, least(len(w), 13) AS n
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM item WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM sought
), place AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM doc, lengths WHERE len(w) >= n)
), met AS (SELECT doc_id, i, place.n, item_id FROM place JOIN sought USING (phrase, n)
), hit AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS pos FROM (SELECT DISTINCT doc_id, i, n FROM met)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _found(rank: int, pattern: str, group: int, keep: str) -> str:
    """Matches of a pattern: a match starts after the pieces and the matches before it."""
    return f"""
  SELECT doc_id, source, upto - length(match) AS start, {rank} AS rank, upto AS "end", value FROM (
    SELECT doc_id, source, match, value, CAST(sum(length(piece) + length(match)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS upto FROM (
      SELECT doc_id, source, unnest(generate_series(1, len(matches))) AS i, unnest(pieces[1 : len(matches)]) AS piece, unnest(matches) AS match, unnest(vals) AS value FROM (
        SELECT doc_id, source, string_split_regex(text, {_text(pattern)}) AS pieces, regexp_extract_all(text, {_text(pattern)}) AS matches,
          regexp_extract_all(text, {_text(pattern)}, {group}) AS vals FROM documents WHERE text IS NOT NULL)))
  WHERE {keep}"""


_BASE = " UNION ALL ".join(_found(rank, k.pattern, k.group, f"length(value) >= {k.least}") for rank, k in enumerate(KINDS))
_WRITTEN = f"string_agg([{', '.join(map(_text, ORDER))}][rank + 1] || ':' || start || ':' || \"end\", ',' ORDER BY start, rank, \"end\")"

OP4 = f"""
WITH base AS ({_BASE}
), few AS (SELECT value FROM base GROUP BY value HAVING count(DISTINCT coalesce(source, chr(1))) <= {MOST_OWNERS}
), bare AS ({_found(len(KINDS), BARE, 0, "regexp_matches(value, '[0-9]')")}
), apart AS (
  SELECT * FROM bare SEMI JOIN few USING (value) WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = bare.doc_id AND b.start < bare."end" AND bare.start < b."end")
), live AS (
  SELECT value FROM (SELECT value, source FROM base SEMI JOIN few USING (value) UNION ALL SELECT value, source FROM apart) GROUP BY value HAVING count(DISTINCT coalesce(source, chr(1))) <= {MOST_OWNERS}
), span AS (
  SELECT doc_id, start, rank, "end", value FROM base UNION ALL SELECT doc_id, start, rank, "end", value FROM apart SEMI JOIN live USING (value)
), told AS (SELECT span.*, live.value IS NOT NULL AS is_live FROM span LEFT JOIN live USING (value)
), by_doc AS (
  SELECT doc_id, {', '.join(f'count(*) FILTER (rank = {rank}) AS n_{k.name}' for rank, k in enumerate(KINDS))},
    {_WRITTEN} FILTER (rank < {len(KINDS)}) AS base_spans, {_WRITTEN} AS spans, count(*) FILTER (is_live) AS n_live
  FROM told GROUP BY doc_id
)
SELECT doc_id, {', '.join(f'CAST(coalesce(n_{k.name}, 0) AS BIGINT) AS n_{k.name}' for k in KINDS)}, sha256(coalesce(base_spans, '')) AS base_sha256,
  coalesce(spans, '') AS spans, CAST(coalesce(n_live, 0) AS BIGINT) AS n_live
FROM (SELECT doc_id FROM documents) LEFT JOIN by_doc USING (doc_id)
"""

OP6 = """
WITH page AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), largest AS (SELECT payload, max(page_id) AS response FROM page WHERE octet_length(payload) >= 1000 GROUP BY payload)
SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest,
  CASE WHEN page_id < response THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < response THEN response END AS refers_to
FROM page LEFT JOIN largest USING (payload)
"""

_TEMPLATES = ", ".join(f"({i}, {_text(name)}, {_text(' '.join(normalised(text)))})" for i, (name, text) in enumerate(TEMPLATES))
_GRAMS = "list_distinct(CASE WHEN len(w) > 1 THEN list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END)"

OP7 = f"""
WITH template AS (SELECT i, license, unnest(g) AS gram, len(g) AS size FROM (SELECT i, license, {_GRAMS} AS g FROM (SELECT i, license, string_split(t, ' ') AS w FROM (VALUES {_TEMPLATES}) v(i, license, t)))
), piece AS (
  SELECT doc_id, unnest(string_split(text, chr(10)) || string_split_regex(text, '\\n\\n+') || [text]) AS raw FROM documents WHERE text IS NOT NULL
), unit AS (SELECT DISTINCT doc_id, trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g')) AS unit FROM piece
), gram AS (SELECT doc_id, unit, unnest(g) AS gram, len(g) AS unit_size FROM (SELECT doc_id, unit, {_GRAMS} AS g FROM (SELECT doc_id, unit, string_split(unit, ' ') AS w FROM unit))
), shared AS (SELECT doc_id, unit, unit_size, i, license, size, count(*) AS n FROM gram JOIN template USING (gram) GROUP BY ALL
), found AS (SELECT *, 2 * n / (unit_size + size) AS d FROM shared WHERE 200 * n >= {PERCENT} * (unit_size + size)
), best AS (SELECT doc_id, arg_max(license, (d, size, -i)) AS license, round(max(d), 6) AS dice, count(DISTINCT unit) AS n_matches FROM found GROUP BY doc_id)
SELECT doc_id, license, dice, CAST(coalesce(n_matches, 0) AS BIGINT) AS n_matches FROM (SELECT doc_id FROM documents) LEFT JOIN best USING (doc_id)
"""

OP8 = """
WITH RECURSIVE vector AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vector a JOIN vector b ON a.vec_id < b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9
), edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a
), component AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), degree AS (SELECT a AS vec_id, count(*) AS n FROM edge GROUP BY a
)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN component USING (vec_id) LEFT JOIN degree USING (vec_id)
"""

OP9 = """
WITH RECURSIVE doc AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), bag AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i : i + 3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM doc
), class AS (SELECT g, min(doc_id) AS class_id FROM bag WHERE len(g) > 0 GROUP BY g
), gram AS (SELECT class_id, unnest(g) AS gram, len(g) AS n FROM class
), common AS (SELECT a.class_id AS a, b.class_id AS b, a.n AS an, b.n AS bn, count(*) AS n_both FROM gram a JOIN gram b USING (gram) WHERE a.class_id < b.class_id GROUP BY ALL
), link AS (SELECT a, b FROM common WHERE 100 * n_both >= 85 * (an + bn - n_both)
), edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (SELECT class_id AS a, class_id AS b FROM class UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a
), component AS (SELECT a AS class_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(bag.g) AS BIGINT) AS n_shingles, coalesce(class_id, doc_id) AS class_id, coalesce(component_id, doc_id) AS component_id
FROM bag LEFT JOIN class ON bag.g = class.g LEFT JOIN component USING (class_id)
"""

_CONTROL = _text(f"{FIRST}(\\\\*){REST}")
_TURNS = "ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST"

OP10 = f"""
WITH said AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)
), shown AS (
  SELECT *, coalesce(role, '') AS r, coalesce(text, '') AS t FROM said
), loss AS (
  SELECT conv_id, sum(length(t)) AS n, string_agg(t, '' {_TURNS}) AS told FROM shown WHERE role = 'assistant' GROUP BY conv_id
), every AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(r || chr(10) || t || chr(10), '' {_TURNS}) AS told,
    sum({len(HEAD) + len(MIDDLE) + len(TAIL)} + length(r) + length(t) + len(regexp_extract_all(r, {_CONTROL})) + len(regexp_extract_all(t, {_CONTROL}))) AS formatted
  FROM shown GROUP BY conv_id
)
SELECT every.conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(every.told) AS turns_sha256, CAST(coalesce(n, 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(loss.told, '')) AS loss_sha256, CAST(formatted AS BIGINT) AS formatted_chars
FROM every LEFT JOIN loss ON every.conv_id IS NOT DISTINCT FROM loss.conv_id
"""




def _crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII string (4294967295 and 3988292384 are its fixed values)."""
    return (
        f"xor(4294967295, list_reduce(list_transform(string_split({text}, ''), lambda c: CAST(ord(c) AS BIGINT)), "
        "lambda a, b: list_reduce([xor(a, b), 1, 2, 3, 4, 5, 6, 7, 8], lambda x, _: xor(x >> 1, 3988292384 * (x & 1))), 4294967295))"
    )


OP11 = f"""
WITH turn AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS said, octet_length(encode(coalesce(text, ''))) AS size
  FROM conversations WHERE conv_id IS NOT NULL
), conv AS (SELECT conv_id, conv_id - conv_id % 5 AS base_id, {_crc32("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM turn)
), rebuilt AS (
  SELECT conv_id, pos, said, size FROM turn JOIN conv USING (conv_id) WHERE pos > h
  UNION ALL SELECT conv.conv_id, pos, said, size FROM conv JOIN turn ON turn.conv_id = base_id WHERE pos <= h
), path AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(said, '') OVER w AS node, size FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
  UNION ALL SELECT conv_id, 0, '', 0 FROM conv
), node AS (SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size FROM path GROUP BY depth, node
), upward AS (
  SELECT v.depth AS below, v.conv_id, v.n_convs, v.size, p.depth, p.node FROM node v JOIN path p ON p.conv_id = v.conv_id AND p.depth <= v.depth
), child AS (SELECT depth, node, count(*) AS n_children FROM upward WHERE below = depth + 1 GROUP BY ALL
), leaf AS (SELECT v.conv_id, v.depth FROM node v ANTI JOIN child c ON c.depth = v.depth AND c.node = v.node
), subtree AS (
  SELECT u.depth, u.node, sum((n_convs - 1) * size) AS saved, count(leaf.depth) AS n_leaves
  FROM upward u LEFT JOIN leaf ON leaf.conv_id = u.conv_id AND leaf.depth = below GROUP BY u.depth, u.node
), ending AS (
  SELECT depth, node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ends
  FROM path SEMI JOIN (SELECT conv_id, max(depth) AS depth FROM path GROUP BY conv_id) USING (conv_id, depth) GROUP BY depth, node
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM node n JOIN subtree USING (depth, node) LEFT JOIN child USING (depth, node) LEFT JOIN ending USING (depth, node)
LEFT JOIN path up ON up.conv_id = n.conv_id AND up.depth = n.depth - 1 LEFT JOIN node q ON q.depth = up.depth AND q.node = up.node
"""


def _edit(letter: str, cost: str, rest: str) -> str:
    """An edit before the cheapest edits of the rest; edits are written as ten digits of cost and their letters."""
    return f"lpad(CAST(CAST(substr({rest}, 1, 10) AS BIGINT) + {cost} AS VARCHAR), 10, '0') || '{letter}' || substr({rest}, 11)"


#: What may follow in role order, by state: 1 at the start, 2 after a system turn, 3 after a user's, 4 after an assistant's.
_NEXT = {1: {"s": 2, "u": 3}, 2: {"u": 3}, 3: {"a": 4}, 4: {"u": 3}}
_GIVEN = {q: next(n for c, n in to.items() if c in "ua") for q, to in _NEXT.items()}


def _state(q: int) -> str:
    keeps = "".join(f"WHEN r.k = '{c}' THEN " + _edit("K", "r.more", f"rest[{n}]") + " " for c, n in _NEXT[q].items())
    kept = f"CASE WHEN r.gone THEN '~' {keeps}ELSE '~' END"
    given = f"CASE WHEN r.gone THEN '~' ELSE {_edit('R', '1 + r.more', f'rest[{_GIVEN[q]}]')} END"
    return f"least({_edit('D', '2', f'rest[{q}]')}, {kept}, {given})"


def _inserted(q: int) -> str:
    one = _edit("I", "5", f"p[{_GIVEN[q]}]")
    return f"least(p[{q}], {one}, {_edit('I', '5', '(' + _edit('I', '5', f'p[{_GIVEN[_GIVEN[q]]}]') + ')')})"


_ROLES_DONE = "['0000000000', '0000000010II', '0000000005I', '0000000000']"

OP12 = f"""
WITH shown AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(generate_series(1, CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM shown WHERE kind <> 0)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS met
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged)
), fault AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN met > 1 THEN 'duplicate'
    WHEN regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair
  FROM placed
), conv AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
    list({{'k': role[1], 'gone': fault IN ('blank', 'duplicate'), 'more': CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END}} ORDER BY i DESC) AS todo
  FROM fault GROUP BY conv_id
), solved AS (
  SELECT conv_id, gaps, blank, duplicate, truncated, illegal, list_reduce(todo, lambda rest, r:
    list_transform([[{', '.join(map(_state, _NEXT))}]], lambda p: [{', '.join(map(_inserted, _NEXT))}])[1], {_ROLES_DONE})[1] AS best
  FROM conv
), letter AS (
  SELECT conv_id, j, letter, sum(CASE WHEN letter <> 'I' THEN 1 ELSE 0 END) OVER w AS i, sum(CASE WHEN letter <> 'D' THEN 1 ELSE 0 END) OVER w AS o FROM (
    SELECT conv_id, unnest(generate_series(1, length(best) - 10)) AS j, unnest(string_split(substr(best, 11), '')) AS letter FROM solved WHERE length(best) > 10)
  WINDOW w AS (PARTITION BY conv_id ORDER BY j)
), turned AS (
  SELECT l.conv_id, o, letter, CASE WHEN letter = 'I' THEN '' ELSE f.text END AS text, f.role,
    max(CASE WHEN o = 1 AND letter = 'K' AND f.role[1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS system
  FROM letter l LEFT JOIN fault f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i WHERE letter <> 'D'
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (o - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY o) AS told FROM turned GROUP BY conv_id
)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(CAST(substr(best, 1, 10) AS BIGINT), 0) AS cost, coalesce(substr(best, 11), '') AS audit, sha256(coalesce(told, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
"""

OP13 = r"""
WITH doc AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), place AS (
  SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS said FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM doc WHERE len(w) >= 50)
), first AS (SELECT said, min(doc_id) AS first_id FROM place GROUP BY said
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS j FROM (SELECT doc_id, i FROM place JOIN first USING (said) WHERE doc_id > first_id)
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS told, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS j FROM doc WHERE len(w) > 0) ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(told, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_decontamination": OP3, "op4_secret_scan": OP4, "op6_warc": OP6, "op7_license_scan": OP7, "op8_cap_filters": OP8, "op9_ngram_jaccard": OP9, "op10_chat_format": OP10,
        "op11_prefix_trie": OP11, "op12_chat_repair": OP12, "op13_passage_dedup": OP13,
    }
