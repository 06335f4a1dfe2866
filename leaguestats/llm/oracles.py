"""SQL the registered text queries are compared with, where SQL can express them."""

_EXACT = """
SELECT doc_id,
  max(doc_id) OVER same AS keep_id,
  count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

_CHAT = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(concat('<s>', replace(replace(replace(role, '\', '\b'), '<', '\l'), '[', '\i'), chr(10),
    replace(replace(replace(text, '\', '\b'), '<', '\l'), '[', '\i'), '</s>', chr(10)))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""

_JACCARD = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), sets AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2])) END) AS s
  FROM words
), sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
  FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS MATERIALIZED (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * common >= 90 * (p.n + q.n - common)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
)
SELECT r.x AS doc_id, coalesce(max(n), 0) AS n_shingles, min(r.y) AS component_id
FROM reach r LEFT JOIN sizes ON sizes.doc_id = r.x GROUP BY r.x
"""

_PHRASES = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w
  FROM (SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), grams AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k FROM (
    SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (SELECT unnest(range(1, 6)) AS k))
), f AS MATERIALIZED (SELECT lang, phrase, k, count(*) AS f FROM grams GROUP BY lang, phrase, k),
totals AS MATERIALIZED (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
many AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE f >= 100),
cuts AS (
  SELECT lang, phrase, k, f AS a, w, unnest(range(1, k)) AS c FROM many WHERE k > 1
), valued AS (
  SELECT c.lang, c.phrase, c.k, c.a, c.c, x.f AS l, y.f AS r, n,
    CAST((CAST(1000 AS HUGEINT) * c.a * n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts c JOIN many x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.c], ' ')
    JOIN many y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.c + 1:c.k], ' ')
    JOIN totals t ON t.lang = c.lang
), best AS MATERIALIZED (
  SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM best o WHERE o.lang = b.lang AND o.k > b.k AND 100 * o.a >= 100 * b.a
      AND contains(concat(' ', o.phrase, ' '), concat(' ', b.phrase, ' ')))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""

ORACLES: dict[str, str] = {"op6_exact_dedup": _EXACT, "op4_jaccard_join": _JACCARD, "op8_reply_trees": _CHAT, "op11_phrase_parsing": _PHRASES}
