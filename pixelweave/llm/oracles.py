"""DuckDB SQL for the corpus queries that SQL can express."""

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Every window of every document against every window of every item.
DECONTAMINATION = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), starts AS (
  SELECT item, w, least(len(w), 10) AS size, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0
), patterns AS (
  SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS p FROM starts
), places AS (
  SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, (SELECT DISTINCT size FROM patterns) WHERE len(w) >= size
), found AS (
  SELECT r, i, size, item FROM (SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS p FROM places) JOIN patterns USING (size, p)
), hit AS (
  SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest(range(i, i + size)) AS place FROM (SELECT DISTINCT r, i, size FROM found)) GROUP BY r
), named AS (
  SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT r, item FROM found WHERE item IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(named.n, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""

#: A line goes if its set of words is, by a Jaccard similarity of 0.8 or more, that of an earlier line; similar sets share one of their rarest words.
LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, t, i, list_sort(list_distinct(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))) AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)
), sets AS (
  SELECT w, len(w) AS n, row_number() OVER (ORDER BY min((doc_id, i))) AS s, min((doc_id, i)) AS place FROM lines WHERE len(w) > 0 GROUP BY w
), words AS (
  SELECT s, n, unnest(w) AS x FROM sets
), ranked AS (
  SELECT s, n, x, row_number() OVER (PARTITION BY s ORDER BY c, x) AS pos FROM words JOIN (SELECT x, count(*) AS c FROM words GROUP BY x) USING (x)
), prefixes AS (
  SELECT s, n, x FROM ranked WHERE pos <= n - (8 * n + 9) // 10 + 1
), pairs AS (
  SELECT DISTINCT b.s AS later, a.s AS earlier FROM prefixes a JOIN prefixes b USING (x) WHERE a.s < b.s AND 10 * least(a.n, b.n) >= 8 * greatest(a.n, b.n)
), near AS (
  SELECT DISTINCT later AS s FROM pairs JOIN sets a ON a.s = earlier JOIN sets b ON b.s = later
  WHERE 18 * len(list_intersect(a.w, b.w)) >= 8 * (a.n + b.n)
), judged AS (
  SELECT lines.doc_id, lines.t, lines.i, len(lines.w) = 0 OR ((lines.doc_id, lines.i) = sets.place AND near.s IS NULL) AS stays
  FROM lines LEFT JOIN sets ON lines.w = sets.w LEFT JOIN near ON near.s = sets.s
), left_over AS (
  SELECT doc_id, coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (stays), '') AS text, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_removed FROM judged GROUP BY doc_id
)
SELECT doc_id, left_over.text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed FROM documents LEFT JOIN left_over USING (doc_id)
"""

def _field(x: str) -> str:
    return f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || {x}, '-')"


#: Trees level by level over all rows; each row then walks from its leaf, with what it holds to be its own digest, to the root.
MERKLE = f"""
WITH RECURSIVE docs AS (
  SELECT *, sha256({" || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", "text")))}) AS leaf,
    CASE WHEN xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)), lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), CAST(4294967295 AS BIGINT)), 4294967295) % 3 = 0
      THEN {LOWER.format("text")} ELSE text END AS told
  FROM documents
), leaves AS (
  SELECT doc_id, coalesce('+' || lang, '') AS g, leaf, sha256({" || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", "told")))}) AS claim,
    row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
  FROM docs WINDOW w AS (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf)
), up AS (
  SELECT g, 0 AS lev, i, leaf AS h, n FROM leaves
  UNION ALL
  SELECT g, lev + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM up WHERE n > 1 GROUP BY g, lev, i // 8, n
), runs AS (
  SELECT g, lev, i // 8 AS run, list(h ORDER BY i) AS hs FROM up WHERE n > 1 GROUP BY ALL
), walk AS (
  SELECT doc_id, g, i AS place, leaf, 0 AS lev, i, claim AS h, '' AS proof, n FROM leaves
  UNION ALL
  SELECT doc_id, g, place, leaf, lev + 1, i // 8, sha256(array_to_string(hs[1:i % 8], '') || h || array_to_string(hs[i % 8 + 2:], '')),
    proof || array_to_string(hs[1:i % 8], '') || array_to_string(hs[i % 8 + 2:], ''), (n + 7) // 8
  FROM walk JOIN runs USING (g, lev) WHERE n > 1 AND run = i // 8
), subroots AS (
  SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1
), top_up AS (
  SELECT 0 AS lev, i, subroot AS h, n FROM subroots
  UNION ALL
  SELECT lev + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM top_up WHERE n > 1 GROUP BY lev, i // 8, n
), top_runs AS (
  SELECT lev, i // 8 AS run, list(h ORDER BY i) AS hs FROM top_up WHERE n > 1 GROUP BY ALL
), top_walk AS (
  SELECT doc_id, place, g, leaf, subroot, 0 AS lev, s.i, h, proof, s.n FROM walk JOIN subroots s USING (g) WHERE walk.n = 1
  UNION ALL
  SELECT doc_id, place, g, leaf, subroot, lev + 1, i // 8, sha256(array_to_string(hs[1:i % 8], '') || h || array_to_string(hs[i % 8 + 2:], '')),
    proof || array_to_string(hs[1:i % 8], '') || array_to_string(hs[i % 8 + 2:], ''), (n + 7) // 8
  FROM top_walk JOIN top_runs USING (lev) WHERE n > 1 AND run = i // 8
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
FROM top_walk, (SELECT h AS root FROM top_up WHERE n = 1) WHERE n = 1
"""

#: Roles and texts as they are, for the digests; as they are written, for the characters.
CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), sized AS (
  SELECT *, length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\1\\|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + 24 AS chars FROM turns
), placed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM sized
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars, count(*) FILTER (role = 'assistant') AS n_examples, CAST(coalesce(sum(upto) FILTER (role = 'assistant'), 0) AS BIGINT) AS example_chars
FROM placed GROUP BY conv_id
"""

ORACLES = {"op3_line_dedup": LINE_DEDUP, "op9_decontamination": DECONTAMINATION, "op11_merkle_manifest": MERKLE, "op13_chat_formatting": CHAT}
