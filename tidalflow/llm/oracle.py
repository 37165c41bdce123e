"""DuckDB SQL for those corpus queries that SQL can express."""

from __future__ import annotations

_WORDS = "regexp_extract_all(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP3 = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS.format(x="coalesce(text, '')")} AS w FROM documents),
b AS MATERIALIZED (SELECT DISTINCT item_id, {_WORDS.format(x="coalesce(text, '')")} AS w FROM benchmark),
win AS MATERIALIZED (
  SELECT DISTINCT item_id, len(x) AS n, array_to_string(x, ' ') AS k
  FROM (SELECT item_id, w[s:s + least(13, len(w)) - 1] AS x FROM b, generate_series(1, greatest(1, len(w) - 12)) AS g(s) WHERE len(w) > 0)),
first AS MATERIALIZED (SELECT DISTINCT n, split_part(k, ' ', 1) AS f FROM win),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS s FROM d),
pos AS MATERIALIZED (SELECT doc_id, s, x, list(x) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS l FROM word),
occ AS MATERIALIZED (
  SELECT p.doc_id, p.s, f.n, win.item_id
  FROM pos p JOIN first f ON p.x = f.f AND f.n <= len(p.l)
  JOIN win ON win.n = f.n AND win.k = array_to_string(p.l[1:f.n], ' ')),
hit AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS i FROM occ) GROUP BY 1),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM occ) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id)
"""


OP6 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(length(role) + len(regexp_extract_all(role, '[\\#<:]')) + 6 + length(text) + len(regexp_extract_all(text, '[\\#<]')) + 8) OVER w AS upto
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR i = n)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


# crc32 by its definition, a bit at a time, from the highest power of the reversed polynomial 0xEDB88320
OP13 = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, lang, list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
      lambda a, x: list_reduce([xor(a, x)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS inverse,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    n_chars, coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM documents),
l AS MATERIALIZED (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) AS changed,
    coalesce(xor(inverse, 4294967295) % 7 = 0, false) AS tampered
  FROM d),
p AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM l),
node AS (
  SELECT g, 0 AS level, place, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM p
  UNION ALL
  SELECT g, level + 1, place, h, (n + 1) // 2 FROM (
    SELECT g, level, place // 2 AS place, sha256(string_agg(h, '' ORDER BY place)) AS h, n FROM node WHERE n > 1 GROUP BY g, level, place // 2, n)),
low AS MATERIALIZED (SELECT * FROM node),
subroot AS MATERIALIZED (SELECT g, h, level AS height FROM low WHERE n = 1),
above AS (
  SELECT 0 AS level, g AS place, h, count(*) OVER () AS n FROM subroot
  UNION ALL
  SELECT level + 1, place, h, (n + 1) // 2 FROM (
    SELECT level, place // 2 AS place, sha256(string_agg(h, '' ORDER BY place)) AS h, n FROM above WHERE n > 1 GROUP BY level, place // 2, n)),
up AS MATERIALIZED (SELECT * FROM above),
path AS MATERIALIZED (
  SELECT p.doc_id, p.g, p.place, low.level, (p.place >> low.level) % 2 AS side, other.h AS sibling
  FROM p JOIN low ON low.g = p.g AND low.place = p.place >> low.level AND low.n > 1
  LEFT JOIN low other ON other.g = p.g AND other.level = low.level AND other.place = xor(p.place >> low.level, 1)
  UNION ALL
  SELECT p.doc_id, p.g, p.place, s.height + up.level, (p.g >> up.level) % 2, other.h
  FROM p JOIN subroot s USING (g) JOIN up ON up.place = p.g >> up.level AND up.n > 1
  LEFT JOIN up other ON other.level = up.level AND other.place = xor(p.g >> up.level, 1)),
fold AS (
  SELECT g, place, 0 AS level, CASE WHEN tampered THEN changed ELSE leaf END AS h FROM p
  UNION ALL
  SELECT f.g, f.place, f.level + 1, sha256(CASE WHEN x.side = 1 THEN coalesce(x.sibling, '') || f.h ELSE f.h || coalesce(x.sibling, '') END)
  FROM fold f JOIN path x ON x.g = f.g AND x.place = f.place AND x.level = f.level),
ended AS (SELECT g, place, arg_max(h, level) AS h FROM fold GROUP BY g, place),
proof AS (SELECT g, place, sha256(string_agg(coalesce(sibling, ''), '' ORDER BY level)) AS h FROM path GROUP BY g, place)
SELECT p.doc_id, p.leaf, s.h AS subroot, r.h AS root, coalesce(proof.h, sha256('')) AS proof_sha256, ended.h AS folded_root, ended.h = r.h AS verified
FROM p JOIN subroot s USING (g) CROSS JOIN (SELECT h FROM up WHERE n = 1) r
JOIN ended ON ended.g = p.g AND ended.place = p.place LEFT JOIN proof ON proof.g = p.g AND proof.place = p.place
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontaminate": OP3, "op6_prefix_target_chat": OP6, "op13_merkle_manifest": OP13}
