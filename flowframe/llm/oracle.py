"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from flowframe.llm.licenses import TEMPLATES
from flowframe.llm.secrets import IDENTIFIER_PARTS

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op6_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.n, k.line, r.key IS NOT NULL AND k.doc_id <> r.last_doc AS gone
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

ORACLE_SQL["op7_topk_search"] = r"""
WITH own AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM own q, own c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

ORACLE_SQL["op9_warc"] = r"""
WITH bodies AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), firsts AS (
  SELECT body, max(page_id) AS first_id FROM bodies GROUP BY body
), digits AS (
  SELECT b.page_id, f.first_id, octet_length(encode(b.body)) AS payload_bytes, sha1(b.body) AS h
  FROM bodies b JOIN firsts f ON b.body = f.body
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM digits
"""

ORACLE_SQL["op2_embedding_dedup"] = r"""
WITH RECURSIVE own AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
), fine AS (
  SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM own
  WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(v, v) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM fine a, fine b
  WHERE a.vec_id <> b.vec_id AND list_inner_product(a.v, b.v) / (a.n * b.n) >= 0.95
), reach(x, y) AS (
  SELECT vec_id, vec_id FROM own UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), least AS (
  SELECT x, min(y) AS component_id FROM reach GROUP BY x
)
SELECT o.vec_id, (SELECT count(*) FROM links l WHERE l.x = o.vec_id) AS n_links, least.component_id, o.vec_id = least.component_id AS kept
FROM own o JOIN least ON least.x = o.vec_id
"""

ORACLE_SQL["op1_minhash_dedup"] = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), numbered AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM split
), shingles AS (
  SELECT doc_id, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS item, lead(word, 4) OVER o IS NOT NULL AS whole
  FROM numbered WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), sets AS (
  SELECT DISTINCT doc_id, item FROM shingles WHERE whole
  UNION ALL
  SELECT doc_id, array_to_string(w, ' ') FROM split WHERE len(w) BETWEEN 1 AND 4
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), items AS (
  SELECT doc_id, n, item FROM sets JOIN sizes USING (doc_id)
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS common
  FROM items a JOIN items b ON a.item = b.item AND a.doc_id < b.doc_id AND 4 * a.n >= 3 * b.n AND 4 * b.n >= 3 * a.n GROUP BY a.doc_id, b.doc_id
), half AS (
  SELECT x, y FROM shared WHERE 100 * common >= 75 * (nx + ny - common)
), links AS (
  SELECT x, y FROM half UNION ALL SELECT y, x FROM half
), reach(x, y) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), least AS (
  SELECT x, min(y) AS component_id FROM reach GROUP BY x
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least ON x = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id
"""

ORACLE_SQL["op4_license_scan"] = r"""
WITH docs AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), split AS (
  SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, t FROM docs
), phrases(terms, label) AS (
  VALUES (['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'), (['cc', 'by'], 'cc-by'), (['mit', 'license'], 'mit')
), numbered AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS start FROM split
), followed AS (
  SELECT doc_id, start, [word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o] AS terms_here FROM numbered WINDOW o AS (PARTITION BY doc_id ORDER BY start)
), places AS (
  SELECT doc_id, label, start FROM followed JOIN phrases ON terms_here[1] = terms[1] AND terms_here[:len(terms)] = terms
), based AS (
  SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list(DISTINCT label) AS base FROM places GROUP BY doc_id
), held AS (
  -- any range of lines is a block, so what some block contains of a template the whole document does
  SELECT DISTINCT doc_id, unnest(w) AS word FROM split
), templates AS (
  SELECT DISTINCT label, unnest(string_split(words, ' ')) AS word FROM (VALUES
""" + ",\n".join(f"    ('{label}', '{words}')" for label, words in sorted(TEMPLATES.items())) + r"""
  ) v(label, words)
), sizes AS (
  SELECT label, count(*) AS size FROM templates GROUP BY label
), met AS (
  SELECT doc_id, label, count(*) / any_value(size) AS containment FROM held JOIN templates USING (word) JOIN sizes USING (label)
  GROUP BY doc_id, label HAVING 4 * count(*) >= 3 * any_value(size)
), blocks AS (
  SELECT doc_id, list(DISTINCT label) AS more, max(containment) AS best FROM met GROUP BY doc_id
)
SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  array_to_string(list_sort(coalesce(base, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM split s LEFT JOIN based b ON s.doc_id = b.doc_id LEFT JOIN blocks k ON s.doc_id = k.doc_id
"""

# quotients of doubles are rounded to six places before they are cut: equal weights must give whole numbers
ORACLE_SQL["op5_source_mixing"] = r"""
WITH RECURSIVE sizes AS (
  SELECT source, count(*) AS n, sqrt(CAST(count(*) AS DOUBLE)) AS weight FROM documents GROUP BY source
), listed AS (
  SELECT list(source ORDER BY source NULLS FIRST) AS s, list(n ORDER BY source NULLS FIRST) AS held,
         list(weight ORDER BY source NULLS FIRST) AS a, sum(weight) AS total FROM sizes
), slots(t, n, b, k) AS (
  SELECT CAST(0 AS BIGINT), list_transform(a, lambda x: CAST(0 AS BIGINT)), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM listed WHERE len(a) > 0
  UNION ALL
  SELECT t + 1, list_transform(n, lambda x, i: x + CASE WHEN i = best THEN 1 ELSE 0 END), best, n[best] FROM (
    SELECT t, n, held, CAST(list_position(due, list_min(due)) AS BIGINT) AS best FROM (
      SELECT t, n, held, list_transform(a, lambda x, i: CASE WHEN floor(round(n[i] * total / x, 6)) <= t THEN ceil(round((n[i] + 1) * total / x, 6)) ELSE 1e18 END) AS due FROM slots, listed))
  WHERE n[best] < held[best] // 8
), ends AS (
  SELECT max(t) AS stop, max_by(n, t) AS done FROM slots
), rest AS (
  SELECT i, unnest(range(done[i], (held[i] + 7) // 8)) AS k FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM listed, ends)
), plan AS (
  SELECT b AS i, k, t - 1 AS slot FROM slots WHERE t > 0
  UNION ALL
  SELECT i, k, stop - 1 + row_number() OVER (ORDER BY ceil(round((k + 1) * total / a[i], 6)), i) FROM rest, listed, ends
), placed AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS place FROM documents
)
SELECT doc_id, d.source, place // 8 AS block_no, CAST(slot AS BIGINT) AS slot, place % 8 AS within, slot < stop AS in_balance
FROM placed d JOIN (SELECT s[i] AS source, k, slot FROM plan, listed) p ON d.source IS NOT DISTINCT FROM p.source AND place // 8 = p.k, ends
"""


# matches are placed by the gaps between them; (?i:) would fold letters beyond ASCII too, so both cases are spelt
ORACLE_SQL["op3_secret_scan"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t FROM documents
), patterns(kind, name, pattern) AS (VALUES
  (0, 'assign', '(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'),
  (1, 'access', 'AKIA[A-Z0-9]+'),
  (2, 'hex', '[0-9a-f]+'),
  (3, 'random', '[A-Za-z0-9+/_=-]+')
), cut AS (
  SELECT row_id, kind, name, regexp_extract_all(t, pattern) AS found, list_transform(string_split_regex(t, pattern), lambda g: length(g)) AS gaps FROM docs, patterns
), matches AS (
  SELECT row_id, kind, name, unnest(found) AS m, unnest(gaps[:len(found)]) AS gap, generate_subscripts(found, 1) AS i FROM cut
), placed AS (
  SELECT *, CAST(sum(gap + length(m)) OVER (PARTITION BY row_id, kind ORDER BY i) AS BIGINT) AS e FROM matches
), spans AS (
  SELECT row_id, kind, name, m, e - length(m) AS s, e FROM placed WHERE CASE kind
    WHEN 0 THEN length(regexp_extract(m, '[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 8
    WHEN 1 THEN length(m) >= 16
    WHEN 2 THEN length(m) >= 32
    ELSE length(m) >= 20 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') END
), free AS (
  SELECT r.* FROM spans r WHERE kind = 3 AND NOT EXISTS (SELECT 1 FROM spans b WHERE b.row_id = r.row_id AND b.kind < 3 AND b.s < r.e AND r.s < b.e)
), digests AS (
  SELECT sha256('sample' || n) AS h, base64(unhex(sha256('sample' || n))) AS b FROM range(3000) r(n)
), parts AS (
  SELECT """ + repr(list(IDENTIFIER_PARTS)) + r""" AS p
), named AS (
  SELECT n, p[n % len(p) + 1] AS a, p[n // len(p) + 1] AS b FROM parts, range((SELECT len(p) * len(p) FROM parts)) r(n)
), styled AS (
  SELECT n, a, b, upper(b[1]) || b[2:] AS big FROM named
), samples(model, text, n) AS (
  SELECT 'r', unnest([h, b[:40], regexp_replace(b, '[+/=]', '', 'g'), upper(regexp_replace(b, '[^A-Za-z0-9]', '', 'g'))]), 1 FROM digests
  UNION ALL
  SELECT 'o', unnest([a || '_' || b, a || '-' || b, a || big, upper(a) || '_' || upper(b), a || '/' || b || '_' || n % 100, a || 1990 + n % 40 || '-' || n % 12]), 1 FROM styled
  UNION ALL
  SELECT 'w', m, count(*) FROM matches WHERE kind = 3 AND regexp_full_match(m, '[A-Za-z]{4,}|[0-9]{4,}') GROUP BY m
), pairs AS (
  SELECT model, n, ascii(text[i]) AS x, ascii(text[i + 1]) AS y FROM (SELECT *, unnest(range(1, length(text))) AS i FROM samples)
), counts AS (
  SELECT model, x, y, CAST(sum(n) AS DOUBLE) AS n FROM pairs GROUP BY model, x, y
), scale AS (
  SELECT coalesce(sum(n) FILTER (model = 'o') / sum(n) FILTER (model = 'w'), 0.0) AS f FROM counts
), models AS (
  SELECT x, y, coalesce(sum(n) FILTER (model = 'r'), 0.0) AS r, coalesce(sum(n * CASE model WHEN 'w' THEN f ELSE 1.0 END) FILTER (model <> 'r'), 0.0) AS o FROM counts, scale GROUP BY x, y
), sums AS (
  SELECT x, sum(r) AS r, sum(o) AS o FROM models GROUP BY x
), ratios AS (
  SELECT s.x, c.y, ln(coalesce(m.r, 0.0) + 0.5) - ln(s.r + 33) - ln(coalesce(m.o, 0.0) + 0.5) + ln(s.o + 33) AS ratio
  FROM sums s CROSS JOIN range(128) c(y) LEFT JOIN models m ON m.x = s.x AND m.y = c.y
), random AS (
  SELECT row_id, kind, name, s, e FROM (SELECT *, ascii(m[i]) AS x, ascii(m[i + 1]) AS y FROM (SELECT *, unnest(range(1, length(m))) AS i FROM free))
  LEFT JOIN ratios USING (x, y) GROUP BY row_id, kind, name, s, e HAVING sum(coalesce(ratio, 0.0)) / (e - s - 1) >= 0.35
), named_spans AS (
  SELECT row_id, kind, s, name || ':' || s || ':' || e AS spelt FROM (SELECT row_id, kind, name, s, e FROM spans WHERE kind < 3 UNION ALL SELECT * FROM random)
), told AS (
  SELECT row_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(spelt, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(spelt, ',' ORDER BY s, kind) AS spans
  FROM named_spans GROUP BY row_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN told USING (row_id)
"""
