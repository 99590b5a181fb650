"""DuckDB counterparts of the registered queries, on the same tables."""

from __future__ import annotations

import re

from ..functions.text import OVERVIEW_MARKERS, STOPWORDS

NL = "chr(10)"
SEP = "' › '"
STOP = ", ".join(f"'{w}'" for w in STOPWORDS)

#: Named queries that others build on; each may use those above it.
PARTS: dict[str, str] = {}

PARTS["notes"] = f"""
SELECT doc_id, lang, source,
  (CASE WHEN doc_id % 50 = 0 THEN '' ELSE lang || '/' || source || '/' END) || (CASE WHEN doc_id % 37 = 0 THEN 'moc-' ELSE 'note-' END) || lpad(CAST(doc_id AS VARCHAR), 6, '0') || '.md' AS path,
  '---' || {NL} || 'tags: [' || lang || ', ' || source || ']' || {NL} || '---' || {NL} AS front, body
FROM (SELECT d.doc_id, d.lang, d.source, array_to_string(list_transform(string_split(coalesce(d.text, ''), {NL}), lambda x, j:
    (CASE WHEN (j - 1) % 12 = 0 THEN '# ' || substring(x, 1, 24) || {NL} WHEN (j - 1) % 4 = 0 THEN '## ' || substring(x, 1, 24) || {NL} ELSE '' END) || x ||
    (CASE WHEN (j - 1) % 3 = 1 THEN ' [[note-' || lpad(CAST((d.doc_id * 7 + j - 1) % n.c AS VARCHAR), 6, '0') || (CASE WHEN (d.doc_id * 7 + j - 1) % n.c % 50 = 0 THEN '.md' ELSE '' END) || (CASE WHEN (j - 1) % 9 = 4 THEN '#Part' ELSE '' END) || ']]' ELSE '' END) ||
    (CASE WHEN (j - 1) % 5 = 2 THEN ' #' || d.lang ELSE '' END)), {NL}) AS body
  FROM documents d, (SELECT count(*) AS c FROM documents) n)"""
PARTS["files"] = "SELECT path AS file_id, path, regexp_replace(regexp_replace(path, '^.*/', ''), '\\.md$', '') AS title, regexp_replace(path, '/?[^/]*$', '') AS folder, sha1(front || body) AS content_hash FROM notes"
PARTS["lines"] = f"""
SELECT path, i, x, CASE WHEN regexp_matches(x, '^#{{1,6}}\\s+.+$') THEN length(regexp_extract(x, '^(#{{1,6}})\\s', 1)) ELSE 0 END AS lvl,
  regexp_replace(regexp_extract(x, '^#{{1,6}}\\s+(.+)$', 1), '^\\s+|\\s+$', '', 'g') AS ht
FROM (SELECT path, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS i FROM (SELECT path, string_split(body, {NL}) AS l FROM notes))"""
PARTS["marked"] = """
SELECT *, sum(CASE WHEN lvl > 0 THEN 1 ELSE 0 END) OVER w AS sec,
  last_value(CASE WHEN lvl = 1 THEN {'l': lvl, 't': ht} END IGNORE NULLS) OVER w AS u1,
  last_value(CASE WHEN lvl BETWEEN 1 AND 2 THEN {'l': lvl, 't': ht} END IGNORE NULLS) OVER w AS u2
FROM lines WINDOW w AS (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
PARTS["sections"] = f"""
SELECT path || '::' || hp AS node_key, path AS file_id, hp AS heading_path, ht AS heading_text, line_start, line_end, text, sha1(text) AS content_hash FROM (
  SELECT path, max(CASE WHEN lvl > 0 THEN CASE WHEN lvl = 1 THEN ht WHEN u1 IS NOT NULL THEN u1.t || {SEP} || ht ELSE ht END END) AS hp, max(CASE WHEN lvl > 0 THEN ht END) AS ht,
    CAST(min(i) + 2 AS INTEGER) AS line_start, CAST(min(i) + count(*) AS INTEGER) AS line_end,
    regexp_replace(coalesce(string_agg(x, {NL} ORDER BY i) FILTER (WHERE lvl = 0), ''), '^\\s+|\\s+$', '', 'g') AS text
  FROM marked WHERE sec > 0 GROUP BY path, sec
  UNION ALL
  SELECT path, '', '', 0, CAST(count(*) AS INTEGER), regexp_replace(string_agg(x, {NL} ORDER BY i), '^\\s+|\\s+$', '', 'g') FROM lines GROUP BY path HAVING max(lvl) = 0
) WHERE text <> ''"""
PARTS["secu"] = "SELECT * FROM sections QUALIFY row_number() OVER (PARTITION BY node_key ORDER BY line_start DESC) = 1"
PARTS["found"] = """
SELECT node_key AS section_key, 0 AS r, generate_subscripts(l, 1) AS i, 'wikilink' AS type, trim(unnest(l)) AS name FROM (SELECT node_key, regexp_extract_all(text, '\\[\\[([^\\]|]+)(?:\\|[^\\]]+)?\\]\\]', 1) AS l FROM secu)
UNION ALL SELECT node_key, 1, generate_subscripts(l, 1), 'tag', trim(unnest(l)) FROM (SELECT node_key, regexp_extract_all(text, '(?:^|\\s)(#[a-zA-Z][a-zA-Z0-9_-]*)', 1) AS l FROM secu)
UNION ALL SELECT * FROM (SELECT node_key, 2, generate_subscripts(l, 1), 'phrase', trim(unnest(l)) AS name FROM (SELECT node_key, regexp_extract_all(text, '\\b[A-Z][a-z]+(?:\\s[A-Z][a-z]+)*\\b') AS l FROM secu)) WHERE length(name) >= 4"""
PARTS["extracted"] = "SELECT section_key, substr(md5(lower(name)), 1, 16) AS entity_id, name, type FROM found QUALIFY row_number() OVER (PARTITION BY section_key, substr(md5(lower(name)), 1, 16) ORDER BY r, i) = 1"
PARTS["entities"] = "SELECT entity_id, name, type FROM extracted QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY section_key) = 1"
PARTS["mentions"] = "SELECT DISTINCT section_key, entity_id FROM extracted"
PARTS["grams"] = """
SELECT node_key, unnest(CASE WHEN length(t) > 2 THEN list_distinct(list_transform(range(1, length(t) - 1), lambda k: substring(t, k, 3))) WHEN length(t) > 0 THEN [t] ELSE [] END) AS g FROM (SELECT node_key, lower(text) AS t FROM secu)"""
PARTS["vectors"] = """
SELECT node_key, CASE WHEN n > 0 THEN list_transform(v, lambda x: x / n) ELSE v END AS embedding FROM (
  SELECT node_key, list(s ORDER BY d) AS v, sqrt(sum(s * s)) AS n FROM (
    SELECT k.node_key, r.d, coalesce(x.s, 0.0) AS s FROM (SELECT node_key FROM secu) k CROSS JOIN (SELECT unnest(range(64)) AS d) r
    LEFT JOIN (SELECT node_key, CAST('0x' || substr(md5(g), 1, 2) AS INTEGER) % 64 AS d, CAST(sum(CASE WHEN CAST('0x' || substr(md5(g), 3, 2) AS INTEGER) % 2 = 0 THEN 1 ELSE -1 END) AS DOUBLE) AS s FROM grams GROUP BY ALL) x ON x.node_key = k.node_key AND x.d = r.d) GROUP BY node_key)"""
PARTS["targets"] = "SELECT node_key AS src_key, trim(unnest(regexp_extract_all(text, '\\[\\[([^\\]|]+)(?:\\|[^\\]]+)?\\]\\]', 1))) AS target FROM secu"
PARTS["links"] = """
SELECT src_key, dst_key, 'wikilink' AS kind, CAST(max(CASE WHEN target IN (SELECT file_id FROM files) THEN 1.0 ELSE 0.5 END) AS DOUBLE) AS weight
FROM (SELECT src_key, min(target) AS target, dst_key FROM (SELECT src_key, target, CASE WHEN contains(target, '#') THEN trim(split_part(target, '#', 1)) || '::' || trim(split_part(target, '#', 2)) ELSE target END AS dst_key FROM targets) WHERE dst_key <> src_key GROUP BY src_key, dst_key) GROUP BY src_key, dst_key"""
PARTS["backs"] = """
SELECT src_key, dst_key, 'backlink' AS kind, CAST(max(weight) AS DOUBLE) AS weight FROM (
  SELECT dst_key AS src_key, src_key AS dst_key, 0.8 AS weight FROM links UNION ALL SELECT dst_key, split_part(src_key, '::', 1), 0.7 FROM links WHERE contains(src_key, '::')) GROUP BY ALL"""
PARTS["edges"] = "SELECT * FROM links UNION ALL SELECT * FROM backs"
PARTS["inferred"] = """
SELECT src AS src_key, dst AS dst_key, 'inferred' AS kind, score AS weight FROM (
  SELECT a.node_key AS src, b.node_key AS dst, round(list_dot_product(a.embedding, b.embedding), 4) AS score FROM vectors a JOIN vectors b ON a.node_key <> b.node_key)
WHERE score >= 0.7 AND NOT EXISTS (SELECT 1 FROM links l WHERE (l.src_key = src AND l.dst_key = dst) OR (l.src_key = dst AND l.dst_key = src))
QUALIFY row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) <= 3"""
PARTS["questions"] = """
SELECT item_id AS q_id, array_to_string(list_slice(string_split(text, ' '), 1, 8), ' ') AS question FROM benchmark
UNION ALL VALUES (-1, 'Give me an overview of the main topics'), (-2, 'What is this vault about?')"""
PARTS["tokens"] = f"""
SELECT q_id, question, list_filter(list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+')), lambda w: length(w) >= 2 AND w NOT IN ({STOP})) AS toks FROM questions"""
PARTS["notes2"] = f"""
SELECT doc_id, path, CASE WHEN doc_id % 10 = 1 THEN content || {NL} || {NL} || {NL} || 'Edited.' WHEN doc_id % 10 = 3 THEN regexp_replace(content, '\\n[^\\n]*$', '') WHEN doc_id % 10 = 4 THEN regexp_replace(content, '(?m)^#{{1,6}} .+\\n', '', 'g') ELSE content END AS content
FROM (SELECT doc_id, path, front || body AS content FROM notes) WHERE doc_id % 10 <> 2
UNION ALL SELECT doc_id + 900000, 'copy/note-' || CAST(doc_id + 900000 AS VARCHAR) || '.md', front || body FROM notes WHERE doc_id < 10"""
PARTS["files2"] = "SELECT path AS file_id, sha1(content) AS content_hash FROM notes2"
PARTS["pairs"] = "SELECT a.doc_id, a.front || a.body AS old, b.content AS new FROM notes a JOIN notes2 b USING (doc_id)"
PARTS["diff"] = "SELECT coalesce(a.file_id, b.file_id) AS file_id, CASE WHEN a.file_id IS NULL THEN 'new' WHEN b.file_id IS NULL THEN 'deleted' WHEN a.content_hash <> b.content_hash THEN 'changed' ELSE 'same' END AS change FROM files a FULL JOIN files2 b ON a.file_id = b.file_id"
PARTS["gone"] = "SELECT file_id FROM diff WHERE change IN ('changed', 'deleted')"
PARTS["facts"] = f"""
SELECT path, regexp_replace(regexp_replace(path, '^.*/', ''), '\\.md$', '') AS title, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '' END AS folder, [lang, source] AS tags,
  len(list_filter(regexp_split_to_array(body, '\\s+'), lambda w: w <> '')) AS n_words, list_filter(regexp_split_to_array(body, '\\s+'), lambda w: w <> '') AS ws,
  CASE WHEN contains(path, 'moc-') THEN 'moc' WHEN NOT contains(path, '/') THEN 'root' ELSE 'regular' END AS kind FROM notes"""
PARTS["units"] = "SELECT path AS unit_id, 'sha1:' || substr(sha1(front || body), 1, 16) AS idempotency_key, path FROM notes WHERE starts_with(path, 'en/src8/')"
PARTS["eligible"] = """
SELECT unit_id, node_key, score, CASE WHEN f = unit_id THEN 'self' WHEN score >= 0.97 THEN 'near_dup' WHEN f IN (SELECT file_id FROM files WHERE folder LIKE 'en/src2%') THEN 'source_set'
  WHEN NOT (starts_with(f, 'note-0') OR starts_with(f, 'moc-')) THEN 'out_of_scope'
  WHEN f IN (SELECT a.file_id FROM files a JOIN files2 b USING (file_id) WHERE a.content_hash <> b.content_hash) THEN 'stale' ELSE 'eligible' END AS verdict
FROM (SELECT split_part(src_key, '::', 1) AS unit_id, dst_key AS node_key, split_part(dst_key, '::', 1) AS f, round(CAST('0x' || substr(md5(dst_key), 1, 4) AS INTEGER) / 65535.0::DOUBLE, 4) AS score FROM links)"""
PARTS["decided"] = """
SELECT unit_id, 'near_dup' AS action, node_key, split_part(node_key, '::', 1) AS file_id, score FROM eligible WHERE verdict = 'near_dup'
UNION ALL SELECT p.path, CASE WHEN e.node_key IS NULL THEN 'no_destination' WHEN e.score >= 0.6 THEN 'placed' ELSE 'flagged' END, e.node_key, split_part(e.node_key, '::', 1), e.score
FROM notes p LEFT JOIN (SELECT * FROM eligible WHERE verdict = 'eligible' QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY score DESC, node_key) = 1) e ON e.unit_id = p.path"""
PARTS["strata"] = "SELECT folder, count(*) AS size FROM files GROUP BY folder"
PARTS["quotas"] = """
SELECT folder, size, CAST(least(size, base + CASE WHEN base + 1 <= size AND rk <= lft THEN 1 ELSE 0 END) AS BIGINT) AS quota FROM (
  SELECT *, row_number() OVER (PARTITION BY base + 1 <= size ORDER BY round(exact - base, 12) DESC, folder) AS rk, 100 - sum(base) OVER () AS lft FROM (
    SELECT folder, size, size / CAST(sum(size) OVER () AS DOUBLE) * 100 AS exact, floor(size / CAST(sum(size) OVER () AS DOUBLE) * 100) AS base FROM strata))"""
PARTS["balances"] = "SELECT 'r' || c_nationkey AS run_id, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS id, round((CAST(c_acctbal AS DOUBLE) + 1000) / 11000, 4) AS score, c_custkey FROM customer"
PARTS["members"] = "SELECT node_key AS section_key, substr(md5(lower(CASE WHEN contains(file_id, '/') THEN split_part(file_id, '/', 1) ELSE '' END)), 1, 16) AS community_id FROM secu"
PARTS["clusters"] = "SELECT CAST(vec_id AS VARCHAR) AS section_key, 'auto-' || label AS community_id FROM embeddings WHERE vec_id % 10 <> 0"
PARTS["seeds"] = """
SELECT lang AS path, lang || ' ' || lang || ' collection' AS text FROM (SELECT DISTINCT lang FROM documents)
UNION ALL SELECT lang || '/src' || s, lang || '/src' || s || ' notes of src' || s FROM (SELECT DISTINCT lang FROM documents), (SELECT unnest(range(10)) AS s)"""
PARTS["dirs"] = """
SELECT folder, count(*) AS n_files, string_agg(regexp_replace(path, '^.*/', ''), ',' ORDER BY regexp_replace(path, '^.*/', '')) AS names FROM files GROUP BY folder
UNION ALL SELECT DISTINCT split_part(folder, '/', 1), 0, '' FROM files WHERE contains(folder, '/')"""
PARTS["tier_a"] = """
SELECT t.q_id, s.node_key, round(len(list_filter(t.toks, lambda w: contains(s.hay, w))) / len(t.toks)::DOUBLE + CASE WHEN contains(s.hay, trim(lower(t.question))) THEN 0.5 ELSE 0 END, 4) AS score
FROM tokens t JOIN (SELECT node_key, lower(concat_ws(' ', nullif(heading_path, ''), nullif(heading_text, ''))) AS hay FROM secu) s ON len(t.toks) > 0 AND len(list_filter(t.toks, lambda w: contains(s.hay, w))) > 0"""
PARTS["tier_b"] = f"""
SELECT t.q_id, m.section_key AS node_key, round(len(list_intersect(t.toks, e.own)) / len(e.own)::DOUBLE, 4) AS score FROM tokens t
JOIN (SELECT entity_id, list_filter(list_distinct(regexp_extract_all(lower(name), '[a-z0-9]+')), lambda w: length(w) >= 2 AND w NOT IN ({STOP})) AS own FROM entities) e ON len(e.own) > 0 AND len(list_intersect(t.toks, e.own)) > 0
JOIN mentions m ON m.entity_id = e.entity_id"""
PARTS["nodes"] = "SELECT q_id, node_key, max(score) AS score, row_number() OVER (PARTITION BY q_id ORDER BY max(score) DESC, node_key) AS pos FROM (SELECT * FROM tier_a UNION ALL SELECT * FROM tier_b) GROUP BY q_id, node_key QUALIFY pos <= 8"
PARTS["best8"] = "SELECT src_key, dst_key, row_number() OVER (PARTITION BY src_key ORDER BY weight DESC, dst_key) AS e FROM edges QUALIFY e <= 8"
PARTS["asked_grams"] = """
SELECT q_id, unnest(CASE WHEN length(t) > 2 THEN list_distinct(list_transform(range(1, length(t) - 1), lambda k: substring(t, k, 3))) ELSE [t] END) AS g FROM (SELECT q_id, lower(trim(replace(question, chr(10), ' '))) AS t FROM questions)"""
PARTS["asked_vectors"] = """
SELECT q_id, CASE WHEN n > 0 THEN list_transform(v, lambda x: x / n) ELSE v END AS embedding FROM (
  SELECT q_id, list(s ORDER BY d) AS v, sqrt(sum(s * s)) AS n FROM (
    SELECT k.q_id, r.d, coalesce(x.s, 0.0) AS s FROM (SELECT q_id FROM questions) k CROSS JOIN (SELECT unnest(range(64)) AS d) r
    LEFT JOIN (SELECT q_id, CAST('0x' || substr(md5(g), 1, 2) AS INTEGER) % 64 AS d, CAST(sum(CASE WHEN CAST('0x' || substr(md5(g), 3, 2) AS INTEGER) % 2 = 0 THEN 1 ELSE -1 END) AS DOUBLE) AS s FROM asked_grams GROUP BY ALL) x ON x.q_id = k.q_id AND x.d = r.d) GROUP BY q_id)"""
PARTS["cosine_places"] = """
SELECT q_id, node_key, score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, node_key) AS pos FROM (
  SELECT q.q_id, s.node_key, round(list_dot_product(q.embedding, s.embedding), 4) AS score FROM asked_vectors q, vectors s)"""
PARTS["spread"] = """
SELECT q_id, node_key, row_number() OVER (PARTITION BY q_id ORDER BY level, r, node_key) AS pos FROM (
  SELECT q_id, node_key, 0 AS level, pos AS r FROM nodes
  UNION ALL SELECT n.q_id, b.dst_key, 1, min(n.pos * 1000 + b.e) FROM nodes n JOIN best8 b ON b.src_key = n.node_key
    WHERE NOT EXISTS (SELECT 1 FROM nodes o WHERE o.q_id = n.q_id AND o.node_key = b.dst_key) GROUP BY n.q_id, b.dst_key)"""
for _k in (3, 5):
    PARTS[f"near{_k}"] = f"SELECT q_id, node_key, score, pos FROM cosine_places WHERE pos <= {_k}"
    PARTS[f"alone{_k}"] = f"""
SELECT q_id, node_key AS key FROM spread s WHERE NOT EXISTS (SELECT 1 FROM near{_k} n WHERE n.q_id = s.q_id AND n.node_key = s.node_key)
QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY pos) <= {_k}"""
    PARTS[f"placed{_k}"] = f"""
SELECT q_id, node_key, score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, node_key) AS pos FROM (
  SELECT r.q_id, r.node_key, coalesce(n.score, 0.0) AS score FROM (
    SELECT DISTINCT a.q_id, s.node_key FROM alone{_k} a JOIN secu s ON s.node_key = a.key
    UNION SELECT a.q_id, s.node_key FROM alone{_k} a JOIN files f ON f.path = a.key OR f.path = a.key || '.md' OR ends_with(f.path, '/' || a.key) OR ends_with(f.path, '/' || a.key || '.md') JOIN secu s ON s.file_id = f.file_id
      WHERE a.key NOT IN (SELECT node_key FROM secu)
  ) r LEFT JOIN nodes n ON n.q_id = r.q_id AND n.node_key = r.node_key)"""
    PARTS[f"hybrid{_k}"] = f"""
SELECT q_id, node_key, m.score AS score, CAST(m.tier AS INTEGER) AS tier, CAST(row_number() OVER (PARTITION BY q_id ORDER BY m.tier, m.pos, node_key) AS INTEGER) AS rank FROM (
  SELECT q_id, node_key, min({{'tier': tier, 'pos': pos, 'score': score}}) AS m FROM (SELECT *, 0 AS tier FROM near{_k} UNION ALL SELECT *, 1 FROM placed{_k}) GROUP BY q_id, node_key)"""
PARTS["vec"] = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
PARTS["heads"] = "SELECT f.folder, s.node_key, s.heading_text FROM secu s JOIN files f USING (file_id) WHERE s.heading_text <> '' AND s.text <> '' QUALIFY row_number() OVER (PARTITION BY f.folder ORDER BY s.node_key) <= 3"
PARTS["defaults"] = "SELECT DISTINCT folder, 'own' AS t FROM files WHERE folder LIKE '%/src1%' UNION ALL SELECT DISTINCT split_part(folder, '/', 1), 'top' FROM files WHERE folder <> '' AND split_part(folder, '/', 1) <> 'de'"
PARTS["sampled"] = "SELECT f.folder, f.path FROM (SELECT folder, path, row_number() OVER (PARTITION BY folder ORDER BY path) - 1 AS i FROM files) f JOIN (SELECT DISTINCT folder, CASE WHEN quota >= size THEN k ELSE least(size - 1, floor(k * size / CAST(quota AS DOUBLE) + 0.5)) END AS i FROM (SELECT *, unnest(range(quota)) AS k FROM quotas WHERE quota > 0)) q ON q.folder = f.folder AND q.i = f.i"


def _second(name: str) -> str:
    """A named query over the first version of the notes as one over the second version."""
    import re

    text = PARTS[name].replace("string_split(body,", "string_split(regexp_replace(content, '^---\\n[^\\n]*\\n---\\n', ''),")
    return re.sub(r"\b(notes|lines|marked|sections|secu|targets|files)\b", r"\g<1>2", text)


for _name in ("lines", "marked", "sections", "secu", "targets", "links"):
    PARTS[f"{_name}2"] = _second(_name)

# As an index embeds its sections: with line breaks as blanks.
PARTS["grams_flat"] = PARTS["grams"].replace("secu", f"(SELECT * REPLACE (replace(text, {NL}, ' ') AS text) FROM secu)")
PARTS["vectors_flat"] = PARTS["vectors"].replace("FROM grams", "FROM grams_flat")
PARTS["inferred_flat"] = PARTS["inferred"].replace("FROM vectors", "FROM vectors_flat").replace("JOIN vectors", "JOIN vectors_flat")

# The same over the second version of the notes.
PARTS["backs2"] = PARTS["backs"].replace("FROM links", "FROM links2")
PARTS["grams_flat2"] = PARTS["grams"].replace("secu", f"(SELECT * REPLACE (replace(text, {NL}, ' ') AS text) FROM secu2)")
PARTS["vectors_flat2"] = PARTS["vectors"].replace("secu", "secu2").replace("FROM grams", "FROM grams_flat2")
PARTS["inferred_flat2"] = PARTS["inferred"].replace("FROM vectors", "FROM vectors_flat2").replace("JOIN vectors", "JOIN vectors_flat2").replace("FROM links", "FROM links2")

# The seeds' texts as vectors.
_SEEDED = "(SELECT substr(md5(lower(path)), 1, 16) AS node_key, text FROM seeds)"
PARTS["seed_grams"] = PARTS["grams"].replace("secu", _SEEDED)
PARTS["seed_vectors"] = PARTS["vectors"].replace("secu", _SEEDED).replace("FROM grams", "FROM seed_grams")

PARTS["told"] = f"""
SELECT community_id, string_agg('### ' || coalesce(nullif(heading_path, ''), node_key) || {NL} || text, {NL} || {NL} ORDER BY node_key) AS report FROM (
  SELECT m.community_id, s.*, sum(ceil(length(s.text) / 4.0)) OVER (PARTITION BY m.community_id ORDER BY s.node_key ROWS UNBOUNDED PRECEDING) AS run FROM secu s JOIN members m ON m.section_key = s.node_key)
WHERE run <= 300 GROUP BY community_id"""
PARTS["told_grams"] = """
SELECT community_id, unnest(list_distinct(list_transform(range(1, length(t) - 1), lambda k: substring(t, k, 3)))) AS g FROM (SELECT community_id, lower(trim(replace(report, chr(10), ' '))) AS t FROM told)"""
PARTS["told_vectors"] = PARTS["asked_vectors"].replace("asked_grams", "told_grams").replace("questions", "told").replace("q_id", "community_id")

PARTS["inbox_notes"] = "SELECT path AS unit_id, body FROM notes WHERE starts_with(path, 'en/src8/')"
PARTS["inbox_grams"] = """
SELECT unit_id, unnest(CASE WHEN length(t) > 2 THEN list_distinct(list_transform(range(1, length(t) - 1), lambda k: substring(t, k, 3))) ELSE [t] END) AS g FROM (SELECT unit_id, lower(trim(replace(body, chr(10), ' '))) AS t FROM inbox_notes)"""
PARTS["inbox_vectors"] = PARTS["asked_vectors"].replace("asked_grams", "inbox_grams").replace("questions", "inbox_notes").replace("q_id", "unit_id")

# Extractions that the fixtures make of assistant turns, the sections that mention their names, and the entities kept.
PARTS["llm_words"] = "SELECT conv_id || '-' || turn AS batch_id, list_filter(regexp_split_to_array(text, '[^A-Za-z]+'), lambda x: length(x) > 3) AS w FROM conversations"
PARTS["llm_names"] = "SELECT batch_id, name FROM (SELECT DISTINCT batch_id, unnest(w) AS name FROM llm_words) QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY name) <= 30"
PARTS["llm_ends"] = """
SELECT batch_id, src, dst FROM (SELECT DISTINCT batch_id, w[i] AS src, coalesce(w[i + 1], w[i]) AS dst FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM llm_words)) WHERE src <> dst
QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY src, dst) <= 30"""
PARTS["llm_asked"] = "SELECT DISTINCT name, lower(name) AS needle FROM (SELECT name FROM llm_names UNION ALL SELECT src FROM llm_ends UNION ALL SELECT dst FROM llm_ends)"
PARTS["llm_met"] = "SELECT n.name, s.node_key AS section_key FROM llm_asked n JOIN secu s ON contains(lower(s.heading_path || ' ' || s.text), n.needle)"
PARTS["llm_kept"] = "SELECT substr(md5(lower(name)), 1, 16) AS entity_id, min(name) AS name FROM (SELECT DISTINCT name FROM llm_names WHERE name IN (SELECT name FROM llm_met)) GROUP BY 1"
PARTS["llm_near"] = "SELECT name, list_slice(list(section_key ORDER BY section_key), 1, 5) AS ks FROM llm_met GROUP BY name"


def _profile(target: int) -> str:
    """The notes of a profile with so many sampled ones, each with its number of excerpt words."""
    return f"""
WITH sizes AS (SELECT folder, count(*) AS size FROM facts WHERE kind = 'regular' GROUP BY folder),
shares AS (SELECT folder, size, least(size, base + CASE WHEN base + 1 <= size AND rk <= lft THEN 1 ELSE 0 END) AS quota FROM (
  SELECT *, row_number() OVER (PARTITION BY base + 1 <= size ORDER BY round(exact - base, 12) DESC, folder) AS rk, {target} - sum(base) OVER () AS lft FROM (
    SELECT folder, size, size / CAST(sum(size) OVER () AS DOUBLE) * {target} AS exact, floor(size / CAST(sum(size) OVER () AS DOUBLE) * {target}) AS base FROM sizes))),
picks AS (SELECT DISTINCT folder, CASE WHEN quota >= size THEN k ELSE least(size - 1, floor(k * size / CAST(quota AS DOUBLE) + 0.5)) END AS i FROM (SELECT *, unnest(range(CAST(quota AS BIGINT))) AS k FROM shares WHERE quota > 0)),
regular AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY path) - 1 AS i FROM facts WHERE kind = 'regular') SEMI JOIN picks USING (folder, i)),
own AS (SELECT greatest(1, least(40, floor(4000 / greatest(count(*), 1)))) AS most FROM regular)
SELECT path, folder, kind, n_words, list_slice(ws, 1, CAST(CASE kind WHEN 'root' THEN 200 WHEN 'moc' THEN 120 ELSE most END AS BIGINT)) AS shown
FROM (SELECT path, folder, kind, n_words, ws FROM facts WHERE kind <> 'regular' UNION ALL SELECT path, folder, kind, n_words, ws FROM regular), own"""


PARTS["profile_long"] = _profile(20)
PARTS["profile_short"] = _profile(2)
PARTS["ledger_fold"] = """
SELECT 'r' || user_id % 5 AS run_id, 'h' || user_id AS id, 'h' || (user_id * 7 + 1) % 50 AS other, bool_or(event_type = 'error') AS linked, min(ts) AS created_at,
  list_reduce(list_prepend(CAST(0.5 AS DOUBLE), list(amount ORDER BY ts, event_id)), lambda s, x: greatest(0.0, least(1.0, round(s + x, 4)))) AS score
FROM (SELECT *, CAST(CASE event_type WHEN 'purchase' THEN 0.2 WHEN 'click' THEN 0.1 WHEN 'error' THEN -0.1 WHEN 'signup' THEN -0.3 ELSE 0 END AS DOUBLE) AS amount FROM events) GROUP BY user_id"""
PARTS["ledger_rows"] = "SELECT *, CASE WHEN score >= 0.8 THEN 'confirmed' WHEN score <= 0 THEN 'refuted' ELSE 'open' END AS status FROM ledger_fold"
PARTS["ledger_runs"] = "SELECT 'r' || user_id % 5 AS run_id, count(*) FILTER (value > 50) / CAST(count(*) AS DOUBLE) AS coverage, count(*) % 3 AS rounds, max(value) > 0 AS reachable, count(*) % 60 AS calls FROM events GROUP BY ALL"
PARTS["ledger_status"] = """
SELECT run_id, coverage, calls, top_score, CASE WHEN met THEN 'conflicted' WHEN NOT reachable AND rounds > 0 OR coverage < 0.3 OR top_score IS NULL THEN 'insufficient_evidence'
    WHEN rounds >= 1 THEN CASE WHEN top_score >= 0.8 THEN 'confirmed' ELSE 'low_confidence' END ELSE 'needs_verification' END AS status,
  CASE WHEN met THEN 'contradiction' WHEN NOT reachable AND rounds > 0 THEN 'index unavailable' WHEN coverage < 0.3 THEN 'coverage' WHEN top_score IS NULL THEN 'no assumptions'
    WHEN rounds >= 1 THEN CASE WHEN top_score >= 0.8 THEN 'verified' ELSE 'verified below threshold' END WHEN top_score >= 0.8 THEN 'not verified' ELSE 'below threshold' END AS reason
FROM (SELECT r.*, (SELECT max(score) FROM ledger_fold l WHERE l.run_id = r.run_id) AS top_score,
    EXISTS (SELECT 1 FROM ledger_fold a JOIN ledger_fold b ON a.run_id = b.run_id AND b.id = a.other WHERE a.run_id = r.run_id AND a.linked AND a.id <> b.id AND a.score >= 0.7 AND b.score >= 0.7) AS met FROM ledger_runs r)"""
PARTS["asked_folders"] = """
SELECT folder, 'Is the purpose of ' || folder || ' "collected notes"?' AS question FROM (SELECT DISTINCT folder FROM dirs WHERE folder <> '')"""
PARTS["folder_hits"] = """
SELECT q_id, folder FROM (
  SELECT a.folder AS q_id, d.folder, 0 AS rk FROM asked_folders a JOIN asked_folders d ON contains(a.question, d.folder)
  UNION ALL
  SELECT a.folder, d.folder, 1 FROM asked_folders a JOIN (SELECT regexp_replace(folder, '^.*/', '') AS base, min(folder) AS folder FROM asked_folders GROUP BY base HAVING count(*) = 1) d ON contains(a.question, d.base))
QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY rk, length(folder) DESC, folder) = 1"""


def _lost(pattern: str) -> str:
    return f"list_sort(list_filter(list_distinct(regexp_extract_all(old, {pattern})), lambda x: NOT list_contains(regexp_extract_all(new, {pattern}), x)))"


# Each file's latest verdict, which is the remainder of the event's number: 3 drops it, the others build it anew.
_JUDGED = """
    SELECT f.file_id, CASE WHEN v.seq IS NULL THEN f.content_hash ELSE coalesce(g.content_hash, f.content_hash) END AS content_hash
    FROM files f JOIN notes n ON n.path = f.file_id LEFT JOIN (SELECT user_id, max(event_id) AS seq FROM events GROUP BY user_id) v ON v.user_id = n.doc_id LEFT JOIN files2 g ON g.file_id = f.file_id
    WHERE v.seq IS NULL OR v.seq % 5 <> 3"""

FINAL: dict[str, str] = {
    "s2_ignore_filter": "SELECT path FROM notes WHERE NOT (starts_with(regexp_replace(path, '^.*/', ''), 'moc-') OR path = 'fr/src1' OR path LIKE 'fr/src1/%' OR path LIKE '%9.md' OR path LIKE 'moc-%')",
    "s3_corpus_from_table": "SELECT 'pages/' || page_id || '.md' AS path, CAST(page_id AS VARCHAR) AS title, 'pages' AS folder, sha1(coalesce(html, '')) AS content_hash, 1 AS version FROM pages",
    "s5_merge_replace": "SELECT user_id, event_type, event_id AS seq, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1",
    "s6_merge_ignore": "SELECT o_custkey AS k, count(*) * CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 100 END AS n FROM orders GROUP BY o_custkey",
    "q3_file_stats": f"SELECT path, strlen(front || body) AS size, substr(sha1(front || body), 1, 12) AS hash, len(string_split(front || body, {NL})) AS n_lines FROM notes",
    "t1_strip_frontmatter": "SELECT path, sha1(body) AS body_hash FROM notes",
    "t2_chunk_sections": "SELECT * FROM sections",
    "t3_significant_tokens": f"SELECT doc_id, array_to_string(list_filter(list_transform(list_sort(list_transform(list_distinct(w), lambda x: {{'p': list_position(w, x), 'x': x}})), lambda s: s.x), lambda x: length(x) >= 2 AND x NOT IN ({STOP})), ' ') AS tokens FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)",
    "t4_word_tokens": "SELECT doc_id, len(w) AS n_words, array_to_string(w, ' ') AS words FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(regexp_replace(text, '[^A-Za-z0-9_\\s]', ' ', 'g')), '\\s+'), lambda x: x <> '') AS w FROM documents)",
    "t5_word_count": "SELECT doc_id, len(w) AS n_words, array_to_string(list_slice(w, 1, 12), ' ') AS excerpt FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents)",
    "t6_estimate_tokens": "SELECT conv_id, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id",
    "t7_frontmatter_table": "SELECT path, 'tags' AS key, 0 AS pos, lang AS value FROM notes UNION ALL SELECT path, 'tags', 1, source FROM notes",
    "t8_extract_tags": "SELECT path, 0 AS pos, lang AS tag FROM notes UNION ALL SELECT path, 1, source FROM notes",
    "t9_heading_outline": f"SELECT n.path, coalesce(o.outline, '') AS outline FROM notes n LEFT JOIN (SELECT path, string_agg(trim(x), {NL} ORDER BY i) AS outline FROM (SELECT * FROM lines WHERE regexp_matches(x, '^#{{1,6}}\\s+') QUALIFY row_number() OVER (PARTITION BY path ORDER BY i) <= 30) GROUP BY path) o USING (path)",
    "t10_classify_note": "SELECT path, kind FROM facts",
    "t11_file_rollup": "SELECT file_id, 'Sections: ' || string_agg(heading_text, ', ' ORDER BY line_start, node_key) AS rollup FROM (SELECT * FROM secu WHERE heading_text <> '' QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY line_start, node_key) <= 10) GROUP BY file_id",
    "t12_prompt_rows": "SELECT item_id, 'Item ' || item_id || ': ' || text || ' {other}' AS prompt FROM benchmark",
    "t13_strip_model_wrapping": "SELECT conv_id, turn, sha1(text) AS plain_hash FROM conversations WHERE role = 'assistant'",
    "n1_extract_entities": "SELECT section_key, entity_id, name, type FROM extracted",
    "n2_entity_table": "SELECT * FROM entities",
    "n4_normalize_kinds": "SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'concept') AS kind, 'semantic:' || coalesce(nullif(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'related_to') AS relation FROM part",
    "n5_match_mentions": "SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(lower(' ' || d.text), lower(trim(b.text)))",
    "n8_sections_for_entities": "SELECT section_key, entity_id FROM mentions WHERE entity_id IN (SELECT entity_id FROM entities WHERE type = 'tag')",
    "v2_hash_embed": """SELECT item_id, d AS dim, round(s / n, 6) AS x FROM (SELECT *, sqrt(sum(s * s) OVER (PARTITION BY item_id)) AS n FROM (
        SELECT b.item_id, r.d, coalesce(sum(CASE WHEN CAST('0x' || substr(md5(g), 1, 2) AS INTEGER) % 64 = r.d THEN CASE WHEN CAST('0x' || substr(md5(g), 3, 2) AS INTEGER) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END END), 0.0::DOUBLE) AS s
        FROM (SELECT item_id, unnest(list_distinct(list_transform(range(1, length(text) - 1), lambda k: substring(lower(text), k, 3)))) AS g FROM benchmark) b, (SELECT CAST(unnest(range(64)) AS INTEGER) AS d) r GROUP BY ALL))""",
    "v3_cosine": "SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 4) AS score FROM vec a JOIN vec b ON b.vec_id = a.vec_id + 1",
    "v4_vector_topk": "SELECT q_id, item_id, score, CAST(row_number() OVER (PARTITION BY q_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM (SELECT a.vec_id AS q_id, b.vec_id AS item_id, round(list_cosine_similarity(a.v, b.v), 4) AS score FROM vec a JOIN vec b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) QUALIFY rank <= 5",
    "v6_similar_pairs": "SELECT src, dst, score FROM (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_cosine_similarity(a.v, b.v), 4) AS score FROM vec a JOIN vec b ON a.vec_id <> b.vec_id) WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) <= 3",
    "v6_inferred_edges": "SELECT * FROM inferred",
    "g11_hybrid_search": "SELECT q_id, node_key, score, tier, rank FROM hybrid5",
    "g12_verify_batch": """WITH hits AS (SELECT h.q_id, h.node_key, h.rank, substring(s.text, 1, 200) AS snippet, row_number() OVER (ORDER BY h.q_id DESC, h.rank DESC) <= 6 AS evidence FROM hybrid3 h JOIN secu s USING (node_key) WHERE h.rank <= 3)
        SELECT q.q_id, h.node_key, h.rank, h.snippet, coalesce(h.evidence, FALSE) AS evidence FROM questions q LEFT JOIN hits h ON h.q_id = q.q_id""",
    "n6_ground_extractions": "SELECT entity_id, name, 'llm:term_kind' AS type FROM llm_kept",
    "n7_refresh_mentions": """SELECT DISTINCT section_key, substr(md5(lower(name)), 1, 16) AS entity_id FROM llm_met WHERE name IN (SELECT name FROM llm_names)
        UNION SELECT s.node_key, k.entity_id FROM llm_kept k JOIN secu2 s ON contains(lower(s.heading_path || ' ' || s.text), lower(k.name))""",
    "g5_semantic_edges": """SELECT DISTINCT src_key, dst_key, 'semantic:next_to' AS kind, 1.0::DOUBLE AS weight FROM (
          SELECT * FROM (SELECT src, dst, src_key, unnest(ks) AS dst_key FROM (SELECT r.src, r.dst, unnest(a.ks) AS src_key, b.ks FROM (SELECT DISTINCT src, dst FROM llm_ends) r JOIN llm_near a ON a.name = r.src JOIN llm_near b ON b.name = r.dst)) WHERE src_key <> dst_key
          QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY src_key, dst_key) <= 4)""",
    "p2_score_candidates": """SELECT unit_id, node_key, score, verdict FROM (
          SELECT *, CASE WHEN split_part(node_key, '::', 1) = unit_id THEN 'self' WHEN score >= 0.97 THEN 'near_dup' ELSE 'eligible' END AS verdict FROM (
            SELECT u.unit_id, v.node_key, round(list_dot_product(u.embedding, v.embedding), 4) AS score FROM inbox_vectors u, vectors v QUALIFY row_number() OVER (PARTITION BY u.unit_id ORDER BY score DESC, v.node_key) <= 15))
        WHERE verdict <> 'self' QUALIFY verdict = 'near_dup' OR row_number() OVER (PARTITION BY unit_id, verdict ORDER BY score DESC, node_key) <= 5""",
    "c12_global_search": f"""WITH routed AS (SELECT q_id, len(toks) = 0 OR {" OR ".join(f"contains(lower(question), '{m}')" for m in OVERVIEW_MARKERS)} AS overview FROM tokens),
        best AS (SELECT q.q_id, t.community_id, row_number() OVER (PARTITION BY q.q_id ORDER BY round(list_dot_product(a.embedding, t.embedding), 4) DESC, t.community_id) AS r FROM routed q JOIN asked_vectors a USING (q_id), told_vectors t WHERE q.overview QUALIFY r <= 3),
        packed AS (SELECT b.q_id, string_agg('## ' || l.label || {NL} || t.report, {NL} || {NL} ORDER BY b.r) AS context, count(*) AS n FROM best b JOIN told t USING (community_id) JOIN (SELECT community_id, min(section_key) AS label FROM members GROUP BY community_id) l USING (community_id) GROUP BY b.q_id)
        SELECT q.q_id, CASE WHEN q.overview AND p.context IS NOT NULL THEN 'global' ELSE 'local' END AS mode, sha1(coalesce(p.context, '')) AS context_hash, coalesce(p.n, 0) AS n_reports FROM routed q LEFT JOIN packed p USING (q_id)""",
    "n9_extraction_batches": """WITH RECURSIVE sized AS (SELECT file_id, node_key, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tok FROM secu),
        cut AS (SELECT *, sum(tok) OVER (PARTITION BY file_id ORDER BY node_key ROWS UNBOUNDED PRECEDING) AS run FROM sized),
        filed AS MATERIALIZED (SELECT row_number() OVER (ORDER BY file_id) AS i, CAST(sum(tok) AS BIGINT) AS t FROM cut WHERE run <= 3000 GROUP BY file_id),
        walk AS (SELECT i, t, 0 AS b, t AS held FROM filed WHERE i = 1
          UNION ALL SELECT f.i, f.t, CASE WHEN w.held + f.t > 3000 THEN w.b + 1 ELSE w.b END, CASE WHEN w.held + f.t > 3000 THEN f.t ELSE w.held + f.t END FROM walk w JOIN filed f ON f.i = w.i + 1)
        SELECT '000000-' || lpad(CAST(b AS VARCHAR), 8, '0') AS batch_id, count(*) AS n_files, CAST(sum(t) AS BIGINT) AS tokens FROM walk GROUP BY b""",
    "v7_near_duplicates": """SELECT node_key AS item_id, twin, 1.0::DOUBLE AS score FROM (SELECT node_key, min(node_key) OVER (PARTITION BY embedding) AS twin FROM vectors) WHERE node_key <> twin
        UNION ALL SELECT a.node_key, b.node_key, round(list_dot_product(a.embedding, b.embedding), 4) FROM (SELECT * FROM vectors QUALIFY node_key = min(node_key) OVER (PARTITION BY embedding)) a JOIN (SELECT * FROM vectors QUALIFY node_key = min(node_key) OVER (PARTITION BY embedding)) b ON a.node_key <> b.node_key WHERE round(list_dot_product(a.embedding, b.embedding), 4) >= 0.97""",
    "g1_wikilink_edges": "SELECT * FROM links",
    "g2_backlink_edges": "SELECT * FROM backs",
    "g3_build_edges": "SELECT * FROM edges UNION ALL SELECT * FROM inferred",
    "g4_edges_for_files": "SELECT * FROM edges WHERE kind = 'wikilink' AND split_part(src_key, '::', 1) IN (SELECT file_id FROM files WHERE folder LIKE 'en/%')",
    "g6_unlinked_sections": "SELECT node_key FROM secu WHERE node_key NOT IN (SELECT src_key FROM links UNION SELECT dst_key FROM links)",
    "g7_resolve_keys": """SELECT DISTINCT k.dst_key AS key, s.node_key FROM links k JOIN secu s ON s.node_key = k.dst_key
        UNION ALL SELECT DISTINCT k.dst_key, s.node_key FROM (SELECT DISTINCT dst_key FROM links WHERE dst_key NOT IN (SELECT node_key FROM secu)) k JOIN files f ON f.path = k.dst_key OR f.path = k.dst_key || '.md' OR ends_with(f.path, '/' || k.dst_key) OR ends_with(f.path, '/' || k.dst_key || '.md') JOIN secu s ON s.file_id = f.file_id""",
    "g8_resolve_query_nodes": "SELECT q_id, node_key, score, CAST(pos AS INTEGER) AS pos FROM nodes",
    "g9_expand_neighbors": """WITH best AS (SELECT src_key, dst_key, row_number() OVER (PARTITION BY src_key ORDER BY weight DESC, dst_key) AS e FROM edges QUALIFY e <= 3),
        l0 AS (SELECT node_key AS q_id, node_key FROM secu),
        l1 AS (SELECT l0.q_id, b.dst_key AS node_key, min(b.e) AS r1 FROM l0 JOIN best b ON b.src_key = l0.node_key WHERE b.dst_key <> l0.node_key GROUP BY ALL),
        l2 AS (SELECT q_id, node_key, min(r) AS r FROM (SELECT l1.q_id, b.dst_key AS node_key, [l1.r1, b.e] AS r FROM l1 JOIN best b ON b.src_key = l1.node_key) x
          WHERE NOT EXISTS (SELECT 1 FROM l0 WHERE l0.q_id = x.q_id AND l0.node_key = x.node_key) AND NOT EXISTS (SELECT 1 FROM l1 WHERE l1.q_id = x.q_id AND l1.node_key = x.node_key) GROUP BY ALL)
        SELECT q_id, node_key, level, CAST(row_number() OVER (PARTITION BY q_id ORDER BY level, r, node_key) AS INTEGER) AS pos FROM (
          SELECT q_id, node_key, 0 AS level, [1] AS r FROM l0 UNION ALL SELECT q_id, node_key, 1, [r1] FROM l1 UNION ALL SELECT q_id, node_key, 2, r FROM l2)""",
    "g10_hybrid_rank": """SELECT q_id, node_key, score, tier, CAST(row_number() OVER (PARTITION BY q_id ORDER BY tier, pos, node_key) AS INTEGER) AS rank FROM (
        SELECT l_suppkey AS q_id, CAST(l_partkey AS VARCHAR) AS node_key, CAST(1 - l_linenumber % 2 AS INTEGER) AS tier, l_orderkey AS pos, CAST(l_quantity AS DOUBLE) AS score FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY 1 - l_linenumber % 2, l_orderkey, l_quantity) = 1)""",
    "c1_seed_table": "SELECT substr(md5(lower(path)), 1, 16) AS community_id, path AS label, text FROM seeds",
    "c3_assign_seeded": "SELECT CAST(s.vec_id AS VARCHAR) AS section_key, 'label-' || q.label AS community_id, round(list_cosine_similarity(s.v, q.v), 4) AS score FROM vec s, (SELECT * FROM vec QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1) q QUALIFY row_number() OVER (PARTITION BY s.vec_id ORDER BY round(list_cosine_similarity(s.v, q.v), 4) DESC, q.vec_id) = 1",
    "c5_assign_auto": "SELECT CAST(e.vec_id AS VARCHAR) AS section_key, coalesce(c.community_id, (SELECT community_id FROM clusters GROUP BY community_id ORDER BY count(*) DESC, community_id LIMIT 1)) AS community_id FROM embeddings e LEFT JOIN clusters c ON c.section_key = CAST(e.vec_id AS VARCHAR)",
    "c6_community_members": "SELECT m.community_id, m.section_key, f.path, f.title FROM members m JOIN secu s ON s.node_key = m.section_key JOIN files f USING (file_id)",
    "c7_prune_empty_auto": "SELECT DISTINCT community_id, 'r' AS report FROM clusters WHERE community_id <> 'auto-3'",
    "c8_membership_diff": "SELECT community_id, CASE WHEN community_id = 'auto-1' THEN 'changed' ELSE 'no report' END AS reason FROM (SELECT DISTINCT community_id FROM clusters WHERE community_id IN ('auto-1', 'auto-2')) WHERE community_id = 'auto-2' OR EXISTS (SELECT 1 FROM clusters WHERE community_id = 'auto-1' AND section_key LIKE '%5')",
    "c9_context_pack": f"SELECT folder, sha1(string_agg('### ' || coalesce(nullif(heading_path, ''), node_key) || {NL} || text, {NL} || {NL} ORDER BY node_key)) AS context_hash, CAST(sum(n) AS BIGINT) AS tokens, count(*) AS n_sections FROM (SELECT *, sum(n) OVER (PARTITION BY folder ORDER BY node_key ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT f.folder, s.node_key, s.heading_path, s.text, ceil(length(s.text) / 4.0) AS n FROM secu s JOIN files f USING (file_id))) WHERE run <= 800 GROUP BY folder",
    "c11_is_overview": "SELECT q_id, len(toks) = 0 OR " + " OR ".join(f"contains(lower(question), '{m}')" for m in OVERVIEW_MARKERS) + " AS overview FROM tokens",
    "f2_content_type_defaults": "SELECT DISTINCT folder, CASE WHEN regexp_matches(lower(folder), 'standard|rule|reference|component|library') THEN 'reference' WHEN regexp_matches(lower(folder), 'inbox|dump|archive|project|job|spec|index') THEN 'narrative-opinion' ELSE 'reference' END AS content_type FROM (SELECT p_name || '-' || p_type AS folder FROM part UNION ALL SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'Project ' ELSE 'RULES ' END || s_name FROM supplier)",
    "f3_inherit_content_type": "SELECT f.file_id, coalesce(a.t, b.t) AS content_type FROM files f LEFT JOIN defaults a ON a.folder = f.folder AND a.folder <> '' LEFT JOIN defaults b ON b.folder = split_part(f.folder, '/', 1) AND b.folder <> ''",
    "f4_folder_files": "SELECT * FROM dirs",
    "f5_uncovered_folders": "SELECT folder FROM dirs WHERE folder <> '' AND folder NOT IN (SELECT path FROM seeds)",
    "f6_folder_top_links": "SELECT f.folder, l.dst_key, count(*) AS n FROM links l JOIN files f ON f.file_id = split_part(l.src_key, '::', 1) GROUP BY f.folder, l.dst_key QUALIFY row_number() OVER (PARTITION BY f.folder ORDER BY count(*) DESC, l.dst_key) <= 6",
    "f7_folder_headings": "SELECT * FROM heads",
    "i1_diff_corpus": "SELECT * FROM diff",
    "i2_retire_files": "SELECT * FROM edges WHERE split_part(src_key, '::', 1) NOT IN (SELECT file_id FROM gone) AND split_part(dst_key, '::', 1) NOT IN (SELECT file_id FROM gone)",
    "i3_retire_structural_edges": "SELECT * FROM (SELECT src_key, dst_key, CASE WHEN weight = 0.7 THEN 'semantic:file' ELSE kind END AS kind, weight FROM edges) WHERE kind = 'semantic:file' OR (split_part(src_key, '::', 1) NOT IN (SELECT file_id FROM gone) AND split_part(dst_key, '::', 1) NOT IN (SELECT file_id FROM gone))",
    "p1_units": "SELECT unit_id, idempotency_key FROM units WHERE idempotency_key NOT IN (SELECT idempotency_key FROM units WHERE unit_id LIKE '%28.md')",
    "p3_eligibility": "SELECT * FROM eligible",
    "p4_drop_ignored_candidates": "SELECT src_key, dst_key AS file_id FROM links WHERE NOT (starts_with(dst_key, 'note-0001') OR ends_with(dst_key, '5.md'))",
    "p5_decide": "SELECT * FROM decided",
    "p7_triage_report": "SELECT action, count(*) AS n, action || ': ' || count(*) AS line FROM decided GROUP BY action",
    "p8_unchanged_check": "SELECT count(*) AS n_compared, count(*) FILTER (WHERE b.content_hash IS DISTINCT FROM a.content_hash) AS n_changed FROM files a LEFT JOIN files2 b USING (file_id)",
    "e1_words_conserved": "SELECT doc_id, len(lost) = 0 AS ok, array_to_string(lost, ' ') AS lost FROM (SELECT doc_id, list_sort(list_filter(list_distinct(a), lambda x: NOT list_contains(b, x))) AS lost FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(regexp_replace(old, '[^A-Za-z0-9_\\s]', ' ', 'g')), '\\s+'), lambda x: x <> '') AS a, list_filter(regexp_split_to_array(lower(regexp_replace(new, '[^A-Za-z0-9_\\s]', ' ', 'g')), '\\s+'), lambda x: x <> '') AS b FROM pairs))",
    "e2_headers_preserved": """
        SELECT doc_id, bool_and(missing IS NULL) AS ok, max(missing) AS missing FROM (WITH RECURSIVE
          hs AS (SELECT doc_id, regexp_extract_all(old, '(?m)^(#+ .+)$', 1) AS a, regexp_extract_all(new, '(?m)^(#+ .+)$', 1) AS b FROM pairs),
          walk AS (SELECT doc_id, 0 AS i, 0 AS reached, CAST(NULL AS VARCHAR) AS missing FROM hs
            UNION ALL SELECT doc_id, i + 1, reached + place, CASE WHEN place = 0 THEN h END FROM (
              SELECT w.doc_id, w.i, w.reached, hs.a[w.i + 1] AS h, CAST(coalesce(list_position(hs.b[w.reached + 1:], hs.a[w.i + 1]), 0) AS INTEGER) AS place
              FROM walk w JOIN hs ON hs.doc_id = w.doc_id WHERE w.missing IS NULL AND w.i < len(hs.a)))
          SELECT * FROM walk) GROUP BY doc_id""",
    "e3_protected_spans": "SELECT doc_id, len(w) = 0 AND len(u) = 0 AS ok, CASE WHEN len(w) > 0 THEN 'wikilink' WHEN len(u) > 0 THEN 'url' END AS kind, array_to_string(CASE WHEN len(w) > 0 THEN w[1:3] ELSE u[1:3] END, ' ') AS lost FROM (SELECT doc_id, " + _lost("'\\[\\[[^\\]]+\\]\\]'") + " AS w, " + _lost("'https?://[^\\s()<>\"'']+'") + " AS u FROM pairs)",
    "e7_rewrite_guard": "SELECT doc_id, CASE WHEN regexp_replace(old, '^\\s+|\\s+$', '', 'g') = regexp_replace(nw, '^\\s+|\\s+$', '', 'g') THEN 'unchanged' WHEN len(list_filter(regexp_split_to_array(nw, '\\s+'), lambda x: x <> '')) < len(list_filter(regexp_split_to_array(old, '\\s+'), lambda x: x <> '')) * 0.2 THEN 'rejected' ELSE 'accepted' END AS verdict FROM (SELECT doc_id, old, CASE WHEN doc_id % 5 = 0 THEN substring(new, 1, 60) ELSE new END AS nw FROM pairs)",
    "e4_join_punctuation": f"""
        SELECT doc_id, 0 AS seq, ends_with(regexp_replace(joined, '^\\s+|\\s+$', '', 'g'), '.') AS ok FROM (
          SELECT doc_id, CASE WHEN e < s THEN '' ELSE coalesce(array_to_string(list_transform(l[s:e], lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), ' '), '') END AS joined FROM (
            SELECT doc_id, least(5, n) AS s, least(6, n) - CASE WHEN doc_id % 7 = 0 THEN 3 ELSE 0 END AS e, string_split(new, {NL}) AS l FROM (SELECT doc_id, new, len(string_split(old, {NL})) AS n FROM pairs)))""",
    "e8_collapse_blank_runs": f"SELECT doc_id, sha1(string_agg(CASE WHEN b THEN '' ELSE x END, {NL} ORDER BY i)) AS content_hash FROM (SELECT *, regexp_matches(x, '^\\s*$') AS b, coalesce(lag(regexp_matches(x, '^\\s*$')) OVER (PARTITION BY doc_id ORDER BY i), false) AS pb FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace(content, '\\. ', '.' || {NL} || {NL} || {NL}, 'g'), {NL}) AS l FROM notes2))) WHERE NOT (b AND pb) GROUP BY doc_id",
    "e10_pending_proposals": "SELECT file_id, user, created_at, fresh FROM (SELECT 'f' || user_id AS file_id, event_type AS user, ts AS created_at, CAST(event_id AS VARCHAR) AS h, coalesce(CAST(event_id AS VARCHAR) = CAST(c.c_custkey AS VARCHAR), false) AS fresh FROM events LEFT JOIN customer c ON c.c_custkey = user_id QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, CAST(event_id AS VARCHAR)) = 1) WHERE created_at + INTERVAL 1440 MINUTE > (SELECT max(ts) FROM events)",
    "k1_allocate_sample": "SELECT * FROM quotas",
    "k2_stride_sample": "SELECT * FROM sampled",
    "k3_per_file_budget": "SELECT folder, CAST(greatest(1, least(40, floor(400 / size))) AS INTEGER) AS budget FROM strata",
    "k4_folder_summary": "SELECT b.folder, b.n_files, b.mean_words, coalesce(x.tags, '') AS tags FROM (SELECT folder, count(*) AS n_files, CAST(floor(avg(n_words) + 0.5) AS BIGINT) AS mean_words FROM facts GROUP BY folder) b LEFT JOIN (SELECT folder, string_agg(tag, ',' ORDER BY n DESC, tag) AS tags FROM (SELECT folder, tag, count(*) AS n FROM (SELECT folder, lower(unnest(tags)) AS tag FROM facts) GROUP BY folder, tag QUALIFY row_number() OVER (PARTITION BY folder ORDER BY count(*) DESC, tag) <= 3) GROUP BY folder) x USING (folder)",
    "l2_rank_ledger": "SELECT run_id, id, score, CAST(row_number() OVER (PARTITION BY run_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM balances QUALIFY rank <= 5",
    "l3_contradicting_pairs": "SELECT DISTINCT a.run_id, least(a.id, b.id) AS a, greatest(a.id, b.id) AS b FROM balances a JOIN balances b ON a.run_id = b.run_id AND (b.c_custkey = a.c_custkey + 25 OR b.c_custkey = a.c_custkey + 3) WHERE a.score >= 0.5 AND b.score >= 0.5",
    "x1_recent_turns": "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3",
    "x2_reconstruct_answer": "SELECT conv_id, coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant' AND text <> ''), '[The agent produced no answer text.]') AS answer FROM conversations GROUP BY conv_id",
    "x3_chat_context": f"SELECT conv_id AS q_id, string_agg('[' || n || '] ' || role || '.md' || CASE WHEN turn % 2 = 0 THEN ' — Part' ELSE '' END || ' (lines ' || turn || '-' || (turn + 2) || '):' || {NL} || text, {NL} || {NL} ORDER BY n) AS context FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY conv_id",
    "x4_number_citations": "SELECT conv_id || '-' || turn AS answer_id, a AS source, 1 AS citation FROM (SELECT conv_id, turn, CAST(turn % 3 + 1 AS INTEGER) AS a, CAST(turn % 2 + 1 AS INTEGER) AS b FROM conversations WHERE role = 'assistant') UNION ALL SELECT conv_id || '-' || turn, CAST(turn % 2 + 1 AS INTEGER), 2 FROM conversations WHERE role = 'assistant' AND turn % 3 <> turn % 2",
    "x5_question_answer_pairs": "SELECT conv_id, turn, question, answer FROM (SELECT conv_id, turn, role, text AS question, lead(role) OVER w AS nr, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant' AND question <> '' AND answer <> '' AND NOT starts_with(answer, 'NO_ANSWER:')",
    "x6_compact_window": "SELECT c.conv_id, c.turn FROM conversations c JOIN (SELECT conv_id, min(turn) AS f, sum(ceil(length(text) / 4.0)) AS n FROM conversations GROUP BY conv_id) x USING (conv_id) WHERE n <= 300 OR turn >= f",
    "q1_search_paths": "SELECT q.source AS q_id, f.path FROM (SELECT DISTINCT source FROM documents) q JOIN files f ON contains(lower(f.path), lower(q.source) || '/') QUALIFY row_number() OVER (PARTITION BY q.source ORDER BY f.path) <= 20",
    "q2_resolve_path": """SELECT q_id, path, CASE rk WHEN 0 THEN 'exact' WHEN 1 THEN 'case' ELSE 'fuzzy' END AS how FROM (
        SELECT q.doc_id AS q_id, f.path, CASE WHEN q.q = f.path THEN 0 WHEN lower(q.q) = lower(f.path) THEN 1 ELSE 2 END AS rk, CASE WHEN lower(q.q) = lower(f.path) THEN 0 ELSE levenshtein(lower(regexp_replace(q.q, '^.*/', '')), lower(regexp_replace(f.path, '^.*/', ''))) END AS dist
        FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN path WHEN doc_id % 3 = 1 THEN upper(path) ELSE 'x/' || regexp_replace(path, 'note-0', 'nte-9') END AS q FROM notes) q JOIN files f ON lower(q.q) = lower(f.path) OR (q.doc_id % 3 = 2 AND abs(length(regexp_replace(q.q, '^.*/', '')) - length(regexp_replace(f.path, '^.*/', ''))) <= 4))
        WHERE dist <= 4 QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY rk, dist, path) = 1""",
}


FINAL |= {
    "t14_note_view": "SELECT f.path, CAST(f.n_words AS INTEGER) AS n_words, array_to_string(f.tags, ',') AS tags, CAST(least(30, l.n) AS INTEGER) AS n_outline, array_to_string(list_slice(f.ws, 1, 200), ' ') AS excerpt FROM facts f JOIN (SELECT path, count(*) FILTER (regexp_matches(x, '^#{1,6}\\s+')) AS n FROM lines GROUP BY path) l USING (path)",
    "n3_parse_extractions": """
        WITH said AS (SELECT conv_id || '-' || turn AS batch_id, list_filter(regexp_split_to_array(text, '[^A-Za-z]+'), lambda x: length(x) > 3) AS w FROM conversations),
        pairs_said AS (SELECT DISTINCT batch_id, w[i] AS src, w[i + 1] AS dst, 'next to' AS relation FROM (SELECT batch_id, w, unnest(range(1, len(w))) AS i FROM said))
        SELECT * FROM pairs_said WHERE src <> dst QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY src, dst, relation) <= 30""",
    "n3_parsed_entities": "SELECT batch_id, name, 'Term Kind' AS type FROM llm_names",
    "n10_run_completions": f"SELECT item_id, coalesce(substring(list_filter(list_transform(string_split(text, {NL}), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')[1], 1, 200), '') AS completion, CAST(NULL AS VARCHAR) AS error FROM benchmark",
    "v1_embed": f"SELECT item_id, CAST(count(*) AS INTEGER) AS dims, round(sum(x * x), 4) AS norm FROM ({FINAL['v2_hash_embed']}) GROUP BY item_id",
    "v5_cached_embed": "SELECT node_key, content_hash, CAST(64 AS INTEGER) AS dims FROM secu",
    "c2_embed_seeds": "SELECT node_key AS community_id, CAST(dim - 1 AS INTEGER) AS dim, round(embedding[dim], 6) AS x FROM (SELECT node_key, embedding, unnest(range(1, 65)) AS dim FROM seed_vectors)",
    "f1_manifest_table": """
        WITH langs AS (SELECT DISTINCT lang FROM documents)
        SELECT 0 AS ord, 'root' AS kind, 'vault' AS folder, 1 AS level, CAST(NULL AS VARCHAR) AS parent, '' AS purpose
        UNION ALL SELECT CAST(row_number() OVER (ORDER BY k) AS INTEGER), 'folder', folder, level, parent, purpose FROM (
          SELECT lang || '0' AS k, lang AS folder, 2 AS level, CAST(NULL AS VARCHAR) AS parent, lang || ' collection' AS purpose FROM langs
          UNION ALL SELECT lang || '1' || s, 'src' || s, 3, lang, 'notes of src' || s FROM langs, (SELECT unnest(range(10)) AS s))""",
    "f9_parse_purposes": "SELECT folder, 'notes of ' || folder AS purpose FROM asked_folders",
    "f10_match_folder_in_question": "SELECT q_id, folder FROM folder_hits",
    "f11_resolve_purposes": "SELECT folder, CASE WHEN length(q_id) % 2 = 0 THEN 'collected notes' ELSE 'plain x notes' END AS purpose FROM folder_hits QUALIFY row_number() OVER (PARTITION BY folder ORDER BY length(q_id) DESC) = 1",
    "s1_scan_corpus": "SELECT path, regexp_replace(regexp_replace(path, '^.*/', ''), '\\.md$', '') AS title, sha1(front || body) AS content_hash, CAST(length(front || body) AS INTEGER) AS n_chars FROM notes",
    "s1_notes_format": "SELECT path, regexp_replace(regexp_replace(path, '^.*/', ''), '\\.md$', '') AS title, sha1(front || body) AS content_hash, CAST(length(front || body) AS INTEGER) AS n_chars FROM notes",
    "s1_notes_stream": "SELECT path, regexp_replace(regexp_replace(path, '^.*/', ''), '\\.md$', '') AS title, sha1(content) AS content_hash FROM (SELECT path, front || body AS content FROM notes UNION ALL SELECT path, content FROM notes2)",
    "s11_render_sink": "SELECT 'of ' || folder AS part, count(*) AS n_lines, min(title) AS first, max(title) AS last FROM files GROUP BY folder",
    "s4_read_index": "SELECT node_key, content_hash, true AS unset FROM secu",
    "s7_reset_index": "SELECT unnest(['files', 'sections', 'entities', 'section_entities', 'edges', 'communities', 'community_sections', 'community_reports', 'index_meta']) AS name, CAST(0 AS BIGINT) AS n_rows",
    "s8_append_meta": "SELECT CAST(count(*) AS VARCHAR) AS vault_version, coalesce(lang, 'None') AS manifest_hash FROM documents GROUP BY lang",
    "s9_read_journal": "SELECT unit_id, idempotency_key, 'pending' AS state FROM units WHERE unit_id LIKE '%8.md'",
    "s10_embedding_cache": "SELECT CAST(vec_id AS VARCHAR) AS content_hash, CAST(len(embedding) AS INTEGER) AS dims, CAST(embedding[1] AS DOUBLE) AS first FROM embeddings WHERE len(embedding) > 0",
    "i6_apply_journal": _JUDGED,
    "z1_stream_index": "SELECT * FROM links2 UNION ALL SELECT * FROM backs2 UNION ALL SELECT * FROM inferred_flat2",
    "z2_stream_journal": _JUDGED,
    "z3_stream_ledger": """
        SELECT 'h' || user_id AS id, list_reduce(list_prepend(CAST(0.5 AS DOUBLE), list(amount ORDER BY ts, event_id)), lambda s, x: greatest(0.0, least(1.0, round(s + x, 4)))) AS score, count(*) AS n_steps
        FROM (SELECT *, CAST(CASE event_type WHEN 'purchase' THEN 0.2 WHEN 'click' THEN 0.1 WHEN 'error' THEN -0.1 WHEN 'signup' THEN -0.3 ELSE 0 END AS DOUBLE) AS amount FROM events)
        WHERE epoch_us(ts) // 1000 < (SELECT max(epoch_us(ts)) // 1000 - 600000 FROM events) GROUP BY user_id""",
    "z4_stream_pending_ttl": """SELECT event_type AS file_id, CAST(user_id AS VARCHAR) AS "user", max(epoch_us(ts)) // 1000 AS created_ms FROM events GROUP BY ALL HAVING max(epoch_us(ts)) // 1000 + 86400000 < (SELECT max(epoch_us(ts)) // 1000 - 60000 FROM events)""",
    "i5_update_edges": "SELECT * FROM links2 UNION ALL SELECT * FROM backs2 UNION ALL SELECT * FROM inferred_flat2",
    "i7_index_edges": "SELECT * FROM edges UNION ALL SELECT * FROM inferred_flat",
    "i5_apply_update": "SELECT node_key, content_hash FROM secu2",
    "k7_profile_cache": """
        SELECT n.path, f.path IS NOT NULL AS hit, CAST(coalesce(f.n_words, len(list_filter(regexp_split_to_array(regexp_replace(n.content, '^---\\n[^\\n]*\\n---\\n', ''), '\\s+'), lambda w: w <> ''))) AS INTEGER) AS n_words
        FROM notes2 n LEFT JOIN facts f ON f.path = n.path AND n.doc_id % 14 = n.doc_id % 7""",
    "l1_fold_ledger": "SELECT run_id, id, score, status, CAST(CASE WHEN linked THEN 1 ELSE 0 END AS INTEGER) AS n_links FROM ledger_rows",
    "l4_evaluate_status": "SELECT run_id, status, reason, top_score FROM ledger_status",
    "l5_clarification_trigger": """
        SELECT run_id, CASE WHEN status IN ('conflicted', 'insufficient_evidence') THEN 'mandatory' WHEN hot THEN 'optional' WHEN late THEN 'mandatory' ELSE 'none' END AS action,
          CASE WHEN status IN ('conflicted', 'insufficient_evidence') THEN status WHEN hot THEN 'hot_topic' WHEN late THEN 'budget' ELSE 'no_trigger' END AS reason
        FROM (SELECT run_id, status, run_id = 'r2' AS hot, calls / 60.0 >= 0.8 AND status = 'needs_verification' AS late FROM ledger_status)""",
    "l6_summary_card": f"""
        WITH lead AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, created_at, id) AS rk FROM ledger_rows QUALIFY rk <= 5),
        said AS (SELECT run_id, string_agg('- [' || status || '] ' || printf('%.2f', score) || ' ' || id, {NL} ORDER BY rk) AS l FROM lead GROUP BY run_id),
        seen AS (SELECT run_id, string_agg('- ' || event_type || ': ' || n, {NL} ORDER BY event_type) AS d FROM (SELECT 'r' || user_id % 5 AS run_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY run_id)
        SELECT s.run_id, concat_ws({NL}, 'status: ' || s.status || ' (coverage ' || printf('%.2f', s.coverage) || ')', 'assumptions:', said.l, 'folders:', seen.d) AS card
        FROM ledger_status s LEFT JOIN said USING (run_id) LEFT JOIN seen USING (run_id)""",
}


FINAL |= {
    "c10_community_reports": f"""
        SELECT community_id, substring(regexp_replace(string_split(min_by('### ' || coalesce(nullif(heading_path, ''), node_key), node_key), {NL})[1], '\\s+$', ''), 1, 200) AS report, CAST(sum(n) AS INTEGER) AS tokens
        FROM (SELECT *, sum(n) OVER (PARTITION BY community_id ORDER BY node_key ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT m.community_id, s.node_key, s.heading_path, ceil(length(s.text) / 4.0) AS n FROM members m JOIN secu s ON s.node_key = m.section_key)) WHERE run <= 3000 GROUP BY community_id""",
    "i4_edges_for_changed": """
        WITH edited AS (SELECT file_id FROM diff WHERE change IN ('changed', 'deleted')),
        kept AS (SELECT * FROM links2 WHERE split_part(src_key, '::', 1) IN (SELECT file_id FROM edited) OR split_part(dst_key, '::', 1) IN (SELECT file_id FROM edited))
        SELECT * FROM kept UNION ALL SELECT src_key, dst_key, 'backlink', CAST(max(weight) AS DOUBLE) FROM (
          SELECT dst_key AS src_key, src_key AS dst_key, 0.8 AS weight FROM kept UNION ALL SELECT dst_key, split_part(src_key, '::', 1), 0.7 FROM kept WHERE contains(src_key, '::')) GROUP BY 1, 2""",
    "i7_build_index": "SELECT kind, count(*) AS n FROM (SELECT kind FROM edges UNION ALL SELECT kind FROM inferred_flat) GROUP BY kind",
    "p6_destination_context": f"""
        SELECT unit_id, node_key, CASE WHEN spot = 0 THEN '' ELSE array_to_string(list_slice(l, greatest(spot - 5, 1), spot - 1), {NL}) END AS before, CASE WHEN spot = 0 THEN '' ELSE array_to_string(list_slice(l, spot + 1, spot + 5), {NL}) END AS after
        FROM (SELECT *, CASE WHEN head = '' THEN 1 ELSE coalesce(list_position(list_transform(l, lambda x: contains(x, head)), true), 0) END AS spot FROM (
          SELECT s.file_id AS unit_id, s.node_key, string_split(string_split(s.node_key, '::')[-1], {SEP})[-1] AS head, string_split(n.front || n.body, {NL}) AS l
          FROM (SELECT file_id, max(node_key) AS node_key FROM secu GROUP BY file_id) s JOIN notes n ON n.path = s.file_id))""",
    "f8_folder_digest": f"""
        SELECT d.folder, concat_ws({NL}, CASE WHEN d.folder = '' THEN '(root)' ELSE d.folder END || '/', 'files: ' || coalesce(array_to_string(string_split(d.names, ',')[1:20], ', '), ''), 'links: ' || l.shown, h.shown) AS digest
        FROM dirs d LEFT JOIN (SELECT folder, string_agg(dst_key, ', ' ORDER BY n DESC, dst_key) AS shown FROM ({FINAL['f6_folder_top_links']}) GROUP BY folder) l ON l.folder = d.folder
        LEFT JOIN (SELECT folder, string_agg('- ' || heading_text || ': ' || substring(regexp_replace(s.text, '\\s+', ' ', 'g'), 1, 100), {NL} ORDER BY node_key) AS shown FROM heads JOIN (SELECT node_key, text FROM secu) s USING (node_key) GROUP BY folder) h ON h.folder = d.folder""",
    "k5_sample_corpus": "SELECT path, kind, CAST(n_words AS INTEGER) AS n_words, array_to_string(shown, ' ') AS excerpt, CAST(len(shown) AS INTEGER) AS excerpt_words FROM profile_long",
    "k6_coverage": "SELECT count(DISTINCT p.folder) / CAST(count(DISTINCT f.folder) AS DOUBLE) AS coverage FROM facts f LEFT JOIN profile_short p ON p.folder = f.folder",
    "k8_profile_report": f"""
        SELECT CAST(0 AS INTEGER) AS part, folder AS key, folder || '/: ' || n_files || ' notes, ' || mean_words || ' words on average, tags ' || tags AS line FROM ({FINAL['k4_folder_summary']})
        UNION ALL SELECT 1, path, path || ' [' || kind || ', ' || n_words || ' words]: ' || array_to_string(shown, ' ') FROM profile_long""",
}

# A document's edits by the ops of the queries: lines 5 and 6 joined, a header before line 4, blanks
# of lines 5 and 6 as one, the same lines removed (on every third document; else of a wrong kind). On
# every seventh the range is empty, so that the header alone is left.
_STRIPPED = "'^\\s+|\\s+$', '', 'g'"
PARTS["opened"] = f"""
SELECT doc_id, old, l, e, bare, CASE WHEN bare THEN 0 ELSE 5 - e END AS moved,
  CASE WHEN bare THEN l ELSE l[:4] || [array_to_string(list_transform(l[5:e], lambda x: regexp_replace(x, {_STRIPPED})), ' ')] || l[e + 1:] END AS joined
FROM (SELECT doc_id, content AS old, string_split(content, {NL}) AS l, least(6, len(string_split(content, {NL}))) AS e, doc_id % 7 = 0 AS bare FROM (SELECT doc_id, front || body AS content FROM notes))"""
PARTS["headed"] = """
SELECT doc_id, old, bare, 6 + moved AS s, e + 1 + moved AS e, joined[:3 + moved] || ['## New part'] || joined[4 + moved:] AS l FROM opened"""
PARTS["squeezed"] = """
SELECT doc_id, old, bare, s, e, CASE WHEN bare OR len(list_filter(l[s:e], lambda x: regexp_matches(x, '^\\s*$'))) < 2 THEN l
  ELSE l[:s - 1] || list_filter(list_transform(l[s:e], lambda x, k: CASE WHEN NOT regexp_matches(x, '^\\s*$') THEN x WHEN len(list_filter(l[s:s + k - 1], lambda y: regexp_matches(y, '^\\s*$'))) = 1 THEN '' END), lambda x: x IS NOT NULL) || l[e + 1:] END AS l
FROM headed"""
PARTS["edits"] = f"""
SELECT doc_id, old, array_to_string(CASE WHEN bare OR doc_id % 3 <> 0 THEN l ELSE l[:s - 1] || l[e + 1:] END, {NL}) AS new, bare, CASE WHEN bare THEN 1 WHEN doc_id % 3 = 0 THEN 4 ELSE 3 END AS n_applied FROM squeezed"""


def _edit_check(name: str) -> str:
    """The check of that query, on the edited documents."""
    return re.sub(r"\bpairs\b", "edits", FINAL[name])


FINAL |= {
    "e5_apply_edits": "SELECT doc_id, sha1(new) AS content_hash, CAST(n_applied AS INTEGER) AS n_applied FROM edits",
    "e6_receipts": f"""
        SELECT a.doc_id, substr(sha1(old), 1, 12) AS hash_before, substr(sha1(new), 1, 12) AS hash_after, w.ok AS words_ok, h.ok AS headers_ok, p.ok AS spans_ok, CAST(n_applied AS BIGINT) AS ops_applied, CAST(4 - n_applied AS BIGINT) AS ops_rejected,
          CASE WHEN bare THEN '{{"insert_header":1}}' WHEN n_applied = 3 THEN '{{"collapse_blanks":1,"insert_header":1,"join_lines":1}}' ELSE '{{"collapse_blanks":1,"insert_header":1,"join_lines":1,"remove_span":1}}' END AS diff_stat
        FROM edits a JOIN (SELECT doc_id, ok OR (lost = 'tag' AND doc_id % 21 <> 0 AND doc_id % 3 = 0) AS ok FROM ({_edit_check('e1_words_conserved')})) w USING (doc_id)
        JOIN ({_edit_check('e2_headers_preserved')}) h USING (doc_id) JOIN ({_edit_check('e3_protected_spans')}) p USING (doc_id)""",
    # Of each pair the length of the longest common subsequence, a row of its table a step.
    "e9_line_diff": f"""
        WITH RECURSIVE sides AS (SELECT doc_id, string_split(old, {NL}) AS a, string_split(new, {NL}) AS b, old = new AS equal FROM pairs),
        above AS (SELECT doc_id, unnest(a) AS x, generate_subscripts(a, 1) AS k FROM sides WHERE NOT equal),
        walk AS (
          SELECT doc_id, len(a) AS i, unnest(range(1, len(b) + 2)) AS j, unnest(b || [NULL]) AS y, 0 AS v FROM sides WHERE NOT equal
          UNION ALL
          SELECT doc_id, i, j, y, max(c) OVER (PARTITION BY doc_id ORDER BY j DESC ROWS UNBOUNDED PRECEDING) AS v FROM (
            SELECT w.doc_id, w.i - 1 AS i, w.j, w.y, CASE WHEN a.x = w.y THEN 1 + lead(w.v) OVER (PARTITION BY w.doc_id ORDER BY w.j) ELSE w.v END AS c
            FROM walk w JOIN above a ON a.doc_id = w.doc_id AND a.k = w.i)),
        shared AS (SELECT s.doc_id, len(a) AS n, len(b) AS m, CASE WHEN equal THEN len(a) ELSE v END AS k FROM sides s LEFT JOIN walk w ON w.doc_id = s.doc_id AND w.i = 0 AND w.j = 1)
        SELECT doc_id, op, n FROM (SELECT doc_id, 'same' AS op, k AS n FROM shared UNION ALL SELECT doc_id, 'delete', n - k FROM shared UNION ALL SELECT doc_id, 'insert', m - k FROM shared) WHERE n > 0""",
}


def _needs(text: str) -> set[str]:
    return {p for p in PARTS if re.search(rf"\b{p}\b", text)}


def sql() -> dict[str, str]:
    """Each statement with the named queries that it builds on, in order."""
    out = {}
    for name, text in FINAL.items():
        need, todo = set(), _needs(text)
        while todo:
            p = todo.pop()
            if p not in need:
                need.add(p)
                todo |= _needs(PARTS[p]) - need - {p}
        used = [f"{p} AS ({PARTS[p].strip()})" for p in PARTS if p in need]
        body = text.strip()
        if used and body.startswith("WITH RECURSIVE "):
            out[name] = "WITH RECURSIVE " + ",\n".join(used) + ",\n" + body[15:]
        elif used and body.startswith("WITH "):
            out[name] = "WITH " + ",\n".join(used) + ",\n" + body[5:]
        else:
            out[name] = ("WITH " + ",\n".join(used) + "\n" if used else "") + body
    return out
