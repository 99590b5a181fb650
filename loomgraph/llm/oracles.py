"""DuckDB counterparts of training-data queries that SQL can express."""

from __future__ import annotations

# The unsigned crc32 of a string: 256 table entries by eight shifts each, then one step a byte.
CRC = """
crc_table AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END, i::BIGINT)) AS t
)"""
CRC_OF = "xor(list_reduce(list_transform(string_split({}, ''), lambda c: ord(c)::BIGINT), lambda a, b: xor(a // 256, crc_table.t[(xor(a % 256, b) + 1)::INT]), 4294967295::BIGINT), 4294967295::BIGINT)"


def _field(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _tree(name: str, leaves: str) -> str:
    """All nodes (g, lvl, idx, size, h) of the trees over ``leaves`` (g, idx, size, h)."""
    return f"""
{name} AS (
  SELECT g, 0 AS lvl, idx, size, h FROM {leaves}
  UNION ALL
  SELECT g, lvl + 1, idx // 2, (size + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM {name} WHERE size > 1 GROUP BY g, lvl, idx // 2, size
)"""


def _climb(name: str, start: str, tree: str) -> str:
    """Rows of ``start`` (doc_id, g, idx, h, proof) carried up the levels of ``tree``."""
    sibling = f"{tree} AS s ON s.g = c.g AND s.lvl = c.lvl AND s.idx = xor(c.idx, 1)"
    return f"""
{name} AS (
  SELECT doc_id, g, 0 AS lvl, idx, h, proof FROM {start}
  UNION ALL
  SELECT c.doc_id, c.g, c.lvl + 1, c.idx // 2,
         sha256(CASE WHEN s.h IS NULL THEN c.h WHEN c.idx % 2 = 0 THEN c.h || s.h ELSE s.h || c.h END), c.proof || coalesce(s.h, '')
  FROM {name} c JOIN {tree} AS o ON o.g = c.g AND o.lvl = c.lvl AND o.idx = c.idx AND o.size > 1 LEFT JOIN {sibling}
)"""


def merkle() -> str:
    odd = f"CASE WHEN n_chars IS NOT NULL AND {CRC_OF.format('doc_id::VARCHAR')} % 7 = 0 THEN {_leaf('(n_chars + 1)')} ELSE {_leaf('n_chars')} END"
    return f"""
WITH RECURSIVE {CRC},
docs AS MATERIALIZED (SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, {odd} AS shown FROM documents, crc_table),
langs AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT lang FROM documents)),
leaves AS MATERIALIZED (
  SELECT g, doc_id, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS size, leaf AS h, shown
  FROM docs JOIN langs ON docs.lang IS NOT DISTINCT FROM langs.lang
), {_tree("up", "leaves")},
subs AS MATERIALIZED (SELECT 0 AS g, g AS idx, count(*) OVER () AS size, h FROM up WHERE size = 1), {_tree("top", "subs")},
start AS (SELECT doc_id, g, idx, shown AS h, '' AS proof FROM leaves), {_climb("climbed", "start", "up")},
middle AS (SELECT doc_id, 0 AS g, c.g AS idx, c.h, c.proof FROM climbed c JOIN up o ON o.g = c.g AND o.lvl = c.lvl AND o.size = 1), {_climb("climbed2", "middle", "top")},
done AS (SELECT c.doc_id, c.h, c.proof, o.h AS root FROM climbed2 c JOIN top o ON o.lvl = c.lvl AND o.size = 1)
SELECT d.doc_id, l.h AS leaf, s.h AS subroot, root, sha256(proof) AS proof_sha256, d.h AS folded_root, d.h = root AS verified
FROM done d JOIN leaves l ON l.doc_id = d.doc_id JOIN subs s ON s.idx = l.g"""


def clusters(k: int = 40, rounds: int = 5) -> str:
    parts = []
    for r in range(rounds + 1):
        parts.append(f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, e, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT vec_id, v.e AS e, m.c AS c, list_sum(list_transform(list_zip(v.e, m.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, m{r} m
  ) GROUP BY vec_id, e
)""")
        if r < rounds:
            parts.append(f"""
m{r + 1} AS MATERIALIZED (
  SELECT m.c, coalesce(n.e, m.e) AS e FROM m{r} m LEFT JOIN (
    SELECT c, list(((s - ((s % n) + n) % n) / n)::BIGINT ORDER BY j) AS e
    FROM (SELECT c, j, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM (SELECT c, unnest(e) AS x, generate_subscripts(e, 1) AS j FROM a{r}) GROUP BY c, j) GROUP BY c
  ) n ON n.c = m.c
)""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
),
m0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS c, e FROM (SELECT sha256('2:' || vec_id::VARCHAR) AS h, e FROM v ORDER BY h LIMIT {k})
), {",".join(parts)}
SELECT vec_id, a.c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(m.e, ',')) AS centroid_sha256
FROM a{rounds} a JOIN m{rounds} m ON m.c = a.c"""


SQL = {"op11_merkle_manifest": merkle(), "op12_centroid_clusters": clusters()}
