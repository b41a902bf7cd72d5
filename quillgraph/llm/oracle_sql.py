"""Reference SQL of the manifest, clustering and top-k queries."""

from __future__ import annotations

_FIELD = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    fields = ("doc_id", "source", "lang", n_chars, "text")
    return "sha256(" + " || ".join(_FIELD.format(f) for f in fields) + ")"


#: CRC-32 of a decimal number bit by bit: 3988292384 is the reversed polynomial.
_CRC = """xor(list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
    lambda crc, byte: list_reduce(
      list_prepend(xor(crc, byte), range(8)::UBIGINT[]),
      lambda a, _: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::UBIGINT) ELSE a // 2 END)), 4294967295::UBIGINT)"""


def _levels(nodes: str, leaves: str) -> str:
    """Every node of every tree: ``tree, level, i, n, digest``."""
    return f"""{nodes} AS (
  SELECT tree, 0 AS level, i, n, digest FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY i))
  FROM {nodes} WHERE n > 1 GROUP BY tree, level, i // 2, n
)"""


def _folds(folds: str, start: str, nodes: str) -> str:
    """Way of every started node to its tree's root: ``r, level, i, acc, proof``."""
    return f"""{folds} AS (
  SELECT r, tree, 0 AS level, i, n, acc, proof FROM {start}
  UNION ALL
  SELECT f.r, f.tree, f.level + 1, f.i // 2, (f.n + 1) // 2,
         sha256(CASE WHEN f.i % 2 = 1 THEN s.digest || f.acc ELSE f.acc || coalesce(s.digest, '') END),
         f.proof || coalesce(s.digest, '')
  FROM {folds} f LEFT JOIN {nodes} s
    ON s.tree = f.tree AND s.level = f.level AND s.i = CASE WHEN f.i % 2 = 1 THEN f.i - 1 ELSE f.i + 1 END
  WHERE f.n > 1
)"""


OP11_SQL = f"""
WITH RECURSIVE rows_ AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('+' || lang, '') AS tree, {_leaf("n_chars")} AS digest,
         CASE WHEN {_CRC} % 7 = 0 THEN {_leaf("(n_chars + 1)")} ELSE {_leaf("n_chars")} END AS claimed
  FROM documents
),
leaves AS (
  SELECT r, doc_id, tree, digest, claimed, count(*) OVER (PARTITION BY tree) AS n,
         row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest, r) - 1 AS i
  FROM rows_
),
{_levels("nodes", "leaves")},
subroots AS (SELECT tree AS own, digest FROM nodes WHERE n = 1),
tops AS (
  SELECT own, '' AS tree, digest, count(*) OVER () AS n, row_number() OVER (ORDER BY encode(own)) - 1 AS i FROM subroots
),
{_levels("crown", "tops")},
started AS (SELECT r, tree, i, n, claimed AS acc, '' AS proof FROM leaves),
{_folds("ways", "started", "nodes")},
arrived AS (
  SELECT w.r, t.tree, t.i, t.n, w.acc, w.proof, t.digest AS subroot, w.tree AS own
  FROM ways w JOIN tops t ON t.own = w.tree WHERE w.n = 1
),
{_folds("last_ways", "arrived", "crown")}
SELECT doc_id, leaves.digest AS leaf, arrived.subroot, crown.digest AS root, sha256(last_ways.proof) AS proof_sha256,
       last_ways.acc AS folded_root, last_ways.acc = crown.digest AS verified
FROM leaves JOIN arrived USING (r) JOIN last_ways USING (r) JOIN crown ON crown.n = 1
WHERE last_ways.n = 1
"""

_USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _round(k: int) -> str:
    """Assignment to the centroids of a round, and the centroids of the next."""
    return f"""
a{k} AS MATERIALIZED (
  SELECT r, vec_id, ints, k, distance FROM (
    SELECT v.r, v.vec_id, v.ints, c.k,
           list_sum(list_transform(range(1, 65), lambda j: (v.ints[j] - c.ints[j]) * (v.ints[j] - c.ints[j])))::BIGINT AS distance
    FROM v CROSS JOIN c{k} c
  ) QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, k) = 1
),
m{k} AS (
  SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY j)::BIGINT[] AS ints FROM (
    SELECT k, j, sum(x) AS s, count(*) AS n
    FROM (SELECT k, unnest(ints) AS x, unnest(range(1, 65)) AS j FROM a{k}) GROUP BY k, j
  ) GROUP BY k
),
c{k + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.ints, c.ints) AS ints FROM c{k} c LEFT JOIN m{k} m USING (k))"""


def _clusters(rounds: int) -> str:
    chain = ",".join(_round(k) for k in range(rounds + 1))
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS ints
  FROM embeddings WHERE len(embedding) = 64 AND {_USABLE}
),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR) NULLS LAST, ints) - 1 AS k, ints FROM v QUALIFY k < 8
),
{chain}
SELECT vec_id, a{rounds}.k::INT AS cluster, distance,
       sum(distance) OVER (PARTITION BY a{rounds}.k)::BIGINT AS cluster_inertia,
       sum(distance) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c{rounds}.ints, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (k)
"""


OP12_SQL = _clusters(10)

OP13_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS terms
  FROM embeddings WHERE {_USABLE}
),
scored AS (
  SELECT q.r AS query, q.vec_id AS query_id, d.r AS row, d.vec_id,
         coalesce(list_sum(list_transform(range(1, least(len(q.terms), len(d.terms)) + 1), lambda j: q.terms[j] * d.terms[j])), 0)::BIGINT AS score
  FROM v q JOIN v d ON q.r <> d.r WHERE q.vec_id % 20 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id NULLS LAST, row)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""
