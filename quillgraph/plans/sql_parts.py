"""SQL fragments shared by the reference statements (DuckDB dialect)."""

from __future__ import annotations

from quillgraph.functions.text import STOP_WORDS

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)

_BREAK = r"""'[\s\p{Z},:;!?()"\[\]{}]+'"""
_TRIM = r"""'^[^\p{L}\p{N}]*(\p{L}+?)(?:''s|''re|''ve|''ll|''d|''m|n''t)?[^\p{L}\p{N}]*$'"""


def word_tokens(text: str, stop: bool = True) -> str:
    extra = f" AND w NOT IN ({_STOP})" if stop else ""
    return (
        f"list_filter(list_transform(regexp_split_to_array(lower({text}), {_BREAK}), "
        rf"lambda x: regexp_extract(x, {_TRIM}, 1)), lambda w: w <> ''{extra})"
    )


def index_tokens(text: str) -> str:
    return (
        rf"regexp_extract_all(lower({text}), "
        r"'[\p{L}\p{M}\p{N}_]+(?:[''’.][\p{L}\p{M}\p{N}_]+)*')"
    )


def _scored(
    name: str, doc_tokens: str, stop: bool, idf: str, part: str, k: int, query_stop: bool = True
) -> str:
    query_tokens = word_tokens("text", query_stop)
    return f"""
{name}_tok AS MATERIALIZED (SELECT doc_id, {doc_tokens} AS tokens FROM documents WHERE text IS NOT NULL),
{name}_corpus AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM {name}_tok),
{name}_df AS (SELECT term, count(*) AS df FROM
  (SELECT unnest(list_distinct(tokens)) AS term FROM {name}_tok) GROUP BY term),
{name}_raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r, n FROM {name}_df, {name}_corpus),
{name}_idf AS (SELECT term, {idf} AS idf FROM {name}_raw),
{name}_qt AS (SELECT query_id, term, count(*) AS times FROM
  (SELECT item_id AS query_id, unnest({query_tokens}) AS term FROM benchmark) GROUP BY ALL),
{name}_tf AS (SELECT doc_id, doc_len, term, count(*) AS tf FROM
  (SELECT doc_id, len(tokens) AS doc_len, unnest(tokens) AS term FROM {name}_tok)
  WHERE term IN (SELECT term FROM {name}_qt) GROUP BY ALL),
{name}_scores AS (SELECT query_id, doc_id, round(sum({part}), 6) AS score
  FROM {name}_tf JOIN {name}_qt USING (term) JOIN {name}_idf USING (term), {name}_corpus
  GROUP BY query_id, doc_id),
{name} AS (SELECT query_id, rank, doc_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
   FROM {name}_scores) WHERE rank <= {k})"""


def bm25(name: str = "bm", k: int = 10, stop: bool = True) -> str:
    """CTEs ending in ``<name>(query_id, rank, doc_id, score)``."""
    return _scored(
        name,
        word_tokens("text", stop),
        stop,
        f"CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM {name}_raw) ELSE r END",
        "times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_len / avgdl))",
        k,
        stop,
    )


def fulltext(name: str = "ft", k: int = 10) -> str:
    return _scored(
        name,
        index_tokens("text"),
        False,
        "ln(1 + (n - df + 0.5) / (df + 0.5))",
        "times * idf * tf / (tf + 1.2 * (0.25 + 0.75 * doc_len / avgdl))",
        k,
    )


COSINE = """round(list_cosine_similarity(
  list_transform({a}, lambda x: x::DOUBLE), list_transform({b}, lambda x: x::DOUBLE)), 6)"""


def vectors(name: str = "vec", k: int = 10) -> str:
    cosine = COSINE.format(a="q.embedding", b="v.embedding")
    return f"""
{name} AS (SELECT query_id, rank, doc_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM
    (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, {cosine} AS score
     FROM embeddings q, embeddings v WHERE q.vec_id IN (SELECT item_id FROM benchmark)))
  WHERE rank <= {k})"""


def fused(parts: list[tuple[str, float]], k: int = 10, k1: int = 60) -> str:
    """CTE ``fused`` over component CTEs named like the parts."""
    union = " UNION ALL ".join(
        f"SELECT query_id, doc_id, rank, {w} AS w FROM {n}" for n, w in parts
    )
    return f"""
fused AS (SELECT query_id, rank, doc_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM
    (SELECT query_id, doc_id, round(sum(w / ({k1} + rank)), 9) AS score
     FROM ({union}) GROUP BY query_id, doc_id)) WHERE rank <= {k})"""


TRUTH = """
truth AS (SELECT b.item_id AS query_id, d.doc_id, 'https://docs.example.org/' || d.doc_id AS reference
  FROM documents d JOIN benchmark b ON contains(d.text, b.text))"""


def annotated(ranked: str = "bm", name: str = "ann") -> str:
    """CTE of positive annotations of a ranking by two-way substring match of addresses."""
    return f"""
{name} AS (SELECT DISTINCT query_id, rank - 1 AS chunk_index FROM
  (SELECT r.query_id, r.rank, 'https://docs.example.org/' || r.doc_id AS url, t.reference
   FROM {ranked} r JOIN truth t ON r.query_id = t.query_id)
  WHERE contains(url, reference) OR contains(reference, url))"""


def per_query(ranked: str = "bm", ann: str = "ann", name: str = "pq") -> str:
    cuts = ",\n".join(
        f"coalesce(max(CASE WHEN rank <= {k} THEN rel END), 0) AS hit_at_{k}, "
        f"coalesce(sum(CASE WHEN rank <= {k} THEN rel END), 0) / {k}.0 AS precision_at_{k}, "
        f"coalesce(sum(CASE WHEN rank <= {k} THEN rel END) / nullif(sum(rel), 0), 0) AS recall_at_{k}"
        for k in (1, 3, 5, 10)
    )
    return f"""
{name} AS (SELECT b.item_id AS query_id, {cuts},
  coalesce(1.0 / min(CASE WHEN rel = 1 THEN rank END), 0) AS mrr,
  coalesce(max(has), false) AS annotated
  FROM benchmark b LEFT JOIN
   (SELECT r.query_id, r.rank, CASE WHEN a.chunk_index IS NULL THEN 0 ELSE 1 END AS rel
    FROM {ranked} r LEFT JOIN {ann} a ON a.query_id = r.query_id AND a.chunk_index = r.rank - 1) x
   ON x.query_id = b.item_id
  LEFT JOIN (SELECT DISTINCT query_id, true AS has FROM {ann}) h ON h.query_id = b.item_id
  GROUP BY b.item_id)"""


DISPLAY = f"""array_to_string(list_filter(list_transform(regexp_split_to_array(lower(text), '\\s+'),
  lambda w: regexp_replace(w, '^[?.,!]+|[?.,!]+$', '', 'g')),
  lambda w: w <> '' AND w NOT IN ({_STOP})), ' ')"""


def ivf(queries: str, k: int = 10, rounds: int = 5, name: str = "ivf") -> str:
    """CTEs of the inverted-file index over ``embeddings`` ending in ``<name>(query_id, rank, doc_id, score)``.

    ``queries``: name of a CTE ``(query_id, v)``. The number of probed cells holds 0.95 of the exact
    ten neighbours of the vectors whose id is divisible by 100.
    """
    near = """(SELECT r.{0}, r.ints, c.k, list_sum(list_transform(range(1, len(r.ints) + 1),
      lambda j: (r.ints[j] - c.ints[j]) * (r.ints[j] - c.ints[j]))) AS far FROM {1} r CROSS JOIN c{2} c)"""
    chain = ",".join(
        f"""
a{n} AS MATERIALIZED (SELECT doc_id, ints, k FROM {near.format("doc_id", "sampled", n)}
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY far, k) = 1),
m{n} AS (SELECT k, list(m ORDER BY j) AS ints FROM
  (SELECT k, j, floor(sum(x) / count(*)) AS m FROM
    (SELECT k, unnest(ints) AS x, unnest(range(1, len(ints) + 1)) AS j FROM a{n}) GROUP BY k, j) GROUP BY k),
c{n + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.ints, c.ints) AS ints FROM c{n} c LEFT JOIN m{n} m USING (k))"""
        for n in range(rounds)
    )
    exact = COSINE.format(a="q.v", b="u.v")

    def whole(v: str) -> str:
        norm = f"sqrt(list_sum(list_transform({v}, lambda y: y * y)))"
        return f"list_transform({v}, lambda x: floor(x / {norm} * 32768))"

    return f"""
u0 AS MATERIALIZED (SELECT vec_id AS doc_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
u AS MATERIALIZED (SELECT doc_id, v, {whole("v")} AS ints FROM u0),
sampled AS MATERIALIZED (SELECT doc_id, ints FROM u
  WHERE ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT % greatest(1, ceil((SELECT count(*) FROM u) / 65536)::BIGINT) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256(doc_id::VARCHAR), ints) - 1 AS k, ints FROM sampled
  QUALIFY k < greatest(1, least(4096, floor(sqrt((SELECT count(*) FROM u)))))),
{chain},
homes AS MATERIALIZED (SELECT doc_id, k FROM {near.format("doc_id", "u", rounds)}
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY far, k) = 1),
asked AS MATERIALIZED (SELECT query_id, v, {whole("v")} AS ints FROM {queries}),
fit AS MATERIALIZED (SELECT doc_id AS query_id, v, ints FROM u WHERE doc_id % 100 = 0),
fit_exact AS MATERIALIZED (SELECT query_id, doc_id FROM (SELECT q.query_id, u.doc_id, {exact} AS score FROM fit q CROSS JOIN u)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10),
fit_places AS (SELECT query_id, k, row_number() OVER (PARTITION BY query_id ORDER BY far, k) AS place
  FROM {near.format("query_id", "fit", rounds)}),
held AS (SELECT place, count(*) AS n FROM fit_exact JOIN homes USING (doc_id) JOIN fit_places USING (query_id, k) GROUP BY place),
probed AS (SELECT min(place) AS probes FROM
  (SELECT place, sum(n) OVER (ORDER BY place) AS seen, sum(n) OVER () AS total FROM held) WHERE seen >= 0.95 * total),
places AS MATERIALIZED (SELECT query_id, k FROM
  (SELECT query_id, k, row_number() OVER (PARTITION BY query_id ORDER BY far, k) AS place
   FROM {near.format("query_id", "asked", rounds)}) WHERE place <= (SELECT probes FROM probed)),
{name} AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
  FROM (SELECT q.query_id, u.doc_id, {exact} AS score FROM asked q JOIN places p USING (query_id) JOIN homes h ON h.k = p.k
    JOIN u ON u.doc_id = h.doc_id) QUALIFY rank <= {k})"""
