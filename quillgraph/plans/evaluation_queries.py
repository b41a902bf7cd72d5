"""Registered annotation, metric, report and experiment-table queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import evaluation as E
from quillgraph.operators import lexical
from quillgraph.operators import reports as R
from quillgraph.plans import inputs
from quillgraph.plans import sql_parts as S
from quillgraph.plans.registry import query
from quillgraph.session import checkpointed
from quillgraph.sources import io
from quillgraph.sources.tables import table

RETRIEVERS = ["bm25", "fulltext"]


def ranked(spark: SparkSession, d: str, kind: str = "bm25", k: int = 10) -> DataFrame:
    search = {"bm25": lexical.bm25_search, "fulltext": lexical.fulltext_search}[kind]
    rows = search(inputs.queries(spark, d), inputs.documents(spark, d), k)
    # k rows per query, read by annotation and metrics alike: searched once, then stored
    return checkpointed(rows).withColumn("source_url", inputs.doc_url())


def annotated(spark: SparkSession, d: str, kind: str = "bm25") -> tuple[DataFrame, DataFrame]:
    rows = ranked(spark, d, kind)
    return rows, E.auto_annotate(rows, inputs.references(spark, d))


def metrics(spark: SparkSession, d: str, kind: str = "bm25") -> DataFrame:
    rows, marks = annotated(spark, d, kind)
    return E.per_query_metrics(inputs.queries(spark, d), rows, marks)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison."""
    return df.select(
        *[F.round(n, digits).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes]
    )


_BM = f"{S.bm25()}, {S.TRUTH}, {S.annotated()}, {S.per_query()}"
_BOTH = f"{_BM}, {S.fulltext()}, {S.annotated('ft', 'ftann')}, {S.per_query('ft', 'ftann', 'ftpq')}"
_METRICS = [f"{m}_at_{k}" for k in (1, 3, 5, 10) for m in ("hit", "precision", "recall")] + ["mrr"]
_ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in _METRICS)
_AVERAGES = ", ".join(f"round(avg({m}), 6) AS avg_{m}" for m in _METRICS)


@query("truth_pairs", f"WITH {S.TRUTH} SELECT query_id, doc_id FROM truth")
def truth_pairs(spark: SparkSession, d: str) -> DataFrame:
    return inputs.truth(spark, d)


@query(
    "ground_truth",
    f"""WITH {S.TRUTH} SELECT query_id, reference FROM truth""",
)
def ground_truth(spark: SparkSession, d: str) -> DataFrame:
    nested = (
        inputs.references(spark, d)
        .groupBy("query_id")
        .agg(F.collect_list("reference").alias("doc_references"))
    )
    return E.ground_truth(nested)


@query("auto_annotate", f"WITH {_BM} SELECT query_id, chunk_index, true AS is_relevant FROM ann")
def auto_annotate(spark: SparkSession, d: str) -> DataFrame:
    return annotated(spark, d)[1].select("query_id", "chunk_index", "is_relevant")


_EXISTING = "old AS (SELECT query_id, rank - 1 AS chunk_index FROM bm WHERE rank = 1)"


@query(
    "annotation_counts",
    f"""WITH {_BM}, {_EXISTING},
new AS (SELECT * FROM ann WHERE (query_id, chunk_index) NOT IN (SELECT query_id, chunk_index FROM old)),
seen AS (SELECT * FROM bm WHERE query_id IN (SELECT query_id FROM truth))
SELECT count(*) AS total_checked, (SELECT count(*) FROM new) AS auto_annotated,
  count_if(rank = 1) AS skipped_existing, count(DISTINCT query_id) AS queries_processed FROM seen""",
)
def annotation_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = ranked(spark, d)
    old = rows.where("rank = 1").select("query_id", (F.col("rank") - 1).alias("chunk_index"))
    refs = inputs.references(spark, d)
    return E.annotation_counts(rows, refs, E.auto_annotate(rows, refs, old), old)


@query(
    "annotation_upsert",
    f"""WITH {_BM},
old AS (SELECT query_id, rank - 1 AS chunk_index, false AS is_relevant, 'note ' || doc_id AS note FROM bm),
new AS (SELECT query_id, chunk_index FROM ann)
SELECT old.query_id, old.chunk_index, new.query_id IS NOT NULL AS is_relevant, note
FROM old LEFT JOIN new USING (query_id, chunk_index)""",
)
def annotation_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows, marks = annotated(spark, d)
    old = rows.select(
        "query_id",
        (F.col("rank") - 1).alias("chunk_index"),
        F.lit(False).alias("is_relevant"),
        F.concat(F.lit("note "), F.col("doc_id").cast("string")).alias("note"),
    )
    return E.upsert_annotations(old, marks.withColumn("seq", F.lit(1)))


@query(
    "add_reference",
    f"""WITH {S.bm25(k=1)}, {S.TRUTH},
refs AS (SELECT query_id, reference FROM truth UNION
  SELECT query_id, 'https://docs.example.org/' || doc_id FROM bm)
SELECT b.item_id AS query_id, count(reference) AS n_references,
  coalesce(string_agg(reference, ' ' ORDER BY reference), '') AS refs
FROM benchmark b LEFT JOIN refs r ON r.query_id = b.item_id GROUP BY b.item_id""",
)
def add_reference(spark: SparkSession, d: str) -> DataFrame:
    stored = (
        inputs.references(spark, d)
        .groupBy("query_id")
        .agg(F.collect_list("reference").alias("doc_references"))
    )
    asked = inputs.queries(spark, d).join(stored, "query_id", "left")
    extra = ranked(spark, d, k=1).select("query_id", F.col("source_url").alias("reference"))
    out = E.add_reference(asked, extra)
    return out.select(
        "query_id",
        F.size("doc_references").cast("long").alias("n_references"),
        F.array_join(F.array_sort("doc_references"), " ").alias("refs"),
    )


@query("metrics_per_query", f"WITH {_BM} SELECT query_id, annotated, {_ROUNDED} FROM pq")
def metrics_per_query(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics(spark, d))


@query(
    "metrics_truth_recall",
    f"""WITH {_BM}, x AS (SELECT query_id, count(DISTINCT reference) AS n FROM truth GROUP BY 1)
SELECT pq.query_id, round(coalesce(precision_at_10 * 10 / n, 0), 6) AS recall_at_10
FROM pq LEFT JOIN x USING (query_id)""",
)
def metrics_truth_recall(spark: SparkSession, d: str) -> DataFrame:
    rows, marks = annotated(spark, d)
    out = E.per_query_metrics(
        inputs.queries(spark, d), rows, marks, (10,), inputs.references(spark, d)
    )
    return rounded(out.select("query_id", "recall_at_10"))


@query(
    "metrics_macro",
    f"""WITH {_BM} SELECT count(*) AS total_queries, count_if(annotated) AS queries_with_annotation,
  count_if(NOT annotated) AS unannotated_queries, {_AVERAGES} FROM pq""",
)
def metrics_macro(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.macro_average(metrics(spark, d)))


@query(
    "view_summary",
    f"""WITH {_BM}, x AS (SELECT query_id, count(*) AS n FROM truth GROUP BY 1),
m AS (SELECT r.query_id, r.rank, CASE WHEN a.chunk_index IS NULL THEN 0 ELSE 1 END AS rel
  FROM bm r LEFT JOIN ann a ON a.query_id = r.query_id AND a.chunk_index = r.rank - 1)
SELECT m.query_id, count(*) AS total_chunks, sum(rel) AS relevant, round(sum(rel) / count(*), 6) AS precision,
  round(sum(rel) / any_value(n), 6) AS recall, max(CASE WHEN rank <= 1 THEN rel END) AS hit_at_1,
  max(CASE WHEN rank <= 3 THEN rel END) AS hit_at_3, max(CASE WHEN rank <= 5 THEN rel END) AS hit_at_5,
  max(CASE WHEN rank <= 10 THEN rel END) AS hit_at_10,
  round(coalesce(1.0 / min(CASE WHEN rel = 1 THEN rank END), 0), 6) AS mrr
FROM m LEFT JOIN x USING (query_id) GROUP BY m.query_id""",
)
def view_summary(spark: SparkSession, d: str) -> DataFrame:
    rows, marks = annotated(spark, d)
    return rounded(E.view_summary(rows, marks, inputs.references(spark, d)))


def both(spark: SparkSession, d: str) -> DataFrame:
    """Per-query metrics of two experiments stacked."""
    parts = [metrics(spark, d, kind).withColumn("experiment", F.lit(kind)) for kind in RETRIEVERS]
    return parts[0].unionByName(parts[1])


_CELLS = " UNION ALL ".join(
    f"SELECT '{label}' AS metric, (SELECT avg({column.removeprefix('avg_')}) FROM pq) AS b, "
    f"(SELECT avg({column.removeprefix('avg_')}) FROM ftpq) AS f"
    for column, label in R.REPORT_METRICS
)


@query(
    "compare_pivot",
    f"""WITH {_BOTH}, c AS ({_CELLS})
SELECT metric,
  CASE WHEN b > f THEN '**' || printf('%.3f', b) || '**' ELSE printf('%.3f', b) END AS bm25,
  CASE WHEN f > b THEN '**' || printf('%.3f', f) || '**' ELSE printf('%.3f', f) END AS fulltext FROM c""",
)
def compare_pivot(spark: SparkSession, d: str) -> DataFrame:
    averages = E.macro_average(both(spark, d), ["experiment"])
    return R.compare(averages, RETRIEVERS)


@query(
    "relevant_found",
    f"""WITH {_BOTH} SELECT 'bm25' AS experiment, count_if(hit_at_10 > 0) || '/' || count(*) AS found FROM pq
UNION ALL SELECT 'fulltext', count_if(hit_at_10 > 0) || '/' || count(*) FROM ftpq""",
)
def relevant_found(spark: SparkSession, d: str) -> DataFrame:
    return R.relevant_found(both(spark, d))


@query(
    "missed_queries",
    f"""WITH {_BOTH} SELECT b.item_id AS query_id, b.text AS query, {S.DISPLAY} AS without_stop_words,
  CASE WHEN pq.hit_at_10 > 0 THEN 'hit' ELSE '**MISS**' END AS bm25,
  CASE WHEN ftpq.hit_at_10 > 0 THEN 'hit' ELSE '**MISS**' END AS fulltext
FROM benchmark b JOIN pq ON pq.query_id = b.item_id JOIN ftpq ON ftpq.query_id = b.item_id
WHERE pq.hit_at_10 = 0 OR ftpq.hit_at_10 = 0""",
)
def missed_queries(spark: SparkSession, d: str) -> DataFrame:
    return R.missed_queries(both(spark, d), inputs.queries(spark, d), RETRIEVERS)


@query(
    "query_stats",
    """SELECT count(*) AS total, count_if(o_orderstatus = 'F') AS successful,
  count_if(o_orderstatus <> 'F') AS failed FROM orders""",
)
def query_stats(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "success").otherwise("failed")
    return E.query_stats(table(spark, d, "orders").select(status.alias("status")))


@query(
    "validation_summary",
    """SELECT coalesce(CASE quality WHEN 1 THEN 'pass' WHEN 0 THEN 'fail' END, 'unvalidated') AS validation,
  count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""",
)
def validation_summary(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"))
    flags = table(spark, d, "labels").select(
        F.col("doc_id").alias("item_id"),
        F.when(F.col("quality") == 1, "pass").when(F.col("quality") == 0, "fail").alias("validation"),
    )
    return E.validation_summary(items, flags)


@query(
    "open_codes",
    r"""WITH c AS (SELECT DISTINCT trim(unnest(regexp_split_to_array(text, '[.\n]'))) AS code FROM conversations)
SELECT code, row_number() OVER (ORDER BY code) AS number FROM c WHERE code <> ''""",
)
def open_codes(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence and line of every turn as a code."""
    notes = table(spark, d, "conversations").select(F.explode(F.split("text", r"[.\n]")).alias("code"))
    return E.open_codes(notes)


# ------------------------------------------------------------- experiment tables


def experiments(spark: SparkSession, d: str) -> DataFrame:
    """Orders seen as stored experiments."""
    priority = F.lower(F.regexp_replace("o_orderpriority", r"^\d-", ""))
    kind = F.concat(F.lit("vector_"), F.regexp_replace(priority, " ", "_"))
    return table(spark, d, "orders").select(
        F.year("o_orderdate").alias("run"),
        F.when(F.col("o_orderstatus") != "P", kind).alias("retriever"),
        F.format_string("%03d", "o_orderkey").alias("experiment_id"),
        F.when(F.col("o_totalprice") > 1000, F.col("o_orderdate")).alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("emb_"), priority)).alias("embedder"),
        F.col("o_orderstatus").alias("chunking"),
    )


_EXP = r"""exp AS (SELECT year(o_orderdate) AS run, CASE WHEN o_orderstatus <> 'P' THEN
    'vector_' || replace(lower(regexp_replace(o_orderpriority, '^\d-', '')), ' ', '_') END AS retriever,
  printf('%03d', o_orderkey) AS experiment_id, o_orderdate AS created_at,
  CASE WHEN o_orderstatus = 'F' THEN 'emb_' || lower(regexp_replace(o_orderpriority, '^\d-', '')) END AS embedder,
  o_orderstatus AS chunking FROM orders)"""


@query(
    "experiment_search",
    f"""WITH {_EXP} SELECT run, retriever, experiment_id, 'retrieval' AS kind FROM exp
WHERE retriever IS NOT NULL AND run = 1997 AND chunking = 'O'""",
)
def experiment_search(spark: SparkSession, d: str) -> DataFrame:
    found = R.search_experiments(experiments(spark, d), kind="retrieval", run=1997, chunking="O")
    return found.select("run", "retriever", "experiment_id", "kind")


@query("distinct_retrievers", f"WITH {_EXP} SELECT DISTINCT retriever FROM exp WHERE retriever <> ''")
def distinct_retrievers(spark: SparkSession, d: str) -> DataFrame:
    return R.distinct_retrievers(experiments(spark, d))


@query(
    "distinct_embedders",
    f"""WITH {_EXP} SELECT embedder FROM exp WHERE embedder <> '' UNION
SELECT replace(retriever, 'vector_', '') FROM exp WHERE retriever LIKE 'vector\\_%' ESCAPE '\\'""",
)
def distinct_embedders(spark: SparkSession, d: str) -> DataFrame:
    return R.distinct_embedders(experiments(spark, d))


@query(
    "next_experiment_id",
    f"""WITH {_EXP} SELECT run, retriever, printf('%03d', max(experiment_id::INT) + 1) AS next_id
FROM exp GROUP BY run, retriever""",
)
def next_experiment_id(spark: SparkSession, d: str) -> DataFrame:
    return R.next_experiment_id(experiments(spark, d))


@query(
    "latest_experiment",
    f"WITH {_EXP} SELECT run, retriever, max(experiment_id) AS experiment_id FROM exp GROUP BY ALL",
)
def latest_experiment(spark: SparkSession, d: str) -> DataFrame:
    return R.latest_experiment(experiments(spark, d))


@query(
    "pending_plan",
    f"""WITH {_EXP}, plan AS (SELECT DISTINCT run + 1 AS run, retriever, chunking FROM exp WHERE retriever IS NOT NULL)
SELECT run, retriever, chunking FROM plan EXCEPT SELECT run, retriever, chunking FROM exp""",
)
def pending_plan(spark: SparkSession, d: str) -> DataFrame:
    stored = experiments(spark, d).where("retriever is not null")
    plan = stored.select((F.col("run") + 1).alias("run"), "retriever", "chunking").distinct()
    return R.pending_plan(plan, stored, ["run", "retriever", "chunking"])


@query(
    "resolve_listed",
    f"""WITH {_EXP}, wanted AS (SELECT 'vector_high' AS retriever, printf('%03d', l_orderkey) AS experiment_id,
  l_linenumber + 10 * l_orderkey AS position FROM lineitem)
SELECT retriever, experiment_id, min(position) AS position FROM wanted
WHERE (retriever, experiment_id) IN (SELECT (retriever, experiment_id) FROM exp WHERE retriever IS NOT NULL)
GROUP BY ALL""",
)
def resolve_listed(spark: SparkSession, d: str) -> DataFrame:
    listed = table(spark, d, "lineitem").select(
        F.lit("vector_high").alias("retriever"),
        F.format_string("%03d", "l_orderkey").alias("experiment_id"),
        (F.col("l_linenumber") + 10 * F.col("l_orderkey")).alias("position"),
    )
    return R.resolve_listed(listed, experiments(spark, d))


@query(
    "experiment_discovery",
    f"""WITH {_EXP}, measured AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
SELECT run, retriever, count(*) AS n FROM exp WHERE retriever IS NOT NULL
 AND experiment_id::BIGINT IN (SELECT l_orderkey FROM measured) GROUP BY ALL""",
)
def experiment_discovery(spark: SparkSession, d: str) -> DataFrame:
    configs = experiments(spark, d)
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey").distinct()
    stats = configs.join(
        returned, F.col("experiment_id").cast("long") == F.col("l_orderkey"), "left_semi"
    )
    return io.discover(configs, stats).groupBy("run", "retriever").agg(F.count("*").alias("n"))


@query(
    "experiment_labels",
    r"""WITH x AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'bm25' WHEN 'O' THEN 'text2cypher'
   ELSE 'fulltext' END AS r, printf('%03d', o_orderkey) AS i,
   CASE WHEN o_orderpriority LIKE '1%' THEN true WHEN o_orderpriority LIKE '2%' THEN false END AS q,
   CASE WHEN o_orderpriority LIKE '2%' THEN o_totalprice > 200000 END AS dd,
   CASE WHEN o_orderpriority LIKE '3%' THEN true WHEN o_orderpriority LIKE '4%' THEN false END AS l,
   CASE WHEN o_orderpriority LIKE '5%' THEN 'V3' ELSE '' END AS v FROM orders)
SELECT o_orderkey, r || CASE WHEN r = 'text2cypher' THEN CASE WHEN v <> '' THEN ' ' || v ELSE '' END
  WHEN q IS NOT NULL OR dd IS NOT NULL THEN CASE WHEN coalesce(q, false) OR coalesce(dd, false)
    THEN ' +sw(' || CASE WHEN q THEN 'Q' ELSE '' END || CASE WHEN dd THEN 'D' ELSE '' END || ')' ELSE ' -sw' END
  WHEN l THEN ' +sw' WHEN NOT l THEN ' -sw' ELSE '' END || ' (' || i || ')' AS label FROM x""",
)
def experiment_labels(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("o_orderpriority")
    kind = (
        F.when(F.col("o_orderstatus") == "F", "bm25")
        .when(F.col("o_orderstatus") == "O", "text2cypher")
        .otherwise("fulltext")
    )
    label = R.experiment_label(
        kind,
        F.format_string("%03d", "o_orderkey"),
        F.when(p.startswith("1"), True).when(p.startswith("2"), False),
        F.when(p.startswith("2"), F.col("o_totalprice") > 200000),
        F.when(p.startswith("3"), True).when(p.startswith("4"), False),
        F.when(p.startswith("5"), "V3").otherwise(""),
    )
    return table(spark, d, "orders").select("o_orderkey", label.alias("label"))


@query(
    "experiment_views",
    """WITH e AS (SELECT l_orderkey, l_linenumber, max(l_discount > 0.05) AS late FROM lineitem
  WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT l.l_orderkey, l.l_linenumber, CASE o_orderstatus WHEN 'F' THEN 'generation' WHEN 'O' THEN 'structured'
  ELSE 'retrieval' END AS view,
  CASE WHEN o_orderstatus = 'O' THEN CASE WHEN late THEN 'failed' ELSE 'success' END END AS execution_status,
  CASE WHEN o_orderstatus = 'O' AND late THEN 'timeout' END AS execution_error
FROM lineitem l LEFT JOIN orders ON o_orderkey = l.l_orderkey
LEFT JOIN e ON e.l_orderkey = l.l_orderkey AND e.l_linenumber = l.l_linenumber""",
)
def experiment_views(spark: SparkSession, d: str) -> DataFrame:
    configs = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("experiment"),
        F.when(F.col("o_orderstatus") == "F", "generation").otherwise("retrieval").alias("experiment_type"),
        F.when(F.col("o_orderstatus") == "O", "text2cypher").otherwise("bm25").alias("retriever_type"),
    )
    lines = table(spark, d, "lineitem")
    rows = lines.select(F.col("l_orderkey").alias("experiment"), F.col("l_linenumber").alias("query_id"))
    late = F.max(F.col("l_discount") > 0.05).alias("late")
    executions = (
        lines.where("l_returnflag = 'R'")
        .groupBy(F.col("l_orderkey").alias("experiment"), F.col("l_linenumber").alias("query_id"))
        .agg(late)
        .select(
            "experiment",
            "query_id",
            F.when(F.col("late"), "failed").otherwise("success").alias("status"),
            F.when(F.col("late"), "timeout").alias("error"),
        )
    )
    return R.experiment_view(rows, configs, executions).select(
        F.col("experiment").alias("l_orderkey"), F.col("query_id").alias("l_linenumber"),
        "view", "execution_status", "execution_error",
    )


@query(
    "metric_names",
    """SELECT DISTINCT replace(o_orderpriority || '@' || o_orderstatus, '@', '_at_') AS name FROM orders""",
)
def metric_names(spark: SparkSession, d: str) -> DataFrame:
    from quillgraph.functions.text import metric_key

    raw = F.concat_ws("@", "o_orderpriority", "o_orderstatus")
    return table(spark, d, "orders").select(metric_key(raw).alias("name")).distinct()
