"""Headline queries timed on one local session; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from quillgraph.plans import all_queries
from quillgraph.session import build_session

HEADLINE = [
    "index_df",
    "bm25_topk",
    "fulltext_topk",
    "vector_topk",
    "rrf_three_way",
    "metrics_macro",
    "contains_link",
    "keyword_link",
    "dedup_documents",
    "edge_upsert",
    "terminal_propagate",
    "closure_members",
    "degree_all",
    "hit_enrichment",
    "fulltext_then_graph",
    "page_text",
    "header_chunks",
    "table_roundtrip",
    "embed_documents",
    "rag_context",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/region.parquet").count()
    queries = all_queries()
    times: dict[str, float] = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_wall_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": folder.rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
