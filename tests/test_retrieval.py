from __future__ import annotations

import glob
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import regex
from pyspark.sql import functions as F

from quillgraph.operators import automaton, blocks, enrichment, fusion, ivf, lexical, runs, substring, vector
from quillgraph.operators.substring import contains_pairs


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id int, rank int, doc_id string, score double")


def test_rrf_same_document_in_both_lists(spark):
    bm25 = ranked(spark, [(1, 1, "a", 1.5)])
    vec = ranked(spark, [(1, 1, "a", 0.9), (1, 2, "b", 0.8)])
    rows = fusion.rrf([("bm25", bm25), ("vector", vec)]).orderBy("rank").collect()
    assert rows[0]["score"] == pytest.approx(2 / 61, abs=1e-8)
    assert rows[0]["source_retriever"] == "vector"
    assert rows[0]["retriever_scores"] == {"bm25": 1.5, "vector": 0.9}
    assert rows[0]["search_type"] == "hybrid_rrf"
    assert rows[1]["score"] == pytest.approx(1 / 62, abs=1e-8)
    assert len(rows[1]["retriever_scores"]) == 1


def test_rrf_weights_duplicates_and_order(spark):
    one = ranked(spark, [(1, 1, "a", 0.1), (1, 2, "a", 0.2)])
    row = fusion.rrf([("x", one)], weights=[2.0]).first()
    assert row["score"] == pytest.approx(2 / 61 + 2 / 62, abs=1e-8)
    assert row["retriever_scores"] == {"x": 0.2}
    alone = ranked(spark, [(1, i, f"d{i}", 1.0 / i) for i in range(1, 6)])
    kept = [r["doc_id"] for r in fusion.rrf([("x", alone)], k=3).orderBy("rank").collect()]
    assert kept == ["d1", "d2", "d3"]
    with pytest.raises(ValueError, match="weights"):
        fusion.rrf([("x", one)], weights=[1.0, 2.0])


def test_fallback_and_both_succeed(spark):
    vec = ranked(spark, [(1, 1, "v", 0.5), (2, 1, "w", 0.4)])
    struct = ranked(spark, [(1, 1, "s", 1.0)])
    status = spark.createDataFrame([(1, True), (2, False)], "query_id int, succeeded boolean")
    rows = fusion.fuse_with_fallback(struct, status, vec, 5).collect()
    tags = {(r["query_id"], r["doc_id"]): r["search_type"] for r in rows}
    assert tags == {
        (1, "s"): "hybrid_rrf", (1, "v"): "hybrid_rrf", (2, "w"): "text2cypher_vector_fallback",
    }


def corpus(spark):
    return spark.createDataFrame(
        [(0, "Bombom deals heavy damage."), (1, "Foxee is a fast leader."), (2, None)],
        "doc_id int, text string",
    )


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")


def test_bm25_and_fulltext_mini_corpus(spark):
    rows = lexical.bm25_search(asked(spark, "damage"), corpus(spark), 1).collect()
    assert [(r["doc_id"], r["rank"]) for r in rows] == [(0, 1)]
    rows = lexical.fulltext_search(asked(spark, "Bombom"), corpus(spark), 5).collect()
    assert [r["doc_id"] for r in rows] == [0]


def test_bm25_padding_and_blank_queries(spark):
    rows = lexical.bm25_search(asked(spark, "damage", "", None), corpus(spark), 5, fill_zero=True)
    got = [(r["query_id"], r["rank"], r["doc_id"], r["score"] > 0) for r in rows.orderBy("rank").collect()]
    assert [g[:3] for g in got] == [(0, 1, 0), (0, 2, 1)]


def test_repeated_query_terms_count_each_time(spark):
    docs = spark.createDataFrame(
        [(i, t) for i, t in enumerate(["snow bell", "frost", "sun", "moon", "bell"])], "doc_id int, text string"
    )
    one = lexical.bm25_search(asked(spark, "snow"), docs, 1).first()["score"]
    two = lexical.bm25_search(asked(spark, "snow snow"), docs, 1).first()["score"]
    assert two == pytest.approx(2 * one, abs=2e-6)


def test_saved_index_ranks_the_same(spark, scratch):
    docs, q = corpus(spark), asked(spark, "heavy damage leader")
    lexical.build_index(docs, lexical.word_analyzer()).save(f"{scratch}/ix")
    stored = lexical.LexicalIndex.load(spark, f"{scratch}/ix")
    live = lexical.bm25_search(q, docs, 5)
    assert lexical.bm25(q, stored, 5).collect() == live.collect()


def test_passes_rank_the_same(spark, monkeypatch):
    docs, q = corpus(spark), asked(spark, "heavy damage leader", "fast")
    small = sorted(lexical.bm25_search(q, docs, 5).collect())
    monkeypatch.setattr(lexical, "PASS_CHARS", 8)
    assert sorted(lexical.bm25_search(q, docs, 5).collect()) == small


def test_block_search_against_plain_scores(spark, scratch, monkeypatch):
    """Small blocks, pruned by their bounds, against every score; awkward documents included."""
    monkeypatch.setattr(blocks, "BLOCK_DOCS", 7)
    monkeypatch.setattr(blocks, "TILE_QUERIES", 3)
    rng = random.Random(3)
    words = [f"q{chr(97 + k)}" for k in range(15)]
    texts = [" ".join(rng.choices(words, weights=range(1, 16), k=rng.randint(0, 30))) for _ in range(120)] + [None, "", "1 2 3"]
    queries = [" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(11)] + ["", None, "unheard of"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "qa qb")], "doc_id long, text string").repartition(4)
    index = lexical.build_index(docs, lexical.word_analyzer(), f"{scratch}/ix")
    n, tokens = 122, {k: (t or "").split() for k, t in enumerate(texts) if t is not None}
    tokens[122] = []
    frequency = Counter(w for t in tokens.values() for w in set(t))
    length = sum(map(len, tokens.values())) / n
    assert {r["term"]: r["df"] for r in index.terms.collect()} == frequency
    assert {r["term"]: r["df"] for r in lexical.document_frequencies(docs, lexical.word_analyzer()).collect()} == frequency
    got = lexical.fulltext(spark.createDataFrame(list(enumerate(queries)), "query_id int, query string"), index, 4, False).collect()
    want = []
    for q, text in enumerate(queries):
        scored = []
        for doc, held in tokens.items():
            parts = [
                math.log(1 + (n - frequency[w] + 0.5) / (frequency[w] + 0.5)) * held.count(w)
                / (held.count(w) + 1.2 * (0.25 + 0.75 * len(held) / length))
                for w in (text or "").split() if w in held
            ]
            if parts:
                scored.append((-round(sum(parts), 6), doc))
        want += [(q, rank, doc, -score) for rank, (score, doc) in enumerate(sorted(scored)[:4], 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    empty = lexical.build_index(docs.limit(0), lexical.word_analyzer(), f"{scratch}/none")
    assert lexical.bm25(spark.createDataFrame([(1, "qa")], "query_id int, query string"), empty).count() == 0


def test_blocks_below_the_threshold_are_not_scored():
    asked = blocks.Asked(np.array([0]), np.array([0]), np.array([1.0]), 1, 1)
    search = blocks.BlockSearch(asked, 1, 1.2, 0.75, 1.0, 10.0)
    rows = {"block": [1, 1, 2, 2, 3], "code": [-1, 0, -1, 0, -1], "most_tf": [0, 5, 0, 1, 0], "least_len": [0, 10, 0, 10, 0]}
    rows |= {"places": [[], [0], [], [0, 1], []], "docs": [[7], [], [8, 9], [], [4]], "lens": [[10], [], [10, 10], [], [3]], "tfs": [[], [5], [], [1, 1], []]}
    search.table(pa.table(rows))
    assert (search.pairs, search.scored) == (2, 1)
    assert [a.tolist() for a in search.found()[:2]] == [[0], [7]]


def test_stop_word_flag_precedence():
    assert lexical.stop_word_flags("bm25") == (True, True)
    assert lexical.stop_word_flags("fulltext") == (True, False)
    assert lexical.stop_word_flags("bm25", both=False) == (False, False)
    assert lexical.stop_word_flags("bm25", query=True, both=False) == (True, False)


def vectors(spark, n, dim, seed, key):
    data = np.random.default_rng(seed).standard_normal((n, dim)).astype("float32")
    data[: n // 3] = data[0]  # a third of the rows are copies
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    return data, spark.createDataFrame(rows, f"{key} int, vector array<float>")


def brute(queries, docs, k):
    q = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    d = docs / np.linalg.norm(docs, axis=1, keepdims=True)
    scores = np.round(q.astype("float64") @ d.astype("float64").T, 6)
    return {
        (i, r + 1): int(j)
        for i, line in enumerate(scores)
        for r, j in enumerate(np.lexsort((np.arange(len(line)), -line))[:k])
    }


@pytest.mark.parametrize("budget", [1 << 20, 64])
def test_vector_topk_both_paths(spark, budget):
    docs, doc_rows = vectors(spark, 90, 8, 1, "doc_id")
    queries, query_rows = vectors(spark, 7, 8, 2, "query_id")
    got = vector.vector_topk(query_rows, doc_rows, 5, 8, broadcast_bytes=budget).collect()
    want = brute(queries.astype("float64"), docs.astype("float64"), 5)
    assert len(got) == 35
    assert sum(want[(r["query_id"], r["rank"])] == r["doc_id"] for r in got) >= 33


def test_vector_dimension_is_enforced(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [1.0])], "doc_id int, vector array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id int, vector array<float>")
    with pytest.raises(Exception, match="dimension 3 wanted, found 1"):
        vector.vector_topk(q, docs, 1, 3).collect()
    fitting = docs.where("doc_id = 1").unionByName(docs.selectExpr("3 doc_id", "cast(null as array<float>) vector"))
    rows = vector.vector_topk(q, fitting, 1, 3).collect()
    assert [(r["doc_id"], r["score"]) for r in rows] == [(1, 1.0)]


def test_identity_looks_at_whole_texts(spark):
    head = "x" * 60
    rows = spark.createDataFrame(
        [(1, head + "a", "s"), (2, head + "b", "s"), (3, head + "a", "s"), (4, head + "a", "t"), (5, None, "s")],
        "doc_id int, text string, source string",
    )
    identity = fusion.text_identity(F.col("text"), F.col("source")).alias("i")
    found = {r["doc_id"]: r["i"] for r in rows.select("doc_id", identity).collect()}
    assert found[1] == found[3] and len(set(found.values())) == 4 and None not in found.values()


def test_padding_keeps_matches_below_zero(spark):
    docs = spark.createDataFrame([(i, "common") for i in range(6)] + [(9, "other")], "doc_id int, text string")
    query = spark.createDataFrame([(0, "common")], "query_id int, query string")
    rows = lexical.bm25_search(query, docs, 2, fill_zero=True).collect()
    plain = lexical.bm25_search(query, docs, 7).collect()
    scores = {r["doc_id"]: r["score"] for r in plain}
    assert scores and all(r["score"] == scores.get(r["doc_id"], 0.0) for r in rows)


def test_tiles_and_ties_give_the_plain_ranking(monkeypatch):
    monkeypatch.setattr(vector, "TILE_QUERIES", 3)
    monkeypatch.setattr(vector, "TILE_DOCS", 4)
    rng = np.random.default_rng(1)
    docs = rng.integers(-2, 3, (30, 3)).astype(float)
    docs[7] = np.nan
    queries, ids = docs[10:18], rng.permutation(30)
    got = vector.best_pairs(pa.array(range(8)), queries, pa.array(ids), docs, 6).to_pylist()
    want = []
    for q, asked in enumerate(queries):
        line = sorted((-float(asked @ d), int(i)) for i, d in zip(ids, docs) if np.isfinite(d).all())
        want += [{"query_id": q, "doc_id": i, "score": -s} for s, i in line[:6]]
    assert got == want
    assert vector.best_pairs(pa.array([], pa.int64()), queries[:0], pa.array(ids), docs, 6).num_rows == 0


def test_inverted_file_index(spark, scratch, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 8)) * 3
    stored = centres[rng.integers(0, 12, 400)] + rng.standard_normal((400, 8))
    stored[:130] = stored[0]  # a third of all rows in one place
    docs = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(stored)] + [(900, None)], "doc_id int, vector array<double>")
    asked = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(stored[::20] + 0.1)], "query_id int, vector array<double>")
    monkeypatch.setattr(ivf, "BLOCK_ROWS", 50)
    index = ivf.build_ivf(docs.repartition(3), scratch, 8)
    assert index.sizes.sum() == 400 and len(index.centroids) == 20
    assert index.rows.count() == 400
    exact = vector.vector_topk(asked, docs, 5, 8).cache()
    everywhere = index.search(asked, 5, 20)
    assert sorted(map(tuple, everywhere.collect())) == sorted(map(tuple, exact.collect()))
    probes = index.probes_for(asked, exact)
    rows = ivf.recall(index, asked, exact, 5, probes).collect()
    assert sum(r["recall"] for r in rows) / len(rows) >= 0.9 and len(rows) == 20
    assert probes < 20 and sum(r["n_multiplied"] for r in rows) < 400 * 20
    again = ivf.IvfIndex.load(spark, scratch)
    assert (again.centroids == index.centroids).all() and (again.sizes == index.sizes).all()
    other = ivf.build_ivf(docs.repartition(5), scratch + "/other", 8)
    assert (other.centroids == index.centroids).all()
    nothing = ivf.build_ivf(docs.limit(0), scratch + "/empty", 8)
    assert nothing.search(asked, 5, 3).count() == 0
    assert index.search(asked.limit(0), 5, 3).count() == 0


def test_contains_pairs_against_brute_force(spark):
    texts = ["the redder bell rings", "a cat, sat on the mat today", "mat", "ÉTÉ fini", "", "aaa"]
    needles = ["red", "bell ring", "cat, sat on", "at on the mat", "mat", "été", "a", "aa", "nothing here now", "ringsx", "he"]
    t = spark.createDataFrame(list(enumerate(texts)), "text_id int, text string")
    n = spark.createDataFrame(list(enumerate(needles)), "needle_id int, needle string")
    for fold in (False, True):
        got = {tuple(r) for r in contains_pairs(t, n, fold).collect()}
        want = {
            (i, j)
            for i, x in enumerate(texts)
            for j, y in enumerate(needles)
            if (y.lower() in x.lower() if fold else y in x)
        }
        assert got == want


def test_automaton_against_plain_search(monkeypatch):
    rng = random.Random(7)
    for alphabet in ("ab", "abé_ 漢-.") * 20:
        monkeypatch.setattr(automaton, "_LANE", rng.choice([3, 7, 2048]))
        needles, texts = (
            ["".join(rng.choices(alphabet, k=rng.randint(low, high))) for _ in range(rng.randint(1, 12))]
            for low, high in ((1, 6), (0, 60))
        )
        found = automaton.Automaton([n.encode() for n in needles])
        encoded = [t.encode() for t in texts]
        want = {(i, j) for i, t in enumerate(texts) for j, n in enumerate(needles) if n in t}
        assert set(zip(*map(np.ndarray.tolist, found.pairs(encoded)))) == want
        word = r"[\p{L}\p{M}\p{N}_]"
        want = {
            (i, j)
            for i, t in enumerate(texts)
            for j, n in enumerate(needles)
            if regex.search(f"(?<!{word}){regex.escape(n)}(?!{word})", t)
        }
        assert set(zip(*map(np.ndarray.tolist, found.pairs(encoded, True)))) == want


def test_needles_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(substring, "CHUNK_BYTES", 40)
    monkeypatch.setattr(substring, "NEEDLE_BYTES", 8)
    monkeypatch.setattr(substring, "TEXT_BYTES", 50)
    texts = ["the redder bell rings", "a cat, sat on the mat today", None, "redder bells", "", "ends in ring"] * 3
    needles = ["redder bell rings", "redder bell rinks", "cat, sat on the mat", "", None, "ring", "e"] + [f"needle {k}" for k in range(9)]
    t = spark.createDataFrame(list(enumerate(texts)), "text_id int, text string")
    rows = [(j, n, j % 2 == 1) for j, n in enumerate(needles)] + [(5, "ring", True), (3, "red", True)]
    got = {tuple(r) for r in substring.matched_pairs(t, spark.createDataFrame(rows, "needle_id int, needle string, whole boolean")).collect()}
    want = {
        (i, j)
        for i, x in enumerate(texts)
        for j, n, whole in rows
        if x and n and (regex.search(rf"\b{regex.escape(n)}\b", x) if whole else n in x)
    }
    assert got == want
    assert substring.matched_pairs(t, spark.createDataFrame([], "needle_id int, needle string, whole boolean")).count() == 0


def test_candidates_are_normalized(spark):
    rows = spark.createDataFrame(
        [(1, "a", 0, None), (1, "b", 1, 0.5), (1, "c", 2, None), (2, None, None, None), (3, "d", None, None)],
        "query_id int, doc_id string, result_index int, score double",
    )
    rows = rows.withColumn("no_results", F.col("query_id") == 2)
    got = [tuple(r) for r in fusion.normalize_candidates(rows, 2).select("query_id", "doc_id", "score", "rank").collect()]
    assert sorted(got) == [(1, "a", 1.0, 1), (1, "b", 0.5, 2), (3, "d", 1.0, 1)]


def test_run_marks_failed_queries(spark):
    candidates = spark.createDataFrame([(0, 5, 0, 1.0)], "query_id int, doc_id int, result_index int, score double")
    status = spark.createDataFrame([(0, True), (1, False)], "query_id int, succeeded boolean")
    c = runs.Corpus(corpus(spark), candidates=candidates, candidate_status=status)
    rows = {r["query_id"]: r for r in runs.run("text2cypher", asked(spark, "x", "y", ""), c, 3).collect()}
    assert rows[0]["status"] == "success" and len(rows[0]["retrieved_chunks"]) == 1
    assert rows[1]["status"] == "failed" and rows[1]["error"] and not rows[1]["retrieved_chunks"]
    assert 2 not in rows
    assert rows[0]["execution"]["status"] == "success" and rows[1]["execution"]["status"] == "failed"
    told = status.withColumn("query", F.lit("MATCH")).withColumn("error", F.lit("no such label"))
    c.candidate_status = told
    row = next(r for r in runs.run("text2cypher", asked(spark, "x", "y"), c, 3).collect() if r["query_id"] == 1)
    assert row["error"] == "no such label" and tuple(row["execution"]) == ("MATCH", "failed", "no such label")
    with pytest.raises(ValueError, match="unknown"):
        runs.retriever("nope", c)


@pytest.mark.parametrize("kind", ["bm25_vector", "fulltext_vector", "bm25_fulltext_vector", "text2cypher_vector"])
def test_every_hybrid_kind_runs(spark, kind):
    vec = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "doc_id int, vector array<float>")
    qv = vec.withColumnRenamed("doc_id", "query_id")
    candidates = spark.createDataFrame([(0, 1, 0, 1.0)], "query_id int, doc_id int, result_index int, score double")
    status = spark.createDataFrame([(0, True)], "query_id int, succeeded boolean")
    c = runs.Corpus(corpus(spark), vec, qv, 2, None, candidates, status)
    rows = runs.run(kind, asked(spark, "damage", "leader"), c, 3).collect()
    assert all(r["retrieved_chunks"] for r in rows) and len(rows) == 2
    chunk = rows[0]["retrieved_chunks"][0]
    assert chunk["retrieved_text"] and chunk["search_type"] and [c["rank"] for c in rows[0]["retrieved_chunks"]] == sorted(c["rank"] for c in rows[0]["retrieved_chunks"])


def test_graph_runs_keep_their_neighbours(spark):
    edges = spark.createDataFrame(
        [("Card", "Foxee", "HAS_DOCUMENT", "Document", str(k), {}) for k in (0, 1)] + [("Card", "Foxee", "HAS_KEYWORD", "Keyword", "fast", {})],
        "src_label string, src_key string, rel string, dst_label string, dst_key string, props map<string,string>",
    )
    c = runs.Corpus(corpus(spark).withColumn("source_url", F.lit("https://w/x")), edges=edges)
    row = runs.run("fulltext_then_cypher", asked(spark, "leader"), c, 3).first()
    chunk = row["retrieved_chunks"][0]
    assert chunk["fields"]["card"] == "Foxee" and chunk["fields"]["keywords"] == '["fast"]'
    assert chunk["source_url"] == "https://w/x" and "leader" in chunk["retrieved_text"]
    assert list(c.indexes) == ["tokens-False"]


def test_enrichment_does_not_multiply_rows(spark):
    edges = spark.createDataFrame(
        [
            ("Card", "b", "HAS_DOCUMENT", "Document", "1", {}),
            ("Card", "a", "HAS_DOCUMENT", "Document", "1", {}),
            ("Card", "a", "HAS_KEYWORD", "Keyword", "k2", {}),
            ("Card", "a", "HAS_KEYWORD", "Keyword", "k1", {}),
            ("Card", "a", "HAS_STAT", "Stat", "s", {"value": "3"}),
            ("Card", "b", "HAS_KEYWORD", "Keyword", "other", {}),
        ],
        "src_label string, src_key string, rel string, dst_label string, dst_key string, props map<string,string>",
    )
    hits = spark.createDataFrame([(1, 1, 1, 0.9), (1, 2, 7, 0.5)], "query_id int, rank int, doc_id int, score double")
    rows = {r["doc_id"]: r for r in enrichment.enrich_hits(hits, edges).collect()}
    assert rows[1]["card"] == "a" and rows[1]["keywords"] == ["k1", "k2"] and rows[1]["stats"] == ["s"]
    assert rows[7]["card"] is None and rows[7]["keywords"] == []
    stats = enrichment.enrich_hits(hits, edges, enrichment.PRESETS["with_stats"]).where("doc_id = 1").first()
    assert [tuple(s) for s in stats["stats"]] == [("s", "3")]
    assert enrichment.enrich_hits(hits, edges, enrichment.PRESETS["card_only"]).count() == 2


def test_index_files_and_blocks_are_bounded(spark, scratch):
    docs = spark.range(0, 20 * blocks.BLOCK_DOCS, 1, 1).selectExpr("id as doc_id", "concat('word ', id % 7) as text")
    lexical.build_index(docs, path=f"{scratch}/index")
    (file,) = glob.glob(f"{scratch}/index/blocks/*.parquet")
    held = pq.ParquetFile(file).metadata
    assert held.num_rows >= 20
    assert max(held.row_group(i).num_rows for i in range(held.num_row_groups)) <= 4

    sizes = [blocks.BLOCK_TOKENS // 2, blocks.BLOCK_TOKENS // 2, 1, blocks.BLOCK_TOKENS + 5, 0, 3]
    tokens = pa.ListArray.from_arrays(pa.array([0, *np.cumsum(sizes)], pa.int32()), pa.array(["w"] * sum(sizes)))
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), tokens], names=["doc_id", "tokens"])
    made = [(b["n_docs"][0].as_py(), b["total_len"][0].as_py()) for b in blocks.make_blocks(iter([rows]))]
    assert made == [(2, blocks.BLOCK_TOKENS), (1, 1), (1, blocks.BLOCK_TOKENS + 5), (2, 3)]


def test_a_task_sends_few_documents_to_the_index_at_once(spark, scratch, monkeypatch):
    limit, bound = blocks.BLOCK_DOCS, 2 * blocks.BATCH_BYTES

    def watched(batches):
        def small():
            for batch in batches:
                assert batch.num_rows <= limit and batch.nbytes <= bound, (batch.num_rows, batch.nbytes)
                yield batch

        yield from blocks.make_blocks(small())

    monkeypatch.setattr(lexical, "make_blocks", watched)
    names = [f"spark.sql.execution.arrow.{limit}PerBatch" for limit in ("maxRecords", "maxBytes")]
    before = [spark.conf.get(name, None) for name in names]
    short = spark.range(0, 5 * limit, 1, 1).selectExpr("id as doc_id", "'one word' as text")
    long = spark.range(0, 200, 1, 1).selectExpr("id as doc_id", "repeat('some words ', 10000) as text")
    for name, docs in (("short", short), ("long", long)):
        index = lexical.build_index(docs, path=f"{scratch}/{name}")
        assert index.corpus.first()["n_docs"] == docs.count()
    assert [spark.conf.get(name, None) for name in names] == before


def test_matching_holds_little_more_than_its_texts():
    import tracemalloc

    needles = [b"needle one", "läng".encode(), b"abc"]
    texts = [b"x" * (1 << 20) + b"needle one", "ein längs".encode() + b"y" * (1 << 20), b"", b"ab" * (1 << 20)]
    matcher = substring.Matcher(needles, [False] * 3)
    tracemalloc.start()
    found = {tuple(map(int, pair)) for pair in zip(*matcher.pairs(texts))}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == {(0, 0), (1, 1)}
    assert peak < 6 * sum(map(len, texts))

    column = pa.array(["é" * n for n in (substring.TEXT_BYTES, 1, 0, substring.TEXT_BYTES // 2, 3)])
    runs = [(start, len(run)) for start, run in substring._portions(column)]
    assert runs == [(0, 1), (1, 2), (3, 1), (4, 1)]
    assert not list(substring._portions(column.slice(0, 0)))
