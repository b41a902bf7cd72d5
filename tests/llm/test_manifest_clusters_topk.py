"""Manifests, centroid clusters and exact top-k against brute-force versions and on awkward rows."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import centroids, maxscore, merkle

DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree string, own string, lo string, digest string"


def H(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row) -> str:
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute_manifest(rows, arity=2):
    """doc_id, leaf, subroot, root, proof, folded root and verdict of every row, by plain recursion."""
    trees: dict = {}
    for row in rows:
        changed = list(row)
        if row[0] is not None and row[3] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0:
            changed[3] += 1
        trees.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(row), leaf(changed), row[0]))

    def grown(bottom):
        levels = [bottom]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][k : k + arity]) for k in range(0, len(levels[-1]), arity)])
        return levels

    def way(levels, at):
        for level in levels[:-1]:
            first = at - at % arity
            yield "".join(level[first:at]), "".join(level[at + 1 : first + arity])
            at //= arity

    keys = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    built = {k: grown([x[2] for x in sorted(trees[k])]) for k in keys}
    top = grown([built[k][-1][0] for k in keys])
    for n, k in enumerate(keys):
        for at, (_, _, own, claimed, doc) in enumerate(sorted(trees[k])):
            steps = [*way(built[k], at), *way(top, n)]
            folded = claimed
            for before, after in steps:
                folded = H(before, folded, after)
            proof = H(*(before + after for before, after in steps))
            yield doc, own, built[k][-1][0], top[-1][0], proof, folded, folded == top[-1][0]


def documents(n: int):
    rows = [(k, f"s{k % 3}", ["en", "de", "fr", None][min(k % 9, 3)], k if k % 5 else None, f"text {k} ä") for k in range(n)]
    rows += [(None, None, None, None, None), (None, None, None, None, None), (None, "", "", 0, ""), (3, "s0", "en", 3, "other"), rows[1], rows[1]]
    return rows


@pytest.mark.parametrize("n", [0, 1, 150])
def test_manifest_matches_brute_force(spark, n):
    rows = documents(n) if n > 1 else documents(2)[:n]
    frame = spark.createDataFrame([(*r, "x", "y", "z", "d") for r in rows], DOCS)
    got = merkle.verified_manifest(frame)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got.collect())) == sorted(map(key, brute_manifest(rows)))


@pytest.mark.parametrize(("arity", "depth"), [(2, 2), (3, 2), (5, 1)])
def test_bands_of_any_shape_give_the_same_trees(spark, arity, depth):
    leaves = spark.createDataFrame(
        [(t, k, H(t, str(k)), k) for t, n in (("+a", 41), ("+b", 1), ("+c", 2), ("+d", 27)) for k in range(n)],
        "tree string, order long, digest string, own long",
    )
    trees = merkle.interval_trees(leaves.repartition(5), ["order"], arity, depth)
    nodes = trees.nodes().collect()
    for tree, n in (("+a", 41), ("+b", 1), ("+c", 2), ("+d", 27)):
        levels = [[H(tree, str(k)) for k in range(n)]]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][k : k + arity]) for k in range(0, len(levels[-1]), arity)])
        want = {
            (level, k * arity**level, min((k + 1) * arity**level, n), digest)
            for level, run in enumerate(levels)
            for k, digest in enumerate(run)
        }
        mine = [(r["level"], r["lo"], r["hi"], r["digest"]) for r in nodes if r["tree"] == tree]
        assert len(mine) == len(want) and set(mine) == want
    crown = spark.createDataFrame([(r["tree"], r["digest"], []) for r in trees.roots().collect()], "tree string, root string, steps array<struct<before:string,after:string>>")
    found = trees.paths(crown).select("tree", "root", merkle.fold(F.col("digest"), F.col("steps")).alias("folded")).collect()
    assert len(found) == 71 and all(r["root"] == r["folded"] for r in found)


def test_null_and_empty_fields_differ(spark):
    frame = spark.createDataFrame([(1, None), (2, ""), (3, "é")], "k long, v string").orderBy("k")
    assert [r[0] for r in frame.select(merkle.field_text(F.col("v"))).collect()] == ["-", "0:", "2:é"]


VECTORS = "vec_id long, embedding array<double>, row string, terms string, ints string, cluster string, rank string"


def awkward_vectors(n: int, width: int, seed: int = 0):
    rng = np.random.default_rng(seed)
    rows = [(k, [float(x) for x in rng.standard_normal(width).round(2)]) for k in range(n)]
    rows += [rows[5], rows[5], (None, rows[6][1]), (7, rows[8][1]), (900, None), (901, [None] * width), (902, [float("nan")] * width)]
    rows += [(903, [float("inf")] + [0.0] * (width - 1)), (904, [0.0] * width), (905, [1e300] * width)]
    return rows


def brute_clusters(rows, width, count, rounds, seed, scale=1024):
    kept = [(v, np.floor(np.array(x) * scale).astype(np.int64)) for v, x in rows if x and len(x) == width and all(c is not None and abs(c) <= centroids.LARGEST for c in x)]
    marks = sorted(kept, key=lambda r: (r[0] is None, H(f"{seed}:{r[0]}") if r[0] is not None else "", r[1].tolist()))
    centres = np.array([m[1] for m in marks[:count]])
    points = np.array([p for _, p in kept])
    for turn in range(rounds + 1):
        distances = ((points[:, None] - centres[None]) ** 2).sum(2)
        best = distances.argmin(1)
        if turn < rounds:
            centres = np.array([points[best == k].sum(0) // (best == k).sum() if (best == k).any() else c for k, c in enumerate(centres)])
    least = distances.min(1)
    return [
        (v, int(b), int(d), int(least[best == b].sum()), int(least.sum()), H(",".join(map(str, centres[b].tolist()))))
        for (v, _), b, d in zip(kept, best, least)
    ]


@pytest.mark.parametrize("count", [8, 500])
def test_clusters_match_brute_force(spark, count):
    rows = awkward_vectors(200, 64) + [(910, [1.0] * 63), (911, [])]
    frame = spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], VECTORS)
    got = centroids.centroid_clusters(frame, count=count, rounds=3, kept=7).collect()
    want = brute_clusters(rows, 64, count, 3, 3)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_clusters_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    got = centroids.centroid_clusters(empty)
    assert got.count() == 0 and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert centroids.centroid_clusters(spark.createDataFrame([(1, None, *"abcde")], VECTORS)).count() == 0


def test_rotated_bounds_spare_distances_and_lose_none():
    rng = np.random.default_rng(3)
    centres = rng.integers(-900, 900, (8, 64))
    points = centres[rng.integers(0, 8, 4000)] + rng.integers(-60, 60, (4000, 64))
    points[:50] = (centres[0] + centres[1]) // 2
    moments = np.cov(points.T)
    rotation = centroids.Rotation(points.mean(0), np.linalg.eigh(moments)[1][:, ::-1], 16)
    nearest = centroids.Nearest(centres, rotation)
    best, least = nearest.find(points, *rotation.split(points))
    exact = ((points[:, None] - centres[None]) ** 2).sum(2)
    assert (best == exact.argmin(1)).all() and (least == exact.min(1)).all()
    assert nearest.verified < nearest.pairs / 4


def brute_top(rows, k, scale, step):
    usable = [
        (at, v, [int(np.floor(c * scale)) for c in x]) for at, (v, x) in enumerate(rows)
        if x is not None and all(c is not None and np.isfinite(c) and abs(c) < 1e9 for c in x)
    ]
    for at, v, terms in usable:
        if v is None or v % step:
            continue
        scored = [(-sum(a * b for a, b in zip(terms, other)), w is None, w or 0, w) for place, w, other in usable if place != at]
        for rank, (score, _, _, w) in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1):
            yield v, rank, w, -score


@pytest.mark.parametrize(("width", "scale"), [(64, 64), (3, 2), (16, 1 << 24)])
def test_top_documents_match_brute_force(spark, width, scale):
    rows = awkward_vectors(300, width, width) + [(920, [1.0] * (width - 1)), (940, []), (960, [3.0] * (width + 2))]
    frame = spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], VECTORS).repartition(3)
    want = sorted(map(str, brute_top(rows, 20, scale, 5)))
    # One group, and many groups in growing rounds.
    for limits in ({}, {"query_rows": 20, "document_rows": 25}):
        got = maxscore.top_documents(frame, F.col("vec_id") % 5 == 0, scale=scale, **limits).collect()
        assert sorted(map(str, map(tuple, got))) == want


def test_top_documents_of_few_rows(spark):
    frame = spark.createDataFrame([(0, [1.0], *"abcde"), (1, [2.0], *"abcde"), (20, [-1.0], *"abcde")], VECTORS)
    got = maxscore.top_documents(frame, F.col("vec_id") % 20 == 0, scale=1).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, 2), (0, 2, 20, -1), (20, 1, 0, -1), (20, 2, 1, -2)]
    assert maxscore.top_documents(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert maxscore.top_documents(frame, F.col("vec_id") < 0).count() == 0


def test_sparse_shards_pass_over_terms():
    """With a full list, a shard is left untouched where its gains cannot reach the threshold."""
    rng = np.random.default_rng(5)
    terms = rng.integers(0, 3, (500, 40)) * (rng.random((500, 40)) < 0.1)
    terms[0] = 9
    shard = maxscore.Shard(np.arange(500), np.ones(500, bool), np.arange(500), terms, np.float32)
    query = np.zeros((2, 40), np.float32)
    query[0, :5], query[1, 5:10] = 4, 1
    bars = np.array([4 * 5 * 9 + 1, 1])
    lists = maxscore.Lists(bars.copy(), 3)
    shard.search(query, np.array([-1, -2]), lists, np.arange(2))
    assert not (lists.query == 0).any()
    scores = terms @ query[1].astype(int)
    best = np.lexsort((np.arange(500), -scores))[:3]
    assert lists.row.tolist() == best.tolist() and lists.score.tolist() == scores[best].tolist()
    assert lists.bars.tolist() == [bars[0], max(1, scores[best[-1]])]
