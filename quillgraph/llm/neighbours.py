"""Near duplicates of embeddings by NN-descent.

Equal vectors become one node. A first neighbour graph links vectors that lie side by side in
the orders of several random projections; rounds of neighbours-of-neighbours joins then improve
it: the neighbours and reverse neighbours of a node meet in one block, all of them are compared,
and only pairs that would enter a list leave the block.

A list whose worst entry is still above the threshold is saturated: more links may exist than it
can hold. Links to other components are therefore searched again among the nodes of saturated
lists, with lists that hold no node of the own component, until no components merge. All nodes
of a component are then compared in square blocks, and only counts leave a block. No list or
group of unknown size meets in one task.

Recall is audited against brute force on a fixed set of query vectors: a link is found if its two
nodes are in one component. While it is below the target, lists grow and rounds go on; lists that
could hold every node and still miss the target fail the job.

Cosines are computed in double precision everywhere. Defined cases: a vector that is null, zero,
of another length than most, or holds a null or non-finite component links with nothing and is
its own component; equal vectors link with each other; a null id takes part but is never a
component's id unless there is no other; repeated rows are counted as often as they occur; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.components import components
from quillgraph.llm.storage import discard, stored

EDGES = "u long, v long, sim double"


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors in double precision from raw float32 bytes."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1).astype(float)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _edge_batch(u: np.ndarray, v: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(sim)], names=["u", "v", "sim"])


def raw_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and the float32 bytes of usable vectors (null for the others)."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for values in batch.column(1).to_pylist():
                usable = values and not any(x is None for x in values)
                row = np.asarray(values, np.float32) if usable else np.zeros(1, np.float32)
                good = np.isfinite(row).all() and np.isfinite(np.linalg.norm(row.astype(float))) and row.any()
                out.append((row + np.float32(0)).tobytes() if good else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "raw"]
            )

    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("vector")
    ).mapInArrow(convert, "vec_id long, raw binary")
    rows = stored(rows, "raw-vectors")
    sizes = rows.where("raw is not null").groupBy(F.octet_length("raw").alias("size")).count()
    usual = sizes.orderBy(F.desc("count"), "size").first()
    width = usual["size"] if usual else 0
    return rows.withColumn("raw", F.when(F.octet_length("raw") == width, F.col("raw")))


def _grouped_batches(
    batches: Iterator[pa.RecordBatch], key: str, rows_at_once: int = 1 << 14
) -> Iterator[pa.Table]:
    """Tables of whole groups from input sorted by the key; a group never spans two tables."""
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        size += batch.num_rows
        if size >= rows_at_once:
            whole = pa.concat_tables(held)
            keys = whole.column(key).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], side="left"))
            if cut:
                yield whole.slice(0, cut)
            held, size = [whole.slice(cut)], whole.num_rows - cut
    if size:
        yield pa.concat_tables(held)


def _projected(nodes: DataFrame, tables: int, width: int, keep: int, seed: int) -> DataFrame:
    """Edges between vectors that are at most ``width`` places apart in the order of a projection.

    Nodes of one ``root`` are not linked; of a run of them only the ends keep their places.
    """

    def sort_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _matrix(batch.column(1))
            if planes is None:
                planes = np.random.default_rng(seed).standard_normal((tables, unit.shape[1], 62))
            for t in range(tables):
                signs = (unit @ planes[t] > 0).astype(np.int64)
                order = signs @ (np.int64(1) << np.arange(61, -1, -1, dtype=np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(order), t, np.int32)), pa.array(order), *batch.columns],
                    names=["t", "place", "node", "raw", "root"],
                )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            unit, node = _matrix(batch.column(3)), batch.column(2).to_numpy()
            table, root = batch.column(0).to_numpy(), batch.column(4).to_numpy()
            if rest is not None:
                unit, node = np.vstack([rest[0], unit]), np.concatenate([rest[1], node])
                table, root = np.concatenate([rest[2], table]), np.concatenate([rest[3], root])
            change = (root[1:] != root[:-1]) | (table[1:] != table[:-1])
            ends = np.r_[True, change] | np.r_[change, True]
            unit, node, table, root = unit[ends], node[ends], table[ends], root[ends]
            us, vs, sims = [], [], []
            for shift in range(1, min(width, len(node) - 1) + 1):
                sim = np.einsum("ij,ij->i", unit[:-shift], unit[shift:])
                same = (table[:-shift] == table[shift:]) & (root[:-shift] != root[shift:])
                us.append(node[:-shift][same])
                vs.append(node[shift:][same])
                sims.append(sim[same])
            if us:
                u, v, sim = np.concatenate(us + vs), np.concatenate(vs + us), np.concatenate(sims + sims)
                order = np.lexsort((v, -sim, u))
                u, v, sim = u[order], v[order], sim[order]
                first = np.r_[True, u[1:] != u[:-1]]
                rank = np.arange(len(u)) - np.flatnonzero(first)[np.cumsum(first) - 1]
                yield _edge_batch(u[rank < keep], v[rank < keep], sim[rank < keep])
            rest = unit[-width:], node[-width:], table[-width:], root[-width:]

    keyed = nodes.select("node", "raw", "root").mapInArrow(
        sort_keys, "t int, place long, node long, raw binary, root long"
    )
    ordered = keyed.repartitionByRange("t", "place", "node").sortWithinPartitions("t", "place", "node")
    return ordered.mapInArrow(link, EDGES)


def _best(edges: DataFrame, size: int) -> DataFrame:
    """The ``size`` nearest of every node; ties go to the smaller neighbour."""
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    return edges.withColumn("rank", rank).where(F.col("rank") <= size).drop("rank")


def _round(nodes: DataFrame, graph: DataFrame, size: int, inner: DataFrame | None = None) -> DataFrame:
    """One neighbours-of-neighbours join; edges that were not there before are fresh.

    Nodes of one ``root`` do not enter each other's lists; ``inner`` has edges between them, over
    which neighbours are passed on.
    """
    back = graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "fresh")
    spread = F.row_number().over(Window.partitionBy("u").orderBy(F.xxhash64("v", "u"), "v"))
    back = back.withColumn("rank", spread).where(F.col("rank") <= size).drop("rank")
    around = graph.select("u", "v", "fresh").unionByName(back)
    if inner is not None:
        around = around.unionByName(inner.select("u", "v", F.lit(False).alias("fresh")))
    around = around.groupBy("u", "v").agg(F.max("fresh").alias("fresh"))
    worst = graph.groupBy("u").agg(F.count("*").alias("n"), F.min("sim").alias("low"))
    bars = worst.select(F.col("u").alias("node"), F.when(F.col("n") >= size, F.col("low")).otherwise(-2.0).alias("bar"))
    known = nodes.select("node", "raw", "root").join(bars, "node", "left").fillna(-2.0, ["bar"])
    rows = around.join(known, F.col("v") == F.col("node")).select("u", "v", "fresh", "bar", "raw", "root")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped_batches(batches, "u"):
            unit = _matrix(table.column("raw").combine_chunks())
            u, v, fresh, bar, root = (table.column(c).to_numpy() for c in ("u", "v", "fresh", "bar", "root"))
            edges = np.flatnonzero(np.r_[True, u[1:] != u[:-1], True])
            us, vs, sims = [], [], []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b - a < 2 or not fresh[a:b].any():
                    continue
                sim = unit[a:b] @ unit[a:b].T
                ask = (fresh[a:b, None] | fresh[None, a:b]) & (sim > bar[a:b, None])
                ask &= root[a:b, None] != root[None, a:b]
                i, j = np.nonzero(ask)
                us.append(v[a + i])
                vs.append(v[a + j])
                sims.append(sim[i, j])
            if us:
                yield _edge_batch(np.concatenate(us), np.concatenate(vs), np.concatenate(sims))

    met = rows.repartition("u").sortWithinPartitions("u").mapInArrow(compare, EDGES)
    merged = (
        graph.select("u", "v", "sim", F.lit(1).alias("old"))
        .unionByName(met.withColumn("old", F.lit(0)))
        .groupBy("u", "v")
        .agg(F.max("sim").alias("sim"), F.max("old").alias("old"))
    )
    return _best(merged, size).select("u", "v", "sim", (F.col("old") == 0).alias("fresh"))


def audit(nodes: DataFrame, roots: DataFrame, threshold: float, queries: int) -> float:
    """Share of the links of a fixed set of nodes whose two nodes are in one component.

    The query nodes are those with the smallest digests of their numbers; they are compared with
    every row in blocks. ``roots``: node and root of all nodes with a link.
    """
    asked = nodes.orderBy(F.xxhash64("node"), "node").limit(queries).select("node", "raw").toArrow()
    if not asked.num_rows:
        return 1.0
    ids = asked.column("node").to_numpy()
    targets = _matrix(asked.column("raw").combine_chunks())

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column(0).to_numpy()
            sim = targets @ _matrix(batch.column(1)).T
            i, j = np.nonzero((sim >= threshold) & (ids[:, None] != node[None, :]))
            yield _edge_batch(ids[i], node[j], sim[i, j])

    true = nodes.select("node", "raw").mapInArrow(exact, EDGES).select("u", "v")
    ends = [roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "uv"]
    placed = true.join(ends[0], "u", "left").join(ends[1], "v", "left")
    found, total = placed.agg(F.count_if(F.col("root_u") == F.col("root_v")), F.count("*")).first()
    return found / total if total else 1.0


def count_links(members: DataFrame, threshold: float, block: int = 512) -> DataFrame:
    """node and the weight of all members of its group (``root``) that link with it.

    A group is cut into blocks of about ``block`` nodes and every pair of blocks is one unit of
    work, so a large group is spread over many tasks; only sums leave a unit.
    """
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = members.join(sizes, "root").withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    units = placed.select("root", "node", "n", "raw", "own", other).select(
        F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("unit"),
        "root",
        F.least("own", "other").alias("a"),
        F.greatest("own", "other").alias("b"),
        (F.col("own") > F.col("other")).alias("second"),
        "node",
        "n",
        "raw",
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped_batches(batches, "unit"):
            unit = _matrix(table.column("raw").combine_chunks())
            cols = {c: table.column(c).to_numpy() for c in ("unit", "root", "a", "b", "second", "node", "n")}
            change = np.zeros(len(unit), bool)
            change[0] = True
            for c in ("unit", "root", "a", "b"):
                change[1:] |= cols[c][1:] != cols[c][:-1]
            edges = np.r_[np.flatnonzero(change), len(unit)]
            nodes, links = [], []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                second, n, node = (cols[c][lo:hi] for c in ("second", "n", "node"))
                near = unit[lo:hi] @ unit[lo:hi].T >= threshold
                np.fill_diagonal(near, False)
                if cols["a"][lo] != cols["b"][lo]:
                    near &= second[:, None] != second[None, :]
                nodes.append(node)
                links.append(near @ n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(nodes)), pa.array(np.concatenate(links).astype(np.int64))],
                names=["node", "links"],
            )

    counted = (
        units.repartition("unit").sortWithinPartitions("unit", "root", "a", "b").mapInArrow(
            compare, "node long, links long"
        )
    )
    return counted.groupBy("node").agg(F.sum("links").alias("links"))


def _descend(
    nodes: DataFrame,
    graph: DataFrame,
    size: int,
    rounds: int,
    settled: float,
    report: Callable[[str], None],
    inner: DataFrame | None = None,
) -> DataFrame:
    """The graph after rounds of joins, until few entries are new."""
    count = nodes.count()
    for turn in range(rounds):
        following = stored(_round(nodes, graph, size, inner), "graph")
        discard(graph)
        graph = following
        changed = graph.where("fresh").count()
        report(f"lists of {size}, round {turn}: {changed} of {count * size} entries are new")
        if changed <= settled * count * size:
            break
    return graph


def _first_graph(nodes: DataFrame, size: int, tables: int, width: int, seed: int) -> DataFrame:
    found = _projected(nodes, tables, width, size, seed).groupBy("u", "v").agg(F.max("sim").alias("sim"))
    return stored(_best(found, size).withColumn("fresh", F.lit(True)), "graph")


def linked_components(
    nodes: DataFrame,
    threshold: float,
    size: int = 10,
    tables: int = 8,
    width: int = 8,
    rounds: int = 6,
    settled: float = 0.01,
    queries: int = 256,
    recall: float = 0.99,
    seed: int = 17,
    report: Callable[[str], None] = lambda line: None,
) -> DataFrame:
    """node and root of all nodes with a link; the root is the smallest node that links reach."""
    single = nodes.select("node", "raw", F.col("node").alias("root"))
    graph = _first_graph(single, size, tables, width, seed)
    count = nodes.count()
    while True:
        graph = _descend(single, graph, size, rounds, settled, report)
        near = graph.where(F.col("sim") >= threshold).select("u", "v")
        roots = stored(components(near, "u", "v"), "roots")
        lows = graph.groupBy("u").agg(F.min("sim").alias("low")).where(F.col("low") >= threshold)
        full = stored(lows.select(F.col("u").alias("node")), "saturated")
        links = near
        while True:
            open_ = stored(nodes.select("node", "raw").join(full, "node").join(roots, "node"), "open")
            if open_.select("root").distinct().limit(2).count() < 2:
                break
            across = _first_graph(open_, size, tables, width, seed)
            across = _descend(open_, across, size, rounds, settled, report, near)
            merging = across.where(F.col("sim") >= threshold).select("u", "v")
            if merging.isEmpty():
                break
            report(f"lists of {size}: components merge")
            links = links.unionByName(merging)
            roots = stored(components(links, "u", "v"), "roots")
        reached = audit(nodes, roots, threshold, queries)
        report(f"lists of {size}: audited recall {reached:.4f}")
        if reached >= recall:
            return roots
        if size >= count:
            raise RuntimeError(f"audited recall {reached:.4f} is below {recall} with lists of {size} for {count} nodes")
        size *= 2
        graph = stored(graph.withColumn("fresh", F.lit(True)), "graph")


def embedding_groups(
    vectors: DataFrame,
    threshold: float = 0.95,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    **settings,
) -> DataFrame:
    """vec_id, number of other vectors linked, smallest id reachable, and whether it is its own."""
    rows = stored(raw_vectors(vectors, id_col, vector_col), "vectors")
    classes = rows.where("raw is not null").groupBy("raw").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("n")
    )
    nodes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    roots = linked_components(nodes, threshold, **settings)
    linked = nodes.join(roots, "node").select("root", "node", "n", "raw", "least")
    counts = count_links(linked.drop("least"), threshold)
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = roots.join(least, "root").join(counts, "node").select("node", "links", "component_id")
    per_node = nodes.join(placed, "node", "left").select(
        "raw",
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component_id", "least").alias("component_id"),
    )
    joined = rows.where("raw is not null").join(per_node, "raw").drop("raw")
    alone = rows.where("raw is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    found = joined.select("vec_id", "n_links", "component_id").unionByName(alone)
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
