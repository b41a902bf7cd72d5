"""Merkle manifests of a table with nested-interval labels.

Rows become leaves of one tree per value of a column; the roots of these trees are the leaves of
one more tree. Every node carries the half-open interval ``[lo, hi)`` of the leaf ranks it covers.
A parent's interval holds its children's, so an ancestor is found by a containment join that meets
in buckets of the ancestor's level (``lo`` divided by the level's width), and the siblings of a
node are what is left of the parent's interval without the node's own.

Nodes are kept in bands of ``depth`` levels: a row of a band is a subtree of at most
``arity ** depth`` nodes at its bottom, with all its levels. Bands are built bottom-up from the
top nodes of the band below; paths to the root are attached top-down, so the table of all leaves
meets one join only. Everything is built-in functions; texts are hashed where they lie and never
move.

Defined cases: a null field is hashed as ``-`` and differs from an empty one; a null tree value
has a tree of its own, first in order; a null key comes before all others; rows of equal key are
ordered by their digests, and equal digests are interchangeable; repeated rows are leaves of their
own; a tree of one leaf is that leaf; an empty table has no rows; columns that are not named as
fields are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.storage import stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field_text(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field_text, fields)), 256)


def tree_key(value: Column) -> Column:
    """A text that is never null and sorts as the value does, null first."""
    return F.coalesce(F.concat(F.lit("+"), value.cast("string")), F.lit(""))


def _digests(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda node: node["digest"]), "")


@dataclass
class IntervalTrees:
    """Trees over leaves ``tree, lo, hi, digest, own``; ``own`` is whatever a leaf carries.

    ``bands[b]``: ``tree, below`` (nodes of the tree at the band's bottom), ``lo, hi`` (of the
    subtree), ``members`` (its bottom nodes; with ``own`` in the lowest band), ``levels``.
    """

    bands: list[DataFrame]
    arity: int
    depth: int

    def width(self, band: int) -> int:
        """Leaves under a full node at the bottom of a band."""
        return self.arity ** (self.depth * band)

    def roots(self) -> DataFrame:
        """``tree, n, digest``: one row per tree."""
        found = None
        for band in self.bands:
            top = F.element_at(F.element_at("levels", -1), 1)
            last = band.where(F.col("below") <= self.width(1)).select(
                "tree", F.col("hi").alias("n"), top["digest"].alias("digest")
            )
            found = last if found is None else found.unionByName(last)
        return found

    def nodes(self) -> DataFrame:
        """``tree, level, lo, hi, digest``: every node once; the manifest to keep with the data."""
        found = None
        for number, band in enumerate(self.bands):
            rows = band.select("tree", "below", F.posexplode("levels").alias("step", "run"))
            # The top of a subtree is a member of the band above, unless there is none.
            rows = rows.where((F.col("step") < self.depth) | (F.col("below") <= self.width(1)))
            level = (F.col("step") + number * self.depth).alias("level")
            rows = rows.select("tree", level, F.inline("run"))
            found = rows if found is None else found.unionByName(rows)
        return found

    def _steps(self, place: Column) -> Column:
        """Siblings of the member at a place, level by level: what the parents' intervals hold besides."""

        def step(level: Column) -> Column:
            at = F.floor(place / F.pow(F.lit(self.arity), level)).cast("int")
            run = F.slice(F.element_at("levels", level + 1), at - at % self.arity + 1, self.arity)
            own = F.element_at(F.element_at("levels", level + 1), at + 1)
            before = F.filter(run, lambda node: node["hi"] <= own["lo"])
            after = F.filter(run, lambda node: node["lo"] >= own["hi"])
            return F.struct(_digests(before).alias("before"), _digests(after).alias("after"))

        height = F.size("levels") - 1
        return F.when(
            height > 0, F.transform(F.sequence(F.lit(0), F.greatest(height - 1, F.lit(0))), step)
        ).otherwise(F.array().cast("array<struct<before:string,after:string>>"))

    def paths(self, above: DataFrame) -> DataFrame:
        """Leaves with ``steps``, the siblings from the leaf up to the root of roots.

        ``above``: ``tree, root, steps`` of every tree.
        """
        over = above.select("tree", F.lit(0).cast("long").alias("a_lo"), F.lit(None).cast("long").alias("a_hi"), "root", "steps")
        reached = over
        for number in range(len(self.bands) - 1, -1, -1):
            wide = self.width(number + 1)
            last = F.col("below") <= self.width(1)
            band = self.bands[number].withColumn("bucket", F.when(last, -1).otherwise(F.floor(F.col("lo") / wide)))
            # The root of a finished tree is under no bucket of its own tree; its path is the one above.
            ancestors = over.withColumn("bucket", F.lit(-1).cast("long"))
            if number < len(self.bands) - 1:
                ancestors = ancestors.unionByName(reached.withColumn("bucket", F.floor(F.col("a_lo") / wide)))
            met = band.join(ancestors.withColumnRenamed("steps", "up"), ["tree", "bucket"]).where(
                (F.col("a_lo") <= F.col("lo")) & (F.col("a_hi").isNull() | (F.col("hi") <= F.col("a_hi")))
            )
            member = F.posexplode("members").alias("place", "node")
            rows = met.select("tree", "root", "up", "levels", member)
            rows = rows.withColumn("steps", F.concat(self._steps(F.col("place")), F.col("up")))
            reached = rows.select(
                "tree", F.col("node.lo").alias("a_lo"), F.col("node.hi").alias("a_hi"), "root", "steps", *(
                    ["node.digest", "node.own"] if number == 0 else []
                )
            )
        return reached.withColumnsRenamed({"a_lo": "lo", "a_hi": "hi"})


def ranked(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """``tree, n, lo, digest, own`` with the rank of every leaf in its tree, over any number of tasks.

    One range exchange of digests; ranks are positions in the written partitions plus the number
    of leaves of the tree in the partitions before.
    """
    order = ["tree", *order, "digest", "nth"]
    placed = leaves.withColumn("nth", F.monotonically_increasing_id())
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "tree", "digest", "own",
        F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"),
    )
    placed = stored(placed, "leaves")
    runs = placed.groupBy("tree", "part").agg(F.min("place").alias("first"), F.count("*").alias("size"))
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "tree", "part",
        (F.coalesce(F.sum("size").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("size").over(Window.partitionBy("tree")).alias("n"),
    )
    return placed.join(runs, ["tree", "part"]).select(
        "tree", "n", (F.col("place") + F.col("shift")).alias("lo"), "digest", "own"
    )


def interval_trees(leaves: DataFrame, order: Sequence[str], arity: int = 2, depth: int = 6) -> IntervalTrees:
    """Build the trees of leaves ``tree, digest, own`` that ascend by ``order`` (columns of leaves)."""
    if arity < 2 or depth < 1:
        raise ValueError("a node needs two children at least, a band one level")
    nodes = ranked(leaves, order).select(
        "tree", F.col("n").alias("below"), "lo", (F.col("lo") + 1).alias("hi"), "digest", "own"
    )
    full = arity**depth

    def parents(run: Column) -> Column:
        def parent(k: Column) -> Column:
            children = F.slice(run, (k * arity + 1).cast("int"), arity)
            return F.struct(
                F.element_at(children, 1)["lo"].alias("lo"),
                F.element_at(children, -1)["hi"].alias("hi"),
                F.sha2(_digests(children), 256).alias("digest"),
            )

        return F.transform(F.sequence(F.lit(0), F.floor((F.size(run) - 1) / arity)), parent)

    trees, number = IntervalTrees([], arity, depth), 0
    while True:
        wide = trees.width(number + 1)
        carried = ["own"] if number == 0 else []
        runs = nodes.groupBy("tree", "below", F.floor(F.col("lo") / wide).alias("bucket")).agg(
            F.array_sort(F.collect_list(F.struct("lo", "hi", "digest", *carried))).alias("members")
        )
        # A tree with few nodes left ends at its root: as many levels as powers of the arity below them.
        powers = F.array(*(F.lit(arity**k).cast("long") for k in range(depth)))
        height = F.size(F.filter(powers, lambda power: power < F.col("below")))
        bottom = F.transform("members", lambda m: F.struct(m["lo"].alias("lo"), m["hi"].alias("hi"), m["digest"].alias("digest")))
        grown = F.aggregate(
            F.sequence(F.lit(1), F.greatest(height, F.lit(1))),
            F.array(bottom),
            lambda levels, _: F.concat(levels, F.array(parents(F.element_at(levels, -1)))),
        )
        band = runs.select(
            "tree", "below", "members", F.when(height > 0, grown).otherwise(F.array(bottom)).alias("levels")
        )
        top = F.element_at(F.element_at("levels", -1), 1)
        band = stored(band.select("tree", "below", top["lo"].alias("lo"), top["hi"].alias("hi"), "members", "levels"), "band")
        trees.bands.append(band)
        unfinished = band.where(F.col("below") > full)
        if unfinished.isEmpty():
            return trees
        nodes = unfinished.select(
            "tree", F.ceil(F.col("below") / full).alias("below"), "lo", "hi", top["digest"].alias("digest")
        )
        number += 1


def manifest(
    docs: DataFrame, fields: Sequence[str] = FIELDS, tree: str = "lang", key: str = "doc_id", own: Sequence[Column] = ()
) -> tuple[IntervalTrees, IntervalTrees]:
    """The trees of a table's rows and the tree of their roots.

    ``own``: further columns that the leaves carry besides the key.
    """
    carried = F.struct(F.col(key).alias("key"), *own).alias("own")
    leaves = docs.select(
        tree_key(F.col(tree)).alias("tree"), F.col(key).alias("order"), row_digest([F.col(f) for f in fields]).alias("digest"), carried
    )
    rows = interval_trees(leaves, ["order"])
    tops = rows.roots().select(F.lit("").alias("tree"), F.col("tree").alias("order"), "digest", F.struct(F.col("tree").alias("key")).alias("own"))
    return rows, interval_trees(tops, ["order"])


def proofs(rows: IntervalTrees, tops: IntervalTrees) -> DataFrame:
    """``tree, lo, hi, digest, own, subroot, root, steps``: every leaf with its way to the root."""
    found = tops.roots().first()
    root = F.lit(found["digest"] if found else None).cast("string")
    crown = F.broadcast(tops.roots().select("tree").limit(1)).select("tree", F.lit("").alias("root"), F.array().cast("array<struct<before:string,after:string>>").alias("steps"))
    above = tops.paths(crown).select(F.col("own.key").alias("tree"), F.col("digest").alias("root"), "steps")
    return rows.paths(above).withColumnRenamed("root", "subroot").withColumn("root", root)


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(steps, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def verified_manifest(docs: DataFrame) -> DataFrame:
    """Every row with its digests, and whether a copy of the rows with planted changes still leads to the root.

    The copy adds one to ``n_chars`` where 7 divides the CRC-32 of the decimal id; a null stays.
    """
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    changed = F.when(hit & F.col("n_chars").isNotNull(), row_digest([more if f == "n_chars" else F.col(f) for f in FIELDS]))
    rows, tops = manifest(docs, own=[changed.alias("changed")])
    found = proofs(rows, tops)
    siblings = F.array_join(F.transform("steps", lambda s: F.concat(s["before"], s["after"])), "")
    found = found.select(
        F.col("own.key").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root",
        F.sha2(siblings, 256).alias("proof_sha256"),
        fold(F.coalesce("own.changed", "digest"), F.col("steps")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
