"""Quality rules: gradient-boosted trees over document counts, scored from flat node arrays.

The trees are fitted on the driver from a bounded sample of labelled documents
(``sample_limit``, a documented parameter). Documents are counted and scored inside tasks,
whole tables and whole texts, without a shuffle.

Defined cases: a null or empty text has zero counts and fails the base rule; a null or repeated
``doc_id`` is scored like any other row; without labels of both classes the trees are constant
and only the base rule decides; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.document_stats import COUNTS, document_stats, labelled_sample
from quillgraph.llm.storage import stored

#: Features and the direction in which quality may move with each (0: free).
FEATURES = {
    "log_words": 0,
    "mean_word": 0,
    "symbol_share": -1,
    "symbol_words": -1,
    "dup_lines": -1,
    "repeated": -1,
    "distinct": 0,
    "top": -1,
    "adjacent": -1,
    "digits": 0,
    "upper": 0,
    "ends": 0,
    "short": 0,
    "long": 0,
    "commas": 0,
    "stops": 0,
}


def features(counts: np.ndarray) -> np.ndarray:
    """Rates of the counts; every denominator is at least one."""
    c = {name: counts[:, k].astype(float) for k, name in enumerate(COUNTS)}
    words, chars, lines = (np.maximum(c[k], 1) for k in ("n_words", "n_chars", "n_lines"))
    return np.column_stack(
        [
            np.log1p(c["n_words"]),
            c["word_chars"] / words,
            c["n_symbols"] / chars,
            c["n_symbol_words"] / words,
            c["n_dup_lines"] / lines,
            c["n_repeat_words"] / words,
            c["n_distinct"] / words,
            c["n_top"] / words,
            c["n_adjacent"] / words,
            c["n_digits"] / chars,
            c["n_upper"] / chars,
            c["n_ends"] / words,
            c["n_short"] / words,
            c["n_long"] / words,
            c["n_commas"] / words,
            c["n_stops"] / lines,
        ]
    )


@dataclass
class Trees:
    """All trees in one set of arrays: a node reads a feature, compares, and names its children.

    A leaf names itself as both children, so ``depth`` steps reach a leaf from any root.
    """

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                goes_left = x[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(goes_left, self.left[node], self.right[node])
            total += self.value[node]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit_trees(
    x: np.ndarray,
    y: np.ndarray,
    directions: list[int],
    rounds: int = 60,
    depth: int = 4,
    rate: float = 0.2,
    bins: int = 64,
    penalty: float = 1.0,
    least: int = 20,
) -> Trees:
    """Second-order boosting of the logistic loss with binned features.

    A split on a constrained feature must keep its direction, and both sides are then held
    apart by the middle of their values all the way down.
    """
    nodes: list[list[float]] = []
    positive = float(y.sum()) if len(y) else 0.0
    base = float(np.log((positive + 0.5) / (len(y) - positive + 0.5)))
    roots: list[int] = []
    if 0 < positive < len(y):
        edges = [np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins)) for f in range(x.shape[1])]
        binned = [np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)]
        margin = np.full(len(y), base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)

            def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
                g, h = grad[rows].sum(), hess[rows].sum()
                own = float(np.clip(-g / (h + penalty), low, high))
                at = len(nodes)
                nodes.append([0, 0.0, at, at, rate * own])
                best, pick = 1e-6, None
                for f in range(len(edges)) if level < depth and len(rows) >= 2 * least else ():
                    size = len(edges[f]) + 1
                    b = binned[f][rows]
                    gl = np.cumsum(np.bincount(b, grad[rows], size))[:-1]
                    hl = np.cumsum(np.bincount(b, hess[rows], size))[:-1]
                    nl = np.cumsum(np.bincount(b, minlength=size))[:-1]
                    if not len(gl):
                        continue
                    vl = np.clip(-gl / (hl + penalty), low, high)
                    vr = np.clip(-(g - gl) / (h - hl + penalty), low, high)
                    gain = (
                        -(gl * vl + 0.5 * (hl + penalty) * vl**2)
                        - ((g - gl) * vr + 0.5 * (h - hl + penalty) * vr**2)
                        + (g * own + 0.5 * (h + penalty) * own**2)
                    )
                    allowed = (nl >= least) & (len(rows) - nl >= least)
                    if directions[f]:
                        allowed &= directions[f] * (vr - vl) >= 0
                    gain = np.where(allowed, gain, -np.inf)
                    k = int(np.argmax(gain))
                    if gain[k] > best:
                        best, pick = gain[k], (f, k, float(vl[k]), float(vr[k]))
                if pick is None:
                    margin[rows] += rate * own
                    return at
                f, k, vl, vr = pick
                middle, turn = (vl + vr) / 2, directions[f]
                goes = binned[f][rows] <= k
                left = grow(rows[goes], level + 1, middle if turn < 0 else low, middle if turn > 0 else high)
                right = grow(rows[~goes], level + 1, middle if turn > 0 else low, middle if turn < 0 else high)
                nodes[at] = [f, float(edges[f][k]), left, right, 0.0]
                return at

            roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
    table = np.array(nodes, float).reshape(-1, 5)
    as_int = lambda k: table[:, k].astype(np.int64)
    return Trees(
        as_int(0), table[:, 1], as_int(2), as_int(3), table[:, 4], np.array(roots, np.int64), depth, base
    )


def base_failed(counts: np.ndarray) -> np.ndarray:
    words, repeated = (counts[:, COUNTS.index(c)] for c in ("n_words", "n_repeat_words"))
    return (words < 10) | (100 * repeated > 20 * words)


RULES = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, probability double, kept boolean"
)


def apply_quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.3,
    sample_limit: int = 20_000,
    label: str = "quality",
) -> DataFrame:
    """Counts, base rule and verdict per document."""
    stats = stored(document_stats(docs, hold=5), "rule-counts")
    sample = labelled_sample(stats, labels, label, sample_limit).select("__label", *COUNTS).toPandas()
    trees = fit_trees(
        features(sample[COUNTS].to_numpy()), sample["__label"].to_numpy(float), list(FEATURES.values())
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.column_stack([batch.column(c).to_numpy() for c in COUNTS])
            failed = base_failed(counts)
            good = trees.probability(features(counts))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(batch.column(c) for c in COUNTS[:5]),
                    pa.array(failed),
                    pa.array(good),
                    pa.array(~failed & (good >= threshold)),
                ],
                names=[part.split()[0] for part in RULES.split(", ")],
            )

    return stats.select("doc_id", *COUNTS).mapInArrow(score, RULES)
