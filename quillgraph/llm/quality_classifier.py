"""Quality classifier: regularised quadratic discriminant over transformed document counts.

Each class has a mean and a covariance shrunk towards the pooled one and its diagonal; the
Cholesky factors are made once, and a score is the logistic of the difference of the two
Mahalanobis log densities and log priors. The moments come from a bounded sample of labelled
documents (``sample_limit``); every document of the table is scored inside its task.

Defined cases: a null or empty text has zero counts and gets a score like any other; a null id
is never held out; without labels of both classes the score is the share of label 1 (0.5 if
there is none); repeated rows are repeated in the result; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillgraph.llm.document_stats import COUNTS, document_stats, labelled_sample
from quillgraph.llm.storage import stored

HOLD = 5
SCORES = "doc_id long, held_out boolean, score double, predicted int, log_odds double"


def transformed(counts: np.ndarray) -> np.ndarray:
    """Log rates with a half count of smoothing, so that heavy tails come close to a bell."""
    c = {name: counts[:, k].astype(float) for k, name in enumerate(COUNTS)}
    rate = lambda a, b: np.log((c[a] + 0.5) / (c[b] + 1.0))
    return np.column_stack(
        [
            np.log1p(c["n_words"]),
            rate("n_symbols", "n_chars"),
            rate("n_symbol_words", "n_words"),
            rate("n_repeat_words", "n_words"),
            rate("n_distinct", "n_words"),
            rate("n_top", "n_words"),
            rate("n_adjacent", "n_words"),
            rate("n_ends", "n_words"),
            rate("n_short", "n_words"),
        ]
    )


@dataclass
class Discriminant:
    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        densities = []
        for mean, factor, constant in zip(self.means, self.factors, self.constants, strict=True):
            z = np.linalg.solve(factor, (x - mean).T) if len(x) else np.zeros((x.shape[1], 0))
            densities.append(constant - 0.5 * (z * z).sum(axis=0))
        return densities[1] - densities[0]


def fit_discriminant(
    x: np.ndarray, y: np.ndarray, shrink: float = 0.5, floor: float = 0.1
) -> Discriminant | float:
    """Two-class discriminant, or the share of label 1 where a class has no rows.

    The class covariance is mixed with the pooled one by ``shrink``; ``floor`` times the pooled
    variance (at least 1e-3) is added on the diagonal, so constant columns do no harm.
    """
    n = [int((y == k).sum()) for k in (0, 1)]
    if 0 in n:
        return float(y.mean()) if len(y) else 0.5
    means = np.array([x[y == k].mean(axis=0) for k in (0, 1)])
    spread = [np.cov(x[y == k].T, bias=True).reshape(x.shape[1], -1) for k in (0, 1)]
    pooled = (n[0] * spread[0] + n[1] * spread[1]) / sum(n)
    ridge = np.diag(np.maximum(floor * np.diag(pooled), 1e-3))
    factors = np.array([np.linalg.cholesky((1 - shrink) * s + shrink * pooled + ridge) for s in spread])
    constants = np.array([np.log(n[k] / sum(n)) - np.log(np.diag(factors[k])).sum() for k in (0, 1)])
    return Discriminant(means, factors, constants)


def classify_quality(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.3,
    sample_limit: int = 20_000,
    label: str = "quality",
) -> DataFrame:
    """Score in [0, 1] per document; labels of held-out ids are never read."""
    stats = stored(document_stats(docs, hold=HOLD), "quality-counts")
    taught = stats.where("not held_out")
    sample = labelled_sample(taught, labels, label, sample_limit).select("__label", *COUNTS).toPandas()
    model = fit_discriminant(transformed(sample[COUNTS].to_numpy()), sample["__label"].to_numpy())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.column_stack([batch.column(c).to_numpy() for c in COUNTS])
            if isinstance(model, float):
                good = np.full(len(counts), model)
                odds = np.zeros(len(counts))
            else:
                odds = model.log_odds(transformed(counts))
                good = 1.0 / (1.0 + np.exp(-np.clip(odds, -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(good),
                    pa.array((good >= threshold).astype(np.int32)),
                    pa.array(odds),
                ],
                names=["doc_id", "held_out", "score", "predicted", "log_odds"],
            )

    return stats.select("doc_id", "held_out", *COUNTS).mapInArrow(score, SCORES)
