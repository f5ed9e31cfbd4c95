"""Linear heads of all labels from one solver: each iteration is one pass over the rows.

A pass adds up, for every label at once, the weighted loss, gradient and curvature (labels x width^2 numbers; meant for
vectors of up to some hundred components). Partitions send one row of sums each; these are merged in two shuffles, so
the driver receives few rows however many partitions there are, and holds one matrix per label.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sliceweave.functions import labels as L
from sliceweave.operators.guards import ContractError

#: Rows a worker multiplies at once.
BLOCK = 4096


@dataclass(frozen=True)
class Heads:
    """One line per label: ``coefficients`` and ``intercepts``; ``usable`` is false where no row had a direction."""

    targets: tuple[str, ...]
    coefficients: np.ndarray
    intercepts: np.ndarray
    usable: np.ndarray
    passes: int


def _signed(features: DataFrame, targets: Sequence[str], vector: str) -> DataFrame:
    """``x``, and ``s`` with the confidence of each label, negative for a negative one and 0 without a direction.

    Rows whose vector is null or holds null or non-finite components take no part.
    """
    signs = [F.when(L.positive(L.col(t)), 1.0).when(L.negative(L.col(t)), -1.0).otherwise(0.0) * L.confidence(L.col(t).cast("double")) for t in targets]
    x = L.col(vector).cast("array<double>")
    whole = F.forall("x", lambda v: F.coalesce(L.finite(v).isNotNull(), F.lit(False)))
    return features.select(x.alias("x"), F.array(*signs).alias("s")).where(F.col("x").isNotNull() & whole)


def _total(rows: DataFrame, sums) -> np.ndarray | None:
    """Sum over all rows of ``sums(x, s)``, a vector of numbers of fixed length; None without rows."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                widths = np.unique(pa.compute.list_value_length(part["x"]).to_numpy())
                if len(widths) > 1:
                    raise ValueError(f"vectors of different lengths: {widths.tolist()}")
                x, s = (part[name].flatten().to_numpy().reshape(part.num_rows, -1) for name in ("x", "s"))
                total = _plus(total, sums(x, s))
        if total is not None:
            yield pa.record_batch({"sums": pa.array([total.tobytes()], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for one in batch["sums"].to_pylist():
                total = _plus(total, np.frombuffer(one))
        if total is not None:
            yield pa.record_batch({"sums": pa.array([total.tobytes()], pa.binary())})

    sent = rows.mapInArrow(partial, "sums binary")
    for _ in range(2):  # unnumbered, so that adaptive execution joins small parts
        sent = sent.repartition(F.spark_partition_id()).mapInArrow(merge, "sums binary")
    total = None
    for row in sent.collect():
        total = _plus(total, np.frombuffer(row["sums"]))
    return total


def _plus(total: np.ndarray | None, more: np.ndarray) -> np.ndarray:
    if total is None:
        return more.copy()
    if len(total) != len(more):
        raise ValueError("vectors of different lengths")
    return total + more


def _moments(x: np.ndarray, s: np.ndarray) -> np.ndarray:
    """For each side and label: sums of the confidence c, of c^2, of c x and of c x^2."""
    out = []
    for c in (np.maximum(s, 0), np.maximum(-s, 0)):
        out.append(np.column_stack([c.sum(axis=0), (c * c).sum(axis=0), c.T @ x, c.T @ (x * x)]).ravel())
    return np.concatenate(out)


def _newton(x: np.ndarray, s: np.ndarray, betas: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each label: sums of the loss, its gradient and its curvature; the intercept stands last."""
    x = np.column_stack([x, np.ones(len(x))])
    out = []
    for label, (beta, weight) in enumerate(zip(betas, weights)):
        used = np.flatnonzero(s[:, label])
        sign, rows = s[used, label], x[used]
        w = np.abs(sign) * np.where(sign > 0, weight, 1.0)
        margin = rows @ beta
        loss = w @ np.logaddexp(0, np.where(sign > 0, -margin, margin))
        p = 0.5 * (1 + np.tanh(margin / 2))
        out += [[loss], rows.T @ (w * (p - (sign > 0))), ((rows * (w * p * (1 - p))[:, None]).T @ rows).ravel()]
    return np.concatenate(out)


def _terms(rows: DataFrame, betas: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    width = betas.shape[1]
    total = _total(rows, lambda x, s: _newton(x, s, betas, weights)).reshape(len(betas), -1)
    return total[:, 0], total[:, 1:1 + width], total[:, 1 + width:].reshape(-1, width, width)


def _start(rows: DataFrame, count: int):
    """Positive weight, sum of weights and deviation of every component, for each label; the deviations are weighted."""
    total = _total(rows, _moments)
    if total is None:
        raise ContractError("no rows with a whole vector")
    positive, negative = total.reshape(2, count, -1)
    weights = np.clip(negative[:, 0] / np.maximum(positive[:, 0], 1), 1, 10)
    both = weights[:, None] * positive + negative
    squares = weights ** 2 * positive[:, 1] + negative[:, 1]
    width = (both.shape[1] - 2) // 2
    mass = both[:, 0]
    safe = np.where(mass > 0, mass, 1)
    means = both[:, 2:2 + width] / safe[:, None]
    spread = both[:, 2 + width:] - safe[:, None] * means ** 2
    degrees = mass - squares / safe
    deviations = np.sqrt(np.maximum(spread, 0) / np.where(degrees > 0, degrees, 1)[:, None])
    deviations[deviations ** 2 <= 1e-14 * np.maximum(means ** 2, 1e-300)] = 0  # constant but for rounding
    return weights, mass, deviations, positive[:, 0], negative[:, 0]


def first_step(features: DataFrame, targets: Sequence[str], vector: str = "features") -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the weighted loss of every label at zero coefficients, the intercept last."""
    rows = _signed(features, targets, vector)
    weights, _, deviations, _, _ = _start(rows, len(targets))
    _, gradient, curvature = _terms(rows, np.zeros((len(targets), deviations.shape[1] + 1)), weights)
    return gradient, curvature


def fit_joint(features: DataFrame, targets: Sequence[str], vector: str = "features", iterations: int = 30,
              regularisation: float = 0.01, tolerance: float = 1e-20) -> Heads:
    """Weighted linear heads by Newton steps, halved where the loss rose; equal to separate fits of each label.

    A row weighs its confidence, times the label's clipped positive weight where positive; missing and neutral labels
    weigh nothing. The penalty is on coefficients times the weighted deviation of their component, not on the
    intercept. Components without deviation get 0. A label with one side alone has no coefficients and an infinite
    intercept; one without any direction is not usable. No rows with a whole vector, or vectors of different lengths,
    are refused. ``tolerance`` bounds the squared Newton decrement at which a label is done.
    """
    rows, count = _signed(features, targets, vector), len(targets)
    weights, mass, deviations, positive, negative = _start(rows, count)
    width = deviations.shape[1] + 1
    penalty = np.column_stack([regularisation * deviations ** 2, np.zeros(count)])
    free = np.column_stack([deviations > 0, np.ones(count, bool)])
    active = (positive > 0) & (negative > 0)
    best, trial = np.zeros((count, width)), np.zeros((count, width))
    with np.errstate(divide="ignore", invalid="ignore"):
        trial[active, -1] = np.log(weights * positive / negative)[active]
    lowest, passes = np.full(count, np.inf), 1
    open_ = active.copy()
    while open_.any() and passes <= iterations:
        losses, gradients, curvatures = _terms(rows, trial, weights)
        passes += 1
        for i in np.flatnonzero(open_):
            loss = losses[i] / mass[i] + 0.5 * penalty[i] @ trial[i] ** 2
            if loss > lowest[i] + 1e-12 * abs(lowest[i]):
                trial[i] = (trial[i] + best[i]) / 2
                continue
            best[i], lowest[i] = trial[i], loss
            at = np.flatnonzero(free[i])
            gradient = (gradients[i] / mass[i] + penalty[i] * best[i])[at]
            curvature = (curvatures[i] / mass[i] + np.diag(penalty[i]))[np.ix_(at, at)]
            step = np.linalg.lstsq(curvature, gradient, rcond=None)[0]
            trial[i, at] = best[i, at] - step
            open_[i] = gradient @ step > tolerance
    if open_.any():
        missing = ", ".join(t for t, o in zip(targets, open_) if o)
        raise ContractError(f"not settled after {iterations} passes: {missing}; raise iterations or the regularisation")
    intercepts = best[:, -1].copy()
    intercepts[(positive > 0) & (negative <= 0)] = np.inf
    intercepts[(positive <= 0) & (negative > 0)] = -np.inf
    return Heads(tuple(targets), best[:, :-1], intercepts, (positive > 0) | (negative > 0), passes)


def _probability(heads: Heads, i: int, x: Column) -> Column:
    if not heads.usable[i]:
        return F.lit(None).cast("double")
    coefficients = F.array(*[F.lit(float(c)) for c in heads.coefficients[i]])
    margin = F.aggregate(F.zip_with(x, coefficients, lambda a, b: a * b), F.lit(float(heads.intercepts[i])), lambda total, v: total + v)
    return 1 / (1 + F.exp(-margin))


def score_joint(features: DataFrame, heads: Heads, key: str, vector: str = "features") -> DataFrame:
    """``key`` and a probability per label, JVM-side; null for vectors that are null, hold nulls or have another length,
    and for labels that are not usable."""
    x = L.col(vector).cast("array<double>")
    fits = F.size(x) == heads.coefficients.shape[1]
    return features.select(L.col(key).alias(key), *[F.when(fits, _probability(heads, i, x)).alias(t) for i, t in enumerate(heads.targets)])
