"""Models fitted by passes over a table: each pass sums gradients and validation losses of all models at once.

A pass is one Spark job. Tasks add up their batches' sums in numpy; where there are many tasks, their sums are added in a
second stage, so the driver gets at most ``MOST_SUMS`` vectors of the models' size. The driver holds models, never rows.
The best state by validation loss is kept, and a model that has not improved for ``patience`` passes stops.

``LinearSweep`` fits linear models (logistic, softmax, least squares) of many targets, seeds and strengths together, so the number
of jobs does not follow the number of models. A step solves with a bound of the curvature that holds for all rows and models
(a quarter, a half or one times the features' Gram matrix), so no step size is searched. A seed draws the features
that a pass leaves out (dropout, one mask a pass) and thus the path to the model.

``PairNet`` is a dense block with shared weights over both members of a pair, the mean of the two, and a linear output; steps by Adam.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_SUMS = 64
#: Splits as numbers in ``labels``.
SPLITS = {"train": 0, "validation": 1, "test": 2}
_SUM = pa.schema([("sum", pa.binary())])


def _adding(partial: Callable) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = partial(batch)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], schema=_SUM)

    return task


def summed(rows: DataFrame, partial: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray | None:
    """The sum of ``partial`` over all batches of ``rows``; None without rows."""
    sums = rows.mapInArrow(_adding(partial), "sum binary")
    if rows.rdd.getNumPartitions() > MOST_SUMS:
        again = _adding(lambda batch: np.sum([np.frombuffer(x, np.float64) for x in batch.column("sum").to_pylist()], axis=0))
        sums = sums.repartition(MOST_SUMS).mapInArrow(again, "sum binary")
    found = [np.frombuffer(r["sum"], np.float64) for r in sums.collect()]
    return np.sum(found, axis=0) if found else None


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1 / (1 + e), e / (1 + e))


@dataclass
class Task:
    """One target and seed. ``classes``: 1 for a number, 2, or more. ``weights``: of each class."""

    target: str
    seed: int
    classes: int
    weights: list[float] = field(default_factory=list)
    centre: float = 0.0
    scale: float = 1.0

    @property
    def outputs(self) -> int:
        return 1 if self.classes <= 2 else self.classes


@dataclass
class LinearSweep:
    """Models of ``tasks`` for each of ``strengths``. Rows: x (vector), labels (array of task, y, split)."""

    tasks: list[Task]
    strengths: Sequence[float]
    dropout: float = 0.1
    epochs: int = 60
    patience: int = 10
    weights: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.models = [(t, s) for t in range(len(self.tasks)) for s in self.strengths]
        sizes = [self.tasks[t].outputs for t, _ in self.models]
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(int)

    def _columns(self, m: int) -> slice:
        return slice(self.first[m], self.first[m + 1])

    def residuals(self, m: int, z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient by the outputs and loss, a row each, times the class's weight."""
        task = self.tasks[self.models[m][0]]
        if task.classes == 1:
            r = z - ((y - task.centre) / task.scale)[:, None]
            return r, 0.5 * r[:, 0] ** 2
        w = np.asarray(task.weights or [1.0] * task.classes)[y.astype(int)]
        if task.classes == 2:
            return (_sigmoid(z) - y[:, None]) * w[:, None], (_softplus(z[:, 0]) - y * z[:, 0]) * w
        z = z - z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        k = y.astype(int)
        loss = -np.log(np.maximum(p[np.arange(len(k)), k], 1e-300)) * w
        p[np.arange(len(k)), k] -= 1
        return p * w[:, None], loss

    def _partial(self, weights: np.ndarray, mask: np.ndarray) -> Callable[[pa.RecordBatch], np.ndarray]:
        """Gradient, training loss and validation loss of each model. ``mask``: factors of features by model."""

        def partial(batch: pa.RecordBatch) -> np.ndarray:
            x, row, task, y, split = labelled(batch)
            gradient, losses = np.zeros_like(weights), np.zeros((2, len(self.models)))
            for t in range(len(self.tasks)):
                for part in (0, 1):
                    here = np.flatnonzero((task == t) & (split == part))
                    some = x[row[here]]
                    for m in (m for m, (own, _) in enumerate(self.models) if own == t and len(here)):
                        at = self._columns(m)
                        factor = mask[:, m : m + 1] if part == 0 else 1.0
                        r, loss = self.residuals(m, some @ (weights[:, at] * factor), y[here])
                        losses[part, m] += loss.sum()
                        if part == 0:
                            gradient[:, at] += (some.T @ r) * factor
            return np.concatenate([gradient.ravel(), losses.ravel()])

        return partial

    def fit(self, rows: DataFrame) -> LinearSweep:
        """Passes over ``rows`` until all models have stopped; keeps each model's best weights."""
        def square(batch: pa.RecordBatch) -> np.ndarray:
            x = with_one(matrix(batch.column("x")))
            return (x.T @ x).ravel()

        def counted(batch: pa.RecordBatch) -> np.ndarray:
            _, _, task, _, split = labelled(batch)
            return np.array([np.sum((task == t) & (split == part)) for t in range(len(self.tasks)) for part in (0, 1)], float)

        gram, sizes = summed(rows, square), summed(rows, counted)
        if gram is None:
            raise ValueError("no rows to fit")
        width = int(round(np.sqrt(len(gram))))
        gram, sizes = gram.reshape(width, width), sizes.reshape(-1, 2)
        steps = []
        for t, strength in self.models:
            task = self.tasks[t]
            bound = {1: 1.0, 2: 0.25}.get(task.classes, 0.5) * max(task.weights or [1.0])
            steps.append(np.linalg.inv(bound * gram / max(sizes[t, 0], 1) + (strength + 1e-9) * np.eye(width)))
        state = np.zeros((width, self.first[-1]))
        ahead, momentum = state.copy(), np.ones(len(self.models))
        best, least, since = state.copy(), np.full(len(self.models), np.inf), np.zeros(len(self.models), int)
        going = np.ones(len(self.models), bool)
        for epoch in range(self.epochs):
            mask = np.ones((width, len(self.models)))
            for m, (t, _) in enumerate(self.models):
                kept = np.random.default_rng((self.tasks[t].seed, epoch)).random(width - 1) >= self.dropout
                mask[:-1, m] = kept / (1 - self.dropout) if epoch and self.dropout else 1.0
            sums = summed(rows, self._partial(ahead, mask))
            gradient = sums[: ahead.size].reshape(ahead.shape)
            losses = sums[ahead.size :].reshape(2, -1)
            for m in np.flatnonzero(going).tolist():
                t, strength = self.models[m]
                at = self._columns(m)
                value = losses[1, m] / max(sizes[t, 1], 1)
                if value < least[m] - 1e-6:
                    least[m], best[:, at], since[m] = value, ahead[:, at], 0
                else:
                    since[m] += 1
                going[m] = since[m] < self.patience
                new = ahead[:, at] - steps[m] @ (gradient[:, at] / max(sizes[t, 0], 1) + strength * ahead[:, at])
                further = (1 + np.sqrt(1 + 4 * momentum[m] ** 2)) / 2
                ahead[:, at] = new + (momentum[m] - 1) / further * (new - state[:, at])
                state[:, at], momentum[m] = new, further
            if not going.any():
                break
        self.weights = best
        return self

    def scored(self, rows: DataFrame, keep: Sequence[str] = (), chosen: Sequence[int] | None = None) -> DataFrame:
        """A row for each label and model (or the ``chosen`` ones): ``keep``, target, seed, model, split, class, probabilities (for a number:
        its one guess)."""
        kept = rows.schema
        fields = [f"{kept[c].name} {kept[c].dataType.simpleString()}" for c in keep]
        schema = ", ".join([*fields, "target string", "seed int", "model int", "split int", "class double", "probabilities array<double>"])
        models = list(range(len(self.models))) if chosen is None else list(chosen)

        def task_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, row, task, y, split = labelled(batch)
                for m in models:
                    t = self.models[m][0]
                    own = self.tasks[t]
                    here = np.flatnonzero(task == t)
                    z = x[row[here]] @ self.weights[:, self._columns(m)]
                    if own.classes == 1:
                        p = z * own.scale + own.centre
                    elif own.classes == 2:
                        p = np.concatenate([_sigmoid(-z), _sigmoid(z)], 1)
                    else:
                        p = np.exp(z - z.max(1, keepdims=True))
                        p /= p.sum(1, keepdims=True)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(here) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))
                    names = [batch.column(c).take(pa.array(row[here])) for c in keep]
                    columns = [*names, pa.array([own.target] * len(here), pa.string()), *(pa.array(np.full(len(here), v, np.int32)) for v in (own.seed, m)), pa.array(split[here].astype(np.int32)), pa.array(y[here]), lists]
                    yield pa.RecordBatch.from_arrays(columns, names=[*keep, "target", "seed", "model", "split", "class", "probabilities"])

        return rows.select(*keep, "x", "labels").mapInArrow(task_of, schema)


def with_one(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.ones((len(x), 1))], 1)


def labelled(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Vectors with a one, and for each label its row, task, value and split."""
    lists = batch.column("labels")
    flat = lists.flatten()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(int)
    fields = [flat.field(n).to_numpy(zero_copy_only=False) for n in ("task", "y", "split")]
    return with_one(matrix(batch.column("x"))), np.repeat(np.arange(len(sizes)), sizes), fields[0], fields[1].astype(float), fields[2]


@dataclass
class PairNet:
    """logit = mean(relu(x A + a), relu(y A + a)) w + b of pairs (x, y, class, split as text)."""

    hidden: int = 32
    seed: int = 1
    rate: float = 0.05
    decay: float = 1e-4
    epochs: int = 150
    patience: int = 20
    weights: np.ndarray | None = None

    def _shapes(self, width: int) -> list[tuple[int, ...]]:
        return [(width, self.hidden), (self.hidden,), (self.hidden,), (1,)]

    def _parts(self, flat: np.ndarray, width: int) -> list[np.ndarray]:
        cuts = np.cumsum([int(np.prod(s)) for s in self._shapes(width)])[:-1]
        return [p.reshape(s) for p, s in zip(np.split(flat, cuts), self._shapes(width), strict=True)]

    def _forward(self, flat: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
        a, a0, w, b = self._parts(flat, x.shape[1])
        hx, hy = x @ a + a0, y @ a + a0
        mean = (np.maximum(hx, 0) + np.maximum(hy, 0)) / 2
        return hx, hy, mean, mean @ w + b[0]

    def gradient(self, flat: np.ndarray, x: np.ndarray, y: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, float]:
        """Sums over the pairs."""
        _, _, w, _ = self._parts(flat, x.shape[1])
        hx, hy, mean, z = self._forward(flat, x, y)
        r = _sigmoid(z) - label
        gx, gy = (r[:, None] * w[None, :] / 2 * (h > 0) for h in (hx, hy))
        return np.concatenate([(x.T @ gx + y.T @ gy).ravel(), gx.sum(0) + gy.sum(0), mean.T @ r, [r.sum()]]), float((_softplus(z) - label * z).sum())

    def fit(self, pairs: DataFrame) -> PairNet:
        first = pairs.select("x").first()
        if first is None:
            raise ValueError("no pairs to fit")
        width = len(first["x"])
        rng = np.random.default_rng(self.seed)
        flat = np.concatenate([rng.normal(size=width * self.hidden) * np.sqrt(2 / width), np.zeros(self.hidden), rng.normal(size=self.hidden) * np.sqrt(1 / self.hidden), [0.0]])
        first_moment, second, best, least, since = np.zeros_like(flat), np.zeros_like(flat), flat.copy(), np.inf, 0
        for epoch in range(1, self.epochs + 1):

            def partial(batch: pa.RecordBatch, flat: np.ndarray = flat) -> np.ndarray:
                x, y = matrix(batch.column("x")), matrix(batch.column("y"))
                label = batch.column("class").to_numpy(zero_copy_only=False).astype(float)
                split = np.array(batch.column("split").to_pylist(), object)
                train, held = split == "train", split == "validation"
                g, loss = self.gradient(flat, x[train], y[train], label[train])
                _, other = self.gradient(flat, x[held], y[held], label[held])
                return np.concatenate([g, [loss, other, train.sum(), held.sum()]])

            sums = summed(pairs.select("x", "y", "class", "split"), partial)
            value = sums[-3] / max(sums[-1], 1)
            if value < least - 1e-6:
                best, least, since = flat.copy(), value, 0
            else:
                since += 1
            if since >= self.patience:
                break
            g = sums[:-4] / max(sums[-2], 1) + self.decay * flat
            first_moment = 0.9 * first_moment + 0.1 * g
            second = 0.999 * second + 0.001 * g * g
            flat = flat - self.rate * (first_moment / (1 - 0.9**epoch)) / (np.sqrt(second / (1 - 0.999**epoch)) + 1e-8)
        self.weights = best
        return self

    def scored(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` with the probability ``p``."""
        flat, own = self.weights, self

        @F.pandas_udf("double")
        def p(x, y):
            import pandas as pd

            return pd.Series(_sigmoid(own._forward(flat, np.stack(x.to_numpy()), np.stack(y.to_numpy()))[3])) if len(x) else pd.Series([], dtype=float)

        return pairs.withColumn("p", p("x", "y"))
