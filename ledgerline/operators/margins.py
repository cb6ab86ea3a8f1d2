"""Support vector machines with probabilities, with a linear or a Gaussian kernel.

A Gaussian kernel is the mean product of random cosine features, so a linear machine on
these stands for one with the kernel. Margins become probabilities by a sigmoid that is
fitted to the margins of rows that the machine has not seen. The machines that leave out a
fold each and that of all rows are fitted in the same passes over blocks of rows. The blocks
are kept with the features as given; the cosines, which are many times as large, are made of
one block at a time in each pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Generator, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES, LABEL, WEIGHT, FOLD = "features", "__label", "__weight", "fold"
MARGIN = "__margin"
CELLS_A_TASK = 2_500_000  # rows times features; fewer are not worth a task of their own
BLOCK_ROWS = 2048


@dataclass(frozen=True)
class Fourier:
    """Random features of the kernel exp(-gamma * distance squared): cosines of random projections."""

    gamma: float
    components: int
    seed: int

    def frame(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Projections (width x components) and phases; the same wherever they are made."""
        return _frame(self, width)

    def project(self, x: np.ndarray) -> np.ndarray:
        w, phase = self.frame(x.shape[1])
        out = x @ w
        out += phase
        np.cos(out, out=out)
        out *= math.sqrt(2 / self.components)
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        """``df`` with the features replaced."""
        project = self.project

        @F.pandas_udf("array<double>")
        def features(x: pd.Series) -> pd.Series:
            return pd.Series(list(project(np.stack(x.to_numpy())))) if len(x) else pd.Series([], dtype=object)

        return df.withColumn(FEATURES, array_to_vector(features(vector_to_array(FEATURES))))


@lru_cache(8)
def _frame(fourier: Fourier, width: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(fourier.seed)
    return rng.normal(0, math.sqrt(2 * fourier.gamma), (width, fourier.components)), rng.uniform(0, 2 * math.pi, fourier.components)


def scale_gamma(df: DataFrame) -> float:
    """1 / (number of features x variance of all their values), as one aggregate."""
    x = vector_to_array(FEATURES)
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    squares = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)
    found = df.agg(F.max(F.size(x)).alias("width"), F.sum(F.size(x)).alias("n"), F.sum(total).alias("s"), F.sum(squares).alias("q")).first()
    if not found.n:
        return 1.0
    spread = found.q / found.n - (found.s / found.n) ** 2
    return 1.0 / (found.width * spread) if spread > 0 else 1.0


@dataclass(frozen=True)
class Sigmoid:
    """Probability 1 / (1 + exp(a * margin + b))."""

    a: float
    b: float

    def column(self, margin):
        return 1 / (1 + F.exp(F.lit(self.a) * margin + F.lit(self.b)))


def fit_sigmoid(df: DataFrame, margin: str = MARGIN, label: str = LABEL, steps: int = 100) -> Sigmoid:
    """The sigmoid of largest likelihood, by Newton steps; each step is one aggregate over the rows."""
    y = F.col(label) == 1
    counts = df.agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg")).first()
    high, low = _targets(counts.pos, counts.neg)
    target = F.when(y, high).otherwise(low)

    def sums(a: float, b: float):
        z, m = F.lit(a) * F.col(margin) + F.lit(b), F.col(margin)
        p = F.when(z >= 0, F.exp(-z) / (1 + F.exp(-z))).otherwise(1 / (1 + F.exp(z)))
        loss = F.when(z >= 0, target * z + F.log1p(F.exp(-z))).otherwise((target - 1) * z + F.log1p(F.exp(z)))
        d1, d2 = target - p, p * (1 - p)
        return df.agg(*[F.coalesce(F.sum(x), F.lit(0.0)) for x in (loss, m * d1, d1, m * m * d2, d2, m * d2)]).first()

    return _newton(sums, counts.pos, counts.neg, steps)


def _targets(pos: int, neg: int) -> tuple[float, float]:
    """The labels, drawn in a little from 1 and 0 by the class counts, so that separable classes have a finite sigmoid too."""
    return (pos + 1.0) / (pos + 2.0), 1.0 / (neg + 2.0)


def _newton(sums: Callable[[float, float], Sequence[float]], pos: int, neg: int, steps: int = 100) -> Sigmoid:
    """Newton steps with halving; ``sums`` has the loss, its gradient and second derivatives (aa, bb, ab) at a and b."""
    a, b = 0.0, math.log((neg + 1.0) / (pos + 1.0))
    loss, ga, gb, haa, hbb, hab = sums(a, b)
    for _ in range(steps):
        if abs(ga) < 1e-5 and abs(gb) < 1e-5:
            break
        haa, hbb = haa + 1e-12, hbb + 1e-12
        det = haa * hbb - hab ** 2
        da, db = -(hbb * ga - hab * gb) / det, -(haa * gb - hab * ga) / det
        slope, step = ga * da + gb * db, 1.0
        while step >= 1e-10:
            new = sums(a + step * da, b + step * db)
            if new[0] < loss + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        a, b = a + step * da, b + step * db
        loss, ga, gb, haa, hbb, hab = new
    return Sigmoid(a, b)


@dataclass
class Block:
    """Some rows: features as given, labels as -1 and 1, weights, folds."""

    given: np.ndarray
    y: np.ndarray
    weight: np.ndarray
    fold: np.ndarray
    fourier: Fourier | None = None

    @cached_property
    def x(self) -> np.ndarray:
        """The features of the machine; they last as long as a pass has the block."""
        return self.fourier.project(self.given) if self.fourier else self.given


def _blocks(df: DataFrame, fourier: Fourier | None, tasks: int) -> RDD:
    """The rows as blocks of up to ``BLOCK_ROWS``, kept by the executors; the kernel's features are not in them."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                own = batch.slice(start, BLOCK_ROWS)
                x = own.column(0).flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, -1)
                y, weight, fold = (own.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
                parts = [np.ascontiguousarray(v) for v in (x, np.where(y == 1, 1.0, -1.0), weight, fold)]
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in parts], names=["x", "y", "weight", "fold"])

    def block(row) -> Block:
        y, weight, fold = np.frombuffer(row.y), np.frombuffer(row.weight), np.frombuffer(row.fold, np.int64)
        return Block(np.frombuffer(row.x).reshape(len(y), -1), y, weight, fold, fourier)

    few = df.select(vector_to_array(FEATURES), LABEL, F.col(WEIGHT).cast("double"), F.col(FOLD).cast("long")).coalesce(tasks)
    return few.mapInArrow(pack, "x binary, y binary, weight binary, fold binary").rdd.map(block).persist(StorageLevel.MEMORY_AND_DISK)


def _total(blocks: RDD, part: Callable[[Block], tuple]) -> list[np.ndarray]:
    """Sums of the arrays that ``part`` makes of each block: one job; a task passes on one set."""
    def work(own: Iterator[Block]) -> Iterator[list[np.ndarray]]:
        found = None
        for b in own:
            more = part(b)
            found = more if found is None else [x + y for x, y in zip(found, more)]
        return iter([found] if found is not None else [])

    return [sum(x) for x in zip(*blocks.mapPartitions(work).collect())]


Search = Generator[list[np.ndarray], list[tuple[float, np.ndarray]], np.ndarray]


def _direction(grad: np.ndarray, moves: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Down the gradient by the inverse curvature of the last moves, newest first; no entry goes up its own gradient."""
    out, kept = grad.copy(), []
    for step, change in moves:
        kept.append(step @ out / (step @ change))
        out -= kept[-1] * change
    if moves:
        out *= moves[0][0] @ moves[0][1] / (moves[0][1] @ moves[0][1])
    for (step, change), k in zip(reversed(moves), reversed(kept)):
        out += (k - change @ out / (step @ change)) * step
    return np.where(-out * grad < 0, -out, 0.0)


def search(start: np.ndarray, iterations: int, tolerance: float, memory: int = 10) -> Search:
    """A quasi-Newton search of limited memory; objective, number of steps and stopping rules are those of MLlib's LinearSVC.

    A generator: it yields points, is sent the value and the gradient at each, and returns the
    best point found; so several searches share the passes over the rows. With a step of a line
    search it asks for those that may come next, as a point more costs less than a pass.
    """
    x, moves, values, failed = start, [], [math.inf], False
    (value, grad), = yield [x]
    first = value
    for turn in range(iterations):
        if np.linalg.norm(grad) <= max(tolerance * value, 1e-8) or len(values) >= 2 and abs(value - max(values)) <= tolerance * first:
            break
        while True:  # a failed line search forgets the moves and is tried once more
            to = _direction(grad, moves)
            slope, side = to @ grad, np.where(x != 0, np.sign(x), np.sign(-grad))
            step, shrink, found = (0.5 / np.linalg.norm(grad) if turn == 0 else 1.0), 0.1 if turn == 0 else 0.5, None
            seen: dict[float, tuple[np.ndarray, float, np.ndarray]] = {}
            for _ in range(21 if slope < 0 else 0):
                if step not in seen:
                    ahead = [step, step * shrink, step * shrink * shrink, step * 2.1]
                    points = [np.where(np.sign(v) == side, v, 0.0) for v in (x + a * to for a in ahead)]  # an entry stops at 0 before it changes sign
                    seen |= {a: (v, *r) for a, v, r in zip(ahead, points, (yield points))}
                at, new, new_grad = seen[step]
                if new > value + 1e-4 * step * slope or new_grad @ to > -0.9 * slope:
                    step *= shrink
                elif new_grad @ to < 0.9 * slope:
                    step *= 2.1
                else:
                    found = at, new, new_grad
                    break
                if not 1e-10 <= step <= 1e10:
                    break
            if found or failed:
                break
            failed, moves = True, []
        if not found:
            break
        failed = False
        moves = [(found[0] - x, found[2] - grad), *moves][:memory]
        if moves[0][0] @ moves[0][1] <= 0:
            moves = []
        x, value, grad = found
        values = [*values, value][-20:]
    return x


@dataclass
class Machine:
    """A hyperplane: margins are x @ coefficients + intercept."""

    coefficients: np.ndarray
    intercept: float


def fit_machines(blocks: RDD, held_out: Sequence[int | None], penalty: float, iterations: int = 100, tolerance: float = 1e-6) -> list[Machine]:
    """A machine for each fold left out (None: no fold), all searched in the same passes over the rows.

    The least mean hinge loss by weight plus half the penalty times the squared coefficients;
    features are centred and scaled for the search only. A pass is one job, and evaluates the
    points that each search asks for.
    """
    def weights(b: Block, machines: Sequence[int]) -> np.ndarray:
        return np.stack([np.where(b.fold != held_out[k], b.weight, 0.0) if held_out[k] is not None else b.weight for k in machines], axis=1)

    every = range(len(held_out))
    total, squares, sums = _total(blocks, lambda b: ((w := weights(b, every)).sum(axis=0), (w * w).sum(axis=0), w.T @ b.x))
    mean = sums / total[:, None]
    spread, = _total(blocks, lambda b: (np.stack([w @ (b.x - m) ** 2 for w, m in zip(weights(b, every).T, mean)]),))
    std = np.sqrt(spread / np.maximum(total - squares / total, 1e-300)[:, None])
    scale = np.divide(1.0, std, out=np.zeros_like(std), where=std > 0)

    def plane(k: int, at: np.ndarray) -> tuple[np.ndarray, float]:
        coefficients = at[:-1] * scale[k]
        return coefficients, at[-1] - coefficients @ mean[k]

    searches = [search(np.zeros(sums.shape[1] + 1), iterations, tolerance) for _ in every]
    wanted = {k: next(s) for k, s in enumerate(searches)}
    done: dict[int, Machine] = {}
    while wanted:
        machines = [k for k, points in wanted.items() for _ in points]
        planes = [plane(k, at) for k, points in wanted.items() for at in points]
        coefficients, intercepts = np.stack([c for c, _ in planes], axis=1), np.array([b for _, b in planes])

        def part(b: Block) -> tuple:
            gap = 1 - b.y[:, None] * (b.x @ coefficients + intercepts)
            inside = np.where(gap > 0, weights(b, machines), 0.0)  # noqa: B023
            push = -b.y[:, None] * inside
            return (inside * gap).sum(axis=0), push.sum(axis=0), push.T @ b.x

        results: dict[int, list] = {k: [] for k in wanted}
        for k, (c, _), loss, push, pull in zip(machines, planes, *_total(blocks, part)):
            grad = scale[k] * ((pull - push * mean[k]) / total[k] + penalty * c)
            results[k].append((loss / total[k] + penalty / 2 * (c @ c), np.append(grad, push / total[k])))
        for k, found in results.items():
            try:
                wanted[k] = searches[k].send(found)
            except StopIteration as end:
                done[k] = Machine(*plane(k, end.value))
                del wanted[k]
    return [done[k] for k in every]


@dataclass
class SVMModel:
    """A fitted machine; transform adds the vector ``probability``."""

    machine: Machine
    fourier: Fourier | None
    sigmoid: Sigmoid

    def margins(self, df: DataFrame) -> DataFrame:
        machine, fourier = self.machine, self.fourier

        @F.pandas_udf("double")
        def margin(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=float)
            cut = [np.stack(x.to_numpy()[at:at + BLOCK_ROWS]) for at in range(0, len(x), BLOCK_ROWS)]
            return pd.Series(np.concatenate([(fourier.project(rows) if fourier else rows) @ machine.coefficients + machine.intercept for rows in cut]))

        return df.withColumn(MARGIN, margin(vector_to_array(FEATURES)))

    def transform(self, df: DataFrame) -> DataFrame:
        p = self.sigmoid.column(F.col(MARGIN))
        return self.margins(df).withColumn("probability", array_to_vector(F.array(1 - p, p))).drop(MARGIN)


@dataclass
class CalibratedSVM:
    """Estimator: a linear machine on the features, or for the kernel rbf on ``components`` cosines of them.

    The rows have fold numbers; the sigmoid is fitted to margins of each fold from the machine
    fitted without it. With a single fold there are no unseen margins, so its own are taken.
    """

    penalty: float
    kernel: str = "linear"
    seed: int = 33
    components: int = 256
    iterations: int = 100

    def fit(self, df: DataFrame) -> SVMModel:
        if self.kernel not in ("linear", "rbf"):
            raise ValueError(f"unknown kernel {self.kernel!r}; known: linear, rbf")
        fourier = Fourier(scale_gamma(df), self.components, self.seed) if self.kernel == "rbf" else None
        y, size = F.col(LABEL) == 1, F.size(vector_to_array(FEATURES))
        counts = df.groupBy(F.col(FOLD).cast("long").alias(FOLD)).agg(
            F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"), F.max(size).alias("width")).collect()
        pos, neg, width = sum(r.pos for r in counts), sum(r.neg for r in counts), self.components if fourier else max(r.width for r in counts)
        folds = sorted(r[FOLD] for r in counts)
        held_out = [*folds, None] if len(folds) > 1 else [None]
        blocks = _blocks(df, fourier, max(1, (pos + neg) * width // CELLS_A_TASK))
        machines = fit_machines(blocks, held_out, self.penalty, self.iterations)
        by_fold = dict(zip(folds, machines))  # a single fold has the machine of all rows

        def unseen(b: Block) -> tuple[np.ndarray, np.ndarray]:
            margin = np.empty(len(b.y))
            for f in np.unique(b.fold).tolist():
                own = b.fold == f
                margin[own] = b.x[own] @ by_fold[f].coefficients + by_fold[f].intercept
            return margin, b.y

        margins = blocks.map(unseen).persist(StorageLevel.MEMORY_AND_DISK)
        high, low = _targets(pos, neg)

        def sums(a: float, b: float) -> list:
            def part(own: tuple[np.ndarray, np.ndarray]) -> tuple:
                m, t = own[0], np.where(own[1] > 0, high, low)
                z = a * m + b
                e = np.exp(-np.abs(z))
                p = np.where(z >= 0, e, 1.0) / (1 + e)
                loss = np.where(z >= 0, t * z, (t - 1) * z) + np.log1p(e)
                d1, d2 = t - p, p * (1 - p)
                return tuple(v.sum() for v in (loss, m * d1, d1, m * m * d2, d2, m * d2))

            return _total(margins, part)

        sigmoid = _newton(sums, pos, neg)
        margins.unpersist()
        blocks.unpersist()
        return SVMModel(machines[-1], fourier, sigmoid)
