"""Second-order gradient boosting over binned features, several models in one pass.

Numbers are cut into bins once, missing cells have a bin of their own. A tree grows level
by level: each task sums gradients and hessians by model, node, feature and bin, the sums
are grouped, and the split of a node is the one of largest gain, with missing values sent
to the side that gains more. Models that differ in parameters or in the fold they leave out
are grown in the same passes. Each row keeps the margins of its models in a table that is
written anew after some rounds, so a pass walks only the trees since.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.sources.shared import stored

_MISSING = 0
CELLS_AT_ONCE = 4_000_000  # sums that a pass may bring to the driver, which adds up those of all tasks itself if there are no more
MARGINS_A_TASK = 50_000  # rows times models; fewer are not worth a task of their own


@dataclass(frozen=True)
class Boosting:
    """Parameters; a leaf has ``least_hessian`` and ``least_rows`` at least, a split gains more than ``least_gain``."""

    rounds: int = 100
    depth: int = 3
    rate: float = 0.1
    l2: float = 1.0
    least_hessian: float = 1.0
    least_rows: int = 1
    least_gain: float = 0.0


@dataclass(frozen=True)
class Task:
    """One model to fit: its parameters, the fold it leaves out, and the weights of both classes."""

    params: Boosting
    held_out: int | None = None
    weights: tuple[float, float] = (1.0, 1.0)


@dataclass
class Tree:
    """A binary tree in heap order from 1; a node with feature -1 is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 1 << depth + 1
        return cls(np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n), np.zeros(n))

    def _ends(self, codes: np.ndarray, of: np.ndarray) -> np.ndarray:
        """The entry in ``of`` of the node that each row of codes ends in; each split is one comparison of whole columns."""
        def below(node: int) -> np.ndarray:
            if self.feature[node] < 0:
                return of[node]
            code, cut = codes[:, self.feature[node]], np.uint16(self.cut[node])
            # 0, for missing, is below all cuts; one less than it is above all
            left = code <= cut if self.missing_left[node] else code - np.uint16(1) < cut
            return np.where(left, below(2 * node), below(2 * node + 1))

        found = below(1)
        return found if np.ndim(found) else np.full(len(codes), found)

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        """The node that each row of codes ends in."""
        return self._ends(codes, np.arange(len(self.feature), dtype=np.int32))

    def margins(self, codes: np.ndarray) -> np.ndarray:
        return self._ends(codes, self.value)


@dataclass
class Binning:
    """Features in order: numbers with the upper edges of their bins, then one 0/1 feature a category."""

    numeric: tuple[str, ...]
    edges: list[np.ndarray]
    categories: list[tuple[str, str]] = field(default_factory=list)

    @property
    def names(self) -> list[str]:
        return [f"num__{c}" for c in self.numeric] + [f"cat__{c}_{v}" for c, v in self.categories]

    @property
    def width(self) -> int:
        return 2 + max([1, *(len(e) for e in self.edges)])

    @property
    def columns(self) -> list[str]:
        return [*self.numeric, *dict.fromkeys(c for c, _ in self.categories)]

    def codes(self, batch: pa.RecordBatch) -> np.ndarray:
        """uint16 codes of the rows of a batch: 0 for missing, then the number of the bin."""
        out = np.zeros((batch.num_rows, len(self.names)), np.uint16, order="F")
        for k, (c, edges) in enumerate(zip(self.numeric, self.edges)):
            value = batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)
            out[:, k] = np.where(np.isnan(value), _MISSING, np.searchsorted(edges, value, side="left") + 1)
        for k, (c, v) in enumerate(self.categories, len(self.numeric)):
            cells = batch.column(c).to_pylist()
            out[:, k] = [1 + (x == v) for x in cells]
        return out


def plan_bins(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), bins: int = 255) -> Binning:
    """Bin edges at quantiles of each number (null and NaN left out), and the categories of each text column.

    One aggregate finds all edges and one all categories; the categories of a model are few,
    as each is a feature of its own.
    """
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    shares = [(i + 1) / bins for i in range(bins - 1)]
    found = df.agg(*[F.percentile_approx(number(c), shares, 100_000).alias(f"e{i}") for i, c in enumerate(numeric)]).first() if numeric else ()
    edges = [np.unique(np.array(e or [], np.float64)) for e in found]
    categories = []
    if categorical:
        cells = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in categorical])))
        order = {c: i for i, c in enumerate(categorical)}
        rows = cells.filter("v IS NOT NULL").distinct().collect()
        categories = sorted(((r.c, r.v) for r in rows), key=lambda x: (order[x[0]], x[1]))
    return Binning(tuple(numeric), edges, categories)


@dataclass
class Boosted:
    """A fitted model: base margin and trees, of which any first ones are a model too."""

    binning: Binning
    params: Boosting
    base: float
    trees: list[Tree]

    def importances(self) -> np.ndarray:
        """Share of each feature in the gain of all splits."""
        total = np.zeros(len(self.binning.names))
        for t in self.trees:
            used = t.feature >= 0
            np.add.at(total, t.feature[used], t.gain[used])
        return total / total.sum() if total.sum() else total

    def staged(self, codes: np.ndarray, prefixes: Sequence[int]) -> np.ndarray:
        """Probabilities of the positive class by the first trees, a column for each prefix."""
        margin, out = np.full(len(codes), self.base), np.empty((len(codes), len(prefixes)))
        for i in range(max(prefixes) + 1):
            for k, prefix in enumerate(prefixes):
                if prefix == i:
                    out[:, k] = 1 / (1 + np.exp(-margin))
            if i < len(self.trees):
                margin += self.trees[i].margins(codes)
        return out

    def score(self, df: DataFrame, prefixes: Sequence[int] | None = None, out: str = "score") -> DataFrame:
        """``df`` with the probability of the positive class; with ``prefixes`` an array of one for each."""
        model, wanted = self, list(prefixes or [self.params.rounds])
        inputs = self.binning.columns

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = model.staged(model.binning.codes(batch), wanted)
                scores = pa.array(list(found), pa.list_(pa.float64())) if prefixes else pa.array(found[:, 0])
                yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, out])

        schema = ", ".join(f"`{c}` {kind}" for c, kind in df.dtypes) + f", `{out}` " + ("array<double>" if prefixes else "double")
        assert set(inputs) <= set(df.columns)
        return df.mapInArrow(work, schema)


def score_folds(df: DataFrame, fold: str, models: dict[int, Sequence[Boosted]], prefixes: Sequence[int], out: str = "scores") -> DataFrame:
    """``df`` with the scores of each row by the models of its fold: for each model one for each prefix, in that order."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column(fold).to_numpy(zero_copy_only=False)
            scores: list = [None] * batch.num_rows
            for f, own in models.items():
                rows = np.flatnonzero(of == f)
                if len(rows):
                    part = batch.take(pa.array(rows))
                    found = np.concatenate([m.staged(m.binning.codes(part), prefixes) for m in own], axis=1)
                    for i, s in zip(rows.tolist(), found):
                        scores[i] = s
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.list_(pa.float64()))], names=[*batch.schema.names, out])

    return df.mapInArrow(work, ", ".join(f"`{c}` {kind}" for c, kind in df.dtypes) + f", `{out}` array<double>")


def _state(df: DataFrame, binning: Binning, label: str, fold: str | None, bases: list[float], n: int) -> DataFrame:
    """codes, y, fold and the margins of all models of the ``n`` rows."""
    spread = min(df.sparkSession.sparkContext.defaultParallelism, n * len(bases) // MARGINS_A_TASK)  # every pass is a job over them
    rows = df.repartition(max(1, spread)).select(*binning.columns, F.col(label).cast("double").alias("__y"), (F.col(fold).cast("int") if fold else F.lit(-1)).alias("__fold"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = binning.codes(batch)
            margins = pa.array([bases] * batch.num_rows, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in codes], pa.binary()), batch.column("__y"), batch.column("__fold"), margins],
                                             names=["codes", "y", "fold", "margins"])

    return stored(rows.mapInArrow(work, "codes binary, y double, fold int, margins array<double>"))


def _unpacked(batch: pa.RecordBatch, features: int, new: list[list[Tree]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """codes, y, fold, and margins (a row a model) with the trees since they were written."""
    n = batch.num_rows
    codes = np.asfortranarray(np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint16).reshape(n, features))
    margins = np.array(batch.column("margins").flatten().to_numpy(zero_copy_only=False).reshape(n, len(new)).T, order="C")
    for m, trees in enumerate(new):
        for t in trees:
            margins[m] += t.margins(codes)
    return codes, batch.column("y").to_numpy(), batch.column("fold").to_numpy(zero_copy_only=False), margins


def _sums(state: DataFrame, tasks: list[Task], new: list[list[Tree]], growing: list[Tree], level: int, features: int, width: int, few: bool) -> np.ndarray:
    """Gradient, hessian and rows of each (model, node of the level, feature, bin)."""
    nodes = 1 << level
    shape = (len(tasks), nodes, features, width)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, *shape))
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, y, fold, margins = _unpacked(batch, features, new)
            for m, t in enumerate(tasks):
                node = growing[m].leaves(codes) - nodes
                use = np.flatnonzero((node >= 0) & (fold != (-2 if t.held_out is None else t.held_out)))
                p = 1 / (1 + np.exp(-margins[m, use]))
                w = np.where(y[use] == 1, t.weights[1], t.weights[0])
                g, h, at = w * (p - y[use]), w * p * (1 - p), node[use] * width
                for f in range(features):
                    cell = at + codes[use, f]
                    for k, x in enumerate((g, h, None)):
                        total[k, m, :, f] += np.bincount(cell, weights=x, minlength=nodes * width).reshape(nodes, width)
        flat = total.reshape(3, -1)
        cell = np.flatnonzero(flat[2])
        yield pa.RecordBatch.from_pydict({"cell": cell, "g": flat[0, cell], "h": flat[1, cell], "n": flat[2, cell]})

    sums = state.mapInArrow(work, "cell long, g double, h double, n double")
    if not few:
        sums = sums.groupBy("cell").agg(*[F.sum(c).alias(c) for c in "ghn"])
    found = sums.toArrow()
    out = np.zeros((3, int(np.prod(shape))))
    for k, c in enumerate("ghn"):
        np.add.at(out[k], found["cell"].to_numpy(), found[c].to_numpy())
    return out.reshape(3, *shape)


def best_split(sums: np.ndarray, p: Boosting) -> tuple[float, int, int, bool, tuple[float, float]] | None:
    """(gain, feature, last bin to the left, missing left, gradient and hessian on the left) of a node's sums (3, feature, bin); None without gain."""
    g, h, n = sums
    total = [x[0].sum() for x in (g, h, n)]
    value = lambda g, h: g * g / (h + p.l2 + 1e-300)
    tried = []
    for left_too in (True, False):
        left = [np.cumsum(x[:, 1:], axis=1) + (x[:, :1] if left_too else 0) for x in (g, h, n)]
        right = [t - x for t, x in zip(total, left)]
        allowed = (left[2] >= max(p.least_rows, 1)) & (right[2] >= max(p.least_rows, 1)) & (left[1] >= p.least_hessian) & (right[1] >= p.least_hessian)
        gain = np.where(allowed, (value(left[0], left[1]) + value(right[0], right[1]) - value(total[0], total[1])) / 2, -np.inf)
        at = int(np.argmax(gain))
        f, b = divmod(at, gain.shape[1])
        tried.append((float(gain[f, b]), f, b + 1, left_too, (float(left[0][f, b]), float(left[1][f, b]))))
    best = max(tried, key=lambda t: t[0])  # missing goes left if both sides gain the same
    return best if best[0] > max(p.least_gain, 1e-12) else None


def _grow(tree: Tree, level: int, sums: np.ndarray, p: Boosting) -> bool:
    """Split the nodes of a level (sums: 3, node, feature, bin) and set the values of new leaves; whether any was split."""
    leaf = lambda g, h: -p.rate * g / (h + p.l2 + 1e-300)
    split = False
    for i in range(1 << level):
        node, mine = (1 << level) + i, sums[:, i]
        if not mine[2, 0].sum():
            continue
        g, h = mine[0, 0].sum(), mine[1, 0].sum()
        if level == 0:
            tree.value[node] = leaf(g, h)
        found = best_split(mine, p)
        if found:
            tree.gain[node], tree.feature[node], tree.cut[node], tree.missing_left[node], (gl, hl) = found
            tree.value[2 * node], tree.value[2 * node + 1] = leaf(gl, hl), leaf(g - gl, h - hl)
            split = True
    return split


def fit_boosted(df: DataFrame, binning: Binning, label: str, tasks: Sequence[Task], fold: str | None = None, stored_rounds: int = 20) -> list[Boosted]:
    """A model for each task; a row counts for those that do not leave its fold out.

    Tasks with equal depth grow together, as many as CELLS_AT_ONCE sums allow. The label is 0
    or 1; a model without rows or with one class has no splits. The margins start at the
    log-odds of the weighted classes.
    """
    counts: dict[int, list[int]] = {}
    keys = [F.col(fold).cast("int").alias("f") if fold else F.lit(-1).alias("f"), F.col(label).cast("int").alias("y")]
    for r in df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(r.f, [0, 0])[r.y] = r.n
    bases = []
    for t in tasks:
        neg, pos = (t.weights[y] * sum(c[y] for f, c in counts.items() if f != t.held_out) for y in (0, 1))
        bases.append(math.log(max(pos, 1e-6) / max(neg, 1e-6)) if pos or neg else 0.0)
    out: list[Boosted | None] = [None] * len(tasks)
    features, width = len(binning.names), binning.width
    for depth in sorted({t.params.depth for t in tasks}):
        alike = [i for i, t in enumerate(tasks) if t.params.depth == depth]
        most = max(1, CELLS_AT_ONCE // ((1 << depth) * features * width))
        for at in range(0, len(alike), most):
            chosen = alike[at:at + most]
            state = _state(df, binning, label, fold, [bases[i] for i in chosen], sum(map(sum, counts.values())))
            trees = _fit_together(state, [tasks[i] for i in chosen], features, width, stored_rounds)
            for i, own in zip(chosen, trees):
                out[i] = Boosted(binning, tasks[i].params, bases[i], own)
    return out


def _fit_together(state: DataFrame, tasks: list[Task], features: int, width: int, stored_rounds: int) -> list[list[Tree]]:
    depth = tasks[0].params.depth
    few = state.rdd.getNumPartitions() * (len(tasks) << depth - 1) * features * width <= CELLS_AT_ONCE
    done: list[list[Tree]] = [[] for _ in tasks]
    new: list[list[Tree]] = [[] for _ in tasks]
    for turn in range(max(t.params.rounds for t in tasks)):
        growing = [Tree.empty(depth) for _ in tasks]
        for level in range(depth):
            sums = _sums(state, tasks, new, growing, level, features, width, few)
            if not any([_grow(tree, level, sums[:, m], t.params) for m, (tree, t) in enumerate(zip(growing, tasks))]):
                break
        for m, (tree, t) in enumerate(zip(growing, tasks)):
            if turn < t.params.rounds:
                new[m].append(tree)
        if turn % stored_rounds == stored_rounds - 1:
            state = _with_margins(state, features, new)
            done = [a + b for a, b in zip(done, new)]
            new = [[] for _ in tasks]
    return [a + b for a, b in zip(done, new)]


def _with_margins(state: DataFrame, features: int, new: list[list[Tree]]) -> DataFrame:
    """The state with the margins after the new trees, written."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                margins = _unpacked(batch, features, new)[3]
                yield pa.RecordBatch.from_arrays([batch.column("codes"), batch.column("y"), batch.column("fold"),
                                                  pa.array(list(margins.T), pa.list_(pa.float64()))], names=["codes", "y", "fold", "margins"])

    return stored(state.mapInArrow(work, "codes binary, y double, fold int, margins array<double>"))
