"""Gradient boosting for losses MLlib has no trees for: softmax over classes, pinball loss at several levels.

All outputs (classes, levels) share one table of binned rows.  A round grows one tree per output, all of them level
by level: a pass over the table adds up, in every task, gradients, curvatures and rows per output, node, feature and
bin, and Spark adds up the tasks.  What reaches the driver is bounded by outputs x 2^depth x features x bins, whatever
the rows.  Sums are whole numbers (gradients in units of 2^-24), so a recomputed task or another partitioning gives
the same trees.  Margins are rewritten to the shared folder every few rounds; in between a task adds the trees since.

Softmax leaves take a Newton step on the shared probabilities.  Pinball trees are fitted to the signs of the loss,
and a leaf's value is then the exact quantile of its residuals, found by ``exact_quantiles``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketrisk.functions.lineage import checkpointed
from marketrisk.functions.ordered import exact_quantiles
from marketrisk.heads.classifiers import CLASSES, FEATURES, LABEL, WEIGHT, Head
from marketrisk.heads.quantiles import LEVELS, level_name

UNIT = 2.0**24
#: Rounds between two rewritings of the margins.
REWRITE = 10
TRAIN, HELD_OUT = -1, -2


@dataclass(frozen=True)
class Settings:
    """Rounds and shape of the trees; ``patience`` rounds without a better held-out loss end the fit."""

    rounds: int = 100
    depth: int = 6
    rate: float = 0.05
    bins: int = 32
    least: int = 20
    ridge: float = 0.1
    patience: int = 50


@dataclass
class Tree:
    """Nodes by heap position, the root at 1; feature -1 marks a leaf; rows with bin <= cut go left."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        size = 2 ** (depth + 1)
        return Tree(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size), np.zeros(size))

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        node, rows = np.ones(len(bins), np.int64), np.arange(len(bins))
        for _ in range(len(self.feature).bit_length() - 2):
            feature = self.feature[node]
            right = bins[rows, np.maximum(feature, 0)] > self.cut[node]
            node = np.where(feature >= 0, 2 * node + right, node)
        return node


@dataclass(frozen=True)
class Loss:
    """Gradients and curvatures per output, and the loss of a row; ``levels`` ask for quantile leaves."""

    gradients: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    of_rows: Callable[[np.ndarray, np.ndarray], np.ndarray]
    levels: tuple[float, ...] = ()


def shares(margins: np.ndarray) -> np.ndarray:
    """Softmax of rows."""
    raised = np.exp(margins - margins.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def softmax_loss(classes: int) -> Loss:
    def gradients(y: np.ndarray, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = shares(margins)
        return p - (y[:, None] == np.arange(classes)), p * (1 - p)

    def of_rows(y: np.ndarray, margins: np.ndarray) -> np.ndarray:
        return -np.log(np.maximum(shares(margins)[np.arange(len(y)), y.astype(int)], 1e-15))

    return Loss(gradients, of_rows)


def pinball_loss(levels: Sequence[float]) -> Loss:
    q = np.array(levels)

    def gradients(y: np.ndarray, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (margins >= y[:, None]) - q, np.ones_like(margins)

    def of_rows(y: np.ndarray, margins: np.ndarray) -> np.ndarray:
        error = y[:, None] - margins
        return np.maximum(q * error, (q - 1) * error).sum(axis=1)

    return Loss(gradients, of_rows, tuple(levels))


@dataclass
class Ensemble:
    """Bin edges per feature, starting margins and, per round, one tree per output."""

    edges: list[np.ndarray]
    start: np.ndarray
    trees: list[list[Tree]] = field(default_factory=list)
    losses: list[tuple[float, float | None]] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Bin of every value: how many edges lie below it; values that are no numbers go last."""
        found = [np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)]
        return np.stack(found, axis=1).astype(np.uint8) if found else np.empty((len(x), 0), np.uint8)

    def added(self, bins: np.ndarray, first: int = 0) -> np.ndarray:
        """What the trees from round ``first`` on add to the margins."""
        total = np.zeros((len(bins), len(self.start)))
        for trees in self.trees[first:]:
            for k, tree in enumerate(trees):
                total[:, k] += tree.value[tree.leaves(bins)]
        return total

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.start + self.added(self.binned(x))

    def importances(self) -> list[float]:
        """Share of each feature in the gains of all splits."""
        gain = np.zeros(len(self.edges))
        for trees in self.trees:
            for tree in trees:
                inner = tree.feature >= 0
                np.add.at(gain, tree.feature[inner], tree.gain[inner])
        return (gain / gain.sum() if gain.sum() > 0 else gain).tolist()

    def nodes(self, spark: SparkSession) -> DataFrame:
        """One row per reachable node: round, output, node, feature and threshold (null in a leaf), value, gain."""
        rows = []
        for r, trees in enumerate(self.trees):
            for k, tree in enumerate(trees):
                reached = [1]
                for node in reached:
                    f = int(tree.feature[node])
                    inner = f >= 0
                    threshold = float(self.edges[f][tree.cut[node]]) if inner else None
                    value = None if inner else float(tree.value[node])
                    rows.append((r, k, node, f if inner else None, threshold, value, float(tree.gain[node])))
                    reached += [2 * node, 2 * node + 1] if inner else []
        schema = "round int, output int, node int, feature int, threshold double, value double, gain double"
        return spark.createDataFrame(rows, schema)


def _edges(vectors: DataFrame, bins: int) -> list[np.ndarray]:
    """Per feature the distinct values at its ``bins`` - 1 inner quantiles, from mergeable sketches."""
    levels = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    found = (
        vectors.select(F.posexplode("x").alias("feature", "value"))
        .groupBy("feature")
        .agg(F.array_sort(F.array_distinct(F.percentile_approx("value", levels, F.lit(10_000)))).alias("edges"))
        .collect()  # one row per feature
    )
    by_feature = {r["feature"]: np.array(r["edges"]) for r in found}
    return [by_feature[f] for f in range(len(by_feature))]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _binned_rows(batch: pa.RecordBatch, width: int) -> np.ndarray:
    blob = batch.column("bins")
    return np.frombuffer(b"".join(blob.to_pylist()), np.uint8).reshape(len(blob), width)


_TABLE = "bins binary, y double, w double, train boolean, m array<double>"


def _table(rows: DataFrame, model: Ensemble) -> DataFrame:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = model.binned(_matrix(batch.column("x"), len(model.edges)))
            m = pa.ListArray.from_arrays(
                pa.array(np.arange(len(bins) + 1) * len(model.start), pa.int32()),
                pa.array(np.tile(model.start, len(bins))),
            )
            blobs = pa.array([row.tobytes() for row in bins], pa.binary())
            columns = [blobs, batch.column("y"), batch.column("w"), batch.column("train"), m]
            yield pa.RecordBatch.from_arrays(columns, names=["bins", "y", "w", "train", "m"])

    return checkpointed(rows.mapInArrow(write, _TABLE))


def _rewritten(table: DataFrame, model: Ensemble, done: int) -> DataFrame:
    width, outputs = len(model.edges), len(model.start)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column("m"), outputs) + model.added(_binned_rows(batch, width), done)
            ends = pa.array(np.arange(len(m) + 1) * outputs, pa.int32())
            listed = pa.ListArray.from_arrays(ends, pa.array(m.ravel()))
            columns = [batch.column(c) for c in ("bins", "y", "w", "train")] + [listed]
            yield pa.RecordBatch.from_arrays(columns, names=["bins", "y", "w", "train", "m"])

    return checkpointed(table.mapInArrow(write, _TABLE))


def _level_sums(
    table: DataFrame, model: Ensemble, done: int, loss: Loss, growing: list[Tree], level: int, bins: int
) -> dict[str, np.ndarray]:
    """Sums by output, node of the level, feature and bin (keys from 0), and the losses (negative keys)."""
    width, outputs, nodes = len(model.edges), len(model.start), 2**level
    size = outputs * nodes * width * bins

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, size), np.int64)
        losses = {TRAIN: np.zeros(3, np.int64), HELD_OUT: np.zeros(3, np.int64)}
        for batch in batches:
            binned = _binned_rows(batch, width)
            y, w = batch.column("y").to_numpy(), batch.column("w").to_numpy()
            train = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
            m = _matrix(batch.column("m"), outputs) + model.added(binned, done)
            each = loss.of_rows(y, m) * w
            for key, some in ((TRAIN, train), (HELD_OUT, ~train)):
                losses[key] += np.array([np.rint(each[some] * UNIT).sum(), np.rint(w[some] * UNIT).sum(), some.sum()], np.int64)
            g, h = loss.gradients(y[train], m[train])
            g, h = np.rint(g * w[train, None] * UNIT), np.rint(h * w[train, None] * UNIT)
            binned = binned[train]
            for k, tree in enumerate(growing):
                node = tree.leaves(binned)
                active = node >= nodes
                place = ((k * nodes + node[active] - nodes)[:, None] * width + np.arange(width)) * bins + binned[active]
                place = place.ravel()
                for s, each_row in enumerate((g[active, k], h[active, k], None)):
                    weights = None if each_row is None else np.repeat(each_row, width)
                    sums[s] += np.bincount(place, weights, size).astype(np.int64)
        keys = np.flatnonzero(sums[2])
        found = np.concatenate([np.stack([losses[TRAIN], losses[HELD_OUT]], axis=1), sums[:, keys]], axis=1)
        columns = [pa.array(np.concatenate([[TRAIN, HELD_OUT], keys])), *[pa.array(x) for x in found]]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "g", "h", "n"])

    parts = table.mapInArrow(partial, "key long, g long, h long, n long")
    added = parts.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")]).toArrow()
    key = added["key"].to_numpy()
    found = {}
    for c in ("g", "h", "n"):
        values = added[c].to_numpy()
        dense = np.zeros(size, np.int64)
        dense[key[key >= 0]] = values[key >= 0]
        found[c] = dense.reshape(outputs, nodes, width, bins)
        found[f"loss_{c}"] = {int(k): int(v) for k, v in zip(key[key < 0], values[key < 0], strict=True)}
    return found


def _split(tree: Tree, sums: dict[str, np.ndarray], k: int, level: int, settings: Settings) -> bool:
    """Give the nodes of a level their best cuts; whether there was one."""
    nodes, ridge, any_split = 2**level, settings.ridge, False
    for slot in range(nodes):
        node = nodes + slot
        if sums["n"][k, slot].sum() == 0:
            continue
        g, h, n = (sums[c][k, slot].cumsum(axis=1) / (1 if c == "n" else UNIT) for c in ("g", "h", "n"))
        all_g, all_h, all_n = g[:, -1:], h[:, -1:], n[:, -1:]
        if level == 0:
            tree.value[node] = -all_g[0, 0] / (all_h[0, 0] + ridge) * settings.rate
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
        fine = (n >= settings.least) & (all_n - n >= settings.least) & np.isfinite(gain)
        gain = np.where(fine, gain, -np.inf)
        feature, cut = np.unravel_index(np.argmax(gain), gain.shape)
        if not gain[feature, cut] > 1e-9:
            continue
        tree.feature[node], tree.cut[node], tree.gain[node] = feature, cut, gain[feature, cut]
        left_g, left_h = g[feature, cut], h[feature, cut]
        tree.value[2 * node] = -left_g / (left_h + ridge) * settings.rate
        tree.value[2 * node + 1] = -(all_g[0, 0] - left_g) / (all_h[0, 0] - left_h + ridge) * settings.rate
        any_split = True
    return any_split


def _quantile_leaves(table: DataFrame, model: Ensemble, done: int, loss: Loss, trees: list[Tree], rate: float) -> None:
    """Set the leaves' values to the exact quantiles of their training residuals, times the rate."""
    width, outputs = len(model.edges), len(model.start)

    def residuals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            binned, y = _binned_rows(batch, width), batch.column("y").to_numpy()
            train = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
            m = _matrix(batch.column("m"), outputs) + model.added(binned, done)
            for k, tree in enumerate(trees):
                columns = [pa.array(np.full(train.sum(), k), pa.int32()), pa.array(tree.leaves(binned)[train])]
                left = pa.array((y - m[:, k])[train])
                columns += [left if j == k else pa.nulls(len(left), pa.float64()) for j in range(outputs)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["output", "leaf", *[f"r{k}" for k in range(outputs)]]
    schema = "output int, leaf long, " + ", ".join(f"r{k} double" for k in range(outputs))
    wanted = {f"v{k}": (f"r{k}", level) for k, level in enumerate(loss.levels)}
    found = exact_quantiles(table.mapInArrow(residuals, schema), ["output", "leaf"], wanted)
    for r in found.collect():  # one row per leaf
        trees[r["output"]].value[r["leaf"]] = r[f"v{r['output']}"] * rate


def _mean_loss(sums: dict[str, np.ndarray], key: int) -> float | None:
    weight = sums["loss_h"].get(key, 0)
    return sums["loss_g"][key] / weight if weight else None


def boosted(rows: DataFrame, loss: Loss, start: Sequence[float], settings: Settings) -> Ensemble:
    """The fitted trees; ``rows`` have x (array of doubles), y, w and train (false: held out to stop early)."""
    model = Ensemble(_edges(rows.filter("train"), settings.bins), np.array(start, float))
    table, done = _table(rows, model), 0
    best, since = None, 0
    for _ in range(settings.rounds):
        growing = [Tree.empty(settings.depth) for _ in start]
        for level in range(settings.depth):
            sums = _level_sums(table, model, done, loss, growing, level, settings.bins)
            if level == 0:
                model.losses.append((_mean_loss(sums, TRAIN), _mean_loss(sums, HELD_OUT)))
                held_out = model.losses[-1][1]
                if held_out is not None and (best is None or held_out < best[0]):
                    best, since = (held_out, len(model.trees)), 0
                else:
                    since += 1
            if not any([_split(tree, sums, k, level, settings) for k, tree in enumerate(growing)]):
                break
        if best is not None and since >= settings.patience:
            break
        if loss.levels:
            _quantile_leaves(table, model, done, loss, growing, settings.rate)
        model.trees.append(growing)
        if len(model.trees) - done >= REWRITE:
            table, done = _rewritten(table, model, done), len(model.trees)
    else:
        sums = _level_sums(table, model, done, loss, [], 0, settings.bins)
        model.losses.append((_mean_loss(sums, TRAIN), _mean_loss(sums, HELD_OUT)))
        held_out = model.losses[-1][1]
        if best is not None and held_out < best[0]:
            best = (held_out, len(model.trees))
    if best is not None:
        model.trees = model.trees[: best[1]]
    return model


def _rows(train: DataFrame, target: str, validation: str | None) -> DataFrame:
    weight = F.col(WEIGHT).cast("double") if WEIGHT in train.columns else F.lit(1.0)
    kept = ~F.col(validation) if validation else F.lit(True)
    return train.select(
        vector_to_array(FEATURES).alias("x"), F.col(target).cast("double").alias("y"), weight.alias("w"), kept.alias("train")
    )


def _margins(model: Ensemble, finish: Callable[[np.ndarray], np.ndarray]):
    @F.pandas_udf("array<double>")
    def scored(x: pd.Series) -> pd.Series:
        return pd.Series(list(finish(model.margins(np.stack(x.to_numpy()))))) if len(x) else pd.Series([], dtype=object)

    return scored


def softmax_boosting(
    train: DataFrame, settings: Settings = Settings(), validation: str | None = None, classes: int = CLASSES
) -> Head:
    """Trees of all classes grown round by round on shared softmax probabilities, with Newton leaves.

    Rows start from the weighted class shares.  ``validation`` names a boolean column; its rows are held out to
    stop early and to choose the best number of rounds.
    """
    rows = _rows(train, LABEL, validation)
    counted = {r["y"]: r["w"] for r in rows.filter("train").groupBy("y").agg(F.sum("w").alias("w")).collect()}
    total = sum(counted.values())
    start = [float(np.log(max(counted.get(float(k), 0.0) / total, 1e-9))) for k in range(classes)]
    model = boosted(rows, softmax_loss(classes), start, settings)
    scored = _margins(model, shares)

    def score(df: DataFrame) -> DataFrame:
        out = df.withColumn("_p", scored(vector_to_array(FEATURES)))
        return out.withColumns({f"p_{k}": F.get(F.col("_p"), k) for k in range(classes)}).drop("_p")

    return Head("softmax_boosting", score, model.importances(), (model,))


def boosted_quantiles(
    train: DataFrame,
    target: str,
    levels: Sequence[float] = LEVELS,
    settings: Settings = Settings(ridge=0.0),
    validation: str | None = None,
) -> tuple[Callable[[DataFrame], DataFrame], Ensemble]:
    """Trees of all levels on their pinball losses; rows start from the exact quantiles of the target.

    The function returned adds q05, q50, ... which may cross (see ``quantiles.monotone``).
    """
    rows = _rows(train, target, validation)
    wanted = {level_name(q): ("y", float(q)) for q in levels}
    first = exact_quantiles(rows.filter("train"), [], wanted).first()
    settings = replace(settings, ridge=max(settings.ridge, 1e-12))
    model = boosted(rows, pinball_loss(levels), [first[level_name(q)] for q in levels], settings)
    scored = _margins(model, lambda m: m)

    def predict(df: DataFrame) -> DataFrame:
        out = df.withColumn("_q", scored(vector_to_array(FEATURES)))
        return out.withColumns({level_name(q): F.get(F.col("_q"), k) for k, q in enumerate(levels)}).drop("_q")

    return predict, model
