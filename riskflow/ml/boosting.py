"""Histogram boosting: one byte a feature and row, gradient sums a (tree node, feature, bin), splits as sets of bins.

Columns are binned at quantiles once; bin 0 holds missing values. A split sends a set of bins, 64 bits, to the left: the
bins up to one for numbers, any set of categories for nominal features, whose bins each node orders by their
gradient. Trees grow level by level, the best splits first while leaves are left.

Rows up to LOCAL_ROWS lie whole in a task (a broadcast of known size), and models are spread over tasks. Up to SHARES
times as many a process, a task takes an executor's cores and its processes share the rows, which come from the written
table: a job a model, as many at once as the cores allow. Still more rows stay in the table, all models grow in lockstep,
every level is a Spark job that sums histograms, and margins are written every REFRESH rounds. Gradients are rounded to
a fixed grid, so their sums don't depend on the order: all ways grow the same trees.
"""

from __future__ import annotations

import json
import math
import pickle
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskflow.ml.team import Team, free_cores, teams_at_once, together, with_cores
from riskflow.session import shared_dir

BINS = 64
#: Rows that a task may hold whole: about 100 bytes each.
LOCAL_ROWS = 500_000
#: Rows that are worth a process of a task.
LEAST_SHARE = 20_000
#: A process that shares a task's rows may have so many times the rows that a task may hold whole: about 300 bytes each.
SHARES = 4
#: A row group of the tables of blocks. Readers and writers hold one, and 100 blocks at least if nobody says otherwise.
GROUP_BYTES = 16 << 20
#: Rounds after which margins of a large table are written anew.
REFRESH = 10
#: A model is sent to tasks in pieces of at most so many bytes.
MOST_PIECE_BYTES = 64 << 20
GRID = float(1 << 24)
#: Sums on the grid are exact below.
MOST_EXACT = float(1 << 53) / GRID
LEAST_HESSIAN = 1e-3
#: Cells of several features that rows are added up by at once.
JOINT_CELLS = (4096, 512)
#: Nodes whose splits are looked for at once, so that their sums stay in a core's cache.
SPLIT_NODES = 8
#: Added to the hessian when categories are ordered by gradient.
SMOOTHING = 10.0
NODES = "tree int, node int, feature int, bins long, left int, right int, value double, cover double, gain double"


@dataclass
class Tree:
    """Nodes in flat arrays; feature is -1 at a leaf. bins: the set that goes left."""

    feature: list[int] = field(default_factory=list)
    bins: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, value: float, cover: float) -> int:
        for column, v in zip((self.feature, self.bins, self.left, self.right, self.value, self.cover, self.gain), (-1, 0, -1, -1, value, cover, 0.0)):
            column.append(v)
        return len(self.feature) - 1

    def packed(self) -> tuple[np.ndarray, ...]:
        return (np.array(self.feature, np.int16), np.array(self.bins, np.uint64), np.array(self.left, np.int32),
                np.array(self.right, np.int32), np.array(self.value, float), np.array(self.cover, float))


def in_sets(bins: np.ndarray) -> np.ndarray:
    """Whether each bin (columns) is in each of the sets (rows)."""
    return np.unpackbits(bins.astype("<u8").view(np.uint8), bitorder="little").view(bool).reshape(-1, BINS)


def leaves_of(tree: tuple[np.ndarray, ...], codes: np.ndarray) -> np.ndarray:
    """The node that each row of codes ends in. A step looks up node and bin in a table, where leaves lead to themselves.

    No place that is looked up lies outside, so numpy need not look ("clip").
    """
    feature, bins, left, right = tree[:4]
    inner = feature >= 0
    after = np.where(in_sets(bins), left[:, None], right[:, None]).astype(np.intp)
    after[~inner] = np.flatnonzero(~inner)[:, None]
    after, column = after.ravel(), np.where(inner, feature, 0).astype(np.intp)
    at, flat, starts = np.zeros(len(codes), np.intp), np.ascontiguousarray(codes).ravel(), np.arange(len(codes)) * codes.shape[1]
    while inner.take(at, mode="clip").any():
        code = flat.take(starts + column.take(at, mode="clip"), mode="clip")
        at = after.take(at * BINS + code, mode="clip")
    return at


@dataclass
class Binning:
    """Borders of numeric features; nominal ones have none: their code + 1 is the bin."""

    names: list[str]
    nominal: list[bool]
    cuts: list[list[float]]

    def codes(self, x: np.ndarray) -> np.ndarray:
        """One byte a feature. Missing (NaN) is bin 0; a category beyond the last bin falls into it."""
        out = np.zeros(x.shape, np.uint8)
        for j, cuts in enumerate(self.cuts):
            v = x[:, j]
            known = ~np.isnan(v)
            if self.nominal[j]:
                out[known, j] = np.clip(v[known], 0, BINS - 2).astype(np.uint8) + 1
            else:
                out[known, j] = np.searchsorted(cuts, v[known], "left") + 1
        return out


def fit_bins(df: DataFrame, names: list[str], nominal: set[str], prefix: str = "x_") -> Binning:
    """Borders at quantiles, all features in one pass."""
    numeric = [n for n in names if n not in nominal]
    shares = [i / (BINS - 1) for i in range(1, BINS - 1)]
    clean = lambda n: F.nanvl(F.col(prefix + n).cast("double"), F.lit(None).cast("double"))
    row = df.agg(*[F.percentile_approx(clean(n), shares, 10_000).alias(n) for n in numeric]).first() if numeric else {}
    return Binning(list(names), [n in nominal for n in names], [[] if n in nominal else sorted(set(row[n] or [])) for n in names])


@dataclass
class Ensemble:
    """Trees with the binning of their inputs and the margin they start from."""

    binning: Binning
    base: float
    trees: list[Tree]

    def margins(self, codes: np.ndarray) -> np.ndarray:
        out = np.full(len(codes), self.base)
        for tree in self.packed():
            out += tree[4][leaves_of(tree, codes)]
        return out

    def packed(self) -> list[tuple[np.ndarray, ...]]:
        if not hasattr(self, "_packed"):
            self._packed = [t.packed() for t in self.trees]
        return self._packed

    def pieces(self, most: int = MOST_PIECE_BYTES) -> list[Ensemble]:
        """The trees in groups of at most `most` bytes, which are sent to tasks one by one; only the first has the base.

        They hold the arrays alone: lists of numbers take seven times the memory, in every Python worker.
        """
        groups: list[list[tuple[np.ndarray, ...]]] = [[]]
        size = 0
        for packed in self.packed():
            nbytes = sum(a.nbytes for a in packed)
            if groups[-1] and size + nbytes > most:
                groups.append([])
                size = 0
            groups[-1].append(packed)
            size += nbytes
        pieces = [Ensemble(self.binning, 0.0 if k else self.base, []) for k in range(len(groups))]
        for piece, group in zip(pieces, groups):
            piece._packed = group
        return pieces

    def importances(self) -> np.ndarray:
        """Share of the gain of all splits, by feature."""
        total = np.zeros(len(self.binning.names))
        for t in self.trees:
            for f, g in zip(t.feature, t.gain):
                if f >= 0:
                    total[f] += g
        return total / total.sum() if total.sum() else total

    def rows(self) -> Iterator[tuple]:
        for i, t in enumerate(self.trees):
            for k, node in enumerate(zip(t.feature, t.bins, t.left, t.right, t.value, t.cover, t.gain)):
                yield (i, k, node[0], node[1] - (1 << 64) if node[1] >> 63 else node[1], *node[2:])

    def save(self, spark: SparkSession, path: str) -> None:
        meta = {"names": self.binning.names, "nominal": self.binning.nominal, "cuts": self.binning.cuts, "base": self.base}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/binning")
        spark.createDataFrame(list(self.rows()), NODES).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Ensemble:
        meta = json.loads(spark.read.text(f"{path}/binning").first().value)
        trees: list[Tree] = []
        # As many rows as the model has nodes.
        for r in spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").collect():
            if r.tree == len(trees):
                trees.append(Tree())
            t = trees[-1]
            t.add(r.value, r.cover)
            t.feature[-1], t.bins[-1], t.left[-1], t.right[-1], t.gain[-1] = r.feature, r.bins % (1 << 64), r.left, r.right, r.gain
        return Ensemble(Binning(meta["names"], meta["nominal"], meta["cuts"]), meta["base"], trees)


def on_grid(v: np.ndarray) -> np.ndarray:
    return np.round(v * GRID) / GRID


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A uniform number in [0, 1) of each id and a salt."""
    x = x ^ np.uint64((salt * 0x9E3779B97F4A7C15) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x / 2.0**64


def features_of_round(params: dict, n: int, seed: int, number: int) -> np.ndarray:
    take = max(1, round(float(params["colsample_bytree"]) * n))
    return np.sort(np.random.default_rng([seed, number]).permutation(n)[:take])


@dataclass
class Block:
    """Some rows in memory, with the margins of every model."""

    codes: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    judging: np.ndarray
    ids: np.ndarray
    margins: np.ndarray  # models x rows

    def sample(self, params: dict, seed: int, number: int) -> np.ndarray:
        """Rows a round's tree is grown on."""
        rows = ~self.judging
        if params["subsample"] < 1:
            rows &= mixed(self.ids, seed * 1_000_003 + number) < params["subsample"]
        return np.flatnonzero(rows)

    def part(self, place: int, size: int) -> Block:
        """The rows of one of so many equal parts."""
        cut = slice(len(self.label) * place // size, len(self.label) * (place + 1) // size)
        return Block(self.codes[cut], self.label[cut], self.weight[cut], self.judging[cut], self.ids[cut], self.margins[:, cut].copy())

    def losses(self, model: int) -> tuple[float, float]:
        """(sum of weighted log loss, sum of weights) of the judging rows."""
        return log_loss(self.weight[self.judging], self.label[self.judging], self.margins[model, self.judging])

    def histogram(self, model: int, tree: Tree, frontier: list[int], features: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Sums of gradient, hessian and rows: frontier nodes x features x bins x 3."""
        codes = self.codes[rows]
        place = np.full(len(tree.feature), -1)
        place[frontier] = np.arange(len(frontier))
        place = place[leaves_of(tree.packed(), codes)]
        inside = place >= 0
        rows, codes, place = rows[inside], codes[inside], place[inside]
        p = 1 / (1 + np.exp(-self.margins[model, rows]))
        w = self.weight[rows]
        g, h = on_grid(w * (p - self.label[rows])), on_grid(w * p * (1 - p))
        out = np.zeros((len(frontier), len(features), BINS, 3))
        size = len(frontier) * BINS
        for j, f in enumerate(features):
            key = place * BINS + codes[:, f]
            for k, weights in enumerate((g, h, None)):
                out[:, j, :, k] = np.bincount(key, weights, minlength=size).reshape(-1, BINS)
        return out


def log_loss(weight: np.ndarray, label: np.ndarray, margins: np.ndarray) -> tuple[float, float]:
    loss = np.logaddexp(0, margins) - np.where(label, margins, 0)
    return float(on_grid(weight * loss).sum()), float(on_grid(weight).sum())


def _pull(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0)


def best_splits(hist: np.ndarray, features: np.ndarray, nominal: np.ndarray, params: dict) -> list[tuple | None]:
    """For every node (gain, feature, bins that go left, sums on the left, sums on the right), or None."""
    return [found for at in range(0, len(hist), SPLIT_NODES) for found in _best_splits(hist[at:at + SPLIT_NODES], features, nominal, params)]


def _best_splits(hist: np.ndarray, features: np.ndarray, nominal: np.ndarray, params: dict) -> list[tuple | None]:
    alpha, lam, least = params["reg_alpha"], params["reg_lambda"], params["min_child_samples"]
    order, sums = {}, np.moveaxis(hist, -1, 0).copy()  # each of the three in one piece
    for j in np.flatnonzero(nominal[features]):
        g, h, n = (hist[:, j, :, k] for k in range(3))
        order[j] = np.argsort(np.where(n > 0, g / (h + SMOOTHING), np.inf), axis=1, kind="stable")
        sums[:, :, j] = np.take_along_axis(sums[:, :, j], order[j][None], axis=2)
    np.cumsum(sums, axis=3, out=sums)
    whole = sums[..., -1:]
    rest = whole - sums

    def worth(s: np.ndarray) -> np.ndarray:
        top, under = np.abs(s[0]), s[1] + lam
        top -= alpha
        np.maximum(top, 0, out=top)
        np.square(top, out=top)
        under += 1e-12
        top /= under
        return top

    gain = worth(sums)
    gain += worth(rest)
    gain -= worth(whole)
    fits = (sums[2] >= max(least, 1)) & (rest[2] >= max(least, 1)) & (sums[1] >= LEAST_HESSIAN) & (rest[1] >= LEAST_HESSIAN)
    gain[~fits] = -np.inf
    gain = gain.reshape(len(hist), -1)
    found = []
    for node, at in enumerate(gain.argmax(axis=1)):
        j, k = divmod(int(at), BINS)
        if not gain[node, at] > 1e-9:
            found.append(None)
            continue
        bins = sum(1 << int(b) for b in order[j][node, :k + 1]) if j in order else (2 << k) - 1
        found.append((float(gain[node, at]), int(features[j]), bins, sums[:, node, j, k], rest[:, node, j, k]))
    return found


@dataclass
class Growing:
    """A model on its way: trees, losses by round, and the tree being grown with its open nodes."""

    params: dict
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    tree: Tree | None = None
    open: list[int] = field(default_factory=list)
    depth: int = 0
    done: bool = False

    def start(self) -> None:
        self.tree, self.open, self.depth = Tree(), [0], 0
        self.tree.add(0.0, 0.0)

    def value(self, sums: np.ndarray) -> float:
        g, h = float(sums[0]), float(sums[1])
        return float(-_pull(np.float64(g), self.params["reg_alpha"]) / (h + self.params["reg_lambda"] + 1e-12) * self.params["learning_rate"])

    def split(self, found: list[tuple | None], whole: np.ndarray) -> None:
        """Takes the best splits of a level's open nodes while leaves are left; their children are open next."""
        tree = self.tree
        if self.depth == 0:
            tree.value[0], tree.cover[0] = self.value(whole), float(whole[2])
        leaves = sum(f < 0 for f in tree.feature)
        ranked = sorted((s for s in zip(found, self.open) if s[0] is not None), key=lambda s: (-s[0][0], s[1]))
        children = []
        free = max(0, int(self.params["num_leaves"]) - leaves)
        for (gain, feature, bins, left, right), node in ranked[:free]:
            tree.feature[node], tree.bins[node], tree.gain[node] = feature, bins, gain
            tree.left[node], tree.right[node] = tree.add(self.value(left), float(left[2])), tree.add(self.value(right), float(right[2]))
            children += [tree.left[node], tree.right[node]]
        self.depth += 1
        # Without a leaf left no node is split further, so none is summed.
        self.open = children if self.depth < int(self.params["max_depth"]) and len(ranked) < free else []


def best_round(losses: list[float], patience: int) -> tuple[int, bool]:
    """(trees up to the smallest loss, whether `patience` rounds in a row then brought no smaller one); without
    losses, as of no judging rows, all trees."""
    best = 0
    for m, loss in enumerate(losses):
        if not np.isfinite(loss):
            return len(losses), False
        if loss < losses[best]:
            best = m
        elif m - best >= patience:
            return best + 1, True
    return best + 1, False


def grow(models: list[Growing], passes, rounds: int, patience: int, n_features: int, nominal: np.ndarray, seed: int) -> None:
    """Grows all models in lockstep, each to its end: at most `rounds` trees, kept up to the least loss."""
    for number in range(rounds):
        active = [k for k, m in enumerate(models) if not m.done]
        if not active:
            return
        features = {k: features_of_round(models[k].params, n_features, seed, number) for k in active}
        for k in active:
            models[k].start()
        while True:
            level = [k for k in active if models[k].open]
            if not level:
                break
            splits = passes.splits(models, level, features, number)
            for k in level:
                models[k].split(*splits[k])
        for k in active:
            models[k].trees.append(models[k].tree)
        for k, (loss, weight) in passes.finish(models, active).items():
            m = models[k]
            m.losses.append(loss / weight if weight else float("nan"))
            best, ended = best_round(m.losses, patience)
            m.done = ended or number + 1 == rounds
            if m.done:
                m.trees = m.trees[:best]


@dataclass
class _Round:
    """A model's round in a task: the rows its tree is grown on, by their place among them, and of each open node its
    rows and histogram."""

    number: int
    features: np.ndarray
    #: The rows the tree is grown on.
    rows: np.ndarray
    grads: tuple[np.ndarray, np.ndarray]
    #: By feature of the round: the bins of the grown rows.
    columns: dict[int, np.ndarray]
    #: Whether a parent less a child is the other child: not with gradients that are not finite (rows without a weight).
    exact: bool
    #: Of every node that was not split: places of the rows the tree is grown on, and all other rows.
    grown: dict[int, np.ndarray]
    others: dict[int, np.ndarray]
    hist: dict[int, np.ndarray] = field(default_factory=dict)
    #: By number of cells: groups of features with the cell of every grown row.
    joint: dict[int, list[tuple[list[int], np.ndarray]]] = field(default_factory=dict)


class InMemory:
    """The passes over rows that lie in a task.

    Rows follow their tree: a split parts its node's rows, so no row walks the tree. Of two children only the one with
    fewer rows is summed; the other is what is left of the parent, exactly, as sums on the grid are exact.

    The processes of a team have a part of the rows each. All of them grow the same tree: they add up their sums, and
    each looks for the best splits of its share of the nodes.
    """

    def __init__(self, block: Block, nominal: np.ndarray, seed: int, team: Team | None = None):
        self.block, self.nominal, self.seed, self.team = block, nominal, seed, team or Team()
        self.columns = [np.ascontiguousarray(column) for column in block.codes.T]
        self.sizes = [int(c.max(initial=0)) + 1 for c in self.columns]
        self.judging = np.flatnonzero(block.judging)
        self.judged = block.weight[self.judging], block.label[self.judging]
        self.rounds: dict[int, _Round] = {}
        #: Of every model: the least loss and the judging rows' margins then.
        self.least: dict[int, tuple[float, np.ndarray]] = {}

    def _started(self, model: int, params: dict, number: int, features: np.ndarray) -> _Round:
        block = self.block
        grown = block.sample(params, self.seed, number)
        left_out = np.ones(len(block.label), bool)
        left_out[grown] = False
        weight = block.weight.take(grown, mode="clip")
        p = 1 / (1 + np.exp(-block.margins[model].take(grown, mode="clip")))
        grads = on_grid(weight * (p - block.label.take(grown, mode="clip"))), on_grid(weight * p * (1 - p))
        exact = bool(self.team.sum(np.array([np.abs(grads[0]).sum() + grads[1].sum()]))[0] < MOST_EXACT)
        columns = {int(f): self.columns[f].take(grown, mode="clip") for f in features}
        return _Round(number, features, grown, grads, columns, exact, {0: np.arange(len(grown))}, {0: np.flatnonzero(left_out)})

    def _parted(self, now: _Round, tree: Tree) -> None:
        """Hands the rows of nodes that were split to their children."""
        for node in [n for n in now.others if tree.feature[n] >= 0]:
            f, bins = tree.feature[node], tree.bins[node]
            upto = bins.bit_length() - 1 if bins & (bins + 1) == 0 else None  # of a number
            for rows, column in ((now.grown, now.columns[f]), (now.others, self.columns[f])):
                mine = rows.pop(node)
                codes = column.take(mine, mode="clip")
                to_left = codes <= upto if upto is not None else in_sets(np.array([bins], np.uint64)).ravel().take(codes)
                rows[tree.left[node]], rows[tree.right[node]] = mine.compress(to_left), mine.compress(~to_left)

    def _joint(self, now: _Round, cells: int) -> list[tuple[list[int], np.ndarray]]:
        """The features in groups of at most so many cells together (one feature may have more), each with its rows' cells."""
        if cells not in now.joint:
            sized = [self.sizes[f] for f in now.features]
            groups: list[list[int]] = []
            sizes: list[int] = []
            for j in sorted(range(len(sized)), key=lambda j: -sized[j]):
                at = next((i for i, n in enumerate(sizes) if n * sized[j] <= cells), len(sizes))
                if at == len(sizes):
                    groups.append([])
                    sizes.append(1)
                groups[at].append(j)
                sizes[at] *= sized[j]
            found = []
            for group in groups:
                cell = now.columns[int(now.features[group[0]])]
                cell = cell.astype(np.uint16) if len(group) > 1 else cell
                for j in group[1:]:
                    cell *= np.uint16(sized[j])
                    cell += now.columns[int(now.features[j])]
                found.append((group, cell))
            now.joint[cells] = found
        return now.joint[cells]

    def _summed(self, now: _Round, nodes: list[int]) -> np.ndarray:
        """Sums of gradient, hessian and rows, over the team: nodes x features x bins x 3.

        Rows are added up by the cells of several features at once, and these along each of them, which is exact too;
        nodes with few rows take fewer cells.
        """
        lengths = [len(now.grown[n]) for n in nodes]
        # The first node has all rows in their order.
        rows = np.concatenate([now.grown[n] for n in nodes]) if nodes != [0] else None
        g, h = now.grads if rows is None else (now.grads[0].take(rows, mode="clip"), now.grads[1].take(rows, mode="clip"))
        out = np.zeros((3, len(nodes), len(now.features), BINS))  # each of the three in one piece
        cells = next((c for c in JOINT_CELLS if len(g) >= 4 * c * len(nodes)), BINS)
        first = np.repeat(np.arange(len(nodes)) * cells, lengths)
        for group, cell in self._joint(now, cells):
            sizes = [self.sizes[now.features[j]] for j in group]
            key = (cell if rows is None else cell.take(rows, mode="clip")).astype(np.intp)
            key += first
            for k, weights in enumerate((g, h, None)):
                sums = np.bincount(key, weights, minlength=len(nodes) * cells).reshape(len(nodes), cells)
                if len(group) == 1:
                    out[k, :, group[0], :sizes[0]] = sums[:, :sizes[0]]
                    continue
                sums = sums[:, :math.prod(sizes)].reshape(len(nodes), *sizes)
                for axis, j in enumerate(group):
                    others = tuple(a + 1 for a in range(len(group)) if a != axis)
                    out[k, :, j, :sizes[axis]] = sums.sum(axis=others)
        return np.moveaxis(self.team.sum(out), 0, -1)

    def _best(self, hist: np.ndarray, features: np.ndarray, params: dict) -> list[tuple | None]:
        size = self.team.size
        if size == 1 or len(hist) < size:
            return best_splits(hist, features, self.nominal, params)
        found: list[tuple | None] = [None] * len(hist)
        for place, theirs in enumerate(self.team.gather(best_splits(hist[self.team.place::size], features, self.nominal, params))):
            found[place::size] = theirs
        return found

    def splits(self, models, level, features, number):
        out = {}
        for k in level:
            m = models[k]
            now = self.rounds.get(k)
            if now is None or now.number != number:
                now = None  # of the round before
                self.rounds.pop(k, None)
                now = self.rounds[k] = self._started(k, m.params, number, features[k])
                hist = self._summed(now, m.open)
            elif not now.exact:
                self._parted(now, m.tree)
                hist = self._summed(now, m.open)
            else:
                self._parted(now, m.tree)
                pairs = [(m.open[i], m.open[i + 1]) for i in range(0, len(m.open), 2)]
                parents = {left: node for node, left in enumerate(m.tree.left) if left >= 0}
                fewer = [min(pair, key=lambda n: m.tree.cover[n]) for pair in pairs]
                hist = np.moveaxis(np.empty((3, len(m.open), len(features[k]), BINS)), 0, -1)
                for i, (pair, sums) in enumerate(zip(pairs, self._summed(now, fewer))):
                    at = 2 * i + pair.index(fewer[i])
                    hist[at], hist[at ^ 1] = sums, now.hist[parents[pair[0]]] - sums
            now.hist = dict(zip(m.open, hist))
            out[k] = self._best(hist, features[k], m.params), hist[0, 0].sum(axis=0)
        return out

    def finish(self, models, active):
        out = {}
        for k in active:
            tree, now = models[k].tree, self.rounds[k]
            self._parted(now, tree)
            gained = np.empty(len(now.rows))
            for node, mine in now.grown.items():
                gained[mine] = tree.value[node]
            self.block.margins[k, now.rows] += gained
            for node, mine in now.others.items():
                self.block.margins[k, mine] += tree.value[node]
            held = self.block.margins[k].take(self.judging, mode="clip")
            out[k] = loss, weight = tuple(self.team.sum(np.array(log_loss(*self.judged, held))).tolist())
            if weight and (k not in self.least or loss / weight < self.least[k][0]):
                self.least[k] = loss / weight, held
        return out

    def held_margins(self, k: int, model: Growing) -> np.ndarray:
        """The judging rows' margins with the trees that a grown model keeps, without another walk of its trees."""
        own = self.block.margins[k].take(self.judging) if len(model.trees) == len(model.losses) else self.least[k][1]
        return np.concatenate(self.team.gather(own)) if self.team.size > 1 else own


_STATE = "codes binary, label binary, weight binary, judging binary, ids binary, margins binary"


_KINDS = (np.uint8, np.bool_, np.float64, np.bool_, np.uint64, np.float64)


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The arrays of each row, as they lie in the batch."""
    for batch in batches:
        for row in zip(*batch.columns):
            yield [np.frombuffer(v.as_buffer(), t) for v, t in zip(row, _KINDS)]


def _blocks(batches: Iterator[pa.RecordBatch], width: int, models: int) -> Iterator[Block]:
    for codes, label, weight, judging, ids, margins in _arrays(batches):
        yield Block(codes.reshape(-1, width), label, weight, judging, ids, margins.reshape(models, -1).copy())


def _whole(batches: Iterator[pa.RecordBatch], width: int, total: int, base: float) -> Block:
    """All rows of the table as one block, whose codes lie by feature."""
    columns, flat = np.empty((width, total), np.uint8), [np.empty(total, t) for t in _KINDS[1:5]]
    at = 0
    for codes, *others in _arrays(batches):
        cut = slice(at, at + len(others[0]))
        columns[:, cut] = codes.reshape(-1, width).T
        for out, own in zip(flat, others):
            out[cut] = own
        at = cut.stop
    if at != total:
        raise RuntimeError(f"{at} rows of {total}")
    return Block(columns.T, *flat, np.broadcast_to(base, (1, total)))


def _stored(blocks: DataFrame, path: str) -> DataFrame:
    """The blocks as a table in groups of GROUP_BYTES, a block at least."""
    (blocks.write.option("parquet.block.size", GROUP_BYTES).option("parquet.block.size.row.check.min", 1)
     .option("parquet.page.size.row.check.min", 1).parquet(path))
    return blocks.sparkSession.read.schema(blocks.schema).parquet(path)


class InTable:
    """The passes over a written table of blocks: a Spark job a level and a round. Only splits reach the driver."""

    def __init__(self, packed: DataFrame, models: int, base: float, binning: Binning, seed: int):
        self.spark, self.width, self.models = packed.sparkSession, len(binning.names), models
        self.nominal, self.seed, self.since = np.array(binning.nominal), seed, 0
        self.table = self._written(packed, [[] for _ in range(models)], base)

    def _written(self, table: DataFrame, trees: list[list[Tree]], base: float | None) -> DataFrame:
        width, models = self.width, self.models
        packed = [[t.packed() for t in own] for own in trees]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(len(batch)):
                    row = batch.slice(k, 1)
                    if base is None:
                        block = next(_blocks(iter([row]), width, models))
                        for m, own in enumerate(packed):
                            for t in own:
                                block.margins[m] += t[4][leaves_of(t, block.codes)]
                        margins = block.margins
                    else:
                        margins = np.full((models, len(row.column(1)[0].as_py())), base)
                    yield pa.RecordBatch.from_arrays([*row.columns[:5], pa.array([margins.tobytes()], pa.binary())], [c.split()[0] for c in _STATE.split(", ")])

        # A task a core: each sends the sums of all open nodes.
        return _stored(table.mapInArrow(run, _STATE), shared_dir(self.spark, "boosting")).coalesce(self.spark.sparkContext.defaultParallelism)

    def _pending(self, models: list[Growing]) -> list[list[tuple]]:
        """Trees that the written margins lack."""
        return [[t.packed() for t in m.trees[self.since:]] for m in models]

    def splits(self, models, level, features, number):
        width, count, seed = self.width, self.models, self.seed
        pending, params = self._pending(models), {k: models[k].params for k in level}
        trees, opened = {k: models[k].tree for k in level}, {k: models[k].open for k in level}

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for block in _blocks(batches, width, count):
                for k in level:
                    for t in pending[k]:
                        block.margins[k] += t[4][leaves_of(t, block.codes)]
                    hist = block.histogram(k, trees[k], opened[k], features[k], block.sample(params[k], seed, number))
                    total[k] = total[k] + hist if k in total else hist
            for k, hist in total.items():
                columns = [k] * len(hist), range(len(hist)), [sums.tobytes() for sums in hist]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()))], ["model", "node", "hist"])

        nominal = self.nominal

        def best(table: pa.Table) -> pa.Table:
            k, node = table.column("model")[0].as_py(), table.column("node")[0].as_py()
            hist = np.zeros((1, len(features[k]), BINS, 3))
            for chunk in table.column("hist"):
                hist += np.frombuffer(chunk.as_buffer(), float).reshape(hist.shape)
            found = pickle.dumps((best_splits(hist, features[k], nominal, params[k])[0], hist[0, 0].sum(axis=0)))
            return pa.table({"model": pa.array([k], pa.int32()), "node": pa.array([node], pa.int32()), "found": pa.array([found], pa.binary())})

        found = self.table.mapInArrow(sums, "model int, node int, hist binary").groupBy("model", "node").applyInArrow(
            best, "model int, node int, found binary").collect()  # a row an open node
        out = {k: [[None] * len(opened[k]), None] for k in level}
        for r in found:
            split, whole = pickle.loads(r["found"])
            out[r["model"]][0][r["node"]] = split
            out[r["model"]][1] = whole if r["node"] == 0 else out[r["model"]][1]
        return {k: tuple(v) for k, v in out.items()}

    def finish(self, models, active):
        width, count = self.width, self.models
        pending = self._pending(models)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {k: np.zeros(2) for k in active}
            for block in _blocks(batches, width, count):
                for k in active:
                    for t in pending[k]:
                        block.margins[k] += t[4][leaves_of(t, block.codes)]
                    total[k] += block.losses(k)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t[0] for t in total.values()]), pa.array([t[1] for t in total.values()])],
                                             ["model", "loss", "weight"])

        sums = self.table.mapInArrow(run, "model int, loss double, weight double").groupBy("model").agg(F.sum("loss").alias("l"), F.sum("weight").alias("w")).collect()
        rounds = max(len(m.trees) for m in models)
        if rounds - self.since >= REFRESH:
            self.table = self._written(self.table, [m.trees[self.since:] for m in models], None)
            self.since = rounds
        return {r["model"]: (r["l"], r["w"]) for r in sums}


def average_precision(label: np.ndarray, score: np.ndarray) -> float:
    """Sum of precision weighted by the recall each distinct score adds; 0 without positives."""
    if not label.any():
        return 0.0
    order = np.argsort(-score, kind="stable")
    hits = np.cumsum(label[order])
    last = np.append(np.flatnonzero(np.diff(score[order])), len(order) - 1)
    gained = np.diff(np.append(0, hits[last]))
    return float((gained * hits[last] / (last + 1)).sum() / hits[-1])


@dataclass
class Fitted:
    ensemble: Ensemble
    losses: list[float]
    average_precision: float


def fit(fitting: DataFrame, names: list[str], nominal: set[str], points: list[dict], rounds: int, patience: int,
        seed: int = 42, local_rows: int = LOCAL_ROWS) -> list[Fitted]:
    """A model for each of the points, with its losses by round and its average precision on the judging rows.

    fitting: x_<name> of every feature, label, weight, is_validation, id (long). Judging rows (is_validation) take
    no part in growing. Every model takes at most `rounds` rounds, ends after `patience` rounds without smaller
    loss and is kept up to its best round. The same bins grow the same trees, whatever the order or partitions of
    the rows, local_rows, or the other points; bins are exact quantiles up to 10,000 rows and close ones above.
    An empty table gives models without trees.
    """
    spark = fitting.sparkSession
    binning = fit_bins(fitting.filter("NOT is_validation"), names, nominal)
    width = len(names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.column_stack([batch.column(j).to_numpy(zero_copy_only=False).astype(float) for j in range(width)])
            columns = [batch.column(width + j).to_numpy(zero_copy_only=False) for j in range(4)]
            parts = [binning.codes(x), *(c.astype(t) for c, t in zip(columns, (np.bool_, np.float64, np.bool_, np.int64)))]
            yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], [c.split()[0] for c in _STATE.split(", ")[:5]])

    inputs = fitting.select(*[F.col(f"x_{n}").cast("double") for n in names], F.col("label").cast("boolean"), "weight", "is_validation", "id")
    packed_schema = ", ".join(_STATE.split(", ")[:5])
    packed = _stored(inputs.mapInArrow(pack, packed_schema), shared_dir(spark, "binned"))
    size = F.octet_length("label")
    up = fitting.filter("NOT is_validation").agg(F.sum(F.when(F.col("label").cast("boolean"), F.col("weight"))), F.sum("weight")).first()
    share = min(max((up[0] or 0.0) / (up[1] or 1.0), 1e-6), 1 - 1e-6)
    base, flags = round(float(np.log(share / (1 - share))), 9), np.array(binning.nominal)
    total = packed.agg(F.sum(size)).first()[0] or 0
    if not total:
        return [Fitted(Ensemble(binning, base, []), [], 0.0) for _ in points]
    # The longest first, so that none of them is left for the end.
    order = sorted(range(len(points)), key=lambda k: -points[k]["num_leaves"] * points[k]["subsample"] * points[k]["colsample_bytree"])

    def fitted(k: int, block: Block, processes: int) -> pa.RecordBatch:
        def grown(team: Team) -> tuple[Growing, np.ndarray]:
            model, passes = Growing(points[k]), InMemory(block.part(team.place, team.size), flags, seed, team)
            grow([model], passes, rounds, patience, width, flags, seed)
            return model, passes.held_margins(0, model) if block.judging.any() else np.empty(0)

        model, held = together(processes, grown)
        ap = average_precision(block.label[block.judging], held)
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([pickle.dumps(Fitted(Ensemble(binning, base, model.trees), model.losses, ap))], pa.binary())],
                                          ["model", "fitted"])

    out = "model long, fitted binary"
    if total > local_rows:
        processes = max(1, min(free_cores(spark, 1), total // LEAST_SHARE))
        if total <= SHARES * local_rows * processes:
            profile = with_cores(spark, processes)

            def alone(k: int) -> Fitted:
                rows = packed.coalesce(1).mapInArrow(lambda batches: iter([fitted(k, _whole(batches, width, total, base), processes)]), out, profile=profile)
                return pickle.loads(rows.collect()[0]["fitted"])

            with ThreadPoolExecutor(min(len(points), teams_at_once(spark, processes))) as pool:
                found = dict(zip(order, pool.map(inheritable_thread_target(spark)(alone), order)))
            return [found[k] for k in range(len(points))]

        models = [Growing(p) for p in points]
        grow(models, InTable(packed, len(points), base, binning, seed), rounds, patience, width, flags, seed)
        return [_judged(fitting, Fitted(Ensemble(binning, base, m.trees), m.losses, 0.0)) for m in models]

    blocks = sorted(packed.collect(), key=lambda r: bytes(r["ids"]))  # at most local_rows rows
    joined = spark.sparkContext.broadcast([b"".join(bytes(r[k]) for r in blocks) for k in range(5)])

    # A model that has an executor's cores to itself uses them all.
    processes = max(1, min(free_cores(spark, len(points)), total // LEAST_SHARE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in (order[i] for i in batch.column(0).to_pylist()):
                row = [*joined.value, np.full(len(joined.value[1]), base).tobytes()]
                data = pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in row], list("abcdef"))
                yield fitted(k, next(_blocks(iter([data]), width, 1)), processes)

    todo = spark.range(0, len(points), 1, max(1, len(points)))
    models = todo.mapInArrow(run, out, profile=with_cores(spark, processes)).collect()  # a row a model
    joined.unpersist()
    return [pickle.loads(r["fitted"]) for r in sorted(models, key=lambda r: r["model"])]


def margin(columns: list[Column], ensemble: Ensemble, spark: SparkSession, most: int = MOST_PIECE_BYTES) -> Column:
    """The model's margin (log odds) of a row, from its inputs in the order of the binning."""
    def of(piece: Ensemble) -> Column:
        sent = spark.sparkContext.broadcast(piece)

        @F.pandas_udf("double")
        def sums(*values: pd.Series) -> pd.Series:
            x = np.column_stack([v.to_numpy(dtype=float, na_value=np.nan) for v in values])
            return pd.Series(sent.value.margins(sent.value.binning.codes(x)))

        return sums(*columns)

    total, *rest = [of(piece) for piece in ensemble.pieces(most)]
    for more in rest:
        total = total + more
    return total


def scored(df: DataFrame, ensemble: Ensemble, column: str = "raw_probability", most: int = MOST_PIECE_BYTES) -> DataFrame:
    """Adds the model's probability, from the columns x_<name>."""
    inputs = [F.col(f"x_{n}").cast("double") for n in ensemble.binning.names]
    return df.withColumn(column, 1 / (1 + F.exp(-margin(inputs, ensemble, df.sparkSession, most))))


def _judged(fitting: DataFrame, fitted: Fitted) -> Fitted:
    from riskflow.operators import evaluate

    held = scored(fitting.filter("is_validation"), fitted.ensemble, "_p")
    fitted.average_precision = evaluate.average_precision(held, "_p", "label").first().average_precision or 0.0
    return fitted
