"""Per-row explanation: exact Shapley values of a boosted-tree model over its own tree paths.

A leaf pays its value where the row meets every condition on its path. For features left out of a coalition the path
goes on with the share of training rows at each split (path-dependent form). The value of a feature is an integral
over [0, 1] of the product of what the other features of the path let through, a polynomial, so a few Gauss points
give it exactly. A tree is walked once for all rows of a batch, each edge a few array operations: the product so far
goes down, the sums of the leaves come up, and every edge takes its feature's factor out of the sum below it. Far down,
where few conditions are left, rows that meet the same ones on the path and below have the same values: one stands for all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from riskflow.ml.boosting import MOST_PIECE_BYTES, Ensemble, in_sets
from riskflow.ml.training import Bundle, model_inputs
from riskflow.operators.explain import as_contributions, top_contributions

#: Rows that a tree is walked with at a time.
ROWS = 8192
#: Conditions on the path and below a node by which rows are told apart, at most.
CONDITIONS = 12
#: One row has to stand for so many on average.
LEAST_ALIKE = 4


def _depth(tree: tuple[np.ndarray, ...]) -> int:
    depth = np.zeros(len(tree[0]), int)
    for node in np.flatnonzero(tree[0] >= 0):  # children stand behind their parents
        depth[[tree[2][node], tree[3][node]]] = depth[node] + 1
    return int(depth.max())


def add_tree(tree: tuple[np.ndarray, ...], codes: np.ndarray, out: np.ndarray) -> None:
    """Adds a tree's contributions to out (rows x features + 1); the last column takes the expected value."""
    feature, bins, left, right, value, cover = tree
    leaves = feature < 0
    out[:, -1] += (value[leaves] * cover[leaves]).sum() / cover[0] if cover[0] else value[0]
    if leaves[0]:
        return
    points, weights = np.polynomial.legendre.leggauss((_depth(tree) + 1) // 2)
    # Points x rows: numpy's inner loops run over the rows, not over the few points.
    points, weights = (points[:, None] + 1) / 2, weights[:, None] / 2

    sets, columns, rest = in_sets(bins), np.ascontiguousarray(codes.T), 1 - points
    feature, left, right, value, cover = (column.tolist() for column in (feature, left, right, value, cover))
    below_it: list[list[int]] = [[] for _ in feature]  # of every node: the inner nodes of its subtree
    for node in range(len(feature) - 1, -1, -1):
        if feature[node] >= 0:
            below_it[node] = [node, *below_it[left[node]], *below_it[right[node]]]

    def standing(node: int, above: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray] | None:
        """(rows that stand for all, of every row the place of the one that does) from this node on, or None if they are too many."""
        conditions = len(above) + len(below_it[node])
        if conditions > CONDITIONS:
            return None
        key = np.zeros(len(codes), np.intp)
        for met in (*above, *(sets[n].take(columns[feature[n]]) for n in below_it[node])):
            key += key
            key += met
        last = np.full(1 << conditions, -1)
        last[key] = np.arange(len(codes))
        rows = last.compress(last >= 0)
        if len(rows) * LEAST_ALIKE > len(codes):
            return None
        return rows, (np.cumsum(last >= 0) - 1).take(key)

    def walk(node: int, product: np.ndarray, path: dict[int, tuple[np.ndarray, float, np.ndarray]], above: list[np.ndarray],
             rows: np.ndarray | None = None, place: np.ndarray | None = None) -> np.ndarray:
        """The sum of the leaves below. above: which rows meet each condition on the way here; rows and place: as `standing`
        gives them, or None if each row stands for itself."""
        f = feature[node]
        if f < 0:
            return product * (value[node] * weights)
        if rows is None and (found := standing(node, above)):
            rows, place = found
            few = {g: (one.take(rows), share, factor.take(rows, axis=1)) for g, (one, share, factor) in path.items()}
            return walk(node, product.take(rows, axis=1), few, [], rows, place).take(place, axis=1)

        def add(own: np.ndarray) -> None:
            out[:, f] += own if place is None else own.take(place)

        goes = sets[node].take(columns[f] if rows is None else columns[f].take(rows))
        before, total = path.get(f), np.zeros_like(product)
        for child, met in ((left[node], goes), (right[node], ~goes)):
            share, one = cover[child] / cover[node], met.astype(float)
            if before is not None:
                share, one = share * before[1], one * before[0]
            factor = rest * share + points * one
            below = walk(child, product * factor if before is None else product / before[2] * factor, {**path, f: (one, share, factor)}, [*above, goes], rows, place)
            add((below / factor).sum(axis=0) * (one - share))
            if before is not None:  # these leaves answer to the last condition on the feature, not to the one above
                add(-((below / before[2]).sum(axis=0) * (before[0] - before[1])))
            total += below
        return total

    walk(0, np.ones((len(points), len(codes))), {}, [])


def shapley_values(x: np.ndarray, ensemble: Ensemble) -> np.ndarray:
    """Contributions (rows x features + 1), in log odds; the last column is the expected value."""
    out = np.zeros((x.shape[1] + 1, x.shape[0])).T  # a feature's column lies in one piece
    out[:, -1] = ensemble.base
    codes = ensemble.binning.codes(x)
    for at in range(0, len(x), ROWS):
        for tree in ensemble.packed():
            add_tree(tree, codes[at:at + ROWS], out[at:at + ROWS])
    return np.ascontiguousarray(out)


def _values(inputs: Column, bundle: Bundle, df: DataFrame, most: int) -> Column:
    """Contributions and base value of an array of inputs; the pieces of a large model are summed."""
    def of(piece: Ensemble) -> Column:
        sent = df.sparkSession.sparkContext.broadcast(piece)

        @F.pandas_udf("array<double>")
        def shapley(x: pd.Series) -> pd.Series:
            return pd.Series(list(shapley_values(np.stack(x.to_numpy()).astype(float), sent.value))) if len(x) else x

        return shapley(inputs)

    total, *rest = [of(piece) for piece in bundle.model.pieces(most)]
    for more in rest:
        total = F.zip_with(total, more, lambda a, b: a + b)
    return total


def contributions(df: DataFrame, bundle: Bundle, id_column: str = "transaction_id", most: int = MOST_PIECE_BYTES) -> DataFrame:
    """id, phi (one value per model feature) and the base value, in log odds of the raw model."""
    n = len(bundle.feature_names)
    inputs = model_inputs(df, bundle.feature_names, bundle.feature_caps).select(id_column, F.array(*[f"x_{c}" for c in bundle.feature_names]).alias("x"))
    values = inputs.select(id_column, _values(F.col("x"), bundle, df, most).alias("_phi"))
    return values.select(id_column, F.slice("_phi", 1, n).alias("phi"), F.col("_phi")[n].alias("base"))


def explain(df: DataFrame, bundle: Bundle, k: int = 5, most: int = MOST_PIECE_BYTES) -> DataFrame:
    """Adds `contributions`: the k features that moved the raw score most, with uncapped values.

    The rows pass through the Python stage with their columns, so no join is needed after it.
    """
    inputs = model_inputs(df, bundle.feature_names, bundle.feature_caps)
    packed = inputs.select(F.struct(*df.columns).alias("row"), F.array(*[f"x_{n}" for n in bundle.feature_names]).alias("x"))
    values = [F.col(f"row.{n}") for n in bundle.feature_names]
    phi = [F.col("_phi")[i] for i in range(len(bundle.feature_names))]
    return packed.withColumn("_phi", _values(F.col("x"), bundle, df, most)).select(
        "row.*", top_contributions(as_contributions(bundle.feature_names, values, phi), k).alias("contributions"))
