"""Exact contributions of features to a tree ensemble's output, per row.

For a leaf, let ``r_j`` be the share of training rows that follow the path's
conditions on feature j (by node counts) and ``o_j`` whether the row does.  The
leaf's Shapley value for feature f is

    value * (o_f - r_f) * integral over t in (0, 1) of prod_{j != f} (o_j t + r_j (1 - t))

because the integral weighs subsets by their size as Shapley values do.  The
integrand is a polynomial of degree (features on the path - 1), so a
Gauss-Legendre rule of half as many points is exact.  Summed over leaves and
trees, contributions add up to the row's output minus the base value, the mean
output over the training rows.

The ensemble's paths are a small table (trees x leaves) that goes with the
tasks; rows are scored in one pass, without expanding them into instances.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass
class Path:
    """A leaf: its value, and per feature on its path the share of training rows
    and the tests (threshold or category set, side) that lead to it."""
    value: float
    features: list[int]
    shares: list[float]
    tests: list[list[tuple]]


def _leaf_value(node, weight: float, classifier: bool) -> float:
    if not classifier:
        return weight * float(node.prediction())
    stats = [float(x) for x in node.impurityStats().stats()]
    return weight * stats[1] / sum(stats)


def tree_paths(model) -> list[Path]:
    """All paths of a fitted MLlib forest or boosted ensemble (binary): values
    add up to the probability of class 1 (forest) or the margin (boosting)."""
    forest = type(model).__name__.startswith("RandomForestClassification")
    weights = list(model.treeWeights)
    total = sum(weights) if forest else 1.0
    out: list[Path] = []

    def walk(node, on_path: dict, weight: float):
        if node.getClass().getSimpleName() == "LeafNode":
            out.append(Path(_leaf_value(node, weight, forest), list(on_path), [s for s, _ in on_path.values()], [t for _, t in on_path.values()]))
            return
        split, count = node.split(), float(node.impurityStats().count())
        f = int(split.featureIndex())
        test = (float(split.threshold()) if split.getClass().getSimpleName() == "ContinuousSplit"
                else frozenset(float(c) for c in split.leftCategories()))
        for child, left in ((node.leftChild(), True), (node.rightChild(), False)):
            share, tests = on_path.get(f, (1.0, []))
            went = float(child.impurityStats().count()) / count
            walk(child, {**on_path, f: (share * went, [*tests, (test, left)])}, weight)
    for tree, weight in zip(model.trees, weights):
        walk(tree._call_java("rootNode"), {}, weight / total)
    return out


def base_value(paths: list[Path]) -> float:
    """Mean output over the training rows."""
    return float(sum(p.value * np.prod(p.shares) for p in paths))


def _follows(x: np.ndarray, tests: list[tuple]) -> np.ndarray:
    ok = np.ones(len(x), dtype=bool)
    for test, left in tests:
        ok &= (np.isin(x, list(test)) if isinstance(test, frozenset) else x <= test) == left
    return ok


def contributions(paths: list[Path], x: np.ndarray) -> np.ndarray:
    """(rows, features) of exact contributions."""
    out = np.zeros(x.shape)
    rules = {}
    for p in paths:
        m = len(p.features)
        if not m:
            continue
        if m not in rules:
            nodes, weights = np.polynomial.legendre.leggauss((m + 1) // 2)
            rules[m] = (nodes + 1) / 2, weights / 2
        t, w = rules[m]
        own = np.stack([_follows(x[:, f], tests) for f, tests in zip(p.features, p.tests)]).astype(np.float64)
        r = np.array(p.shares)[:, None]
        factor = own[:, :, None] * t + r[:, :, None] * (1 - t)          # feature, row, node: never zero, as shares are positive
        whole = factor.prod(axis=0)
        for i, f in enumerate(p.features):
            out[:, f] += p.value * (own[i] - r[i]) * ((whole / factor[i]) @ w)
    return out


def tree_contributions(model, rows: DataFrame, key: str, feats: Sequence[str], base: float | None = None) -> DataFrame:
    """(key, feature, value, contribution, base_value, output) of every row and
    feature of ``rows``; a feature that is null counts as not a number, which
    no threshold test passes, as in the model."""
    paths = tree_paths(model)
    base = base_value(paths) if base is None else base
    names = pa.array(list(feats), pa.string())
    d = rows.select(key, *feats)
    schema = d.select(key).schema.add("feature", "string")
    for c in ("value", "contribution", "base_value", "output"):
        schema = schema.add(c, "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, k = b.num_rows, len(names)
            x = np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in b.columns[1:]]).reshape(n, k)
            phi = contributions(paths, x)
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(np.repeat(np.arange(n), k))), names.take(pa.array(np.tile(np.arange(k), n))),
                pa.array(x.ravel(), from_pandas=True), pa.array(phi.ravel()), pa.array(np.full(n * k, base)),
                pa.array(np.repeat(base + phi.sum(axis=1), k))], names=[key, "feature", "value", "contribution", "base_value", "output"])
    return d.mapInArrow(score, schema)
