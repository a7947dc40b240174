"""Feature attributions as per-task numpy over Arrow blocks of rows.

* path-dependent tree attributions (margin scale): a leaf of value v with the
  distinct features U on its path (o_j: the row passes feature j's splits,
  z_j: share of the training cover that does) adds
  v (o_i - z_i) sum_k k!(|U|-k-1)!/|U|! q_k to feature i, where q_k are the
  coefficients of the product of (z_j + o_j t) over the other features.  The
  product over all features is extended one by one, and each feature is
  divided out again: |U|^2 steps a leaf, no subsets.  Attributions + expected
  value = margin.  What a row gets from a leaf depends on its pattern of passes
  alone: a leaf of up to ``TABLE_FEATURES`` features is worked out once a
  pattern, and rows look their pattern up.
* interventional tree attributions: against one background row a feature
  matters only where exactly one of the two rows passes its splits.
  Background rows are grouped by their pattern of passes at each leaf, rows
  too; a pair of patterns is weighted by its count, so the cost does not grow
  with rows x background, and rows look their pattern up here, too.
* permutation attributions: one seeded feature order walked forward and
  backward (rows take x on the switched features and the background row
  elsewhere).  A stump model is a sum of one term a feature, so a step changes
  one term; sums telescope to f(x) - mean f(background).

All validation rows are explained, in blocks (``ROW_BLOCK``), against a
background that is a bounded sample of the fold's training rows.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskfold.functions.batches import x_block
from riskfold.operators import boost as B
from riskfold.session import ship_package

PHI_SCHEMA = "g int, row_id string, j int, phi double, base double"
#: Rows explained together; attributions of rows x background x 8 bytes are the largest array.
ROW_BLOCK = 2048
#: Rows of a group that a task gathers before it explains them by tables of patterns.
GATHER_ROWS = 16_384
#: Features of a path up to which all patterns of passes are tabled, leaves worked out together.
TABLE_FEATURES, TABLE_LEAVES = 8, 512


def leaf_paths(tree: B.Tree, n_bins: int) -> list[tuple[float, dict]]:
    """[(value, {feature: (lo_bin, hi_bin, cover_fraction)})] for each leaf."""
    out = []

    def walk(node, cons):
        if tree.feat[node] < 0:
            out.append((tree.value[node], cons))
            return
        j, b = tree.feat[node], tree.thr[node]
        cov = tree.cover[node] or 1e-300
        for child, lo, hi in ((tree.left[node], 0, b), (tree.right[node], b + 1, n_bins - 1)):
            frac = tree.cover[child] / cov
            c = dict(cons)
            plo, phi_, pz = c.get(j, (0, n_bins - 1, 1.0))
            c[j] = (max(plo, lo), min(phi_, hi), pz * frac)
            walk(child, c)

    walk(0, {})
    return out


def _shares(u: int) -> np.ndarray:
    """k!(u-k-1)!/u! for k = 0..u-1."""
    return np.array([math.factorial(k) * math.factorial(u - k - 1) / math.factorial(u) for k in range(u)])


def _passes(bins: np.ndarray, cons: dict) -> np.ndarray:
    """Row x feature: whether the row passes the path's splits of the feature."""
    at = list(cons)
    low, high = (np.array([cons[j][k] for j in at]) for k in (0, 1))
    own = bins[:, at]
    return (own >= low) & (own <= high)


def _path_leaf(v: float, cons: dict, passes: np.ndarray, phi: np.ndarray) -> None:
    """Add one leaf's path-dependent attributions."""
    feats, u = list(cons), len(cons)
    o, z = passes.astype(np.float64).T, np.array([cons[j][2] for j in feats])
    whole = np.zeros((u + 1, len(passes)))
    whole[0] = 1.0
    for n in range(u):   # extend by feature n
        whole[1:n + 2] = whole[1:n + 2] * z[n] + whole[:n + 1] * o[n]
        whole[0] *= z[n]
    shares = _shares(u)
    for n, j in enumerate(feats):   # unwind feature n: from the top where it passes, else by its share alone
        down, total_pass, total_fail = np.zeros(len(passes)), np.zeros(len(passes)), np.zeros(len(passes))
        for k in range(u - 1, -1, -1):
            down = whole[k + 1] - z[n] * down
            total_pass += shares[k] * down
            if z[n] > 0:
                total_fail += shares[k] * whole[k] / z[n]
        phi[:, j] += v * np.where(passes[:, n], (1.0 - z[n]) * total_pass, -z[n] * total_fail)


def _patterns(passes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct patterns of passes, each row's place among them, and counts."""
    code = passes @ (1 << np.arange(passes.shape[1], dtype=np.int64)) if passes.shape[1] < 63 else np.unique(passes, axis=0, return_inverse=True)[1].ravel()
    _, first, place, count = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
    return passes[first], place.ravel(), count


def _background_leaf(v: float, cons: dict, passes: np.ndarray, bg_passes: np.ndarray, phi: np.ndarray) -> float:
    """Add one leaf's interventional attributions; returns its mean value over the background."""
    feats, u = list(cons), len(cons)
    rows, place, _ = _patterns(passes)
    back, _, count = _patterns(bg_passes)
    weight = count / count.sum()
    only_row = rows[:, None, :] & ~back[None, :, :]
    only_back = ~rows[:, None, :] & back[None, :, :]
    reach = ~(~rows[:, None, :] & ~back[None, :, :]).any(2)
    x, y = only_row.sum(2), only_back.sum(2)
    f = np.array([float(math.factorial(k)) for k in range(u + 1)])
    gain = np.where(x > 0, f[np.maximum(x - 1, 0)] * f[y] / f[x + y], 0.0) * reach * weight
    loss = np.where(y > 0, f[x] * f[np.maximum(y - 1, 0)] / f[x + y], 0.0) * reach * weight
    part = v * ((gain[:, :, None] * only_row).sum(1) - (loss[:, :, None] * only_back).sum(1))
    phi[:, feats] += part[place]
    return v * float(weight[back.all(1)].sum())


def _all_patterns(u: int) -> np.ndarray:
    """(2^u, u): pattern c passes feature n if bit n of c is set."""
    return (np.arange(1 << u)[:, None] >> np.arange(u)) & 1 == 1


def _path_tables(v: np.ndarray, z: np.ndarray) -> np.ndarray:
    """(leaves, u, patterns) of path-dependent attributions; ``v`` (leaves,),
    ``z`` (leaves, u) shares.  The steps are those of ``_path_leaf``."""
    u = z.shape[1]
    passes = _all_patterns(u)
    o, z = passes.astype(np.float64).T[:, None, :], z.T[:, :, None]
    whole = np.zeros((u + 1, len(v), len(passes)))
    whole[0] = 1.0
    for n in range(u):
        whole[1:n + 2] = whole[1:n + 2] * z[n] + whole[:n + 1] * o[n]
        whole[0] *= z[n]
    shares, out = _shares(u), np.empty((len(v), u, len(passes)))
    for n in range(u):
        down, total_pass, total_fail = (np.zeros(whole.shape[1:]) for _ in range(3))
        safe = np.where(z[n] > 0, z[n], 1.0)
        for k in range(u - 1, -1, -1):
            down = whole[k + 1] - z[n] * down
            total_pass += shares[k] * down
            total_fail += np.where(z[n] > 0, shares[k] * whole[k] / safe, 0.0)
        out[:, n] = v[:, None] * np.where(passes[:, n], (1.0 - z[n]) * total_pass, -z[n] * total_fail)
    return out


@lru_cache(maxsize=None)
def _pair_shares(u: int) -> np.ndarray:
    """(background pattern, u, row pattern): what feature n gets for a leaf of
    value 1 from one background row."""
    rows = back = _all_patterns(u)
    only_row = rows[:, None, :] & ~back[None, :, :]
    only_back = ~rows[:, None, :] & back[None, :, :]
    reach = (rows[:, None, :] | back[None, :, :]).all(2)
    x, y = only_row.sum(2), only_back.sum(2)
    f = np.array([float(math.factorial(k)) for k in range(u + 1)])
    gain = np.where(x > 0, f[np.maximum(x - 1, 0)] * f[y] / f[x + y], 0.0) * reach
    loss = np.where(y > 0, f[x] * f[np.maximum(y - 1, 0)] / f[x + y], 0.0) * reach
    return np.ascontiguousarray((gain[:, :, None] * only_row - loss[:, :, None] * only_back).transpose(1, 2, 0))


class Leaves:
    """One group's leaves, ready to explain blocks of rows: per leaf its
    features, their bounds and the table of patterns."""

    def __init__(self, paths_per_tree: list, n_features: int, bg_bins: np.ndarray | None) -> None:
        self.n_features, self.bg_bins, self.base = n_features, bg_bins, 0.0
        self.tabled: list[tuple] = []    # (((feature, low, high), ...), table u x patterns)
        self.wide: list[tuple] = []
        by_size: dict[int, list] = {}
        for paths in paths_per_tree:
            for v, cons in paths:
                if not cons:
                    self.base += v
                elif len(cons) > TABLE_FEATURES:
                    self.wide.append((v, cons))
                else:
                    by_size.setdefault(len(cons), []).append((v, cons))
        back = None if bg_bins is None else _Tests(bg_bins)
        for u, leaves in sorted(by_size.items()):
            for lo in range(0, len(leaves), TABLE_LEAVES):
                part = leaves[lo:lo + TABLE_LEAVES]
                tests = [tuple((j, c[0], c[1]) for j, c in cons.items()) for _, cons in part]
                v = np.array([v for v, _ in part], dtype=np.float64)
                if back is None:
                    z = np.array([[c[2] for c in cons.values()] for _, cons in part], dtype=np.float64)
                    tables = _path_tables(v, z)
                    self.base += float((v * z.prod(axis=1)).sum())
                else:
                    count = np.array([np.bincount(back.code(t), minlength=1 << u) for t in tests]) / len(bg_bins)
                    tables = v[:, None, None] * (count @ _pair_shares(u).reshape(1 << u, -1)).reshape(len(part), u, 1 << u)
                    self.base += float((v * count[:, -1]).sum())
                self.tabled += zip(tests, tables)

    def explain(self, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phi rows x p, base rows)."""
        tests, phi, base = _Tests(bins), np.zeros((self.n_features, len(bins))), self.base
        for asked, table in self.tabled:
            code = tests.code(asked).astype(np.intp)
            for n, (j, _, _) in enumerate(asked):
                phi[j] += table[n].take(code)
        phi = np.ascontiguousarray(phi.T)
        for v, cons in self.wide:
            if self.bg_bins is None:
                base += v * math.prod(z for _, _, z in cons.values())
                _path_leaf(v, cons, _passes(bins, cons), phi)
            else:
                base += _background_leaf(v, cons, _passes(bins, cons), _passes(self.bg_bins, cons), phi)
        return phi, np.full(len(bins), base)


class _Tests:
    """Patterns of passes of a block of rows; a test of a feature's bounds is
    made once, however many leaves ask for it."""

    def __init__(self, bins: np.ndarray) -> None:
        self.bins, self.made = np.ascontiguousarray(bins.T.astype(np.int16)), {}

    def code(self, asked: tuple) -> np.ndarray:
        out = np.zeros(self.bins.shape[1], np.uint8)
        for n, test in enumerate(asked):
            if test not in self.made:
                j, low, high = test
                self.made[test] = ((self.bins[j] >= low) & (self.bins[j] <= high)).view(np.uint8)
            out |= self.made[test] << np.uint8(n)
        return out


def tree_phi(bins: np.ndarray, paths_per_tree: list, n_features: int, bg_bins: np.ndarray | None = None):
    """(phi rows x p, base rows) on the margin scale; path-dependent when
    ``bg_bins`` is None, else interventional averaged over background rows."""
    return Leaves(paths_per_tree, n_features, bg_bins).explain(bins)


def _explain(rows: DataFrame, cuts: dict, n_features: int, of, values: list | None = None) -> DataFrame:
    """(g, row_id, j, phi, base): ``of(g)`` gives what explains a block of the
    group's bins.  With ``values``, the positions of features, only these
    features' rows and their ``value`` besides."""
    picked = np.arange(n_features, dtype=np.int32) if values is None else np.array(sorted(values), dtype=np.int32)
    p = len(picked)

    def task(batches):
        held: dict[int, list] = {}
        explainers: dict = {}

        def explained(g):
            bins, x, ids = zip(*held.pop(g))
            bins, x, ids = np.concatenate(bins), np.concatenate(x), pa.concat_arrays(ids)
            if g not in explainers:
                explainers[g] = of(g)
            phi, base = explainers[g](bins)
            for lo in range(0, len(bins), ROW_BLOCK):
                n = len(bins[lo:lo + ROW_BLOCK])
                columns = {"g": pa.array(np.full(n * p, g, np.int32)), "row_id": ids.take(pa.array(np.repeat(np.arange(lo, lo + n), p))),
                           "j": pa.array(np.tile(picked, n)), "phi": pa.array(phi[lo:lo + n, picked].ravel()), "base": pa.array(np.repeat(base[lo:lo + n], p))}
                if values is not None:
                    columns["value"] = pa.array(x[lo:lo + n].ravel())
                yield pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            if not batch.num_rows:
                continue
            x, g, ids = x_block(batch), batch.column("g").to_numpy(zero_copy_only=False), batch.column("row_id")
            for gv in np.unique(g).tolist():
                at = np.flatnonzero(g == gv)
                mine = held.setdefault(gv, [])
                mine.append((B._bins(x[at], cuts[gv]).astype(np.uint8), x[at][:, picked] if values is not None else x[:0], ids.take(pa.array(at))))
                if sum(len(m[0]) for m in mine) >= GATHER_ROWS:
                    yield from explained(gv)
        for gv in list(held):
            yield from explained(gv)

    ship_package(rows.sparkSession)
    return rows.select("g", "row_id", "x").mapInArrow(task, PHI_SCHEMA + ("" if values is None else ", value double"))


def tree_attributions(rows: DataFrame, cuts: dict, model: dict, n_features: int, n_bins: int = 32,
                      background: dict | None = None, values: list | None = None) -> DataFrame:
    """(g, row_id, j, phi, base) for the rows' groups; ``background`` maps g
    to a small array of background feature rows (interventional)."""
    paths = {g: [leaf_paths(t, n_bins) for t in trees] for g, trees in model.items()}
    bg = None if background is None else {g: B._bins(b, cuts[g]) for g, b in background.items()}
    return _explain(rows, cuts, n_features, lambda g: Leaves(paths[g], n_features, None if bg is None else bg[g]).explain, values)


def stump_terms(bins: np.ndarray, stumps: list, n_features: int) -> np.ndarray:
    """Row x feature: the sum of the feature's stumps."""
    out = np.zeros((len(bins), n_features))
    for j, b, sign, weight in stumps:
        out[:, j] += weight * np.where(bins[:, j] <= b, sign, -sign)
    return out


def permutation_phi(bins: np.ndarray, bg_bins: np.ndarray, stumps: list, n_features: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phi, base) on the probability scale, forward and backward order."""
    own, back = stump_terms(bins, stumps, n_features), stump_terms(bg_bins, stumps, n_features)
    total = sum(a for *_, a in stumps) or 1.0
    phi = np.zeros((len(bins), n_features))
    used = {j for j, *_ in stumps}
    base = 1.0 / (1.0 + np.exp(-2.0 * back.sum(1) / total))
    for direction in (order, order[::-1]):
        margin = np.repeat(back.sum(1)[None, :], len(bins), axis=0)
        before = np.full(len(bins), base.mean())
        for j in direction:
            if j in used:
                margin += own[:, j][:, None] - back[:, j][None, :]
                now = (1.0 / (1.0 + np.exp(-2.0 * margin / total))).mean(1)
                phi[:, j] += (now - before) / 2.0
                before = now
    return phi, np.full(len(bins), base.mean())


def permutation_attributions(rows: DataFrame, cuts: dict, model: dict, n_features: int, background: dict,
                             seed: int = 42, values: list | None = None) -> DataFrame:
    """(g, row_id, j, phi, base) on the probability scale of a stump model."""
    bg = {g: B._bins(b, cuts[g]) for g, b in background.items()}

    def of(g):
        order = np.random.default_rng(seed + max(g, 0)).permutation(n_features)

        def explain(bins):
            parts = [permutation_phi(bins[lo:lo + ROW_BLOCK], bg[g], model[g], n_features, order) for lo in range(0, len(bins), ROW_BLOCK)]
            return tuple(np.concatenate(x) for x in zip(*parts))
        return explain

    return _explain(rows, cuts, n_features, of, values)


def importance(phi: DataFrame, names: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """(g, feature, mean_abs_shap, rank): mean |phi| per group and feature,
    unique ranks 1..p (importance desc, ties in feature order).  ``kept``
    (g, j) are the features that the group's selector kept: others are no
    features of its model and get no row."""
    agg = phi.groupBy("g", "j").agg(F.avg(F.abs("phi")).alias("mean_abs_shap"))
    if kept is not None:
        agg = agg.join(F.broadcast(kept), ["g", "j"])   # at most groups x features
    w = Window.partitionBy("g").orderBy(F.desc("mean_abs_shap"), "j")
    return agg.join(F.broadcast(names), "j").withColumn("rank", F.row_number().over(w))
