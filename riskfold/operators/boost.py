"""Histogram boosting as Spark jobs, all fit groups and models batched.

Training rows carry ``(g, row_id, y, w0, h, x)`` with ``x`` the processed
feature array.  ``bin_cuts`` places at most ``max_bins`` bins per (g, feature)
from a mergeable sketch (``functions/sketch.py``) whose result does not depend
on the partitioning.

**State.**  The rows are turned once into a table of blocks: per block packed
bin codes (``functions/packs.py``), label, weight, row hash and, per model, the
margin so far.  A new version of the state is made once a cycle (one tree of every
model): the trees grown since are added to the margins, so a row meets every
tree once and a fit is linear in its trees.  A version is cached when its
first pass reads it, the version before is released then; every ``KEEP``
cycles the state is written to the checkpoint folder and the write before
deleted, so the loss of executors costs at most ``KEEP`` cycles.

**Pass.**  One job serves every model and group that still grows.  Map tasks
route their blocks through the tree under growth and add up histograms of
whole numbers (gradients and weights in fixed point, so that sums do not
depend on order).  Below the root only the smaller child of a split is added
up; the other is its parent's histogram, kept by the pass before, less that
child.  Histograms are exchanged by (model, group, node, tile of features),
the receiving task adds them, searches the best split by running sums, and
the driver gets one row per (model, group, node).

Groups whose packed codes fit a task (``TASK_CELLS``, checked) are grown by one
task a model and group with the same growers, histograms and split search: the
passes then need no jobs of their own.  Such a task keeps its rows in the order
of the nodes: a level splits the ranges of the level before.

* stumps: discrete AdaBoost (SAMME, two classes) of depth-1 trees with weights
  w0 * exp(-y F / 2), the closed form of the multiplicative update, divided by
  the total of the round before.
* trees: second-order gradient boosting with logistic loss, L2 leaf penalty,
  row subsampling by a row hash and per-tree column sampling; ``leaves=None``
  grows level by level (depth-wise), ``leaves=n`` grows to the depth cap and
  keeps the n best leaves best-first (leaf-wise).
"""

from __future__ import annotations

import math
import pickle
import time
import uuid
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfold.functions.batches import x_block
from riskfold.functions.packs import Packs, leaf_bits
from riskfold.functions.sketch import feature_cuts
from riskfold.session import discard, ensure_checkpoint_dir, ship_package

SCORE_SCHEMA = "m int, g int, row_id string, y int, score double, margin double"
#: Rows of a group that a scoring task gathers, and rows that it hands on at a time.
SCORE_ROWS, SEND_ROWS = 65_536, 8_192
#: Rows of a state block, features of a histogram tile, bytes of histograms a receiving task takes on.
BLOCK_ROWS, TILE, TASK_BYTES = 32_768, 256, 16_000_000
#: Cycles between two writes of the state, rows below which a state partition is not worth a task.
KEEP, PART_ROWS = 25, 16_384
#: Packed codes (rows x packs) that one task may hold for a group.
TASK_CELLS = 32_000_000
_LEVEL = "m int, g int, node int, tile int, hist binary, feat int, bin int, side int, gain double, left_s0 long, left_s1 long, left_n long, s0 long, s1 long, n long, ns long"
_PART = "m int, g int, parent int, child int, tile int, hist binary, ns long"


# --------------------------------------------------------------------------- binning
def bin_cuts(train: DataFrame, n_features: int, max_bins: int = 32) -> dict[int, np.ndarray]:
    """Weighted quantile cuts per (g, feature): {g: array (p, max_bins-1)}."""
    return feature_cuts(train, n_features, max_bins)


def _bins(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Bin index = number of cuts strictly below the value."""
    out = np.empty(x.shape, dtype=np.int32)
    for j in range(x.shape[1]):
        out[:, j] = np.searchsorted(cuts[j], x[:, j], side="left")
    return out


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    """splitmix64 of (row hash, salt) -> uniform [0, 1)."""
    z = (h.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z = z ^ (z >> np.uint64(31))
    return (z >> np.uint64(11)).astype(np.float64) / float(1 << 53)


# --------------------------------------------------------------------------- model tables
@dataclass
class Tree:
    """Nodes in arrays; node 0 is the root.  ``feat < 0`` marks a leaf."""

    feat: list = field(default_factory=lambda: [-1])
    thr: list = field(default_factory=lambda: [0])
    left: list = field(default_factory=lambda: [-1])
    right: list = field(default_factory=lambda: [-1])
    value: list = field(default_factory=lambda: [0.0])
    gain: list = field(default_factory=lambda: [0.0])
    cover: list = field(default_factory=lambda: [0.0])

    def split(self, node: int, j: int, b: int, gain: float) -> tuple[int, int]:
        self.feat[node], self.thr[node], self.gain[node] = j, b, gain
        ids = []
        for _ in range(2):
            ids.append(len(self.feat))
            for lst, v in ((self.feat, -1), (self.thr, 0), (self.left, -1), (self.right, -1),
                           (self.value, 0.0), (self.gain, 0.0), (self.cover, 0.0)):
                lst.append(v)
        self.left[node], self.right[node] = ids
        return ids[0], ids[1]

    def arrays(self):
        return (np.asarray(self.feat), np.asarray(self.thr), np.asarray(self.left), np.asarray(self.right),
                np.asarray(self.value, dtype=np.float64))


def _route(bins: np.ndarray, tree_arrays, stop_at_depth: int | None = None) -> np.ndarray:
    """Node reached by each row (leaf, or the node at ``stop_at_depth``)."""
    feat, thr, left, right, _ = tree_arrays
    node = np.zeros(bins.shape[0], dtype=np.int64)
    depth = 0
    while True:
        f = feat[node]
        inner = f >= 0
        if not inner.any() or (stop_at_depth is not None and depth >= stop_at_depth):
            return node
        b = bins[np.arange(bins.shape[0]), np.where(inner, f, 0)]
        go_left = b <= thr[node]
        node = np.where(inner, np.where(go_left, left[node], right[node]), node)
        depth += 1


# --------------------------------------------------------------------------- the state
_BLOCK = "g int, n int, codes binary, y binary, w binary, h binary, margins binary"


def _state(train: DataFrame, packs: dict, parts: int | None = None) -> DataFrame:
    """Blocks (g, n, codes, y, w, h, margins) of the training rows; codes are
    pack by pack.  Margins are null: all zero."""
    if parts is None:
        parts = max(1, min(train.rdd.getNumPartitions(), -(-train.count() // PART_ROWS)))

    def task(batches):
        held: dict[int, list] = {}

        def block(g, parts):
            codes, y, w, h = (np.concatenate(x, axis=-1) for x in zip(*parts))
            return pa.RecordBatch.from_pydict({"g": pa.array([g], pa.int32()), "n": pa.array([len(y)], pa.int32()), **{
                k: pa.array([v.tobytes()], pa.binary()) for k, v in (("codes", codes), ("y", y), ("w", w), ("h", h))}, "margins": pa.array([None], pa.binary())})

        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(lo, BLOCK_ROWS)
                g, y, w, h = (part.column(c).to_numpy(zero_copy_only=False) for c in ("g", "y", "w0", "h"))
                x = x_block(part)
                for gv in np.unique(g):
                    at = g == gv
                    mine = held.setdefault(int(gv), [])
                    mine.append((packs[int(gv)].encode(x[at]), y[at].astype(np.uint8), w[at].astype(np.float64), h[at].astype(np.int64)))
                    if sum(len(m[1]) for m in mine) >= BLOCK_ROWS:
                        yield block(int(gv), held.pop(int(gv)))
        for gv, mine in held.items():
            yield block(gv, mine)

    ship_package(train.sparkSession)
    return train.select("g", "y", "w0", "h", "x").coalesce(parts).mapInArrow(task, _BLOCK)


def _write(state: DataFrame) -> tuple[DataFrame, str]:
    """The state as a written table in the shared folder: its lineage ends there."""
    spark = state.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/boost-state-{uuid.uuid4().hex}"
    state.write.parquet(folder)
    return spark.read.schema(state.schema).parquet(folder), folder


def _open(row: dict, packs: Packs) -> tuple:
    codes = np.frombuffer(row["codes"], packs.kind).reshape(len(packs.sizes), row["n"])
    return codes, np.frombuffer(row["y"], np.uint8), np.frombuffer(row["w"], np.float64), np.frombuffer(row["h"], np.int64)


def _grown(state: DataFrame, added: dict, n_models: int, packs: dict) -> DataFrame:
    """The next version: ``added[(m, g)]`` are trees (or stumps) whose values
    go on the margins."""
    kept = [c for c in state.columns if c != "margins"]

    def task(batches):
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                margins = _margins(row, n_models)
                codes = _open(row, packs[row["g"]])[0]
                for m in range(n_models):
                    for one in added.get((m, row["g"]), ()):
                        margins[m] += packs[row["g"]].value(codes, one)
                made.append(margins.tobytes())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(made, pa.binary())], [*kept, "margins"])

    return state.mapInArrow(task, state.schema)


def _margins(row: dict, n_models: int) -> np.ndarray:
    if row["margins"] is None:
        return np.zeros((n_models, row["n"]))
    return np.frombuffer(row["margins"], np.float64).reshape(n_models, row["n"]).copy()


def _value(codes: np.ndarray, one: tuple) -> np.ndarray:
    """What a stump (feature, bin, left sign, weight) or the arrays of a tree give each row."""
    if len(one) == 4:
        j, b, sign, weight = one
        return weight * np.where(codes[:, j] <= b, sign, -sign)
    return one[4][_route(codes, one)]


# --------------------------------------------------------------------------- one pass
@dataclass
class Ask:
    """What a model wants of one pass for one group: histograms of ``nodes``
    (child: its split parent, -1 for the root) of the tree under growth."""

    kind: str
    nodes: dict[int, int]
    columns: np.ndarray                 # features that may be split on
    pending: list = field(default_factory=list)   # finished since the state's version
    tree: tuple | None = None
    depth: int = 0
    sibling: dict[int, int] = field(default_factory=dict)   # child asked for -> its larger sibling
    norm: float = 1.0                   # stumps: total weight of the round before over the first
    salt: int = 0
    subsample: float = 1.0
    lam: float = 1.0
    least_weight: float = 0.0
    least_rows: int = 1


def _weights(ask: Ask, margin: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, scale: float) -> tuple:
    """Fixed-point (s0, s1, n) of the rows: gradient and hessian, or the weights of either label."""
    if ask.kind == "stumps":
        q = np.rint(w * np.exp(-(y * 2.0 - 1.0) * margin / 2.0) / ask.norm * scale)
        return np.where(y > 0, q, 0.0), np.where(y > 0, 0.0, q), np.ones(len(y))
    p = 1.0 / (1.0 + np.exp(-margin))
    keep = np.ones(len(y), bool) if ask.subsample >= 1 else _mix(h, ask.salt) < ask.subsample
    return np.where(keep, np.rint(w * (p - y) * scale), 0.0), np.where(keep, np.rint(w * p * (1 - p) * scale), 0.0), keep.astype(np.float64)


def _packed_sums(ask: Ask, packs: Packs, codes: np.ndarray, margin: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, scale: float) -> list:
    """A pack an array (3, asked nodes, codes) of whole-number sums of a block's rows."""
    stats = _weights(ask, margin, y, w, h, scale)
    slot = np.zeros(len(y), np.intp) if ask.tree is None else np.full(len(y), -1, np.intp)
    if ask.tree is not None:
        places = {node: s for s, node in enumerate(ask.nodes)}
        for node, rows in packs.nodes(codes, ask.tree, ask.depth):
            slot[rows] = places.get(int(node), -1)
    at = np.flatnonzero((slot >= 0) & (stats[2] > 0))
    s0, s1, slot = stats[0][at], stats[1][at], slot[at]
    return [packs.count(k, slot * size + codes[k][at], (s0, s1, None), len(ask.nodes)) for k, size in enumerate(packs.sizes)]


def _partials(state: DataFrame, asks: dict, n_models: int, packs: dict, p: int, scale: float) -> DataFrame:
    """Each task's histograms by (m, g, parent, child, tile)."""

    def task(batches):
        total, spent = {}, {}
        for batch in batches:
            for row in batch.to_pylist():
                g, margins = row["g"], None
                for m in range(n_models):
                    ask = asks.get((m, g))
                    if ask is None:
                        continue
                    began = time.perf_counter_ns()
                    if margins is None:
                        margins = _margins(row, n_models)
                        codes, y, w, h = _open(row, packs[g])
                    margin = sum([packs[g].value(codes, one) for one in ask.pending], margins[m])
                    own = _packed_sums(ask, packs[g], codes, margin, y, w, h, scale)   # sums of a group stay below 2^53
                    total[(m, g)] = [a + b for a, b in zip(total[(m, g)], own)] if (m, g) in total else own
                    spent[(m, g)] = spent.get((m, g), 0) + time.perf_counter_ns() - began
        out = {c: [] for c in ("m", "g", "parent", "child", "tile", "hist", "ns")}
        for (m, g), packed in total.items():
            sums = packs[g].apart(packed)
            for s, (child, parent) in enumerate(asks[(m, g)].nodes.items()):
                for tile, lo in enumerate(range(0, p, TILE)):
                    values = (m, g, parent, child, tile, np.ascontiguousarray(sums[:, s, lo:lo + TILE]).tobytes(), spent[(m, g)] if s == tile == 0 else 0)
                    for c, v in zip(out, values):
                        out[c].append(v)
        if out["m"]:
            yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.binary() if c == "hist" else pa.int64() if c == "ns" else pa.int32()) for c, v in out.items()})

    return state.mapInArrow(task, _PART)


def best_split(ask: Ask, hist: np.ndarray, first: int, scale: float) -> tuple:
    """(feature, bin, side, gain, left s0, s1, n) of the best split in a tile
    whose first feature is ``first``; feature -1 if none is allowed.  Equal
    gains go to the smaller feature, then bin.  For stumps the gain is minus
    the weighted error and side the label of the left."""
    left = hist.cumsum(axis=2)[:, :, :-1]
    whole = hist[:, :, :].sum(axis=2)[:, 0]
    none = (-1, 0, 0, 0.0, 0, 0, 0)
    allowed = np.isin(np.arange(first, first + hist.shape[1]), ask.columns)
    if not allowed.any() or not left.shape[2]:
        return none
    if ask.kind == "stumps":
        pos, neg = left[0] / scale, left[1] / scale
        all_pos, all_neg = whole[0] / scale, whole[1] / scale
        total = all_pos + all_neg
        if total <= 0:
            return none
        errors = np.stack([(neg + all_pos - pos) / total, (pos + all_neg - neg) / total], axis=1)  # left is 1, left is 0
        errors = np.where(allowed[:, None, None], errors, np.inf)
        at = int(errors.argmin())
        j, rest = divmod(at, errors.shape[1] * errors.shape[2])
        side, b = divmod(rest, errors.shape[2])
        return (first + j, b, 1 if side == 0 else -1, -float(errors[j, side, b]), *[int(left[k, j, b]) for k in range(3)])
    grad, hess = left[0] / scale, left[1] / scale
    g_all, h_all = whole[0] / scale, whole[1] / scale
    gain = grad ** 2 / (hess + ask.lam) + (g_all - grad) ** 2 / (h_all - hess + ask.lam) - g_all ** 2 / (h_all + ask.lam)
    least = max(ask.least_rows, 1)
    good = (hess >= ask.least_weight) & (h_all - hess >= ask.least_weight) & (left[2] >= least) & (whole[2] - left[2] >= least) & allowed[:, None]
    gain = np.where(good, gain, -np.inf)
    j, b = divmod(int(gain.argmax()), gain.shape[1])
    if not gain[j, b] > 1e-12:
        return none
    return (first + j, b, 0, float(gain[j, b]), *[int(left[k, j, b]) for k in range(3)])


def _levels(partials: DataFrame, before: DataFrame | None, asks: dict, p: int, bins: int, scale: float, tasks: int, alone: bool) -> DataFrame:
    """One row per (m, g, node, tile) with the node's histogram and its best
    split; the larger sibling's histogram is the parent's less the child's.
    ``alone``: the state is one partition, so that there is nothing to exchange."""
    if before is not None:
        own = before.selectExpr("m", "g", "node as parent", "-1 as child", "tile", "hist", "0L as ns")
        partials = partials.unionByName(own)

    def task(batches):
        sums, parents, spent = {}, {}, {}
        for batch in batches:
            for r in batch.to_pylist():
                hist = np.frombuffer(r["hist"], np.int64)
                if r["child"] < 0:
                    parents[(r["m"], r["g"], r["parent"], r["tile"])] = hist
                    continue
                key = (r["m"], r["g"], r["parent"], r["tile"], r["child"])
                spent[key] = spent.get(key, 0) + r["ns"]
                sums[key] = sums[key] + hist if key in sums else hist
        out = []
        for (m, g, parent, tile, child), hist in sums.items():
            began = time.perf_counter_ns()
            ask, first = asks[(m, g)], tile * TILE
            found = [(child, hist)]
            if child in ask.sibling:
                found.append((ask.sibling[child], parents[(m, g, parent, tile)] - hist))
            for node, h in found:
                shaped = h.reshape(3, -1, bins)
                whole = shaped[:, 0].sum(axis=1)
                out.append([m, g, node, tile, h.tobytes(), *best_split(ask, shaped, first, scale), *[int(v) for v in whole], 0])
            out[-1][-1] = spent[(m, g, parent, tile, child)] + time.perf_counter_ns() - began
        if out:
            names = [x.split()[0] for x in _LEVEL.split(", ")]
            kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds[x.split()[1]]) for v, x in zip(zip(*out), _LEVEL.split(", "))], names)

    dealt = partials.coalesce(1) if alone else partials.repartition(tasks, "m", "g", "parent", "tile")
    return dealt.mapInArrow(task, _LEVEL)


@dataclass
class Found:
    """A node's best split and sums, in units."""

    feat: int
    bin: int
    side: int
    gain: float
    left: tuple[float, float, int]
    whole: tuple[float, float, int]


@contextmanager
def _plain_plans(spark):
    """Passes are short jobs of a fixed shape: no re-planning between their
    stages.  Their rows are whole blocks, so batches hold few of them."""
    want = {"spark.sql.adaptive.enabled": "false", "spark.sql.inMemoryColumnarStorage.batchSize": "8",
            "spark.sql.parquet.columnarReaderBatchSize": "8", "spark.sql.execution.arrow.maxRecordsPerBatch": "8"}
    had = {k: spark.conf.get(k) for k in want}
    for k, v in want.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in had.items():
            spark.conf.set(k, v)


class Passes:
    """Runs passes over the state and keeps its versions."""

    def __init__(self, written: DataFrame, folder: str, scale: float, p: int, bins: int, n_models: int, packs: dict) -> None:
        self.packs = packs
        self.spark, self.p, self.bins, self.n_models, self.scale = written.sparkSession, p, bins, n_models, scale
        self.state, self.folder = written, folder
        self.old: list[DataFrame] = []
        self.old_folder: str | None = None
        self.levels: DataFrame | None = None
        self.cycles, self.count = 0, 0
        self.alone = written.rdd.getNumPartitions() == 1
        self.seconds = [0.0] * n_models

    def advance(self, added: dict) -> None:
        """Next version of the state; earlier ones are released after its first pass."""
        self.cycles += 1
        fresh = _grown(self.state, added, self.n_models, self.packs)
        self.old.append(self.state)
        if self.levels is not None:
            self.old.append(self.levels)
            self.levels = None
        if self.cycles % KEEP == 0:
            self.old_folder = self.folder
            fresh, self.folder = _write(fresh)
        self.state = fresh.persist(StorageLevel.MEMORY_AND_DISK)

    def run(self, asks: dict) -> dict:
        """{(m, g, node): Found} for the asked nodes and their siblings."""
        began = time.monotonic()
        self.count += 1
        wide = self.p * self.bins * 24
        tasks = max(1, min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(len(a.nodes) for a in asks.values()) * wide // TASK_BYTES)))
        below = any(a.sibling for a in asks.values())
        partials = _partials(self.state, asks, self.n_models, self.packs, self.p, self.scale)
        level = _levels(partials, self.levels if below else None, asks, self.p, self.bins, self.scale, tasks, self.alone and tasks == 1).persist(StorageLevel.MEMORY_AND_DISK)
        rows = level.drop("hist")
        if self.p > TILE:  # the best of all tiles, found by the tasks
            best = F.max_by(F.struct(*[c for c in rows.columns if c not in ("m", "g", "node", "ns")]),
                            F.struct((F.col("feat") >= 0).alias("any"), "gain", (-F.col("feat")).alias("first")))
            rows = rows.groupBy("m", "g", "node").agg(best.alias("b"), F.sum("ns").alias("ns")).select("m", "g", "node", "b.*", "ns")
        s, out, own = self.scale, {}, [0.0] * self.n_models
        for r in rows.collect():
            out[(r["m"], r["g"], r["node"])] = Found(r["feat"], r["bin"], r["side"], r["gain"], (r["left_s0"] / s, r["left_s1"] / s, r["left_n"]),
                                                     (r["s0"] / s, r["s1"] / s, r["n"]))
            own[r["m"]] += r["ns"] / 1e9
        for df in self.old:
            df.unpersist()
        if self.old_folder is not None:
            discard(self.spark, self.old_folder)
            self.old_folder = None
        self.old = [self.levels] if self.levels is not None else []
        self.levels = level
        # the pass belongs to its models by their share of the tasks' own time
        total = sum(own) or 1.0
        for m in range(self.n_models):
            self.seconds[m] += (time.monotonic() - began) * own[m] / total
        return out

    def close(self) -> None:
        for df in [*self.old, self.state, *([self.levels] if self.levels is not None else [])]:
            df.unpersist()
        for folder in {self.folder, self.old_folder} - {None}:
            discard(self.spark, folder)


# --------------------------------------------------------------------------- growers
def _leaf(gs, hs, lam, rate):
    return -gs / (hs + lam) * rate


class Stumps:
    """AdaBoost over the passes: one round a pass."""

    depth = 1

    def __init__(self, groups: list[int], columns: dict, rounds: int = 20, rate: float = 0.1) -> None:
        self.model: dict[int, list] = {g: [] for g in groups}
        self.columns, self.rounds, self.rate = columns, rounds, rate
        self.active, self.norm, self.first, self.pending = set(groups), {g: 1.0 for g in groups}, {}, {g: [] for g in groups}

    def done(self) -> bool:
        return not self.active or self.rounds <= 0

    def asks(self, cycle: int, level: int) -> dict:
        if self.done():
            return {}
        return {g: Ask("stumps", {0: -1}, self.columns[g], pending=list(self.pending[g]), norm=self.norm[g]) for g in self.active}

    def take(self, found: dict) -> None:
        self.rounds -= 1
        for g in sorted(self.active):
            f = found.get((g, 0))
            if f is None or f.feat < 0:
                self.active.discard(g)
                continue
            err = -f.gain
            total = (f.whole[0] + f.whole[1]) * self.norm[g]
            self.norm[g] = total / self.first.setdefault(g, total)
            if err <= 0:
                self._add(g, (f.feat, f.bin, f.side, 1.0))
                self.active.discard(g)
            elif err >= 0.5:
                self.active.discard(g)
            else:
                self._add(g, (f.feat, f.bin, f.side, self.rate * math.log((1 - err) / err)))

    def _add(self, g: int, stump: tuple) -> None:
        self.model[g].append(stump)
        self.pending[g].append(stump)

    def only(self, g: int) -> None:
        self.model, self.active, self.pending = {g: []}, {g}, {g: []}

    def settle(self) -> dict:
        """What the next version of the state adds."""
        out, self.pending = self.pending, {g: [] for g in self.model}
        return out


class Trees:
    """Gradient boosting over the passes: one level a pass, one tree a cycle."""

    def __init__(self, groups: list[int], columns: dict, trees: int = 10, rate: float = 0.05, depth: int = 4, lam: float = 1.0,
                 min_child_weight: float = 1.0, min_child_rows: int = 0, subsample: float = 0.8, colsample: float = 0.8,
                 leaves: int | None = None, seed: int = 42) -> None:
        self.model: dict[int, list] = {g: [] for g in groups}
        self.groups, self.columns, self.trees, self.rate, self.depth, self.lam = groups, columns, trees, rate, depth, lam
        self.least_weight, self.least_rows, self.subsample, self.colsample = min_child_weight, min_child_rows, subsample, colsample
        self.leaves, self.seed = leaves, seed
        self.cur: dict[int, Tree] = {}

    def only(self, g: int) -> None:
        self.model, self.groups = {g: []}, [g]

    def done(self) -> bool:
        return all(len(v) >= self.trees for v in self.model.values()) and not self.cur

    def asks(self, cycle: int, level: int) -> dict:
        if level == 0:
            if self.done():
                return {}
            self.cur, self.t = {g: Tree() for g in self.groups}, cycle
            self.frontier = {g: [(0, -1, None)] for g in self.groups}   # (child to add up, split parent, sibling)
            self.level = 0
            self.cols = {}
            for g in self.groups:
                own = self.columns[g]
                n = max(1, int(round(self.colsample * len(own)))) if len(own) else 0
                self.cols[g] = np.sort(np.random.default_rng([self.seed, cycle, g + 1]).choice(own, n, replace=False))
        if not self.cur or level >= self.depth:
            return {}
        self.level = level
        return {g: Ask("trees", {c: q for c, q, _ in f}, self.cols[g], tree=self.cur[g].arrays() if level else None, depth=level,
                       sibling={c: s for c, _, s in f if s is not None}, salt=self.seed * 1000003 + self.t, subsample=self.subsample,
                       lam=self.lam, least_weight=self.least_weight, least_rows=self.least_rows)
                for g, f in self.frontier.items() if f}

    def take(self, found: dict) -> None:
        for g, asked in self.frontier.items():
            tree, fresh = self.cur[g], []
            for node in sorted([n for c, _, s in asked for n in (c, s) if n is not None]):
                f = found.get((g, node))
                if f is None:
                    continue
                whole = f.whole
                if self.level == 0:
                    tree.value[node], tree.cover[node] = _leaf(whole[0], whole[1], self.lam, self.rate), whole[1]
                if f.feat < 0:
                    continue
                a, b = tree.split(node, f.feat, f.bin, f.gain)
                # the children's sums are the two sides of the chosen cut: their values need no pass over the rows
                right = tuple(x - y for x, y in zip(whole, f.left))
                for child, (gs, hs, _) in ((a, f.left), (b, right)):
                    tree.value[child], tree.cover[child] = _leaf(gs, hs, self.lam, self.rate), hs
                fresh.append((a, node, b) if f.left[2] <= right[2] else (b, node, a))
            self.frontier[g] = fresh

    def settle(self) -> dict:
        out = {}
        for g, tree in self.cur.items():
            if self.leaves is not None:
                tree = _best_first(tree, self.leaves)
            self.model[g].append(tree)
            out[g] = [tree.arrays()]
        self.cur = {}
        return out


def _grow(passes, growers: list, watch=None) -> None:
    """Cycles until every grower is done: a level a pass, a tree a cycle."""
    cycle, levels = 0, max([g.depth for g in growers if isinstance(g, Trees)], default=8)
    while not all(g.done() for g in growers):
        for level in range(levels):
            asks = {(m, g): a for m, grower in enumerate(growers) for g, a in grower.asks(cycle, level).items()}
            if not asks:
                break
            found = passes.run(asks)
            for m in sorted({m for m, _ in asks}):
                growers[m].take({(g, n): f for (k, g, n), f in found.items() if k == m})
        added = {(m, g): v for m, grower in enumerate(growers) for g, v in grower.settle().items() if v}
        cycle += 1
        if watch is not None:
            watch(passes)
        if not all(g.done() for g in growers):
            passes.advance(added)


class TaskPasses:
    """Passes over the rows of one group and one model that a task holds.
    ``kept`` and ``rest`` are the rows that the tree under growth sees and the
    others, in the order of its nodes; ``at`` are the nodes' ranges in both."""

    def __init__(self, packs: Packs, codes: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, scale: float) -> None:
        self.packs, self.codes, self.y, self.w, self.h, self.scale = packs, codes, y, w, h, scale
        self.margin, self.parents, self.seen = np.zeros(len(y)), {}, 0
        self.s0, self.s1, self.tree = np.zeros(len(y)), np.zeros(len(y)), None
        self.at: dict[int, tuple] = {}

    def advance(self, added: dict) -> None:
        for values in added.values():
            for one in values[self.seen:]:
                if len(one) == 4 or self.tree is None:
                    self.margin += self.packs.value(self.codes, one)
                else:
                    self._add_tree(one)
        self.seen = 0

    def _add_tree(self, one: tuple) -> None:
        """Margins of the finished tree: the tree under growth or its first splits."""
        feat, thr, left, right, value = one
        _, _, grown_left, grown_right, _ = self.tree
        open_ = [(0, 0)]   # node under growth, the same node of the finished tree
        while open_:
            s, o = open_.pop()
            if feat[o] >= 0 and grown_left[s] in self.at:
                open_ += [(grown_left[s], left[o]), (grown_right[s], right[o])]
                continue
            a, b, c, d = self.at[s]
            for rows in (self.kept[a:b], self.rest[c:d]):
                below = [(o, rows)]
                while below:
                    node, rows = below.pop()
                    if feat[node] < 0:
                        self.margin[rows] += value[node]
                    else:
                        go = self.packs.left(self.codes, feat[node], thr[node], rows)
                        below += [(left[node], rows[go]), (right[node], rows[~go])]

    def _weigh(self, ask: Ask) -> np.ndarray:
        keep = np.empty(len(self.y), bool)
        for lo in range(0, len(self.y), BLOCK_ROWS):
            at = slice(lo, lo + BLOCK_ROWS)
            self.s0[at], self.s1[at], n = _weights(ask, self.margin[at], self.y[at], self.w[at], self.h[at], self.scale)
            keep[at] = n > 0
        return keep

    def _split(self, tree: tuple, node: int) -> None:
        """The ranges of a node's children: its rows, the left ones first."""
        a, b, c, d = self.at[node]
        middle = []
        for order, lo, hi in ((self.kept, a, b), (self.rest, c, d)):
            rows = order[lo:hi]
            go = self.packs.left(self.codes, tree[0][node], tree[1][node], rows)
            first, second = rows[go], rows[~go]
            order[lo:lo + len(first)], order[lo + len(first):hi] = first, second
            middle.append(lo + len(first))
        self.at[int(tree[2][node])] = (a, middle[0], c, middle[1])
        self.at[int(tree[3][node])] = (middle[0], b, middle[1], d)

    def _sums(self, rows: np.ndarray | None) -> list:
        own = (self.s0, self.s1, None) if rows is None else (self.s0[rows], self.s1[rows], None)
        return [self.packs.count(k, self.codes[k] if rows is None else self.codes[k][rows], own) for k in range(len(self.packs.sizes))]

    def run(self, asks: dict) -> dict:
        out, held, s = {}, {}, self.scale
        for (m, g), ask in asks.items():
            if ask.kind == "stumps":
                for one in ask.pending[self.seen:]:
                    self.margin += self.packs.value(self.codes, one)
                self.seen = len(ask.pending)
                self._weigh(ask)
                wanted = [None]
            elif ask.tree is None:
                keep = self._weigh(ask)
                self.kept, self.rest = np.flatnonzero(keep).astype(np.int32), np.flatnonzero(~keep).astype(np.int32)
                self.at, self.tree, wanted = {0: (0, len(self.kept), 0, len(self.rest))}, Tree().arrays(), [self.kept]
            else:
                self.tree = ask.tree
                for parent in dict.fromkeys(ask.nodes.values()):
                    self._split(ask.tree, parent)
                wanted = [self.kept[slice(*self.at[child][:2])] for child in ask.nodes]
            for (child, parent), rows in zip(ask.nodes.items(), wanted):
                sums = self.packs.apart([x[:, 0] for x in self._sums(rows)])
                found = [(child, sums)]
                if child in ask.sibling:
                    found.append((ask.sibling[child], self.parents[parent] - sums))
                for node, hist in found:
                    held[node] = hist
                    j, b, side, gain, *left = best_split(ask, hist, 0, s)
                    whole = hist[:, 0].sum(axis=1).tolist()
                    out[(m, g, node)] = Found(j, b, side, gain, (left[0] / s, left[1] / s, left[2]), (whole[0] / s, whole[1] / s, whole[2]))
        self.parents = held
        return out


def _grown_in_tasks(train: DataFrame, packs: dict, growers: list, heaviest: float) -> tuple[list, list]:
    """Models and seconds of all growers; a task holds one group's codes for
    one model.  Only for groups of a checked size."""
    scale, plain = _scale(heaviest), pickle.dumps(growers)

    def task(key, table):
        g, m = key[0].as_py(), key[1].as_py()
        began, held = time.perf_counter(), []
        for batch in table.to_batches():
            held += [_open(row, packs[g]) for row in batch.to_pylist()]
        codes, y, w, h = (np.concatenate(x, axis=-1) for x in zip(*held))
        del held
        grower = pickle.loads(plain)[m]
        grower.only(g)
        _grow(TaskPasses(packs[g], codes, y, w, h, scale), [grower])
        made = pickle.dumps(grower.model[g])
        return pa.table({"g": pa.array([g], pa.int32()), "m": pa.array([m], pa.int32()), "model": pa.array([made], pa.binary()), "s": pa.array([time.perf_counter() - began])})

    # rows become blocks of codes before they are sent to their tasks
    blocks = _state(train, packs, train.rdd.getNumPartitions()).drop("margins")
    rows = blocks.select("*", F.explode(F.array(*[F.lit(m) for m in range(len(growers))])).alias("m"))
    rows = rows.repartition(4 * len(packs) * len(growers), "g", "m")   # small to move, long to work on: not to be coalesced
    models, seconds = [{} for _ in growers], [0.0] * len(growers)
    for r in rows.groupBy("g", "m").applyInArrow(task, "g int, m int, model binary, s double").collect():   # a model a row
        models[r["m"]][r["g"]] = pickle.loads(r["model"])
        seconds[r["m"]] += r["s"]
    return [{g: m[g] for g in sorted(m)} for m in models], seconds


def _scale(heaviest: float) -> float:
    """Steps of a unit of weight: a group's sums stay whole numbers below 2^52."""
    return 2.0 ** min(40, math.floor(51 - math.log2(max(heaviest, 1.0))))


def fit_many(train: DataFrame, n_features: int, specs: dict, max_bins: int = 32, columns: dict | None = None, seconds: dict | None = None,
             watch=None, task_cells: int = TASK_CELLS, blocks=()) -> dict:
    """Fit several models on the same fit groups: ``specs[key] = ("stumps" |
    "trees", kwargs)``; one set of bin cuts for all.  Groups of at most
    ``task_cells`` packed codes (rows x packs) are grown by one
    task a model and group; larger ones in passes over the shared state, one
    job for every model still growing.  Both give the same model.  ``columns``
    limits a group's splits to the features it kept, ``blocks`` are the features
    of which a row has at most one that is not zero (the dummies of a column),
    ``seconds`` receives each
    model's seconds (its tasks', or its share of the passes), ``watch`` is
    called with the passes after each cycle.  Returns {key: (cuts, model)}."""
    if max_bins > 256:
        raise ValueError("bin codes are one byte: at most 256 bins")
    spark = train.sparkSession
    cuts = bin_cuts(train, n_features, max_bins)
    groups = sorted(cuts)
    own = {g: np.asarray(sorted(columns[g]) if columns is not None else range(n_features), dtype=np.int64) for g in groups}
    growers = [Stumps(groups, own, **kw) if kind == "stumps" else Trees(groups, own, **kw) for kind, kw in specs.values()]
    if not groups:
        return {key: (cuts, grower.model) for key, grower in zip(specs, growers)}
    ship_package(spark)
    sizes = train.groupBy("g").agg(F.sum("w0").alias("w"), F.count(F.lit(1)).alias("n")).collect()
    heaviest = max(float(r["w"]) for r in sizes)
    packs = {g: Packs(cuts[g], max_bins, blocks) for g in groups}
    if max(r["n"] * len(packs[r["g"]].sizes) for r in sizes) <= task_cells and watch is None:
        models, own_seconds = _grown_in_tasks(train, packs, growers, heaviest)
    else:
        written, folder = _write(_state(train, packs))
        with _plain_plans(spark):
            passes = Passes(written.persist(StorageLevel.MEMORY_AND_DISK), folder, _scale(heaviest), n_features, max_bins, len(growers), packs)
            _grow(passes, growers, watch)
            passes.close()
        models, own_seconds = [g.model for g in growers], passes.seconds
    if seconds is not None:
        seconds.update(zip(specs, own_seconds))
    return {key: (cuts, model) for key, model in zip(specs, models)}


def fit_stumps(train: DataFrame, n_features: int, rounds: int = 20, rate: float = 0.1,
               max_bins: int = 32) -> tuple[dict, dict]:
    """Returns ({g: cuts}, {g: [(j, b, left_label, alpha), ...]})."""
    return fit_many(train, n_features, {0: ("stumps", dict(rounds=rounds, rate=rate))}, max_bins)[0]


def fit_trees(train: DataFrame, n_features: int, max_bins: int = 32, **kw) -> tuple[dict, dict]:
    """Returns ({g: cuts}, {g: [Tree, ...]}); base margin 0 (probability 0.5)."""
    return fit_many(train, n_features, {0: ("trees", kw)}, max_bins)[0]


def _best_first(tree: Tree, n_leaves: int) -> Tree:
    """Keep the splits a best-first (leaf-wise) grower would make first: a
    node's best split depends only on its own rows, so growing everything to
    the depth cap and then expanding the highest-gain frontier node first
    gives the leaf-wise tree."""
    out = Tree()
    out.value[0], out.cover[0] = tree.value[0], tree.cover[0]
    frontier = [(0, 0)]    # (node in source, node in out)
    count = 1
    while frontier and count < n_leaves:
        cand = [(tree.gain[s], s, o) for s, o in frontier if tree.feat[s] >= 0]
        if not cand:
            break
        _, s, o = max(cand)
        frontier.remove((s, o))
        a, b = out.split(o, tree.feat[s], tree.thr[s], tree.gain[s])
        for src, dst in ((tree.left[s], a), (tree.right[s], b)):
            out.value[dst], out.cover[dst] = tree.value[src], tree.cover[src]
            frontier.append((src, dst))
        count += 1
    return out


# --------------------------------------------------------------------------- scoring
def score_rows(rows: DataFrame, cuts: dict, model: dict, kind: str, blocks=()) -> DataFrame:
    """(g, row_id, y, score, margin): positive-class probability of each row
    under its group's model.  ``kind`` is 'stumps' or 'trees'."""
    return score_models(rows, [(kind, cuts, model)], blocks).drop("m")


def score_models(rows: DataFrame, models: list, blocks=()) -> DataFrame:
    """(m, g, row_id, y, score, margin): every row under each of ``models``
    (kind, cuts, model), in one pass over the rows.  Tasks gather a group's
    rows as packed bin codes and look up the packs' tables; ``blocks`` as in
    ``fit_many``."""
    packed = [{g: list(v) if kind == "stumps" else [leaf_bits(t.arrays(), cuts[g].shape[1] + 1) for t in v] for g, v in model.items()}
              for kind, cuts, model in models]
    layouts: dict[int, dict] = {}   # models fitted together share their cuts
    for _, cuts, _ in models:
        layouts.setdefault(id(cuts), {g: Packs(c, c.shape[1] + 1, blocks) for g, c in cuts.items()})
    layout, first = list(layouts.values()), [list(layouts).index(id(cuts)) for _, cuts, _ in models]

    def scored(g, held):
        ids, y = pa.chunked_array([h[0] for h in held]).combine_chunks(), np.concatenate([h[1] for h in held])
        codes = [np.concatenate([h[2][i] for h in held], axis=1) for i in range(len(layout))]
        for m, (kind, _, _) in enumerate(models):
            packs, mine = layout[first[m]][g], codes[first[m]]
            if kind == "stumps":
                margin = np.zeros(len(y))
                for j, b, lab, a in packed[m][g]:
                    margin += packs.value(mine, (j, b, lab, a))
                prob = 1.0 / (1.0 + np.exp(-2.0 * margin / (sum(a for *_, a in packed[m][g]) or 1.0)))
            else:
                margin = packs.margin(mine, packed[m][g])
                prob = 1.0 / (1.0 + np.exp(-margin))
            for lo in range(0, len(y), SEND_ROWS):
                at = slice(lo, lo + SEND_ROWS)
                n = len(y[at])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, m, np.int32)), pa.array(np.full(n, g, np.int32)), ids.slice(lo, n), pa.array(y[at]),
                                                  pa.array(prob[at]), pa.array(margin[at])], ["m", "g", "row_id", "y", "score", "margin"])

    def task(batches):
        held: dict[int, list] = {}
        for batch in batches:
            x, groups = x_block(batch), batch.column("g").to_numpy()
            y = batch.column("y").to_numpy(zero_copy_only=False).astype(np.int32)
            for g in np.unique(groups).tolist():
                at = np.flatnonzero(groups == g)
                mine = held.setdefault(g, [])
                mine.append((batch.column("row_id").take(pa.array(at)), y[at], [packs[g].encode(x[at]) for packs in layout]))
                if sum(len(h[1]) for h in mine) >= SCORE_ROWS:
                    yield from scored(g, held.pop(g))
        for g, mine in held.items():
            yield from scored(g, mine)

    ship_package(rows.sparkSession)
    return rows.select("g", "row_id", "y", "x").mapInArrow(task, SCORE_SCHEMA)


def model_table(spark, model: dict, kind: str) -> DataFrame:
    """The fitted model as rows (for inspection and persistence)."""
    rows = []
    if kind == "stumps":
        for g, stumps in model.items():
            for t, (j, b, lab, a) in enumerate(stumps):
                rows.append((int(g), t, 0, int(j), int(b), float(lab), float(a), None, None))
    else:
        for g, trees in model.items():
            for t, tr in enumerate(trees):
                for n in range(len(tr.feat)):
                    rows.append((int(g), t, n, int(tr.feat[n]), int(tr.thr[n]), float(tr.value[n]),
                                 float(tr.gain[n]), int(tr.left[n]), int(tr.right[n])))
    return spark.createDataFrame(rows, "g int, tree int, node int, feature int, bin int, value double, "
                                       "weight double, left int, right int")
