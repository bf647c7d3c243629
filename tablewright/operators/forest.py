"""Decision trees and random forests with exact splits and open depth.

Nodes with many rows are split in distributed passes over histograms. As soon as a node's rows fit a task, the rows are
grouped by tree and node and the rest of the subtree is grown there with exact splits, all its nodes of a level at once.
A table that fits a task from the start is grouped by parts of the forest, so its rows move once for several trees.
Rows move as blocks of columns; those of large nodes move for some trees after the other, so that the disk holds few copies.
"""

from __future__ import annotations

import json
import math
import pickle
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.functions.session import drop_path, drop_shuffles, shared_path

# Rows of a node that a task grows by itself, and bins of a feature where a node has more.
LOCAL_ROWS, BINS = 200_000, 64
# Values of a feature that are counted by node instead of sorted.
FEW_VALUES = 256
# Rows up to which a regression tree sorts all features.
SORTED_ROWS = 50_000
# A whole table fits a task with so many times the rows, and with so many numbers at most.
TABLE_SHARE, TABLE_CELLS = 5, 10_000_000
# Bytes of trees that a task predicts with; those of a larger model are dealt to tasks with the rows instead of passing the driver.
MODEL_BYTES = 32 << 20
# Bytes of rows that move at once when subtrees are grown, of sums that a task of a pass holds, and rows it takes at once.
MOVED_BYTES, SUMS_BYTES, TAKEN_ROWS = 1 << 31, 64 << 20, 100_000
# Rows that a task predicts for with a portion of a larger model.
ASKED_ROWS = 1_000_000
# Tasks for each core that the trees of a small table are dealt to.
DEALS = 3

NODES = {"feature": np.int32, "threshold": np.float64, "left": np.int32, "right": np.int32, "gain": np.float64}


@dataclass(frozen=True)
class TreeRules:
    """How trees grow: None is no limit of depth; `columns` are looked at for each split; a forest draws its rows."""
    trees: int = 1
    depth: int | None = None
    split_rows: int = 2
    leaf_rows: int = 1
    columns: object = "all"
    drawn: bool = False
    classes: int = 0
    seed: int = 42

    def width(self, features: int) -> int:
        named = {"all": features, "sqrt": math.sqrt(features), "log2": math.log2(max(features, 1))}
        wanted = named[self.columns] if isinstance(self.columns, str) else self.columns * features
        return min(features, max(1, int(wanted)))


def row_weights(ids: np.ndarray, tree: int, rules: TreeRules) -> np.ndarray:
    """How often each row is drawn for a tree: a Poisson number from a hash of row and tree, or once."""
    if not rules.drawn:
        return np.ones(len(ids))
    x = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((tree * 2654435761 + rules.seed * 97 + 1) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    share = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])
    out = np.zeros(len(share))
    for step in steps[:3]:
        out += share >= step
    many = np.flatnonzero(share >= steps[2])
    out[many] = np.searchsorted(steps, share[many], "right")
    return out


def statistics(labels: np.ndarray, weights: np.ndarray, classes: int) -> np.ndarray:
    """Weighted class indicators, or weighted label and its square; their sums describe a node."""
    if classes:
        out = np.zeros((len(labels), classes))
        out[np.arange(len(labels)), labels.astype(np.int64)] = weights
        return out
    return np.column_stack([weights, weights * labels, weights * labels * labels])


def _purity(sums: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(weight, sum of squares over weight): the more of the second in the parts, the less impurity is left."""
    if classes:
        weight = sums.sum(axis=-1)
        return weight, (sums * sums).sum(axis=-1) / np.maximum(weight, 1e-300)
    return sums[..., 0], sums[..., 1] ** 2 / np.maximum(sums[..., 0], 1e-300)


def _impure(sums: np.ndarray, classes: int) -> np.ndarray:
    weight, score = _purity(sums, classes)
    total = weight if classes else sums[:, 2]
    return total - score > 1e-10 * np.maximum(total, 1e-300)


def _best_cuts(of: np.ndarray, values: np.ndarray, cells: list[np.ndarray], counts: np.ndarray | None, sums: np.ndarray, sizes: np.ndarray,
               rules: TreeRules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes with a cut, its score, its threshold) for one feature; cells are sums of equal values, sorted by node and value.

    Without counts a cell is one row. Of cuts with the same score the lowest is taken.
    """
    at = np.flatnonzero((values[1:] > values[:-1]) & (of[1:] == of[:-1]))
    running = [np.cumsum(c) for c in cells]
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    node = of[first]
    if rules.leaf_rows > 1 and len(at):
        upto = np.cumsum(counts) if counts is not None else np.arange(1, len(of) + 1)
        before = np.zeros(len(sizes), dtype=np.int64)
        before[node] = np.where(first > 0, upto[first - 1], 0)
        lefts = upto[at] - before[of[at]]
        at = at[(lefts >= rules.leaf_rows) & (sizes[of[at]] - lefts >= rules.leaf_rows)]
    if not len(at):
        return np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0)
    here = of[at]
    lefts = []
    for column in running:
        before = np.zeros(len(sizes))
        before[node] = np.where(first > 0, column[first - 1], 0.0)
        lefts.append(column[at] - before[here])
    rights = [sums[here, k] - left for k, left in enumerate(lefts)]
    score = np.zeros(len(at))
    for side in (lefts, rights):
        if rules.classes:
            weight, squares = side[0].copy(), side[0] * side[0]
            for part in side[1:]:
                weight += part
                squares += part * part
            score += squares / np.maximum(weight, 1e-300)
        else:
            score += side[1] * side[1] / np.maximum(side[0], 1e-300)
    firsts = np.flatnonzero(np.r_[True, here[1:] != here[:-1]])
    top = np.maximum.reduceat(score, firsts)
    hit = np.flatnonzero(score >= np.repeat(top - 1e-12 * np.abs(top), np.diff(np.r_[firsts, len(here)])))
    hit = hit[np.r_[True, here[hit][1:] != here[hit][:-1]]]
    low, high = values[at[hit]], values[at[hit] + 1]
    middle = low + (high - low) / 2
    return here[hit], score[hit], np.where(middle < high, middle, low)


@dataclass(frozen=True)
class Coded:
    """A feature's values, or its few different values and each row's place among them."""
    levels: np.ndarray | None
    values: np.ndarray

    @staticmethod
    def of(values: np.ndarray) -> "Coded":
        levels = np.unique(values)
        return Coded(levels, np.searchsorted(levels, values).astype(np.uint8)) if len(levels) <= FEW_VALUES else Coded(None, np.ascontiguousarray(values))

    @staticmethod
    def joined(parts: list["Coded"]) -> "Coded":
        if all(p.levels is not None for p in parts):
            levels = np.unique(np.concatenate([p.levels for p in parts]))
            if len(levels) <= FEW_VALUES:
                return Coded(levels, np.concatenate([np.searchsorted(levels, p.levels).astype(np.uint8)[p.values] for p in parts]))
        return Coded(None, np.concatenate([p.plain() for p in parts]))

    def taken(self, rows) -> "Coded":
        return Coded(self.levels, self.values[rows])

    def plain(self) -> np.ndarray:
        return self.values if self.levels is None else self.levels[self.values]


def _grow_sorted(x: np.ndarray, labels: np.ndarray, weights: np.ndarray, rules: TreeRules, rng: np.random.Generator, depth: int) -> dict:
    """`grow` with all features sorted and sums that run over all rows of a level.

    Which of two cuts with equal scores is taken hangs on the rounding of such sums, so small tables keep theirs.
    """
    keep = np.flatnonzero(weights > 0)
    x, labels, weights = x[keep], labels[keep], weights[keep]
    shift = 0.0 if rules.classes or not len(labels) else float(np.average(labels, weights=weights))  # keeps squares small
    stats = statistics(labels - shift, weights, rules.classes)
    features = x.shape[1]
    orders = [np.argsort(x[:, f], kind="stable") for f in range(features)]
    out = {name: [] for name in NODES} | {"sums": []}
    starts, sizes = np.array([0]), np.array([len(x)])
    while len(sizes):
        first_node = sum(map(len, out["feature"]))
        n, sums = len(sizes), np.add.reduceat(stats[orders[0]], starts) if features else stats.sum(axis=0)[None]
        node = np.repeat(np.arange(n), sizes)
        best = np.full((n, features), -np.inf)
        cut = np.zeros((n, features))
        place = np.zeros((n, features), dtype=np.int64)
        open_ = _impure(sums, rules.classes) & (sizes >= rules.split_rows) & (sizes >= 2 * rules.leaf_rows)
        if rules.depth is not None and depth >= rules.depth:
            open_[:] = False
        if open_.any():
            ends = starts + sizes
            for f, order in enumerate(orders):
                values = x[order, f]
                running = np.cumsum(stats[order], axis=0)
                before = np.where((starts > 0)[:, None], running[starts - 1], 0.0)
                # a cut after position i: same node on both sides, another value, enough rows left and right
                at = np.flatnonzero((values[1:] > values[:-1]) & (node[1:] == node[:-1]) & open_[node[:-1]])
                if rules.leaf_rows > 1:
                    at = at[(at + 1 - starts[node[at]] >= rules.leaf_rows) & (ends[node[at]] - at - 1 >= rules.leaf_rows)]
                if not len(at):
                    continue
                of = node[at]
                left = running[at] - before[of]
                score = _purity(left, rules.classes)[1] + _purity(sums[of] - left, rules.classes)[1]
                firsts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                top = np.maximum.reduceat(score, firsts)
                reach = top - 1e-12 * np.abs(top)
                hit = np.flatnonzero(score >= np.repeat(reach, np.diff(np.r_[firsts, len(of)])))
                hit = hit[np.r_[True, of[hit][1:] != of[hit][:-1]]]
                best[of[hit], f], place[of[hit], f] = score[hit], at[hit] + 1 - starts[of[hit]]
                low, high = values[at[hit]], values[at[hit] + 1]
                middle = low + (high - low) / 2
                cut[of[hit], f] = np.where(middle < high, middle, low)
        width = rules.width(features) if features else 0
        if width < features:
            rank = np.where(np.isfinite(best), rng.random(best.shape), 2.0).argsort(axis=1)
            allowed = np.zeros(best.shape, dtype=bool)
            np.put_along_axis(allowed, rank[:, :width], True, axis=1)
            best[~allowed] = -np.inf
        reach = best.max(axis=1, initial=-np.inf)
        chosen = np.argmax(best >= (reach - 1e-12 * np.abs(reach))[:, None], axis=1) if features else np.zeros(n, dtype=np.int64)
        split = np.isfinite(reach)
        rows = np.arange(n)
        number = np.cumsum(split) - 1
        feature = np.where(split, chosen, -1)
        out["feature"].append(feature.astype(np.int32))
        out["threshold"].append(np.where(split, cut[rows, chosen], 0.0) if features else np.zeros(n))
        out["left"].append(np.where(split, first_node + n + 2 * number, -1).astype(np.int32))
        out["right"].append(np.where(split, first_node + n + 2 * number + 1, -1).astype(np.int32))
        out["gain"].append(np.where(split, reach - _purity(sums, rules.classes)[1], 0.0))
        out["sums"].append(sums)
        if not split.any():
            break
        # rows of leaves go; the others stay in their order, left rows of a node before its right ones
        goes_left = np.zeros(len(x), dtype=bool)
        row_node = np.empty(len(x), dtype=np.int64)
        row_node[orders[0]] = node
        live = split[row_node]
        mine = np.flatnonzero(live)
        goes_left[mine] = x[mine, chosen[row_node[mine]]] <= cut[row_node[mine], chosen[row_node[mine]]]
        lefts = place[rows, chosen][split]
        child_sizes = np.column_stack([lefts, sizes[split] - lefts]).ravel()
        child_starts = np.cumsum(child_sizes) - child_sizes
        renumber = np.cumsum(live) - 1
        orders_next = []
        for order in orders:
            order = order[live[order]]
            side = goes_left[order]
            of = number[row_node[order]]
            base = np.cumsum(sizes[split]) - sizes[split]
            seen = np.cumsum(side)
            left_before = seen - side - np.r_[0, seen][base][of]
            target = np.where(side, child_starts[2 * of] + left_before, child_starts[2 * of + 1] + np.arange(len(order)) - base[of] - left_before)
            moved = np.empty_like(order)
            moved[target] = renumber[order]
            orders_next.append(moved)
        x, stats, orders = x[mine], stats[mine], orders_next
        starts, sizes = child_starts, child_sizes
        depth += 1
    tree = {name: np.concatenate(out[name]) if out[name] else np.zeros(0, dtype=kind) for name, kind in NODES.items()}
    sums = np.concatenate(out["sums"])
    if rules.classes:
        value = sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-300)
    else:
        value = (sums[:, 1] / np.maximum(sums[:, 0], 1e-300) + shift)[:, None]
    return tree | {"value": value}


def grow(x: np.ndarray | list[Coded], labels: np.ndarray, weights: np.ndarray, rules: TreeRules, rng: np.random.Generator, depth: int = 0) -> dict:
    """One tree over rows with a positive weight, level by level; every level is a few numpy steps for each feature.

    A node is split while it is impure, has `split_rows` different rows and is above the depth; of all cuts halfway between
    neighbouring values that leave `leaf_rows` on both sides, the one with the least impurity is taken, on a tie the
    feature drawn first and the lowest cut. Features without a cut don't count among those drawn.

    Rows are kept sorted by node and value for features with many values; those with few are counted by node and value while
    that gives fewer cells than rows.
    """
    keep = np.flatnonzero(weights > 0)
    if not rules.classes and len(keep) <= SORTED_ROWS:
        plain = _plain([c.taken(keep) for c in x], slice(None)) if isinstance(x, list) else x[keep]
        return _grow_sorted(plain, labels[keep], weights[keep], rules, rng, depth)
    labels, weights = labels[keep], weights[keep]
    columns = [c.taken(keep) for c in (x if isinstance(x, list) else [Coded.of(x[:, f]) for f in range(x.shape[1])])]
    features, rows = len(columns), len(keep)
    shift = 0.0 if rules.classes or not rows else float(np.average(labels, weights=weights))  # keeps squares small
    stats = np.ascontiguousarray(statistics(labels - shift, weights, rules.classes).T)
    used = len(stats) if rules.classes else 2
    levels, codes = [c.levels for c in columns], [c.values for c in columns]
    orders = [None if c.levels is not None else np.argsort(c.values, kind="stable") for c in columns]
    out = {name: [] for name in NODES} | {"sums": []}
    base, goes_left = np.arange(rows), np.zeros(rows, dtype=bool)
    starts, sizes = np.array([0]), np.array([rows])
    early = rules.leaf_rows <= 1  # whether a node has a cut is known from its least and largest value
    while len(sizes):
        first_node = sum(map(len, out["feature"]))
        n, sums = len(sizes), np.column_stack([np.add.reduceat(s[base], starts) for s in stats])
        open_ = _impure(sums, rules.classes) & (sizes >= rules.split_rows) & (sizes >= 2 * rules.leaf_rows)
        if rules.depth is not None and depth >= rules.depth:
            open_[:] = False
        if not open_.all():  # rows of closed nodes go
            mask = np.repeat(open_, sizes)
            base, orders = base[mask], [o if o is None else o[mask] for o in orders]
        opened = np.flatnonzero(open_)
        m, m_sizes, m_sums = len(opened), sizes[opened], sums[opened]
        m_starts = np.cumsum(m_sizes) - m_sizes
        node = np.repeat(np.arange(m), m_sizes)
        best, cut = np.full((m, features), -np.inf), np.zeros((m, features))
        width = rules.width(features) if features else 0
        drawn = rng.random((n, features))[opened] if width < features else None
        allowed = np.ones((m, features), dtype=bool)
        if drawn is not None and early and m:
            for f in range(features):
                if orders[f] is None:
                    here = codes[f][base]
                    allowed[:, f] = np.maximum.reduceat(here, m_starts) > np.minimum.reduceat(here, m_starts)
                else:
                    allowed[:, f] = codes[f][orders[f][m_starts + m_sizes - 1]] > codes[f][orders[f][m_starts]]
            rank = np.where(allowed, drawn, 2.0).argsort(axis=1)
            taken = np.zeros(best.shape, dtype=bool)
            np.put_along_axis(taken, rank[:, :width], True, axis=1)
            allowed &= taken
        for f in range(features if m else 0):
            asked = allowed[:, f]
            if not asked.any() or levels[f] is not None and len(levels[f]) < 2:
                continue
            cells = m * len(levels[f]) if levels[f] is not None else 0
            if orders[f] is None and cells > 2 * len(base):
                orders[f] = base[np.argsort(node * len(levels[f]) + codes[f][base], kind="stable")]
            mask = None if asked.all() else np.repeat(asked, m_sizes)
            at, of = (base if orders[f] is None else orders[f]), node
            if mask is not None:
                at, of = at[mask], of[mask]
            if orders[f] is None:
                key = of * len(levels[f]) + codes[f][at]
                counts = np.bincount(key, minlength=cells)
                held = np.flatnonzero(counts)
                sums_by = [np.bincount(key, weights=stats[k][at], minlength=cells)[held] for k in range(used)]
                got = _best_cuts(held // len(levels[f]), levels[f][held % len(levels[f])], sums_by, counts[held], m_sums, m_sizes, rules)
            else:
                got = _best_cuts(of, codes[f][at] if levels[f] is None else levels[f][codes[f][at]], [stats[k][at] for k in range(used)], None, m_sums, m_sizes, rules)
            best[got[0], f], cut[got[0], f] = got[1], got[2]
        if drawn is not None and not early:
            rank = np.where(np.isfinite(best), drawn, 2.0).argsort(axis=1)
            taken = np.zeros(best.shape, dtype=bool)
            np.put_along_axis(taken, rank[:, :width], True, axis=1)
            best[~taken] = -np.inf
        reach = best.max(axis=1, initial=-np.inf)
        chosen = np.argmax(best >= (reach - 1e-12 * np.abs(reach))[:, None], axis=1) if features else np.zeros(m, dtype=np.int64)
        good = np.isfinite(reach)
        split = np.zeros(n, dtype=bool)
        split[opened] = good
        number = np.cumsum(split) - 1
        feature, threshold, gain = np.full(n, -1, dtype=np.int32), np.zeros(n), np.zeros(n)
        where = opened[good]
        feature[where] = chosen[good]
        threshold[where] = cut[good, chosen[good]]
        gain[where] = reach[good] - _purity(m_sums[good], rules.classes)[1]
        out["feature"].append(feature)
        out["threshold"].append(threshold)
        out["left"].append(np.where(split, first_node + n + 2 * number, -1).astype(np.int32))
        out["right"].append(np.where(split, first_node + n + 2 * number + 1, -1).astype(np.int32))
        out["gain"].append(gain)
        out["sums"].append(sums)
        if not good.any():
            break
        if not good.all():
            mask = np.repeat(good, m_sizes)
            base, orders = base[mask], [o if o is None else o[mask] for o in orders]
            m_sizes = m_sizes[good]
            m_starts = np.cumsum(m_sizes) - m_sizes
        # rows stay in their order, left rows of a node before its right ones
        by, limit, side = np.repeat(feature[where], m_sizes), np.repeat(threshold[where], m_sizes), np.zeros(len(base), dtype=bool)
        for f in np.unique(feature[where]):
            at = np.flatnonzero(by == f)
            here = codes[f][base[at]]
            side[at] = (here if levels[f] is None else levels[f][here]) <= limit[at]
        goes_left[base] = side
        lefts = np.add.reduceat(side, m_starts, dtype=np.int64)
        sizes = np.column_stack([lefts, m_sizes - lefts]).ravel()
        starts = np.cumsum(sizes) - sizes
        to = []
        for k, many in enumerate((lefts, m_sizes - lefts)):
            to.append(np.arange(many.sum()) + np.repeat(starts[k::2] - (np.cumsum(many) - many), many))

        def parted(order):
            if order is None:
                return None
            left = goes_left[order]
            moved = np.empty_like(order)
            moved[to[0]], moved[to[1]] = order[left], order[~left]
            return moved

        base, orders = parted(base), [parted(o) for o in orders]
        depth += 1
    tree = {name: np.concatenate(out[name]) if out[name] else np.zeros(0, dtype=kind) for name, kind in NODES.items()}
    sums = np.concatenate(out["sums"])
    if rules.classes:
        value = sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-300)
    else:
        value = (sums[:, 1] / np.maximum(sums[:, 0], 1e-300) + shift)[:, None]
    return tree | {"value": value}


def leaves(tree: dict, x: np.ndarray) -> np.ndarray:
    """The leaf that each row reaches."""
    at, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
    while len(rows):
        feature = tree["feature"][at[rows]]
        rows = rows[feature >= 0]
        feature = feature[feature >= 0]
        here = at[rows]
        at[rows] = tree["left"][here] + ~(x[rows, feature] <= tree["threshold"][here])  # a right child follows the left one
    return at


def fits_task(rows: int, features: int) -> bool:
    """Whether a task grows trees over a whole table."""
    return rows <= min(TABLE_SHARE * LOCAL_ROWS, max(LOCAL_ROWS, TABLE_CELLS // max(features, 1)))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


PACKED = ("feature", "threshold", "value")
TREE = "tree long, node long, feature binary, threshold binary, value binary, gain array<double>"


def _packed(rows: list[tuple[int, int, dict]], features: int) -> pa.Table:
    """Trees as they are stored: thresholds of inner nodes, values of leaves, gains summed by feature.

    Nodes stand level by level, so the children of the i-th inner node are the nodes 2 i + 1 and 2 i + 2.
    """
    columns = {"tree": pa.array([t for t, _, _ in rows], pa.int64()), "node": pa.array([n for _, n, _ in rows], pa.int64())}
    inner = [tree["feature"] >= 0 for _, _, tree in rows]
    columns["feature"] = pa.array([tree["feature"].astype(np.int8 if features < 128 else np.int32).tobytes() for _, _, tree in rows], pa.binary())
    columns["threshold"] = pa.array([tree["threshold"][i].tobytes() for (_, _, tree), i in zip(rows, inner)], pa.binary())
    columns["value"] = pa.array([tree["value"][~i].tobytes() for (_, _, tree), i in zip(rows, inner)], pa.binary())
    columns["gain"] = pa.array([np.bincount(tree["feature"][i], weights=tree["gain"][i], minlength=features).astype(np.float64) for (_, _, tree), i in zip(rows, inner)],
                               pa.list_(pa.float64()))
    return pa.table(columns)


def _unpacked(row, width: int) -> dict:
    nodes = len(row["threshold"]) // 4 + 1  # an inner node more is two nodes more
    feature = np.frombuffer(row["feature"], dtype=f"i{len(row['feature']) // nodes}")
    inner = feature >= 0
    threshold, value = np.zeros(len(feature)), np.zeros((len(feature), width))
    threshold[inner], value[~inner] = np.frombuffer(row["threshold"]), np.frombuffer(row["value"]).reshape(-1, width)
    return {"feature": feature, "threshold": threshold, "left": np.where(inner, 2 * np.cumsum(inner) - 1, -1).astype(np.int32), "value": value}


def _joined(top: dict, subtrees: list[tuple[int, dict]], width: int) -> dict:
    """One tree of the splits of large nodes and of subtrees in place of their leaves; other leaves have no votes."""
    size = len(top["feature"])
    if size == 1 and len(subtrees) == 1:
        return subtrees[0][1]
    parts = {"feature": [top["feature"].copy()], "threshold": [top["threshold"].copy()], "left": [top["left"].copy()], "value": [np.zeros((size, width))]}
    for node, tree in subtrees:
        moved = tree | {"left": np.where(tree["feature"] >= 0, tree["left"] + size, -1)}
        for name, held in parts.items():
            held[0][node] = moved[name][0]
            held.append(moved[name])
        size += len(tree["feature"])
    return {name: np.concatenate(held) for name, held in parts.items()}


def _grown(stored: list, tops: list[dict], width: int) -> Iterator[dict]:
    """Trees to predict with, one after the other, each joined from its stored parts (tree, node, arrays)."""
    subtrees: dict[int, list] = {}
    for tree, node, packed in stored:
        subtrees.setdefault(tree, []).append((node, packed))
    for tree, found in subtrees.items():
        yield _joined(tops[tree], [(node, _unpacked(packed, width)) for node, packed in found], width)


def _chunks(rules: TreeRules, parts: int) -> int:
    """Into how many groups the trees of a part are dealt, so that all cores have some."""
    cores = SparkContext.getOrCreate().defaultParallelism
    return min(rules.trees, -(-DEALS * cores // parts))


BLOCK = "ids binary, x binary, labels binary"


def _block(ids: np.ndarray, x: np.ndarray, labels: np.ndarray) -> list[bytes]:
    """Rows as bytes, the features column by column and few values as places; x has a row for each feature."""
    return [ids.tobytes(), pickle.dumps([(c.levels, c.values) for c in map(Coded.of, x)]), labels.tobytes()]


def _plain(columns: list[Coded], rows) -> np.ndarray:
    return np.column_stack([c.taken(rows).plain() for c in columns])


def _rows(group: pa.Table) -> tuple[np.ndarray, list[Coded], np.ndarray, np.ndarray]:
    """ids, features and labels of a group's blocks in the order of ids, so that a rerun sums in the same order, and that order."""
    ids = np.concatenate([np.frombuffer(b.as_buffer(), dtype=np.int64) for b in group.column("ids")])
    labels = np.concatenate([np.frombuffer(b.as_buffer()) for b in group.column("labels")])
    blocks = [pickle.loads(b.as_buffer()) for b in group.column("x")]
    order = np.argsort(ids, kind="stable")
    return ids[order], [Coded.joined([Coded(*c) for c in parts]).taken(order) for parts in zip(*blocks)], labels[order], order


_SLOTS: dict[int, list[int]] = {}


def _slots(spark: SparkSession, count: int) -> list[int]:
    """As many numbers, each dealt to another one of `count` partitions by Spark's hash."""
    if count not in _SLOTS:
        found: dict[int, int] = {}
        tried = spark.range(count * (16 + 2 * count.bit_length())).select("id", F.pmod(F.hash("id"), F.lit(count)).alias("at")).collect()
        for row in tried:
            found.setdefault(row["at"], row["id"])
        spare = iter(r["id"] for r in tried if r["id"] not in set(found.values()))
        _SLOTS[count] = [found.get(at) if at in found else next(spare) for at in range(count)]
    return _SLOTS[count]


def _dealt(blocks: DataFrame, rules: TreeRules, parts: int) -> tuple[DataFrame, dict[int, tuple[int, int]], int]:
    """Blocks of rows once for each group of trees of their part, what part and group a slot has, and the groups."""
    groups = _chunks(rules, parts)
    slots = _slots(blocks.sparkSession, parts * groups)
    of_part = F.array(*[F.array(*[F.lit(s).cast("long") for s in slots[p * groups:(p + 1) * groups]]) for p in range(parts)])
    dealt = blocks.withColumn("slot", F.explode(F.get(of_part, F.col("part").cast("int")))).repartition(parts * groups, "slot")
    return dealt, {s: divmod(i, groups) for i, s in enumerate(slots)}, groups


def _rng(rules: TreeRules, tree: int, node: int = 0) -> np.random.Generator:
    return np.random.default_rng([rules.seed, tree, node])


def fold_votes(table: DataFrame, rules: TreeRules, parts: int) -> DataFrame:
    """(part, id, label, votes): for the rows that `held` marks, summed class shares or means of the part's trees.

    table: part, id, x (array of double), label, trained and held (booleans) - all rows of one part must fit a task
    (`fits_task`). Each part has a forest of its own; all parts grow in the same job and no tree leaves its task.
    """
    def packed(batches):
        for batch in batches:
            ids, x, labels = batch.column("id").to_numpy(), _matrix(batch.column("x")).T, batch.column("label").to_numpy()
            of = batch.column("part").to_numpy()
            flags = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("trained", "held")]
            for part in np.unique(of):
                at = np.flatnonzero(of == part)
                cells = [int(part), *_block(ids[at], x[:, at], labels[at]), *(flag[at].tobytes() for flag in flags)]
                yield pa.RecordBatch.from_arrays([pa.array([c]) for c in cells], ["part", "ids", "x", "labels", "trained", "held"])

    def run(key, group):
        part, deal = of[key[0].as_py()]
        ids, x, labels, order = _rows(group)
        trained, held = (np.concatenate([np.frombuffer(b.as_py(), dtype=bool) for b in group.column(c)])[order] for c in ("trained", "held"))
        width = rules.classes or 1
        asked = np.flatnonzero(held)
        votes = np.zeros((len(asked), width))
        for tree in range(deal, rules.trees, groups):
            weights = np.where(trained, row_weights(ids, tree, rules), 0.0)
            grown = grow(x, labels, weights, rules, _rng(rules, tree))
            for start in range(0, len(asked), TAKEN_ROWS):
                votes[start:start + TAKEN_ROWS] += grown["value"][leaves(grown, _plain(x, asked[start:start + TAKEN_ROWS]))]
        ends = np.arange(len(votes) + 1, dtype=np.int32) * width
        return pa.table({"part": pa.array(np.full(len(votes), part, dtype=np.int32)), "id": pa.array(ids[held]), "label": pa.array(labels[held]),
                         "votes": pa.ListArray.from_arrays(pa.array(ends), pa.array(votes.ravel()))})

    blocks = table.mapInArrow(packed, f"part long, {BLOCK}, trained binary, held binary")
    dealt, of, groups = _dealt(blocks, rules, parts)
    votes = dealt.groupBy("slot").applyInArrow(run, "part int, id long, label double, votes array<double>")
    width = rules.classes or 1
    sums = [F.sum(F.get("votes", F.lit(k))).alias(f"v{k}") for k in range(width)]
    return votes.groupBy("part", "id", "label").agg(*sums).select("part", "id", "label", F.array(*[f"v{k}" for k in range(width)]).alias("votes"))


def decided(votes, rules: TreeRules):
    """The class with most votes, the first on a tie, or the mean of the trees."""
    if not rules.classes:
        return F.get(votes, F.lit(0)) / F.lit(float(rules.trees))
    return (F.array_position(votes, F.array_max(votes)) - 1).cast("double")


@dataclass
class _Top:
    """Splits of a tree's nodes that were too large for a task; negative children are not split here."""
    feature: list[int] = field(default_factory=lambda: [-1])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    gain: list[float] = field(default_factory=lambda: [0.0])
    depth: list[int] = field(default_factory=lambda: [0])

    def arrays(self) -> dict:
        return {name: np.array(getattr(self, name), dtype=kind) for name, kind in NODES.items()}

    def split(self, node: int, feature: int, threshold: float, gain: float) -> tuple[int, int]:
        self.feature[node], self.threshold[node], self.gain[node] = feature, threshold, gain
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for _ in range(2):
            for name, empty in (("feature", -1), ("threshold", 0.0), ("left", -1), ("right", -1), ("gain", 0.0), ("depth", self.depth[node] + 1)):
                getattr(self, name).append(empty)
        return self.left[node], self.right[node]


def _bin_edges(table: DataFrame, features: int) -> list[np.ndarray]:
    """Cuts between about equally many rows for each feature, by Spark's approximate percentiles."""
    shares = ", ".join(str(i / BINS) for i in range(1, BINS))
    row = table.select(*[F.expr(f"percentile_approx(x[{f}], array({shares}), 10000)").alias(f"f{f}") for f in range(features)]).first()
    return [np.unique(np.array(row[f"f{f}"] or [], dtype=np.float64)) for f in range(features)]


def _taken(batches) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, features (a row for each) and labels of about TAKEN_ROWS rows at once."""
    held = []
    for batch in batches:
        held.append((batch.column("id").to_numpy(), _matrix(batch.column("x")).T, batch.column("label").to_numpy()))
        if sum(len(ids) for ids, _, _ in held) >= TAKEN_ROWS:
            yield tuple(np.concatenate(c, axis=-1) for c in zip(*held))
            held = []
    if held:
        yield tuple(np.concatenate(c, axis=-1) for c in zip(*held))


def _reached(top: dict, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The leaf that each of the rows reaches; x has a row for each feature. A leaf leads to itself."""
    leaf = top["feature"] < 0
    feature, threshold = np.where(leaf, 0, top["feature"]).astype(np.int64), np.where(leaf, np.inf, top["threshold"])
    left, flat, width = np.where(leaf, np.arange(len(leaf)), top["left"]).astype(np.int64), x.ravel(), x.shape[1]
    at = np.zeros(len(rows), dtype=np.int64)
    while not leaf[at].all():
        at = left[at] + (flat[feature[at] * width + rows] > threshold[at])
    return at


def _large_nodes(table: DataFrame, rules: TreeRules, features: int, rows: int) -> tuple[list[_Top], dict[int, dict[int, list[float]]]]:
    """Splits nodes with more than LOCAL_ROWS rows by histograms, a pass over the table for each level of such nodes.

    Also gives the sums of the nodes of each tree that stay leaves: large ones without a cut, and the children at the
    depth or of one class, whose sums are known from the split.
    """
    tops, edges = [_Top() for _ in range(rules.trees)], _bin_edges(table, features)
    closed: dict[int, dict[int, list[float]]] = {}
    active = {t: [0] for t in range(rules.trees)} if rows > LOCAL_ROWS else {}
    width = rules.classes or 3
    bins = [len(e) + 1 for e in edges]
    offsets = np.cumsum([0, *bins])
    table = table.select("id", "x", "label").coalesce(2 * table.sparkSession.sparkContext.defaultParallelism)

    def splits_of(routes: dict[int, tuple[dict, list[int]]]) -> list:
        def histograms(batches):
            sums = {tree: np.zeros((len(nodes), offsets[-1], width + 1)) for tree, (_, nodes) in routes.items()}
            for ids, x, labels in _taken(batches):
                binned = [np.searchsorted(edges[f], x[f], "left") for f in range(features)]
                classes = labels.astype(np.int64) if rules.classes else None
                for tree, (top, nodes) in routes.items():
                    weights = row_weights(ids, tree, rules)
                    number = np.full(len(top["feature"]), -1)
                    number[nodes] = np.arange(len(nodes))
                    drawn = np.flatnonzero(weights > 0)
                    at = number[_reached(top, x, drawn)]
                    drawn, at = drawn[at >= 0], at[at >= 0]
                    w = weights[drawn]
                    y = w * labels[drawn] if not rules.classes else None
                    held = sums[tree]
                    for f in range(features):
                        cell, cells, place = at * bins[f] + binned[f][drawn], len(nodes) * bins[f], slice(offsets[f], offsets[f + 1])
                        shape = (len(nodes), bins[f])
                        held[:, place, 0] += np.bincount(cell, minlength=cells).reshape(shape)
                        if rules.classes:
                            held[:, place, 1:] += np.bincount(cell * width + classes[drawn], weights=w, minlength=cells * width).reshape(*shape, width)
                            continue
                        held[:, place, 1] += np.bincount(cell, weights=w, minlength=cells).reshape(shape)
                        held[:, place, 2] += np.bincount(cell, weights=y, minlength=cells).reshape(shape)
                        if not f:  # a node's total is read from its first feature
                            held[:, place, 3] += np.bincount(cell, weights=y * labels[drawn], minlength=cells).reshape(shape)
            for tree, held in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), tree)), pa.array(np.array(routes[tree][1])), pa.array([h.tobytes() for h in held])], ["tree", "node", "cells"])

        def best(key, group):
            tree, node = key[0].as_py(), key[1].as_py()
            known = np.sum([np.frombuffer(b.as_py()) for b in group.column("cells")], axis=0).reshape(-1, width + 1)
            cells = np.zeros((features, BINS, width + 1))
            for f in range(features):
                cells[f, :bins[f]] = known[offsets[f]:offsets[f + 1]]
            total = cells[0].sum(axis=0)
            left = np.cumsum(cells, axis=1)[:, :-1]
            right = total - left
            score = _purity(left[..., 1:], rules.classes)[1] + _purity(right[..., 1:], rules.classes)[1]
            score[(left[..., 0] < rules.leaf_rows) | (right[..., 0] < rules.leaf_rows)] = -np.inf
            for f in range(features):
                score[f, len(edges[f]):] = -np.inf
            usable = np.flatnonzero(np.isfinite(score.max(axis=1)))
            usable = np.sort(_rng(rules, tree, node + 1).permutation(usable)[:rules.width(features)])
            found = len(usable) > 0 and bool(_impure(total[None, 1:], rules.classes)[0])
            f, b = divmod(int(np.argmax(score[usable])), BINS - 1) if found else (0, 0)
            f = int(usable[f]) if found else -1
            gain = float(score[f, b] - _purity(total[None, 1:], rules.classes)[1][0]) if found else 0.0
            sides = [left[f, b], right[f, b]] if found else [total, total]
            return pa.table({"tree": [tree], "node": [node], "feature": [f], "threshold": [float(edges[f][b]) if found else 0.0], "gain": [gain],
                             "left": [sides[0].tolist()], "right": [sides[1].tolist()]})

        cells = table.mapInArrow(histograms, "tree long, node long, cells binary")
        return cells.groupBy("tree", "node").applyInArrow(best, "tree long, node long, feature long, threshold double, gain double, left array<double>, right array<double>").collect()

    while active:
        splits, routes, size = [], {}, 0
        for tree, nodes in active.items():  # a pass for as many trees as a task can hold sums of
            need = len(nodes) * int(offsets[-1]) * (width + 1) * 8
            if routes and size + need > SUMS_BYTES:
                splits += splits_of(routes)
                routes, size = {}, 0
            routes[tree] = (tops[tree].arrays(), list(nodes))
            size += need
        splits += splits_of(routes)
        active = {}
        for s in splits:
            if s["feature"] < 0:
                closed.setdefault(s["tree"], {})[s["node"]] = s["left"][1:]
                continue
            top = tops[s["tree"]]
            children = top.split(s["node"], s["feature"], s["threshold"], s["gain"])
            deeper = rules.depth is None or top.depth[children[0]] < rules.depth
            for child, (n, *sums) in zip(children, (s["left"], s["right"])):
                if not deeper or rules.classes and not _impure(np.array([sums]), rules.classes)[0]:
                    closed.setdefault(s["tree"], {})[child] = sums
                elif n > LOCAL_ROWS:
                    active.setdefault(s["tree"], []).append(child)
    return tops, closed


def _leaf_rows(closed: dict[int, dict[int, list[float]]], rules: TreeRules, features: int) -> list[tuple]:
    """Leaves whose sums are known, as trees of one node."""
    out = []
    for tree, nodes in closed.items():
        for node, sums in nodes.items():
            sums = np.array(sums)
            value = sums / max(sums.sum(), 1e-300) if rules.classes else np.array([sums[1] / max(sums[0], 1e-300)])
            only = {"feature": np.array([-1]), "threshold": np.zeros(1), "gain": np.zeros(1), "value": value[None]}
            out.append((tree, node, only))
    return [tuple(r.values()) for r in _packed(out, features).to_pylist()]


class ForestModel:
    """Trees as rows of a stored table: the splits of large nodes on the driver, everything below as (tree, node, arrays)."""

    def __init__(self, spark: SparkSession, path: str, rules: TreeRules, features: int, tops: list[dict]):
        self.spark, self.path, self.rules, self.features, self.tops = spark, path, rules, features, tops

    def save(self, path: str) -> None:
        """Rules and large nodes as one JSON row, trees as Parquet."""
        spark = self.spark
        meta = {"rules": asdict(self.rules), "features": self.features, "tops": [{c: top[c].tolist() for c in NODES} for top in self.tops]}
        self._stored().write.mode("overwrite").parquet(f"{path}/trees")
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/rules")

    @staticmethod
    def load(path: str) -> "ForestModel":
        spark = SparkSession.getActiveSession()
        meta = json.loads(spark.read.text(f"{path}/rules").first()[0])
        tops = [{c: np.array(top[c], dtype=kind) for c, kind in NODES.items()} for top in meta["tops"]]
        return ForestModel(spark, f"{path}/trees", TreeRules(**meta["rules"]), meta["features"], tops)

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(TREE).parquet(self.path)

    def _pieces(self) -> list[list]:
        """Rows of the model in portions of about MODEL_BYTES."""
        size = sum((F.length(c) for c in PACKED), F.lit(0))
        sizes = self._stored().select("tree", "node", size.alias("size")).orderBy("tree", "node").collect()
        portions, held = [[]], 0
        for row in sizes:
            if held and held + row["size"] > MODEL_BYTES:
                portions.append([])
                held = 0
            portions[-1].append((row["tree"], row["node"]))
            held += row["size"]
        return portions

    def _votes(self):
        """The function that sums the votes of a small model."""
        width, tops = self.rules.classes or 1, self.tops
        sent = self.spark.sparkContext.broadcast([(r["tree"], r["node"], {c: r[c] for c in PACKED}) for r in self._stored().drop("gain").collect()])

        @F.arrow_udf("array<double>")
        def votes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            trees = list(_grown(sent.value, tops, width))
            for vectors in batches:
                x = _matrix(vectors)
                total = np.zeros((len(x), width))
                for tree in trees:
                    total += tree["value"][leaves(tree, x)]
                yield pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * width), pa.array(total.ravel()))

        return votes

    def _dealt_votes(self, rows: DataFrame, portions: list[list[tuple[int, int]]]) -> DataFrame:
        """(_row, _votes) of rows (_row, _x): blocks of rows meet each portion of the model in a task, their votes are summed by block."""
        width, tops, spark = self.rules.classes or 1, self.tops, self.spark
        cuts = max(1, -(-rows.count() // ASKED_ROWS))
        slots = _slots(spark, cuts * len(portions))

        def packed(batches):
            renamed = (pa.RecordBatch.from_arrays([b.column("_row"), b.column("_x"), pa.array(np.zeros(b.num_rows))], ["id", "x", "label"]) for b in batches)
            for ids, x, _ in _taken(renamed):
                cells = [int(ids[0]), *_block(ids, x, ids[:0])[:2]]
                yield pa.RecordBatch.from_arrays([pa.array([c]) for c in cells], ["block", "ids", "x"])

        def vote(rows: pa.Table, stored: pa.Table) -> pa.Table:
            known = [(tree, node, {c: stored.column(c)[i].as_buffer() for c in PACKED})
                     for i, (tree, node) in enumerate(zip(stored.column("tree").to_pylist(), stored.column("node").to_pylist()))]
            ids, blocks = [b.as_buffer() for b in rows.column("ids")], [b.as_buffer() for b in rows.column("x")]
            totals = [np.zeros((len(b) // 8, width)) for b in ids]
            for tree in _grown(known, tops, width):
                for total, block in zip(totals, blocks):
                    total += tree["value"][leaves(tree, _plain([Coded(*c) for c in pickle.loads(block)], slice(None)))]
            out = [(block, i.to_pybytes(), total.tobytes()) for block, i, total in zip(rows.column("block").to_pylist(), ids, totals)]
            return pa.table({c: pa.array([r[k] for r in out], kind) for k, (c, kind) in enumerate((("block", pa.int64()), ("ids", pa.binary()), ("votes", pa.binary())))})

        def summed(group: pa.Table) -> pa.Table:
            ids, votes = np.frombuffer(group.column("ids")[0].as_buffer(), dtype=np.int64), group.column("votes")
            total = np.zeros(len(ids) * width)
            for part in votes:
                total += np.frombuffer(part.as_buffer())
            return pa.table({"_row": pa.array(ids), "_votes": pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * width), pa.array(total))})

        table = [[s for s in slots[cut * len(portions):(cut + 1) * len(portions)]] for cut in range(cuts)]
        of_cut = F.array(*[F.array(*[F.lit(s).cast("long") for s in line]) for line in table])
        of_portion = F.array(*[F.array(*[F.lit(line[g]).cast("long") for line in table]) for g in range(len(portions))])
        portion = spark.createDataFrame([(t, n, g) for g, keys in enumerate(portions) for t, n in keys], "tree long, node long, portion int")
        blocks = rows.mapInArrow(packed, "block long, ids binary, x binary")
        left = blocks.withColumn("slot", F.explode(F.get(of_cut, F.pmod(F.xxhash64("block"), F.lit(cuts)).cast("int"))))
        right = self._stored().drop("gain").join(F.broadcast(portion), ["tree", "node"]).withColumn("slot", F.explode(F.get(of_portion, F.col("portion")))).drop("portion")
        left, right = (t.repartition(len(slots), "slot").groupBy("slot") for t in (left, right))
        votes = left.cogroup(right).applyInArrow(vote, "block long, ids binary, votes binary")
        return votes.groupBy("block").applyInArrow(summed, "_row long, _votes array<double>")

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds `prediction` from `features`. Rows are stored once for a model beyond MODEL_BYTES, and joined with their votes."""
        portions = self._pieces()
        x = vector_to_array("features")
        if len(portions) == 1:
            df = df.withColumn("_votes", self._votes()(x))
        else:
            path = shared_path(df.sparkSession, "rows")
            kept = df.withColumn("_row", F.monotonically_increasing_id())
            kept.write.parquet(path)
            kept = df.sparkSession.read.schema(kept.schema).parquet(path)
            votes = shared_path(df.sparkSession, "votes")
            self._dealt_votes(kept.select("_row", x.alias("_x")), portions).write.parquet(votes)
            drop_shuffles(df.sparkSession)
            df = kept.join(df.sparkSession.read.schema("_row long, _votes array<double>").parquet(votes), "_row").drop("_row")
        return df.withColumn("prediction", decided(F.col("_votes"), self.rules)).drop("_votes")

    @property
    def featureImportances(self):
        """Impurity that a feature's splits remove, as a share within each tree, averaged over trees that split."""
        gains = np.zeros((self.rules.trees, self.features))
        for tree, top in enumerate(self.tops):
            inner = top["feature"] >= 0
            np.add.at(gains[tree], top["feature"][inner], top["gain"][inner])
        one = F.posexplode("gain").alias("feature", "gain")
        for row in self._stored().select("tree", one).groupBy("tree", "feature").agg(F.sum("gain").alias("gain")).collect():
            gains[row["tree"], row["feature"]] += row["gain"]
        total = gains.sum(axis=1, keepdims=True)
        shares = (gains / np.where(total > 0, total, 1.0))[total[:, 0] > 0]
        return Vectors.dense(shares.mean(axis=0) if len(shares) else np.zeros(self.features))


class Forest:
    """Estimator with the rules above: fit(df with `features` and `label`, optionally a key column)."""

    def __init__(self, rules: TreeRules, key: str | None = None):
        self.rules, self.key = rules, key

    def fit(self, df: DataFrame) -> ForestModel:
        spark, rules = df.sparkSession, self.rules
        identity = F.xxhash64(self.key) if self.key else F.monotonically_increasing_id()
        kept = shared_path(spark, "rows")
        df.select(identity.alias("id"), vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label")).write.parquet(kept)
        table = spark.read.parquet(kept)
        size = table.agg(F.count("*").alias("rows"), F.max(F.size("x")).alias("features")).first()
        if not size["rows"]:
            raise ValueError("no rows to grow trees on")
        features = size["features"]
        path = shared_path(spark, "trees")
        if fits_task(size["rows"], features):
            tops = [_Top().arrays() for _ in range(rules.trees)]

            def packed(batches):
                for batch in batches:
                    cells = [0, *_block(batch.column("id").to_numpy(), _matrix(batch.column("x")).T, batch.column("label").to_numpy())]
                    yield pa.RecordBatch.from_arrays([pa.array([c]) for c in cells], ["part", "ids", "x", "labels"])

            def whole(key, group):
                ids, x, labels, _ = _rows(group)
                return _packed([(tree, 0, grow(x, labels, row_weights(ids, tree, rules), rules, _rng(rules, tree))) for tree in range(of[key[0].as_py()][1], rules.trees, groups)], features)

            dealt, of, groups = _dealt(table.mapInArrow(packed, f"part long, {BLOCK}"), rules, 1)
            dealt.groupBy("slot").applyInArrow(whole, TREE).write.parquet(path)
            del dealt
            drop_shuffles(spark)
        else:
            known, closed = _large_nodes(table, rules, features, size["rows"])
            tops, depths = [t.arrays() for t in known], [t.depth for t in known]

            def grown(trees: range) -> DataFrame:
                def placed(batches):
                    for ids, x, labels in _taken(batches):
                        for tree in trees:
                            drawn = np.flatnonzero(row_weights(ids, tree, rules) > 0)
                            node = _reached(tops[tree], x, drawn)
                            small = ~np.isin(node, list(closed.get(tree, ())))
                            drawn, node = drawn[small], node[small]
                            order = np.argsort(node, kind="stable")
                            drawn, node = drawn[order], node[order]
                            firsts = np.flatnonzero(np.diff(node, prepend=-1))
                            blocks = [_block(ids[at], x[:, at], labels[at]) for at in np.split(drawn, firsts[1:])] if len(node) else []
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(blocks), tree)), pa.array(node[firsts]), *(pa.array([b[k] for b in blocks], pa.binary()) for k in range(3))],
                                                             ["tree", "node", "ids", "x", "labels"])

                def subtree(key, group):
                    tree, node = key[0].as_py(), key[1].as_py()
                    ids, x, labels, _ = _rows(group)
                    return _packed([(tree, node, grow(x, labels, row_weights(ids, tree, rules), rules, _rng(rules, tree, node), depths[tree][node]))], features)

                return table.mapInArrow(placed, f"tree long, node long, {BLOCK}").groupBy("tree", "node").applyInArrow(subtree, TREE)

            drawn = size["rows"] * (0.64 if rules.drawn else 1.0) * 8 * (features + 2)
            at_once = max(1, int(MOVED_BYTES // drawn))
            for first in range(0, rules.trees, at_once):
                grown(range(first, min(first + at_once, rules.trees))).write.mode("append").parquet(path)
                drop_shuffles(spark)
            if closed:
                spark.createDataFrame(_leaf_rows(closed, rules, features), TREE).write.mode("append").parquet(path)
        drop_path(spark, kept)
        return ForestModel(spark, path, rules, features, tops)
