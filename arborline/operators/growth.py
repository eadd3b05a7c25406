"""Tracing of branches order by order from a main axis: seeds, growth, extension of tips, selection, assignment.

The orders depend on each other, so one specimen is traced by one task (``kernels.grouped``); specimens are traced side
by side. Every step looks at neighbours in a grid, so time grows with the points.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from arborline.operators.kernels import Grid, density_clusters, greedy_cover, grow_path

#: Step lengths in spacings that are tried from each seed, and those tried only where they found nothing.
STEPS, LATE_STEPS = (2.5, 4.0, 6.0), (8.0, 10.0)

#: Spacings around a path that it owns, and around its parent in which seeds may lie.
OWN, NEAR = 2.5, 14.0

#: Steps by which a tip is extended at a time, and in all.
BATCH, MOST = 30, 300


def nearest_on(points: np.ndarray, nodes: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest node of each point and its distance; -1 and infinity beyond ``radius``."""
    grid = Grid(nodes, radius)
    at, far = np.full(len(points), -1), np.full(len(points), np.inf)
    for i, p in enumerate(points):
        near = grid.within(p, radius)
        if len(near):
            d = np.linalg.norm(nodes[near] - p, axis=1)
            k = int(np.lexsort((near, d))[0])
            at[i], far[i] = near[k], d[k]
    return at, far


def extend_tip(points: np.ndarray, path: list[int], step: float, blocked: np.ndarray, support: int = 1) -> list[int]:
    """A path carried on from its tip in batches, as long as each batch adds nodes with at least ``support`` points around."""
    path = list(path)
    grid = Grid(points, step)
    while len(path) < MOST:
        taken = blocked.copy()
        taken[path] = True
        back = path[-2] if len(path) > 1 else path[-1]
        direction = points[path[-1]] - points[back]
        if not np.linalg.norm(direction):
            break
        on = grow_path(points, path[-1], direction, step, min(BATCH, MOST - len(path)), taken)[1:]
        kept = []
        for i in on:
            near = grid.within(points[i], step)
            if (~taken[near]).sum() < support:
                break
            kept.append(i)
        path += kept
        if len(kept) < min(BATCH, len(on)) or not kept:
            break
    return path


def trace_orders(points: np.ndarray, axis: list[int], spacing: float, orders: int = 3, least: int = 5, most: int | None = None) -> pd.DataFrame:
    """All branches below a main axis: root, parent, root_order, place, point (index), one row per node; the axis is root 0.

    Of each order: unowned points within NEAR spacings of the paths of the order before are clustered; from the member of
    a cluster that is nearest to its parent, paths are grown outwards with several steps and their tips extended; the
    candidates that cover most new points are taken; what lies around them is theirs. Stops when an order has no branch.
    Places are in the order of a path from its parent on. Fewer than ``least`` points around a parent give no seed.
    """
    rows = [(0, -1, 0, j, i) for j, i in enumerate(axis)]
    owned = nearest_on(points, points[axis], OWN * spacing)[0] >= 0 if len(axis) else np.zeros(len(points), bool)
    parents = {0: list(axis)} if len(axis) else {}
    number = 1
    for order in range(1, orders + 1):
        nodes = [(r, i) for r, path in parents.items() for i in path]
        open_ = np.flatnonzero(~owned)
        if not nodes or len(open_) < least:
            break
        line = points[[i for _, i in nodes]]
        at, gap = nearest_on(points[open_], line, NEAR * spacing)
        near = np.flatnonzero(at >= 0)
        if len(near) < least:
            break
        group = density_clusters(points[open_[near]], least)
        candidates: list[tuple[int, list[int]]] = []
        for c in np.unique(group[group >= 0]):
            members = near[group == c]
            s = members[np.lexsort((open_[members], gap[members]))[0]]
            seed, parent = int(open_[s]), nodes[at[s]][0]
            middle = points[open_[members]].mean(axis=0) - line[at[s]]
            out = points[seed] - line[at[s]]
            direction = out if np.linalg.norm(out) > 0 else middle
            found = []
            for steps in (STEPS, LATE_STEPS):
                for k in steps:
                    path = extend_tip(points, grow_path(points, seed, direction, k * spacing, BATCH, owned), k * spacing, owned)
                    if len(path) > 2:
                        found.append((parent, path))
                if found:
                    break
            candidates += found
        if not candidates:
            break
        supports, lengths = [], []
        for _, path in candidates:
            around, _ = nearest_on(points[open_], points[path], 2 * OWN * spacing)
            supports.append(set(open_[around >= 0].tolist()))
            lengths.append(float(np.linalg.norm(np.diff(points[path], axis=0), axis=1).sum()))
        taken = greedy_cover(supports, np.array(lengths), spacing, most=most)
        parents = {}
        for k in taken:
            parent, path = candidates[k]
            rows += [(number, parent, order, j, i) for j, i in enumerate(path)]
            parents[number] = path
            owned[list(supports[k])] = True
            number += 1
        if not parents:
            break
    return pd.DataFrame(rows, columns=["root", "parent", "root_order", "place", "point"])


def assign_points(points: np.ndarray, traced: pd.DataFrame, spacing: float) -> np.ndarray:
    """The root of each point by the nearest node of all paths within twice OWN spacings; -1 for none."""
    if not len(traced):
        return np.full(len(points), -1)
    at, _ = nearest_on(points, points[traced["point"].to_numpy()], 2 * OWN * spacing)
    return np.where(at >= 0, traced["root"].to_numpy()[np.maximum(at, 0)], -1)
