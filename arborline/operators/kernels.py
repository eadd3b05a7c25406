"""Algorithms that are sequential within one specimen, as NumPy kernels, and the grouped maps that run them side by side.

A specimen is one group of ``grouped``; it must fit a task (these are meshes of up to some million points). Inputs are
sorted inside the kernels, since the rows of a group come in no order.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def grouped(df: DataFrame, by: str, kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``kernel`` on each group; its result gets the group's key in front. ``schema``: the kernel's columns."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = kernel(pdf)
        out.insert(0, by, key[0])
        return out

    return df.groupBy(by).applyInPandas(run, f"{by} {df.schema[by].dataType.simpleString()}, {schema}")


class Grid:
    """Points in cells; finds all within a radius up to the cell width, or the k nearest."""

    def __init__(self, points: np.ndarray, width: float) -> None:
        self.points, self.width = points, width
        cells = np.floor(points / width).astype(np.int64)
        self.cells: dict[tuple, list[int]] = {}
        for i, c in enumerate(map(tuple, cells)):
            self.cells.setdefault(c, []).append(i)

    def around(self, p: np.ndarray, reach: int = 1) -> np.ndarray:
        x, y, z = np.floor(p / self.width).astype(np.int64)
        span = range(-reach, reach + 1)
        return np.array([i for a in span for b in span for c in span for i in self.cells.get((x + a, y + b, z + c), ())], np.int64)

    def within(self, p: np.ndarray, radius: float) -> np.ndarray:
        near = self.around(p, int(np.ceil(radius / self.width)))
        return near[np.linalg.norm(self.points[near] - p, axis=1) <= radius] if len(near) else near


def _cells_of(points: np.ndarray, low: np.ndarray, width: float) -> tuple[np.ndarray, tuple[int, int]]:
    """One number per cell; neighbours along the last axis are consecutive."""
    c = np.floor((points - low) / width).astype(np.int64) + 1
    span = c.max(axis=0) + 2
    return (c[:, 0] * span[1] + c[:, 1]) * span[2] + c[:, 2], (int(span[1] * span[2]), int(span[2]))


def nearest_neighbours(points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest others of each point (ties by position): indices and distances.

    Points are sorted into cells that hold some k of them where any are; those of a cell look in the 27 cells around. A
    point whose k nearest are no farther than a cell's width is done, since none nearer can lie outside; the others look
    again in cells twice as wide. Time grows with the points, not with their square.
    """
    n = len(points)
    k = min(k, max(0, n - 1))
    index, distance = np.empty((n, k), np.int64), np.empty((n, k))
    if k == 0:
        return index, distance
    low, sides = points.min(axis=0), np.ptp(points, axis=0)
    whole = float(max(sides.max(), 1e-12))
    width = whole
    while width > whole * 2**-19:
        cell, _ = _cells_of(points, low, width / 2)
        if n / len(np.unique(cell)) < k:
            break
        width /= 2
    open_ = np.arange(n)
    while len(open_):
        cell, (sx, sy) = _cells_of(points, low, width)
        order = np.argsort(cell, kind="stable")
        keys, start = np.unique(cell[order], return_index=True)
        stop = np.r_[start[1:], n]
        asked = np.zeros(n, bool)
        asked[open_] = True
        rows = [x * sx + y * sy for x in (-1, 0, 1) for y in (-1, 0, 1)]
        late = []
        for key in np.unique(cell[open_]):
            own = order[start[np.searchsorted(keys, key)] : stop[np.searchsorted(keys, key)]]
            own = own[asked[own]]
            at = np.searchsorted(keys, [key + r - 1 for r in rows]), np.searchsorted(keys, [key + r + 1 for r in rows], "right")
            around = np.sort(np.concatenate([order[start[i] : stop[j - 1]] for i, j in zip(*at) if j > i]))
            if len(around) <= k and width < whole:
                late.append(own)
                continue
            for z in range(0, len(own), max(1, 4_000_000 // len(around))):
                q = own[z : z + max(1, 4_000_000 // len(around))]
                d = np.sqrt(((points[q, None] - points[around][None]) ** 2).sum(axis=2))
                d[q[:, None] == around[None]] = np.inf
                near = np.argsort(d, axis=1, kind="stable")[:, :k]
                index[q], distance[q] = around[near], np.take_along_axis(d, near, 1)
                short = distance[q, -1] > width
                if width < whole and short.any():
                    late.append(q[short])
        open_ = np.concatenate(late) if late else np.zeros(0, np.int64)
        width *= 2
    return index, distance


def neighbour_graph(points: np.ndarray, k: int = 14, radius: float | None = None) -> list[dict[int, float]]:
    """The symmetric graph of k nearest neighbours, optionally without edges beyond a radius."""
    index, distance = nearest_neighbours(points, k)
    graph: list[dict[int, float]] = [{} for _ in points]
    for i, (near, far) in enumerate(zip(index.tolist(), distance.tolist())):
        for j, d in zip(near, far):
            if radius is None or d <= radius:
                graph[i][j] = graph[j][i] = d
    return graph


def shortest_paths(graph: list[dict[int, float]], sources: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Dijkstra from the nearest of several sources: distances and predecessors (-1: none)."""
    best, before = np.full(len(graph), np.inf), np.full(len(graph), -1)
    heap = [(0.0, s) for s in sorted(sources)]
    best[sources] = 0.0
    while heap:
        d, u = heapq.heappop(heap)
        if d > best[u]:
            continue
        for v, w in graph[u].items():
            if d + w < best[v]:
                best[v], before[v] = d + w, u
                heapq.heappush(heap, (d + w, v))
    return best, before


def path_between(points: np.ndarray, start: int, end: int, k: int = 14, tries: int = 4) -> list[int]:
    """The shortest path over the neighbour graph; if there is none, with twice the neighbours, up to four times."""
    for t in range(tries):
        best, before = shortest_paths(neighbour_graph(points, k * 2**t), [start])
        if np.isfinite(best[end]):
            path = [end]
            while before[path[-1]] >= 0:
                path.append(int(before[path[-1]]))
            return path[::-1]
    return []


def density_clusters(points: np.ndarray, min_size: int = 5, min_samples: int | None = None) -> np.ndarray:
    """Density clusters of stable extent (HDBSCAN, Campello et al. 2013); -1 is noise, few points are one cluster."""
    n = len(points)
    if n < 2 * min_size:
        return np.zeros(n, int)
    core = nearest_neighbours(points, min_samples or min_size)[1][:, -1]
    # Minimum spanning tree of mutual reachability (Prim).
    left, reach, parent = np.ones(n, bool), np.full(n, np.inf), np.zeros(n, int)
    u, tree = 0, []
    for _ in range(n - 1):
        left[u] = False
        d = np.maximum(np.maximum(np.linalg.norm(points - points[u], axis=1), core), core[u])
        closer = left & (d < reach)
        reach[closer], parent[closer] = d[closer], u
        v = int(np.where(left, reach, np.inf).argmin())
        tree.append((reach[v], parent[v], v))
        u = v
    # Single-linkage merges from short to long; each merge is a node n, n + 1, ...
    root, size, kids, height = list(range(2 * n - 1)), [1] * n + [0] * (n - 1), {}, {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k, (d, a, b) in enumerate(sorted(tree)):
        a, b, m = find(a), find(b), n + k
        root[a] = root[b] = m
        size[m], kids[m], height[m] = size[a] + size[b], (a, b), d

    def leaves(x: int) -> list[int]:
        out, todo = [], [x]
        while todo:
            y = todo.pop()
            todo += kids[y] if y in kids else []
            if y < n:
                out.append(y)
        return out

    # Condense: a cluster lives from the level at which it splits off to the level at which it splits or fades.
    clusters: list[dict] = [{"birth": 0.0, "up": -1, "stability": 0.0, "members": [], "split": []}]
    todo = [(2 * n - 2, 0)]
    while todo:
        node, c = todo.pop()
        while node in kids:
            level = 1 / max(height[node], 1e-300)
            big = [x for x in kids[node] if size[x] >= min_size]
            if len(big) == 2:
                clusters[c]["stability"] += size[node] * (level - clusters[c]["birth"])
                for x in big:
                    clusters.append({"birth": level, "up": c, "stability": 0.0, "members": leaves(x), "split": []})
                    clusters[c]["split"].append(len(clusters) - 1)
                    todo.append((x, len(clusters) - 1))
                node = -1
                break
            fallen = sum(size[x] for x in kids[node] if x not in big)
            clusters[c]["stability"] += (fallen if big else size[node]) * (level - clusters[c]["birth"])
            if not big:
                node = -1
                break
            node = big[0]
    clusters[0]["members"] = list(range(n))
    chosen, value = {}, {}
    for c in range(len(clusters) - 1, -1, -1):
        below = sum(value[x] for x in clusters[c]["split"])
        own = clusters[c]["stability"]
        chosen[c] = not clusters[c]["split"] or own >= below
        value[c] = max(own, below) if clusters[c]["split"] else own
    labels, todo, number = np.full(n, -1), [0], 0
    while todo:
        c = todo.pop()
        if chosen[c]:
            labels[clusters[c]["members"]] = number
            number += 1
        else:
            todo += reversed(clusters[c]["split"])
    return labels


def hull_2d(points: np.ndarray) -> np.ndarray:
    """The convex hull in the plane, counter-clockwise (monotone chain)."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def half(q: np.ndarray) -> list:
        out: list = []
        for x in q:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (x[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (x[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(x)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def hull_width(points: np.ndarray) -> float:
    """The greatest distance between two points of the plane, over the hull."""
    h = hull_2d(points)
    return float(np.linalg.norm(h[:, None] - h[None], axis=2).max()) if len(h) else 0.0


def hull_volume(points: np.ndarray) -> float:
    """The volume of the convex hull (incremental; 0 for flat sets)."""
    p = np.unique(points, axis=0)
    if len(p) < 4:
        return 0.0
    scale = float(np.ptp(p, axis=0).max())
    eps = 1e-10 * scale**3
    a = 0
    b = int(np.linalg.norm(p - p[a], axis=1).argmax())
    c = int(np.linalg.norm(np.cross(p - p[a], p[b] - p[a]), axis=1).argmax())
    side = (p - p[a]) @ np.cross(p[b] - p[a], p[c] - p[a])
    d = int(np.abs(side).argmax())
    if abs(side[d]) <= eps:
        return 0.0
    inner = p[[a, b, c, d]].mean(0)
    faces: set[tuple[int, int, int]] = set()

    def outward(i: int, j: int, k: int) -> tuple[int, int, int]:
        return (i, j, k) if np.dot(np.cross(p[j] - p[i], p[k] - p[i]), inner - p[i]) < 0 else (i, k, j)

    for t in ((a, b, c), (a, b, d), (a, c, d), (b, c, d)):
        faces.add(outward(*t))
    for q in np.argsort(-np.linalg.norm(p - inner, axis=1)).tolist():
        f = np.array(list(faces))
        seen = np.einsum("ij,ij->i", np.cross(p[f[:, 1]] - p[f[:, 0]], p[f[:, 2]] - p[f[:, 0]]), p[q] - p[f[:, 0]]) > eps
        if not seen.any():
            continue
        edges = {}
        for i, j, k in f[seen].tolist():
            for u, v in ((i, j), (j, k), (k, i)):
                if (v, u) in edges:
                    del edges[v, u]
                else:
                    edges[u, v] = True
        faces -= set(map(tuple, f[seen].tolist()))
        faces |= {(u, v, q) for u, v in edges}
    f = np.array(list(faces))
    return float(np.einsum("ij,ij->i", p[f[:, 0]] - inner, np.cross(p[f[:, 1]] - inner, p[f[:, 2]] - inner)).sum() / 6)


def farthest_points(points: np.ndarray, count: int) -> list[int]:
    """Landmarks: the lowest point first, then always the one farthest from those chosen (ties: the first)."""
    if not len(points):
        return []
    out = [int(np.lexsort((np.arange(len(points)), points[:, 2]))[0])]
    gap = np.linalg.norm(points - points[out[0]], axis=1)
    while len(out) < min(count, len(points)) and gap.max() > 0:
        out.append(int(gap.argmax()))
        gap = np.minimum(gap, np.linalg.norm(points - points[out[-1]], axis=1))
    return out


def spread_out(points: np.ndarray, order: np.ndarray, count: int, separation: float) -> list[int]:
    """The first ``count`` points of an order that keep a distance from all accepted before."""
    out: list[int] = []
    for i in order:
        if len(out) == count:
            break
        if not out or np.linalg.norm(points[out] - points[i], axis=1).min() >= separation:
            out.append(int(i))
    return out


# Fixed values that make results comparable with published ones. Cover: price of a point that is already covered, worth of
# length as it stands and in spacings. Growth: weights of turn, density and distance; reach, least travel and passed progress in
# steps, greatest turn in degrees, share of the old direction that is kept.
OVERLAP, LENGTH, LENGTH_IN_SPACINGS = 1.25, 10.0, 0.35
TURN, DENSITY, DISTANCE = 0.57, 0.20, 0.15
REACH, TRAVEL, PASSED, WIDEST, KEPT = 2.2, 0.375, 0.29, 100.0, 0.75


def greedy_cover(supports: list[set[int]], lengths: np.ndarray, spacing: float, penalty: float = OVERLAP, most: int | None = None) -> list[int]:
    """Weighted greedy cover: take the candidate of the greatest new support less ``penalty`` times its overlap, plus its
    length terms, until none is worth more than nothing. Ties go to the first.

    A candidate's worth only falls as others are taken, so it is counted again only when it comes to the head of the queue.
    """
    used: set[int] = set()
    out: list[int] = []

    def worth(i: int) -> float:
        new = len(supports[i] - used)
        return new - penalty * (len(supports[i]) - new) + LENGTH * lengths[i] + LENGTH_IN_SPACINGS * lengths[i] / spacing if new else -math.inf

    queue = [(-worth(i), i, 0) for i in range(len(supports))]
    heapq.heapify(queue)
    while queue and (most is None or len(out) < most):
        value, i, taken = heapq.heappop(queue)
        if value >= 0:
            break
        if taken < len(out):
            heapq.heappush(queue, (-worth(i), i, len(out)))
            continue
        out.append(i)
        used |= supports[i]
    return out


def principal_axes(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variances from great to small, and their directions as rows."""
    if len(points) < 2:
        return np.zeros(3), np.eye(3)
    w, v = np.linalg.eigh(np.cov(points.T, bias=True))
    return w[::-1], v[:, ::-1].T


def weighted_quantile(values: np.ndarray, weights: np.ndarray, share: float) -> float:
    """The least value at which the summed weights reach the share."""
    order = np.argsort(values, kind="stable")
    sums = np.cumsum(weights[order])
    return float(values[order][np.searchsorted(sums, share * sums[-1])]) if len(values) and sums[-1] > 0 else float("nan")


def geometric_median(points: np.ndarray, weights: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Weiszfeld's iteration."""
    x = np.average(points, axis=0, weights=weights)
    for _ in range(rounds):
        w = weights / np.maximum(np.linalg.norm(points - x, axis=1), 1e-12)
        new = (points * w[:, None]).sum(0) / w.sum()
        if np.linalg.norm(new - x) < 1e-12:
            break
        x = new
    return x


def circle_center(points: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, float]:
    """Least-squares circle through weighted points of the plane: centre and radius."""
    a = np.c_[2 * points, np.ones(len(points))] * weights[:, None]
    b = (points**2).sum(1) * weights
    s = np.linalg.lstsq(a, b, rcond=None)[0]
    return s[:2], float(np.sqrt(max(0.0, s[2] + s[0] ** 2 + s[1] ** 2)))


def grow_path(points: np.ndarray, start: int, direction: np.ndarray, step: float, steps: int = 80, blocked: np.ndarray | None = None) -> list[int]:
    """A path that steps from point to point within a cone, until nothing new lies ahead.

    Candidates lie within 2.2 steps at a turn of at most 100 degrees and at least 0.375 steps away; the score weighs turn,
    local density and distance; points passed (within 0.9 steps and not ahead) are not used again.
    """
    grid = Grid(points, REACH * step)
    covered = np.zeros(len(points), bool) if blocked is None else blocked.copy()
    covered[start] = True
    path, d = [start], direction / max(np.linalg.norm(direction), 1e-12)
    for _ in range(steps):
        p = points[path[-1]]
        near = grid.within(p, REACH * step)
        near = near[~covered[near]]
        v = points[near] - p
        far = np.linalg.norm(v, axis=1)
        ok = far >= TRAVEL * step
        near, v, far = near[ok], v[ok], far[ok]
        if not len(near):
            break
        cosine = v @ d / far
        ok = cosine >= np.cos(np.radians(WIDEST))
        near, v, far, cosine = near[ok], v[ok], far[ok], cosine[ok]
        if not len(near):
            break
        dense = np.array([len(grid.within(points[i], 0.75 * step)) for i in near], float)
        spread = np.ptp(dense)
        dense = (dense - dense.min()) / spread if spread > 0 else np.full(len(dense), 0.5)
        score = TURN * cosine + DENSITY * dense - DISTANCE * np.abs(far - step) / step
        k = int(np.lexsort((near, -score))[0])
        axis = v[k] / far[k]
        passed = grid.within(p, 0.9 * REACH * step)
        covered[passed[(points[passed] - p) @ axis <= PASSED * step]] = True
        path.append(int(near[k]))
        covered[near[k]] = True
        d = KEPT * d + (1 - KEPT) * axis
        d /= max(np.linalg.norm(d), 1e-12)
    return path


def rank_primaries(points: np.ndarray, k: int = 8, count: int = 5) -> pd.DataFrame:
    """Candidate main axes from low collars to tips, ranked: start, end, length, down, straight, score, rank.

    Ends are landmarks; the score weighs descent, length, straightness and how central the path is, each scaled to 0..1
    over the candidates.
    """
    marks = farthest_points(points, count + 1)
    top = int(np.lexsort((np.arange(len(points)), -points[:, 2]))[0])
    best, before = shortest_paths(neighbour_graph(points, k), [top])
    rows = []
    for m in marks:
        if m == top or not np.isfinite(best[m]):
            continue
        path = [m]
        while before[path[-1]] >= 0:
            path.append(int(before[path[-1]]))
        line = points[path]
        chord = float(np.linalg.norm(line[0] - line[-1]))
        rows.append((top, m, float(best[m]), float(points[top, 2] - points[m, 2]), chord / max(best[m], 1e-12), -float(np.abs(line[:, :2] - points[:, :2].mean(0)).mean())))
    out = pd.DataFrame(rows, columns=["start", "end", "length", "down", "straight", "central"])
    scaled = {c: (out[c] - out[c].min()) / np.ptp(out[c]) if len(out) and np.ptp(out[c]) > 0 else 0.5 for c in ("length", "down", "straight", "central")}
    out["score"] = 0.35 * scaled["down"] + 0.3 * scaled["length"] + 0.15 * scaled["straight"] + 0.2 * scaled["central"]
    out = out.sort_values(["score", "end"], ascending=[False, True], kind="stable").reset_index(drop=True)
    out["rank"] = np.arange(1, len(out) + 1)
    return out.drop(columns="central")


def descend(unary: np.ndarray, edges: np.ndarray, start: np.ndarray, weight: float, sweeps: int = 50) -> np.ndarray:
    """Labels of least energy by coordinate descent in index order: unary costs plus ``weight`` per edge between labels.

    A patch keeps its label unless another is strictly better by more than 1e-9 and alone in that.
    """
    labels = start.copy()
    links: list[list[int]] = [[] for _ in labels]
    for u, v in edges.tolist():
        links[u].append(v)
        links[v].append(u)
    for _ in range(sweeps):
        changed = False
        for i in range(len(labels)):
            cost = unary[i].copy()
            for j in links[i]:
                cost += weight
                cost[labels[j]] -= weight
            k = int(cost.argmin())
            tied = (np.abs(cost - cost[k]) <= 1e-9).sum() > 1
            if cost[k] < cost[labels[i]] - 1e-9 and not tied:
                labels[i], changed = k, True
        if not changed:
            break
    return labels
