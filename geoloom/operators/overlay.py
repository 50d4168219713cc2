"""Union and repair of polygons, and rings from open ways.

Union: polygons, outer rings counter-clockwise and holes clockwise, are dealt to the grid cells their boxes touch. In a cell all edges are
cut where they meet each other and at the cell's border lines, and each piece belongs to the one cell its middle lies in, so seams cancel
without clipping. A ray from a piece's middle gives the winding number on either side; pieces with cover on one side only are the union's
boundary. What is left of coincident pieces is their difference. Areas are sums over the pieces; rings are chained per connected
boundary. Equal polygons count once. The cell size defaults to that of the spatial joins. A crowded cell is cut into four until few edges are left in it; a
part that lies under a polygon as a whole has no boundary and is left out, so deep cover costs no crossings.

Repair does the same for one polygon under the even-odd rule: crossings become vertices, spikes vanish, loops become parts of their own.

Places are snapped to SNAP metres, below which nothing is told apart.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geometry as geo
from geoloom.operators import network
from geoloom.operators.spatial import cell_size, with_cells

SNAP = 1e-6
#: Pairs of edges that are compared at once.
_PAIRS = 4_000_000
#: Edges that a cell may hold uncut, and how often it is cut into four at most.
_CROWD, _DEPTH = 64, 16


def _snap(a: np.ndarray) -> np.ndarray:
    return np.round(np.asarray(a, float) / SNAP) * SNAP


def _signed(ring: np.ndarray) -> float:
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def _open(ring) -> np.ndarray:
    """Snapped corners without repeats, not closed."""
    r = _snap([(p["x"], p["y"]) for p in ring]).reshape(-1, 2)
    keep = np.any(r != np.roll(r, 1, axis=0), axis=1) if len(r) > 1 else np.zeros(len(r), bool)
    return r[keep]


def _edges(rings, turned: bool) -> np.ndarray:
    """(x0, y0, x1, y1) of all edges; turned: outer ring counter-clockwise, the others clockwise."""
    out = []
    for k, ring in enumerate(rings):
        r = _open(ring)
        if len(r) < 2:
            continue
        if turned and (_signed(r) > 0) != (k == 0):
            r = r[::-1]
        out.append(np.hstack([r, np.roll(r, -1, axis=0)]))
    return np.vstack(out) if out else np.zeros((0, 4))


def _cuts(e: np.ndarray, lines: tuple[float, float, float, float] | None) -> np.ndarray:
    """The edges cut at each other, at corners that lie on them and at the lines (x0, y0, x1, y1); each piece with its edge's direction."""
    n = len(e)
    a, d = e[:, :2], e[:, 2:] - e[:, :2]
    length = np.hypot(d[:, 0], d[:, 1])
    at: list[list[np.ndarray]] = [[e[i, :2], e[i, 2:]] for i in range(n)]
    step = max(1, _PAIRS // max(n, 1))
    low, high = np.minimum(e[:, :2], e[:, 2:]) - 2 * SNAP, np.maximum(e[:, :2], e[:, 2:]) + 2 * SNAP
    for s in range(0, n, step):
        i = np.arange(s, min(n, s + step))
        near = (low[i, None, 0] <= high[None, :, 0]) & (low[None, :, 0] <= high[i, None, 0]) & (low[i, None, 1] <= high[None, :, 1]) & (low[None, :, 1] <= high[i, None, 1])
        p, q = np.nonzero(near)
        p = i[p]
        p, q = p[p != q], q[p != q]
        w = a[q] - a[p]
        cross = d[p, 0] * d[q, 1] - d[p, 1] * d[q, 0]
        # Corners of q on p.
        off = np.abs(d[p, 0] * w[:, 1] - d[p, 1] * w[:, 0]) / length[p]
        along = (d[p, 0] * w[:, 0] + d[p, 1] * w[:, 1]) / length[p]
        for k in np.flatnonzero((off <= 1.5 * SNAP) & (along > SNAP) & (along < length[p] - SNAP)):
            at[p[k]].append(e[q[k], :2])
        # Proper crossings, once a pair; the point serves both edges.
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (w[:, 0] * d[q, 1] - w[:, 1] * d[q, 0]) / cross
            u = (w[:, 0] * d[p, 1] - w[:, 1] * d[p, 0]) / cross
        hit = (p < q) & (np.abs(cross) > 1e-12 * length[p] * length[q]) & (t * length[p] > SNAP) & (t * length[p] < length[p] - SNAP) & (u * length[q] > SNAP) & (u * length[q] < length[q] - SNAP)
        for k in np.flatnonzero(hit):
            point = _snap(a[p[k]] + t[k] * d[p[k]])
            at[p[k]].append(point)
            at[q[k]].append(point)
    if lines is not None:
        for axis, value in ((0, lines[0]), (1, lines[1]), (0, lines[2]), (1, lines[3])):
            for k in np.flatnonzero((np.minimum(e[:, axis], e[:, axis + 2]) < value) & (np.maximum(e[:, axis], e[:, axis + 2]) > value)):
                # Along the edge from its smaller end, so that the same line cuts both directions in the same place.
                ends = e[k].reshape(2, 2)
                one, two = ends[np.lexsort((ends[:, 1], ends[:, 0]))]
                point = one + (value - one[axis]) / (two[axis] - one[axis]) * (two - one)
                point[axis] = value
                at[k].append(_snap(point))
    pieces = []
    for k in range(n):
        points = np.array(at[k])
        order = np.argsort((points - a[k]) @ d[k], kind="stable")
        points = points[order]
        moved = np.any(points[1:] != points[:-1], axis=1)
        pieces.append(np.hstack([points[:-1][moved], points[1:][moved]]))
    return np.vstack(pieces) if pieces else np.zeros((0, 4))


def _edges_of(column: pa.Array) -> list[np.ndarray]:
    """_edges(rings, False) of each polygon in a column."""
    rings = column.flatten()
    points, polygon, ring = rings.flatten(), pc.list_parent_indices(column).to_numpy(), pc.list_parent_indices(rings).to_numpy()
    p = _snap(np.stack([points.field(k).to_numpy(zero_copy_only=False) for k in range(2)], axis=1)) if len(points) else np.zeros((0, 2))

    def beside(ring: np.ndarray, step: int) -> np.ndarray:
        """Each point's next one or the one before in its ring."""
        first = np.searchsorted(ring, ring)
        return first + (np.arange(len(ring)) - first + step) % (np.searchsorted(ring, ring, "right") - first)

    keep = np.any(p != p[beside(ring, -1)], axis=1)
    p, ring = p[keep], ring[keep]
    e, owner = np.hstack([p, p[beside(ring, 1)]]), polygon[ring] if len(ring) else np.zeros(0, int)
    return np.split(e, np.cumsum(np.bincount(owner, minlength=len(column)))[:-1]) if len(column) else []


def _touch(e: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """Which edges may come as near to the box as a few SNAP."""
    gap = 8 * SNAP
    x0, y0, x1, y1 = box[0] - gap, box[1] - gap, box[2] + gap, box[3] + gap
    hit = (np.minimum(e[:, 0], e[:, 2]) <= x1) & (np.maximum(e[:, 0], e[:, 2]) >= x0) & (np.minimum(e[:, 1], e[:, 3]) <= y1) & (np.maximum(e[:, 1], e[:, 3]) >= y0)
    # Nor with all corners of the box on one side of the edge's line.
    d = e[:, 2:] - e[:, :2]
    sides = np.stack([d[:, 0] * (y - e[:, 1]) - d[:, 1] * (x - e[:, 0]) for x in (x0, x1) for y in (y0, y1)])
    return hit & (sides.min(axis=0) <= 0) & (sides.max(axis=0) >= 0)


def _turns_once(e: np.ndarray) -> bool:
    """Whether a polygon's edges are one convex ring, so that it winds 0 or 1 times around any place."""
    d = e[:, 2:] - e[:, :2]
    n = np.roll(d, -1, axis=0)
    turn = np.arctan2(d[:, 0] * n[:, 1] - d[:, 1] * n[:, 0], (d * n).sum(axis=1))
    return bool((e[:, 2:] == np.roll(e[:, :2], -1, axis=0)).all() and (turn >= 0).all() and abs(turn.sum() - 2 * np.pi) < 1e-6)


def parts_of(polygons: list[np.ndarray], box: tuple[float, float, float, float]) -> Iterator[tuple[tuple[float, float, float, float], np.ndarray, np.ndarray, int]]:
    """(part of the box, edges in it, all edges of polygons with an edge in it, how often the other polygons wind around it), without parts that are covered for sure.

    Parts are quarters of quarters, so their lines are the same whatever the polygons are.
    """
    polygons = [p for p in polygons if len(p)]
    if not polygons:
        return
    e, size = np.vstack(polygons), np.array([len(p) for p in polygons])
    owner, start = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
    # How far below 0 a polygon may wind, at most.
    below = np.array([0 if _turns_once(p) else len(p) // 2 for p in polygons])
    todo = [(box, np.arange(len(size)), np.arange(len(e)), 0, 0)]
    while todo:
        part, mine, near, base, depth = todo.pop()
        near = near[_touch(e[near], part)]
        active = np.unique(owner[near])
        gone = np.setdiff1d(mine, active, assume_unique=True)
        if len(gone):
            f = e[np.repeat(start[gone], size[gone]) + np.arange(size[gone].sum()) - np.repeat(np.cumsum(size[gone]) - size[gone], size[gone])]
            x, y = (part[0] + part[2]) / 2, (part[1] + part[3]) / 2
            f = f[(f[:, 1] <= y) != (f[:, 3] <= y)]
            right = f[:, 0] + (y - f[:, 1]) / (f[:, 3] - f[:, 1]) * (f[:, 2] - f[:, 0]) > x
            base += int(np.where(f[:, 3] > f[:, 1], 1, -1)[right].sum())
        if not len(active) or base > below[active].sum():
            continue
        if len(near) <= _CROWD or depth == _DEPTH:
            every = np.repeat(start[active], size[active]) + np.arange(size[active].sum()) - np.repeat(np.cumsum(size[active]) - size[active], size[active])
            yield part, e[near], e[every], base
            continue
        mx, my = float(_snap((part[0] + part[2]) / 2)), float(_snap((part[1] + part[3]) / 2))
        for quarter in ((part[0], part[1], mx, my), (mx, part[1], part[2], my), (part[0], my, mx, part[3]), (mx, my, part[2], part[3])):
            todo.append((quarter, active, near, base, depth + 1))


def boundary(e: np.ndarray, rule: str, lines: tuple[float, float, float, float] | None = None, every: np.ndarray | None = None, base: int = 0) -> np.ndarray:
    """Directed pieces, cover on their left, that part what is covered (winding over 0, or odd) from what isn't.

    `every` are the edges that wind around places, if e are only those near the lines; `base` is added to what they wind.
    """
    if not len(e):
        return np.zeros((0, 4))
    pieces = _cuts(e, lines)
    if lines is not None:
        middle = (pieces[:, :2] + pieces[:, 2:]) / 2
        pieces = pieces[(middle[:, 0] >= lines[0]) & (middle[:, 0] < lines[2]) & (middle[:, 1] >= lines[1]) & (middle[:, 1] < lines[3])]
    back = (pieces[:, 0] > pieces[:, 2]) | ((pieces[:, 0] == pieces[:, 2]) & (pieces[:, 1] > pieces[:, 3]))
    forward = np.where(back[:, None], pieces[:, [2, 3, 0, 1]], pieces)
    names, at = np.unique(np.round(forward / SNAP).astype(np.int64), axis=0, return_inverse=True)
    net = np.bincount(at.ravel(), np.where(back, -1, 1), len(names)).astype(int)
    names, net = names[net != 0] * SNAP, net[net != 0]
    covered = (lambda w: w + base > 0) if rule == "positive" else (lambda w: (w + base) % 2 != 0)
    e, out = e if every is None else every, []
    for (x0, y0, x1, y1), n in zip(names, net, strict=True):
        mx, my, flat = (x0 + x1) / 2, (y0 + y1) / 2, abs(x1 - x0) >= abs(y1 - y0)
        # Along the axis on which the piece is shorter: crossings beyond the piece, without those that run along it.
        v, u = (0, 1) if flat else (1, 0)
        p, q = (mx, my) if flat else (my, mx)
        over = (e[:, v] <= p) != (e[:, v + 2] <= p)
        f = e[over]
        where = f[:, u] + (p - f[:, v]) / (f[:, v + 2] - f[:, v]) * (f[:, u + 2] - f[:, u])
        rising = np.where(f[:, v + 2] > f[:, v], 1, -1) * (-1 if flat else 1)
        far = int(rising[where > q + 3 * SNAP].sum())
        own = n * (-1 if flat else (1 if y1 > y0 else -1))
        near = far + own
        # flat: `far` is the side above; the piece runs to the right, so above is on its left. Else `far` is the side to the right.
        left, right = (far, near) if flat else ((near, far) if y1 > y0 else (far, near))
        if covered(left) != covered(right):
            out.append((x0, y0, x1, y1) if covered(left) else (x1, y1, x0, y0))
    return np.array(out).reshape(-1, 4)


def _each(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, place within it) of items that have so many places each."""
    which = np.repeat(np.arange(len(count)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)


def odd_boundaries(polygons: list[np.ndarray]) -> list[np.ndarray]:
    """boundary(e, "odd") of each polygon's edges; small polygons many at a time, with the same steps and results."""
    out: list[np.ndarray] = [np.zeros((0, 4))] * len(polygons)
    small: list[int] = []
    pairs = 0
    for k, e in enumerate(polygons):
        if len(e) > _CROWD:
            out[k] = boundary(e, "odd")
        elif len(e):
            small.append(k)
            pairs += len(e) ** 2
        if small and (pairs >= _PAIRS // 20 or k == len(polygons) - 1):
            for i, got in zip(small, _odd([polygons[i] for i in small]), strict=True):
                out[i] = got
            small, pairs = [], 0
    return out


def _odd(polygons: list[np.ndarray]) -> list[np.ndarray]:
    size = np.array([len(e) for e in polygons])
    e, owner, start = np.vstack(polygons), np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
    a, d = e[:, :2], e[:, 2:] - e[:, :2]
    length = np.hypot(d[:, 0], d[:, 1])
    low, high = np.minimum(e[:, :2], e[:, 2:]) - 2 * SNAP, np.maximum(e[:, :2], e[:, 2:]) + 2 * SNAP
    p, q = _each(size[owner])
    q = q + start[owner[p]]
    near = (p != q) & (low[p, 0] <= high[q, 0]) & (low[q, 0] <= high[p, 0]) & (low[p, 1] <= high[q, 1]) & (low[q, 1] <= high[p, 1])
    p, q = p[near], q[near]
    w = a[q] - a[p]
    cross = d[p, 0] * d[q, 1] - d[p, 1] * d[q, 0]
    off, along = np.abs(d[p, 0] * w[:, 1] - d[p, 1] * w[:, 0]) / length[p], (d[p, 0] * w[:, 0] + d[p, 1] * w[:, 1]) / length[p]
    on = (off <= 1.5 * SNAP) & (along > SNAP) & (along < length[p] - SNAP)
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = (w[:, 0] * d[q, 1] - w[:, 1] * d[q, 0]) / cross, (w[:, 0] * d[p, 1] - w[:, 1] * d[p, 0]) / cross
    hit = (p < q) & (np.abs(cross) > 1e-12 * length[p] * length[q]) & (t * length[p] > SNAP) & (t * length[p] < length[p] - SNAP) & (u * length[q] > SNAP) & (u * length[q] < length[q] - SNAP)
    point = _snap(a[p[hit]] + t[hit, None] * d[p[hit]])
    edge = np.concatenate([np.arange(len(e)), np.arange(len(e)), p[on], p[hit], q[hit]])
    points = np.vstack([e[:, :2], e[:, 2:], e[q[on], :2], point, point])
    order = np.lexsort((((points - a[edge]) * d[edge]).sum(axis=1), edge))
    edge, points = edge[order], points[order]
    moved = (edge[1:] == edge[:-1]) & np.any(points[1:] != points[:-1], axis=1)
    pieces, of = np.hstack([points[:-1][moved], points[1:][moved]]), owner[edge[:-1][moved]]
    back = (pieces[:, 0] > pieces[:, 2]) | ((pieces[:, 0] == pieces[:, 2]) & (pieces[:, 1] > pieces[:, 3]))
    names = np.round(np.where(back[:, None], pieces[:, [2, 3, 0, 1]], pieces) / SNAP).astype(np.int64)
    order = np.lexsort((names[:, 3], names[:, 2], names[:, 1], names[:, 0], of))
    names, of, turn = names[order], of[order], np.where(back, -1, 1)[order]
    new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | np.any(names[1:] != names[:-1], axis=1)])) if len(of) else np.zeros(0, int)
    net = np.add.reduceat(turn, new) if len(new) else np.zeros(0, int)
    new, net = new[net != 0], net[net != 0]
    f, of = names[new] * SNAP, of[new]
    x0, y0, x1, y1 = f.T
    flat = np.abs(x1 - x0) >= np.abs(y1 - y0)
    place, mate = _each(size[of])
    g = e[mate + start[of[place]]]
    level = flat[place]
    gv, gu, hv, hu = (np.where(level, g[:, i], g[:, j]) for i, j in ((0, 1), (1, 0), (2, 3), (3, 2)))
    across, beyond = np.where(flat, (x0 + x1) / 2, (y0 + y1) / 2)[place], np.where(flat, (y0 + y1) / 2, (x0 + x1) / 2)[place]
    over = (gv <= across) != (hv <= across)
    with np.errstate(divide="ignore", invalid="ignore"):
        where = gu + (across - gv) / (hv - gv) * (hu - gu)
    rising = np.where(hv > gv, 1, -1) * np.where(level, -1, 1)
    far = np.bincount(place, np.where(over & (where > beyond + 3 * SNAP), rising, 0), len(f)).astype(int)
    beside = far + net * np.where(flat, -1, np.where(y1 > y0, 1, -1))
    left, right = np.where(flat | ~(y1 > y0), far, beside), np.where(flat | ~(y1 > y0), beside, far)
    keep = (left % 2 != 0) != (right % 2 != 0)
    f = np.where((left % 2 != 0)[:, None], f, f[:, [2, 3, 0, 1]])[keep]
    return np.split(f, np.cumsum(np.bincount(of[keep], minlength=len(size)))[:-1])


def chain(pieces: np.ndarray) -> list[np.ndarray]:
    """Closed rings of directed pieces; where several leave a corner, the sharpest turn to the left is taken, so that rings don't cross or touch themselves."""
    keys = [tuple(k) for k in np.round(np.asarray(pieces, float) / SNAP).astype(np.int64).tolist()]
    leave: dict[tuple[int, int], list[int]] = defaultdict(list)
    for k, key in enumerate(keys):
        leave[key[:2]].append(k)
    used, rings = [False] * len(pieces), []
    for start in range(len(pieces)):
        if used[start]:
            continue
        ring, k = [], start
        while not used[k]:
            used[k] = True
            ring.append(k)
            ways = [j for j in leave[keys[k][2:]] if not used[j]]
            if not ways:
                break
            if len(ways) == 1:
                k = ways[0]
                continue
            d = pieces[k, 2:] - pieces[k, :2]
            turn = lambda j: np.arctan2(d[0] * (pieces[j, 3] - pieces[j, 1]) - d[1] * (pieces[j, 2] - pieces[j, 0]), d @ (pieces[j, 2:] - pieces[j, :2]))  # noqa: B023, E731
            k = max(ways, key=turn)
        r = pieces[ring, :2]
        # Corners on a straight way are left out.
        while len(r) > 2:
            before, after = r - np.roll(r, 1, axis=0), np.roll(r, -1, axis=0) - r
            bend = np.abs(before[:, 0] * after[:, 1] - before[:, 1] * after[:, 0]) > 1e-9 * np.hypot(*before.T) * np.hypot(*after.T)
            if bend.all():
                break
            r = r[bend]
        if len(r) > 2:
            rings.append(r)
    return rings


def _holds(ring: np.ndarray, x: float, y: float) -> bool:
    nxt = np.roll(ring, -1, axis=0)
    over = (ring[:, 1] <= y) != (nxt[:, 1] <= y)
    a, b = ring[over], nxt[over]
    return bool((a[:, 0] + (y - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0]) > x).sum() % 2)


def nest(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Polygons (outer ring counter-clockwise, then holes clockwise) of rings that don't cross, by how many others hold each."""
    if len(rings) == 1:
        return [[rings[0] if _signed(rings[0]) > 0 else rings[0][::-1]]]
    size = [abs(_signed(r)) for r in rings]
    inside = []
    for i, r in enumerate(rings):
        x, y = (r[0] + r[1]) / 2
        inside.append([j for j, s in enumerate(rings) if j != i and size[j] > size[i] and _holds(s, x, y)])
    outer = {i: [rings[i] if _signed(rings[i]) > 0 else rings[i][::-1]] for i in range(len(rings)) if len(inside[i]) % 2 == 0}
    for i, r in enumerate(rings):
        if len(inside[i]) % 2:
            outer[min(inside[i], key=lambda j: (size[j], j))].append(r if _signed(r) < 0 else r[::-1])
    return list(outer.values())


def _rows(polygons: list[list[np.ndarray]]) -> list[list[list[dict]]]:
    close = lambda r: [{"x": float(x), "y": float(y)} for x, y in [*r, r[0]]]
    return [[close(r) for r in p] for p in polygons]


_PIECES = "x0 double, y0 double, x1 double, y1 double"


def union_boundary(polygons: DataFrame, rings: str = "rings", cell: float | None = None) -> DataFrame:
    """(x0, y0, x1, y1): the directed pieces of the boundary of all polygons together, cover on the left."""
    cell = cell or cell_size(polygons, rings)
    rows = with_cells(polygons.where(F.size(rings) > 0).select(F.col(rings).alias("rings")).distinct(), "rings", cell)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lines = tuple(float(_snap(k * cell)) for k in (key[0], key[1], key[0] + 1, key[1] + 1))
        got = [boundary(near, "positive", part, every, base) for part, near, every, base in parts_of([_edges(r, True) for r in pdf["rings"]], lines)]
        return pd.DataFrame(np.vstack(got) if got else np.zeros((0, 4)), columns=["x0", "y0", "x1", "y1"])

    return rows.groupBy("cx", "cy").applyInPandas(run, _PIECES)


def boundary_figures(pieces: DataFrame) -> DataFrame:
    """One row: area, perimeter, pieces."""
    cross = (F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")) / 2
    return pieces.agg(F.coalesce(F.sum(cross), F.lit(0.0)).alias("area"), F.coalesce(F.sum(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))), F.lit(0.0)).alias("perimeter"), F.count("*").alias("pieces"))


def union_rings(pieces: DataFrame) -> DataFrame:
    """(part, rings): closed rings, one row each connected boundary; outer rings counter-clockwise, holes clockwise.

    Boundaries that touch nowhere are rows of their own, a hole's too: whoever wants them nested passes rings to `nested`.
    """
    name = lambda x, y: F.xxhash64(F.round(F.col(x) / SNAP).cast("long"), F.round(F.col(y) / SNAP).cast("long"))
    rows = pieces.withColumn("src", name("x0", "y0")).withColumn("dst", name("x1", "y1"))
    label = network.components(rows.select(F.col("src").alias("id")).distinct(), rows.select("src", "dst"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        got = chain(pdf[["x0", "y0", "x1", "y1"]].to_numpy())
        return pd.DataFrame({"part": [key[0]], "rings": [_rows([got])[0]]})

    return rows.join(label, F.col("src") == F.col("id")).groupBy("label").applyInPandas(run, f"part long, rings {geo.POLYGON}")


def repair(polygons: DataFrame, polygon_id: str, rings: str = "rings") -> DataFrame:
    """(polygon_id, part, rings): valid parts under the even-odd rule, largest first; polygons that cover nothing have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts, rings_, held = [], [], [], []
            for i, piece in enumerate(odd_boundaries(_edges_of(batch.column(1)))):
                got = nest(chain(piece))
                got.sort(key=lambda p: -abs(_signed(p[0])))
                rows += [i] * len(got)
                parts += range(len(got))
                held += [len(p) for p in got]
                rings_ += [r for p in got for r in p]
            if rows:
                points = np.vstack([x for r in rings_ for x in (r, r[:1])])
                at = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                flat = pa.StructArray.from_arrays([pa.array(points[:, 0]), pa.array(points[:, 1])], ["x", "y"])
                shapes = pa.ListArray.from_arrays(at(held), pa.ListArray.from_arrays(at([len(r) + 1 for r in rings_]), flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(parts, pa.int32()), shapes], [polygon_id, "part", "rings"])

    kind = polygons.schema[polygon_id].dataType.simpleString()
    # A small file is one task, but its polygons are work for all.
    spread = polygons.select(polygon_id, F.col(rings).alias("rings")).repartition(int(polygons.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return spread.mapInArrow(run, f"`{polygon_id}` {kind}, part int, rings {geo.POLYGON}")


def assemble(ways: DataFrame, relation_id: str, points: str = "points") -> DataFrame:
    """(relation_id, part, rings, open_ways): polygons of each relation's ways, whatever their order and direction.

    Ways are joined at their ends into rings, rings are nested by who holds whom (roles aren't trusted); ways that close no ring are counted.
    A relation's ways are one group. Relations without any ring have one row, part and rings null.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ways_ = [_snap([(p["x"], p["y"]) for p in w]).reshape(-1, 2) for w in pdf["points"] if w is not None and len(w) > 1]
        rings, left = _joined(ways_)
        got = nest([r for r in rings if len(r) > 2])
        got.sort(key=lambda p: (-abs(_signed(p[0])), tuple(p[0].min(axis=0))))
        rows = _rows(got) or [None]
        return pd.DataFrame({relation_id: [key[0]] * len(rows), "part": pd.array(list(range(len(got))) or [None], dtype="Int32"), "rings": rows, "open_ways": pd.Series([left] * len(rows), dtype="int32")})

    kind = ways.schema[relation_id].dataType.simpleString()
    return ways.select(relation_id, F.col(points).alias("points")).groupBy(relation_id).applyInPandas(run, f"`{relation_id}` {kind}, part int, rings {geo.POLYGON}, open_ways int")


def _joined(ways: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """(rings, number of ways that belong to none): ends that only one way has are trimmed first, then any walk along the rest closes."""
    end = lambda p: (round(p[0] / SNAP), round(p[1] / SNAP))
    order = sorted(range(len(ways)), key=lambda k: sorted(map(tuple, ways[k].tolist())))
    ways = [ways[k] for k in order]
    at: dict[tuple[int, int], set[int]] = defaultdict(set)
    rings, alive = [], set()
    for k, w in enumerate(ways):
        if end(w[0]) == end(w[-1]):
            rings.append(w[:-1])
        else:
            alive.add(k)
            at[end(w[0])].add(k)
            at[end(w[-1])].add(k)
    loose = [k for k in alive if len(at[end(ways[k][0])]) == 1 or len(at[end(ways[k][-1])]) == 1]
    while loose:
        k = loose.pop()
        if k not in alive:
            continue
        alive.discard(k)
        for p in (ways[k][0], ways[k][-1]):
            at[end(p)].discard(k)
            if len(at[end(p)]) == 1:
                loose.append(next(iter(at[end(p)])))
    left = len(ways) - len(rings) - len(alive)
    while alive:
        start = min(alive)
        path, seen = [ways[start]], {end(ways[start][0]): 0}
        alive.discard(start)
        at[end(ways[start][0])].discard(start)
        at[end(ways[start][-1])].discard(start)
        while True:
            here = end(path[-1][-1])
            if here in seen:  # the walk has come round: what began there is a ring, what led there goes back
                k = seen[here]
                rings.append(np.vstack([w[:-1] for w in path[k:]]))
                left += k
                break
            seen[here] = len(path)
            if not at[here]:
                left += len(path)
                break
            nxt = min(at[here])
            w = ways[nxt] if end(ways[nxt][0]) == here else ways[nxt][::-1]
            alive.discard(nxt)
            at[end(w[0])].discard(nxt)
            at[end(w[-1])].discard(nxt)
            path.append(w)
    return rings, left
