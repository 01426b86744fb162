"""Overlay of two edge sets: noding, labels, face walk. A kernel over all shapes of an Arrow batch.

Coordinates are whole numbers on a grid of 1 / GRID degrees, so that every orientation test is exact.

* Noding: edges of one owner that share a cell of the owner's own grid are compared; they are cut where
  they cross or touch, crossings are rounded to the grid, and this is repeated until nothing is cut, so
  that edges meet at their ends alone.
* Labels: of every distinct edge, how often each side winds round the positions left and right of it,
  from the edges above its middle (a vertical strip of the owner is looked through, not all edges).
* Faces: an edge with the wanted area on one side only is a border of the result and runs with the area
  on its left. At each node a border goes on with the next one clockwise; rings are found by pointer
  doubling, cut where they meet themselves, and holes go to the least ring around them.

A shape is an array of polygons, a polygon an array of closed rings (the first is the outer one), as in
a GeoJSON MultiPolygon. Results have counter-clockwise outer rings and clockwise holes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GRID = 1_000_000_000
#: Pairs of edges looked at together, and edges of a batch that the kernel takes at once.
PAIRS, EDGES = 2_000_000, 100_000
_CELLS = 256

POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
SHAPE = pa.list_(pa.list_(pa.list_(POINT)))
SHAPE_TYPE = "array<array<array<struct<x:double,y:double>>>>"

OPERATIONS: dict[str, Callable] = {
    "intersection": lambda a, b: a & b,
    "difference": lambda a, b: a & ~b,
    "union": lambda a, b: a | b,
    "symmetric_difference": lambda a, b: a ^ b,
    "own": lambda a, b: a,
}


class Edges:
    """Directed edges p -> q of owners (rows of a batch) and sides (0 or 1), as columns of whole numbers."""

    def __init__(self, own, side, px, py, qx, qy):
        self.own, self.side, self.px, self.py, self.qx, self.qy = (np.asarray(c, np.int64) for c in (own, side, px, py, qx, qy))

    def __len__(self) -> int:
        return len(self.own)

    def take(self, at) -> Edges:
        return Edges(*(c[at] for c in (self.own, self.side, self.px, self.py, self.qx, self.qy)))

    def plus(self, other: Edges) -> Edges:
        return Edges(*(np.concatenate([a, b]) for a, b in zip(self.columns(), other.columns(), strict=True)))

    def columns(self):
        return self.own, self.side, self.px, self.py, self.qx, self.qy


def cross_sign(ax, ay, bx, by):
    """Sign of ax * by - ay * bx, exact for numbers below 2**39: the product is added up in two halves."""
    high = (ax >> 16) * by - (ay >> 16) * bx
    low = (ax & 0xFFFF) * by - (ay & 0xFFFF) * bx
    whole = high + (low >> 16)
    return np.where(whole != 0, np.sign(whole), (low & 0xFFFF) > 0)


def _ids(*columns) -> np.ndarray:
    """A number for each distinct row of the columns, in their order."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= np.diff(c[order]) != 0
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in row) of counts[i] entries for each row i."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def _by_owner(own: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, width) of each entry's owner."""
    n = int(own.max()) + 1
    least, most = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(least, own, low)
    np.maximum.at(most, own, high)
    return least[own], (most - least)[own] + 1


def _close_pairs(e: Edges) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of edges of one owner whose boxes meet, each once, in bounded parts."""
    n = np.bincount(e.own)[e.own]
    cells = np.clip(np.sqrt(n / 2).astype(np.int64), 1, _CELLS)
    box = [(np.minimum(p, q), np.maximum(p, q)) for p, q in ((e.px, e.qx), (e.py, e.qy))]
    at = []
    for low, high in box:
        least, width = _by_owner(e.own, low, high)
        at.append(((low - least) * cells // width, (high - least) * cells // width))
    (i0, i1), (j0, j1) = at
    edge, k = _spread((i1 - i0 + 1) * (j1 - j0 + 1))
    tall = (j1 - j0 + 1)[edge]
    key = (e.own[edge] * _CELLS + i0[edge] + k // tall) * _CELLS + j0[edge] + k % tall
    order = np.argsort(key, kind="stable")
    edge, key = edge[order], key[order]
    after = np.searchsorted(key, key, side="right") - np.arange(len(key)) - 1
    ends = np.cumsum(after)
    lo = 0
    while lo < len(key):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, side="right")))
        row, step = _spread(after[lo:hi])
        a, b = edge[lo + row], edge[lo + row + step + 1]
        meet = key[lo + row] == (e.own[a] * _CELLS + np.maximum(i0[a], i0[b])) * _CELLS + np.maximum(j0[a], j0[b])
        for low, high in box:
            meet &= (low[a] <= high[b]) & (low[b] <= high[a])
        yield a[meet], b[meet]
        lo = hi


def _cuts(e: Edges) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edge, x, y) of the places inside edges where others cross or touch them."""
    found = [(np.array([], np.int64),) * 3]
    for a, b in _close_pairs(e):
        side = lambda i, x, y: cross_sign(e.qx[i] - e.px[i], e.qy[i] - e.py[i], x - e.px[i], y - e.py[i])
        d = [side(a, e.px[b], e.py[b]), side(a, e.qx[b], e.qy[b]), side(b, e.px[a], e.py[a]), side(b, e.qx[a], e.qy[a])]
        for i, on, x, y in ((a, d[0], e.px[b], e.py[b]), (a, d[1], e.qx[b], e.qy[b]), (b, d[2], e.px[a], e.py[a]), (b, d[3], e.qx[a], e.qy[a])):
            hit = (on == 0) & (np.minimum(e.px[i], e.qx[i]) <= x) & (x <= np.maximum(e.px[i], e.qx[i])) & (np.minimum(e.py[i], e.qy[i]) <= y) & (y <= np.maximum(e.py[i], e.qy[i]))
            found.append((i[hit], x[hit], y[hit]))
        proper = (d[0] * d[1] < 0) & (d[2] * d[3] < 0)
        a, b = a[proper], b[proper]
        ax, ay, bx, by = (v.astype(float) for v in (e.qx[a] - e.px[a], e.qy[a] - e.py[a], e.qx[b] - e.px[b], e.qy[b] - e.py[b]))
        t = ((e.px[b] - e.px[a]) * by - (e.py[b] - e.py[a]) * bx) / (ax * by - ay * bx)
        x, y = e.px[a] + np.rint(t * ax).astype(np.int64), e.py[a] + np.rint(t * ay).astype(np.int64)
        found += [(a, x, y), (b, x, y)]
    edge, x, y = (np.concatenate(c) for c in zip(*found, strict=True))
    inside = ~(((x == e.px[edge]) & (y == e.py[edge])) | ((x == e.qx[edge]) & (y == e.qy[edge])))
    return edge[inside], x[inside], y[inside]


def noded(e: Edges) -> Edges:
    """The edges, cut until they meet at their ends alone."""
    while len(e):
        edge, x, y = _cuts(e)
        if not len(edge):
            break
        touched = np.zeros(len(e), bool)
        touched[edge] = True
        cut = np.flatnonzero(touched)
        every, ex, ey = (np.concatenate(c) for c in ((edge, cut, cut), (x, e.px[cut], e.qx[cut]), (y, e.py[cut], e.qy[cut])))
        far = (ex - e.px[every]).astype(float) * (e.qx - e.px)[every] + (ey - e.py[every]).astype(float) * (e.qy - e.py)[every]
        order = np.lexsort((ey, ex, far, every))
        every, ex, ey = every[order], ex[order], ey[order]
        step = (every[1:] == every[:-1]) & ((ex[1:] != ex[:-1]) | (ey[1:] != ey[:-1]))
        i = every[:-1][step]
        e = e.take(~touched).plus(Edges(e.own[i], e.side[i], ex[:-1][step], ey[:-1][step], ex[1:][step], ey[1:][step]))
    return e


def _winding(own, px, py, qx, qy, net: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(winding, crossings) left of every distinct edge p -> q (p first in x, then y), for both sides."""
    n = len(own)
    strips = np.clip(np.bincount(own)[own] // 2, 1, 1 << 14)
    least, width = _by_owner(own, px, qx)
    place = lambda x2: (x2 - 2 * least) * strips // (2 * width)
    first, last, mine = place(2 * px), place(2 * qx), place(px + qx)
    edge, k = _spread(last - first + 1)
    key = own[edge] << 15 | (first[edge] + k)
    order = np.argsort(key, kind="stable")
    edge, key = edge[order], key[order]
    asked = own << 15 | mine
    lo, hi = np.searchsorted(key, asked), np.searchsorted(key, asked, side="right")
    ends, wind, cross = np.cumsum(hi - lo), np.zeros((2, n)), np.zeros((2, n))
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, side="right")))
        row, step = _spread((hi - lo)[i:j])
        m, o = i + row, edge[lo[i + row] + step]
        mx, my = px[m] + qx[m], py[m] + qy[m]
        after = (2 * px[o] < mx) | ((2 * px[o] == mx) & (2 * py[o] <= my))
        before = (mx < 2 * qx[o]) | ((mx == 2 * qx[o]) & (my < 2 * qy[o]))
        m, o, mx, my = (c[after & before & (m != o)] for c in (m, o, mx, my))
        above = cross_sign(qx[o] - px[o], qy[o] - py[o], mx - 2 * px[o], my - 2 * py[o]) < 0
        m, o = m[above], o[above]
        for s in (0, 1):
            wind[s] -= np.bincount(m, net[s][o], n)
            cross[s] += np.bincount(m, odd[s][o], n)
        i = j
    return wind, cross


def borders(e: Edges, operation: str, winding: bool = False) -> tuple[Edges, np.ndarray]:
    """(directed borders of the result, owners whose sides meet). Side 0 and 1 each have an inside: where
    they wind round at all (``winding``), else where an odd number of edges is above."""
    if not len(e):
        return e, np.array([], np.int64)
    up = (e.px < e.qx) | ((e.px == e.qx) & (e.py < e.qy))
    ends = [np.where(up, a, b) for a, b in ((e.px, e.qx), (e.py, e.qy), (e.qx, e.px), (e.qy, e.py))]
    same = _ids(e.own, *ends)
    n = int(same.max()) + 1
    first = np.empty(n, np.int64)
    first[same[::-1]] = np.arange(len(e))[::-1]
    own, px, py, qx, qy = (c[first] for c in (e.own, *ends))
    net = [np.bincount(same, np.where(e.side == s, np.where(up, 1, -1), 0), n) for s in (0, 1)]
    count = [np.bincount(same, e.side == s, n) for s in (0, 1)]
    wind, cross = _winding(own, px, py, qx, qy, net, count)
    if winding:
        left, right = ([wind[s] - d * net[s] != 0 for s in (0, 1)] for d in (0, 1))
    else:
        left, right = ([(cross[s] + d * count[s]) % 2 == 1 for s in (0, 1)] for d in (0, 1))
    f = OPERATIONS[operation]
    a, b = f(*left), f(*right)
    keep = a != b
    flip = b & keep
    out = [np.where(flip, x, y)[keep] for x, y in ((qx, px), (qy, py), (px, qx), (py, qy))]
    # sides meet where both are inside, or where they share a node
    both = (left[0] & left[1]) | (right[0] & right[1])
    at = _ids(np.concatenate([own, own]), np.concatenate([px, qx]), np.concatenate([py, qy]))
    has = [np.bincount(at, np.tile(count[s] > 0, 2)) > 0 for s in (0, 1)]
    shared = (has[0] & has[1])[at[:n]] | (has[0] & has[1])[at[n:]]
    return Edges(own[keep], np.zeros(int(keep.sum())), *out), np.unique(own[both | shared])


# ---- rings -----------------------------------------------------------------------------------


def _clockwise_first(back: tuple[int, int], ways: list[tuple[int, int, int]]) -> int:
    """Of directions (x, y, edge), the edge of the first one clockwise from ``back``."""
    half = lambda w: 0 if (c := back[0] * w[1] - back[1] * w[0]) < 0 else 1 if c == 0 and back[0] * w[0] + back[1] * w[1] < 0 else 2 if c > 0 else 3

    def compare(v, w):
        return half(v) - half(w) or (v[0] * w[1] - v[1] * w[0] > 0) - (v[0] * w[1] - v[1] * w[0] < 0)

    return min(ways, key=cmp_to_key(compare))[2]


def following(start: np.ndarray, end: np.ndarray, e: Edges) -> np.ndarray:
    """Of each directed border, the border that its ring goes on with; -1 where none leaves its end."""
    order = np.argsort(start, kind="stable")
    lo, hi = (np.searchsorted(start[order], end, side=s) for s in ("left", "right"))
    out = np.where(hi > lo, order[np.minimum(lo, len(order) - 1)], -1)
    for i in np.flatnonzero(hi - lo > 1).tolist():
        back = int(e.px[i] - e.qx[i]), int(e.py[i] - e.qy[i])
        out[i] = _clockwise_first(back, [(int(e.qx[k] - e.px[k]), int(e.qy[k] - e.py[k]), k) for k in order[lo[i] : hi[i]].tolist()])
    return out


def ordered_rings(follow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ring, order): the least border of each one's ring, and all borders ring by ring in their order."""
    label, jump = np.arange(len(follow)), follow.copy()
    while True:
        less = np.minimum(label, label[jump])
        if (less == label).all():
            break
        label, jump = less, jump[jump]
    before = np.empty_like(follow)
    before[follow] = np.arange(len(follow))
    head = label == np.arange(len(follow))
    before[head] = np.flatnonzero(head)
    far = np.where(head, 0, 1)
    while not head[before].all():
        far, before = far + far[before], before[before]
    return label, np.lexsort((far, label))


def _simple(nodes: list[int]) -> list[list[int]]:
    """Places of a ring's corners, cut into rings that visit no node twice."""
    out, stack, at = [], [], {}
    for i, n in enumerate(nodes):
        if n in at:
            cut = at[n]
            out.append(stack[cut:])
            for k in stack[cut:]:
                at.pop(nodes[k], None)
            del stack[cut:]
        at[n] = len(stack)
        stack.append(i)
    return [*out, stack]


def _offsets(counts: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))


class Rings:
    """Closed rings as corners (x, y) with their ring, and each ring's owner and twice its area."""

    def __init__(self, ring, x, y, own):
        start = np.flatnonzero(np.diff(ring, prepend=-1))
        size = np.diff(np.append(start, len(ring)))
        at = np.repeat(start, size)
        after, before = np.arange(len(ring)) + 1, np.arange(len(ring)) - 1
        after[start + size - 1], before[start] = start, start + size - 1
        turn = cross_sign(x - x[before], y - y[before], x[after] - x, y[after] - y)
        keep = turn != 0  # corners on a straight line say nothing
        dx, dy = (x - x[at]).astype(float), (y - y[at]).astype(float)
        area = np.add.reduceat(dx * dy[after] - dx[after] * dy, start) if len(start) else np.array([])
        self.own, self.area = own[start], area
        self.size = np.add.reduceat(keep.astype(np.int64), start) if len(start) else size
        self.x, self.y, self.start = x[keep], y[keep], np.cumsum(self.size) - self.size

    def holds(self, i: int, x2: int, y2: int) -> bool:
        """Whether ring i is around a position (in half grid steps) that isn't on it."""
        part = slice(self.start[i], self.start[i] + self.size[i])
        px, py = self.x[part] * 2, self.y[part] * 2
        qx, qy = np.roll(px, -1), np.roll(py, -1)
        spans = (py > y2) != (qy > y2)
        sign = cross_sign((qx - px) >> 1, (qy - py) >> 1, x2 - px, y2 - py)
        return bool((spans & (np.where(qy > py, sign, -sign) > 0)).sum() % 2)

    def _closed(self, order: np.ndarray) -> pa.Array:
        size = self.size[order] + 1
        ring, k = _spread(size)
        at = self.start[order][ring] + k % self.size[order][ring]  # the first corner once more at the end
        points = pa.StructArray.from_arrays([pa.array(self.x[at] / GRID), pa.array(self.y[at] / GRID)], fields=list(POINT))
        return pa.ListArray.from_arrays(_offsets(size), points)

    def loose(self, n: int) -> pa.Array:
        """All rings of each of ``n`` owners, turned as they are."""
        order = np.argsort(self.own, kind="stable")
        return pa.ListArray.from_arrays(_offsets(np.bincount(self.own, minlength=n)), self._closed(order)).cast(pa.list_(pa.list_(POINT)))

    def polygons(self, n: int) -> pa.Array:
        """The shape of each of ``n`` owners."""
        outer = np.flatnonzero(self.area > 0)
        owner = np.full(len(self.own), -1)
        owner[outer] = outer
        of = {}
        for i in outer[np.argsort(self.area[outer], kind="stable")].tolist():
            of.setdefault(int(self.own[i]), []).append(i)
        for h in np.flatnonzero(self.area < 0).tolist():
            around = of.get(int(self.own[h]), [])
            if len(around) > 1:
                a = self.start[h]
                x2, y2 = int(self.x[a] + self.x[a + 1]), int(self.y[a] + self.y[a + 1])
                around = [i for i in around if self.area[i] > -self.area[h] and self.holds(i, x2, y2)]
            owner[h] = around[0] if around else -1
        hole = self.area < 0
        used = np.flatnonzero(owner >= 0)
        order = used[np.lexsort((used, hole[used], owner[used], self.own[used]))]
        rings = self._closed(order)
        first = ~hole[order]
        polygons = pa.ListArray.from_arrays(pa.array(np.append(np.flatnonzero(first), len(order)).astype(np.int32)), rings)
        per_owner = np.bincount(self.own[order][first], minlength=n)
        return pa.ListArray.from_arrays(_offsets(per_owner), polygons).cast(SHAPE)


def rings_of(e: Edges) -> Rings:
    """Simple rings of directed borders, each owner's on its own."""
    if not len(e):
        return Rings(e.own, e.px, e.py, e.own)
    node = _ids(np.concatenate([e.own, e.own]), np.concatenate([e.px, e.qx]), np.concatenate([e.py, e.qy]))
    start, end = node[: len(e)], node[len(e) :]
    follow = following(start, end, e)
    if (np.bincount(follow, minlength=len(e)) != 1).any():
        raise RuntimeError("the borders don't close")
    label, order = ordered_rings(follow)
    ring = _ids(label)[order]
    corner = _ids(ring, start[order])
    again = np.unique(ring[np.bincount(corner)[corner] > 1])
    if len(again):
        lo, hi = (np.searchsorted(ring, again, side=s) for s in ("left", "right"))
        parts, top = [], int(ring[-1]) + 1
        rest = ~np.isin(ring, again)
        places, rings = [np.flatnonzero(rest)], [ring[rest]]
        for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
            for part in _simple(start[order[a:b]].tolist()):
                parts.append(a + np.array(part))
                rings.append(np.full(len(part), top))
                top += 1
        at, ring = np.concatenate(places + parts), np.concatenate(rings)
        order = order[at]
    return Rings(ring, e.px[order], e.py[order], e.own[order])


# ---- Arrow -----------------------------------------------------------------------------------


def edges_of(shapes: pa.Array, side: int = 0) -> Edges:
    """The edges of shapes, with their rows as owners; positions that aren't finite are left out."""
    size = lambda a: pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    polygons = shapes.flatten()
    rings = polygons.flatten()
    points = rings.flatten()
    row = np.repeat(np.repeat(np.arange(len(shapes)), size(shapes)), size(polygons))
    xy = [pc.fill_null(points.field(i), float("nan")).to_numpy(zero_copy_only=False) for i in (0, 1)]
    ring = np.repeat(np.arange(len(rings)), size(rings))
    good = np.isfinite(xy[0]) & np.isfinite(xy[1])
    x, y, ring = np.rint(xy[0][good] * GRID).astype(np.int64), np.rint(xy[1][good] * GRID).astype(np.int64), ring[good]
    if not len(ring):
        return Edges(*[[]] * 6)
    start = np.flatnonzero(np.diff(ring, prepend=-1))
    after = np.arange(len(ring)) + 1
    after[np.append(start[1:], len(ring)) - 1] = start
    long = (x != x[after]) | (y != y[after])
    e = Edges(row[ring], np.full(len(ring), side), x, y, x[after], y[after]).take(long)
    e.ring = ring[long]  # which ring an edge belongs to, one after the other
    return e


def _needed(a: Edges, b: Edges) -> Edges:
    """Edges of b in the strip of each owner's box of a, from its lower side upwards: all that decides inside that box."""
    n = int(max(a.own.max(initial=-1), b.own.max(initial=-1))) + 1
    most, least = np.iinfo(np.int64).max, np.iinfo(np.int64).min
    x0, x1, y0 = np.full(n, most), np.full(n, least), np.full(n, most)
    for c in (a.px, a.qx):
        np.minimum.at(x0, a.own, c)
        np.maximum.at(x1, a.own, c)
    np.minimum.at(y0, a.own, a.py)
    o = b.own
    return b.take((np.maximum(b.px, b.qx) >= x0[o]) & (np.minimum(b.px, b.qx) <= x1[o]) & (np.maximum(b.py, b.qy) >= y0[o]))


def overlay(a: pa.Array, b: pa.Array | None, operation: str, winding: bool = False) -> tuple[pa.Array, np.ndarray]:
    """(shape of the operation on every row, whether the row's shapes meet)."""
    one = edges_of(a, 0)
    if b is not None:
        two = edges_of(b, 1)
        one = one.plus(_needed(one, two) if operation in ("intersection", "difference") else two)
    result, met = borders(noded(one), operation, winding)
    flags = np.zeros(len(a), bool)
    flags[met] = True
    return rings_of(result).polygons(len(a)), flags


def _runs(counts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of places whose counts add up to ``most`` at most, or that are single."""
    ends, lo = np.cumsum(counts), 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


def _lines(shapes: pa.Array, x: int, y: int) -> tuple[np.ndarray, ...]:
    """(start, count) by shape, and of its edges (left, right, height at 0, rise, sign), in degrees from (x, y)."""
    px, py, qx, qy = shapes.flatten().to_numpy().reshape(-1, 4).T - np.array([[x], [y], [x], [y]])
    n = pc.list_value_length(shapes).to_numpy() // 4
    rise = (qy - py) / (qx - px)
    return np.cumsum(n) - n, n, np.minimum(px, qx) / GRID, np.maximum(px, qx) / GRID, py / GRID - px / GRID * rise, rise, np.where(px > qx, 1.0, -1.0)


def shared_areas(a: pa.Array, b: pa.Array, i: np.ndarray, j: np.ndarray, x: int, y: int) -> np.ndarray:
    """The area that a[i] and b[j] share, for each place of i and j; in square degrees.

    Elements are the edges (px, py, qx, qy, ...) of a shape's turned rings on the grid, upright ones left out;
    (x, y) is a place nearby from which they are counted. A shape is the sum of what lies below its edges,
    minus where an edge runs to the right; so two shapes share the sum, over pairs of their edges, of what
    lies below both.
    """
    a_start, a_n, a_left, a_right, a_at, a_rise, a_sign = _lines(a, x, y)
    b_start, b_n, b_left, b_right, b_at, b_rise, b_sign = _lines(b, x, y)
    area = np.zeros(len(i))
    for lo, hi in _runs(a_n[i], PAIRS // 8):
        pair, edge = _spread(a_n[i[lo:hi]])
        pair += lo
        edge += a_start[i[pair]]
        for first, last in _runs(b_n[j[pair]], PAIRS // 8):
            row, n = _spread(b_n[j[pair[first:last]]])
            row += first
            m = edge[row]
            n += b_start[j[pair[row]]]
            low, high = np.maximum(a_left[m], b_left[n]), np.minimum(a_right[m], b_right[n])
            both = np.flatnonzero(low < high)
            row, m, n, low, high = row[both], m[both], n[both], low[both], high[both]
            at, rise, other_at, other_rise = a_at[m], a_rise[m], b_at[n], b_rise[n]
            one, two = at + low * rise, other_at + low * other_rise
            one_end, two_end = at + high * rise, other_at + high * other_rise
            left, right = np.minimum(one, two), np.minimum(one_end, two_end)
            below = left + right
            d, f = one - two, one_end - two_end
            cross = np.flatnonzero(d * f < 0)  # the lower one changes at t
            if len(cross):
                t = d[cross] / (d[cross] - f[cross])
                below[cross] = t * left[cross] + (1 - t) * right[cross] + one[cross] + t * (one_end - one)[cross]
            area += np.bincount(pair[row], a_sign[m] * b_sign[n] * below * (high - low), len(i)) / 2
    return area


def in_parts(batch: pa.RecordBatch, *shapes: int, most: int = EDGES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` positions in the shape columns."""
    total = np.zeros(batch.num_rows, np.int64)
    for i in shapes:
        col = batch.column(i)
        n = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(col)), n)
        polygons = col.flatten()
        m = pc.fill_null(pc.list_value_length(polygons), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(row, m)
        points = pc.fill_null(pc.list_value_length(polygons.flatten()), 0).to_numpy(zero_copy_only=False)
        total += np.bincount(row, points, batch.num_rows).astype(np.int64)
    ends, i = np.cumsum(total), 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right")))
        yield batch.slice(i, j - i)
        i = j
