"""Ring kernels: measures, assembly, roles, label points and rectangle clipping."""

from __future__ import annotations

import math
from collections.abc import Sequence

from tilewright.schema import EARTH

Point = tuple[float, float]
Ring = list[Point]


def area2(ring: Sequence[Point]) -> float:
    """Twice the signed area; the ring closes by itself. Exact on integers."""
    x0, y0 = ring[0] if ring else (0, 0)
    total = 0
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], *ring[:1]], strict=True):
        total += (ax - x0) * (by - y0) - (bx - x0) * (ay - y0)
    return total


def area_m2(ring: Sequence[Point]) -> float:
    """Square metres of a ring in the unit square: each edge's part is scaled by the latitude of its middle."""
    total, (x0, y0) = 0.0, ring[0]
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], *ring[:1]], strict=True):
        scale = EARTH / math.cosh(math.pi * (1 - ay - by))
        total += ((ax - x0) * (by - y0) - (bx - x0) * (ay - y0)) * scale * scale
    return abs(total) / 2


def inside(p: Point, ring: Sequence[Point]) -> bool:
    """Even-odd rule."""
    x, y = p
    found = False
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], *ring[:1]], strict=True):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            found = not found
    return found


def centroid(shape: Sequence[Sequence[Point]]) -> Point | None:
    """Area centroid with holes taken off; shape: outer ring, then holes."""
    ox, oy = shape[0][0]
    mx = my = m = 0.0
    for k, ring in enumerate(shape):
        rx = ry = r = 0.0
        for (ax, ay), (bx, by) in zip(ring, [*ring[1:], *ring[:1]], strict=True):
            cross = (ax - ox) * (by - oy) - (bx - ox) * (ay - oy)
            rx += (ax + bx - 2 * ox) * cross
            ry += (ay + by - 2 * oy) * cross
            r += cross
        sign = (1 if k == 0 else -1) * (1 if r > 0 else -1)
        mx, my, m = mx + sign * rx, my + sign * ry, m + sign * r
    return (ox + mx / (3 * m), oy + my / (3 * m)) if m else None


def is_simple(ring: Sequence[Point]) -> bool:
    """No two edges that aren't neighbours meet."""
    n = len(ring)
    edges = [(ring[i], ring[(i + 1) % n]) for i in range(n)]
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    on = lambda a, b, c: min(a[0], b[0]) <= c[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= c[1] <= max(a[1], b[1])
    for i in range(n):
        for j in range(i + 2, n):
            if i == 0 and j == n - 1:
                continue
            (a, b), (c, d) = edges[i], edges[j]
            s, t, u, v = turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)
            if (s > 0) != (t > 0) and (u > 0) != (v > 0) and 0 not in (s, t, u, v):
                return False
            if s == 0 and on(a, b, c) or t == 0 and on(a, b, d) or u == 0 and on(c, d, a) or v == 0 and on(c, d, b):
                return False
    return True


def is_convex(ring: Sequence[Point]) -> bool:
    """One turning direction and at most two changes of direction on each axis."""
    n = len(ring)
    signs = set()
    for i in range(n):
        (ax, ay), (bx, by), (cx, cy) = ring[i], ring[(i + 1) % n], ring[(i + 2) % n]
        cross = (bx - ax) * (cy - by) - (by - ay) * (cx - bx)
        if cross:
            signs.add(cross > 0)
    if n < 3 or len(signs) != 1:
        return False
    for axis in (0, 1):
        steps = [s for i in range(n) if (s := ring[(i + 1) % n][axis] - ring[i][axis])]
        if sum((a > 0) != (b > 0) for a, b in zip(steps, steps[1:] + steps[:1], strict=True)) != 2:
            return False
    return True


def point_on_surface(shape: Sequence[Sequence[Point]], lines: int = 5) -> Point | None:
    """Middle of the longest stretch inside on ``lines`` scan lines; the first of equals. None for a shape without an inside there."""
    ys = [y for _, y in shape[0]]
    low, high = min(ys), max(ys)
    best: tuple[float, Point] | None = None
    for k in range(1, lines + 1):
        y = low + (high - low) * k / (lines + 1)
        xs = sorted((bx - ax) * (y - ay) / (by - ay) + ax for ring in shape for (ax, ay), (bx, by) in zip(ring, [*ring[1:], *ring[:1]], strict=True) if (ay > y) != (by > y))
        for a, b in zip(xs[::2], xs[1::2], strict=False):
            middle = ((a + b) / 2, y)
            if (best is None or b - a > best[0]) and a < middle[0] < b and in_shape(middle, shape):
                best = (b - a, middle)
    return best[1] if best else None


def in_shape(p: Point, shape: Sequence[Sequence[Point]]) -> bool:
    return inside(p, shape[0]) and not any(inside(p, hole) for hole in shape[1:])


def point_with_holes(shape: Sequence[Sequence[Point]]) -> Point | None:
    """A point of the shape outside its holes: seven lines, else the outer ring's own point unless a hole has it."""
    found = point_on_surface(shape, 7)
    if found is None and (other := point_on_surface(shape[:1])) is not None and in_shape(other, shape):
        found = other
    return found


def label_point(shapes: Sequence[Sequence[Sequence[Point]]], how: str = "surface") -> Point | None:
    """One point for all shapes of a feature.

    centroid: of all, aligned to the largest; convex: the centroid if the only
    ring is convex, else as surface: on the largest shape, the first of equals.
    """
    if not shapes:
        return None
    largest = max(shapes, key=lambda s: abs(area2(s[0])))
    if how == "centroid" or how == "convex" and len(shapes) == len(largest) == 1 and is_convex(largest[0]):
        p = area_and_centroid(shapes)[1]
        xs, ys = ([q[i] for s in shapes for q in s[0]] for i in (0, 1))
        # lobes of a ring that crosses itself may cancel, and leave a centroid far away
        if p is not None and min(xs) <= p[0] <= max(xs) and min(ys) <= p[1] <= max(ys):
            return p
    return point_with_holes(largest)


def area_and_centroid(shapes: Sequence[Sequence[Sequence[Point]]]) -> tuple[float, Point | None]:
    """Area, holes taken off, and centroid; shapes of another world copy are moved to the largest shape's."""
    if not shapes:
        return 0.0, None
    largest = max(shapes, key=lambda s: abs(area2(s[0])))
    home = centroid(largest)
    x = y = total = 0.0
    for shape in shapes:
        size = (abs(area2(shape[0])) - sum(abs(area2(h)) for h in shape[1:])) / 2
        at = centroid(shape)
        if at is None or size <= 0:
            continue
        away = round(at[0] - home[0]) if home else 0
        x, y, total = x + (at[0] - away) * size, y + at[1] * size, total + size
    return total, (x / total, y / total) if total else home


def vertex_key(p: Point) -> tuple[int, int]:
    """A vertex as whole numbers of 1e-12 of the world."""
    return round(p[0] * 1e12), round(p[1] * 1e12)


def unwrapped(points: Sequence[Point]) -> Ring:
    """Vertices without steps of more than half a world."""
    out: Ring = []
    shift = 0.0
    for k, (x, y) in enumerate(points):
        if k:
            step = x - points[k - 1][0]
            shift += -1.0 if step > 0.5 else 1.0 if step < -0.5 else 0.0
        out.append((x + shift, y))
    return out


#: Ends nearer than this meet.
NEAR = 1e-9


class _Ends:
    """Ends of ways by place; ends nearer than NEAR are one."""

    def __init__(self):
        self.cells: dict[tuple[int, int], list[tuple[Point, int]]] = {}
        self.count = 0

    def number(self, p: Point) -> int:
        cell = (math.floor(p[0] / NEAR), math.floor(p[1] / NEAR))
        for dx in (-1, 0, 1):
            for dy in (-1, 0, 1):
                for q, n in self.cells.get((cell[0] + dx, cell[1] + dy), ()):
                    if abs(q[0] - p[0]) <= NEAR and abs(q[1] - p[1]) <= NEAR:
                        return n
        self.cells.setdefault(cell, []).append((p, self.count))
        self.count += 1
        return self.count - 1


def assemble(ways: Sequence[Sequence[Point]]) -> tuple[list[Ring], int]:
    """Rings of ways chained at their ends; the number of chains that don't close.

    A chain that comes back to an end it has passed gives that loop as a ring and
    goes on from there, so no choice at a junction costs a ring.  Rings of under
    three vertices are dropped.
    """
    ends = _Ends()
    rings: list[Ring] = []
    left: list[tuple[int, int, list[Point]]] = []  # end, end, points
    for way in ways:
        if len(way) < 2:
            continue
        a, b = ends.number(way[0]), ends.number(way[-1])
        if a == b:
            if len(way) >= 4:
                rings.append(list(way[:-1]))
        else:
            left.append((a, b, list(way)))
    at: dict[int, list[int]] = {}
    for k, (a, b, _) in enumerate(left):
        at.setdefault(a, []).append(k)
        at.setdefault(b, []).append(k)
    used = [False] * len(left)

    def follow(end: int) -> int | None:
        return next((k for k in at[end] if not used[k]), None)

    dropped = 0
    for first in range(len(left)):
        if used[first]:
            continue
        # start where an open chain must, at an end of its own
        chain: list[tuple[int, list[Point]]] = []  # end that a piece starts at, its points
        tip = left[first][0]
        for direction in (0, 1):
            while (k := follow(tip)) is not None:
                used[k] = True
                a, b, points = left[k]
                chain.append((tip, points if a == tip else points[::-1]))
                tip = b if a == tip else a
                loop = next((i for i, (start, _) in enumerate(chain) if start == tip), None)
                if loop is not None:
                    ring = [p for _, piece in chain[loop:] for p in piece[:-1]]
                    if len(ring) >= 3:
                        rings.append(ring)
                    del chain[loop:]
            if not direction and chain:  # the other way round, from the chain's start
                start = chain[0][0]
                stops = [s for s, _ in chain[1:]] + [tip]
                chain = [(stop, piece[::-1]) for stop, (_, piece) in zip(reversed(stops), reversed(chain), strict=True)]
                tip = start
        dropped += bool(chain)
    return rings, dropped


def on_boundary(p: Point, ring: Sequence[Point]) -> bool:
    """Whether a point is a corner or on an edge."""
    x, y = p
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], *ring[:1]], strict=True):
        if (bx - ax) * (y - ay) == (by - ay) * (x - ax) and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return True
    return False


def contains(outer: Sequence[Point], ring: Sequence[Point]) -> bool:
    """Is a ring inside another: by a vertex, or an edge's middle, off its boundary."""
    for p in ring:
        if not on_boundary(p, outer):
            return inside(p, outer)
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], *ring[:1]], strict=True):
        if not on_boundary(p := ((ax + bx) / 2, (ay + by) / 2), outer):
            return inside(p, outer)
    return False


def in_order(rings: Sequence[Ring]) -> list[Ring]:
    """Rings from their least vertex on, sorted by box and then by vertices: the same however they came."""
    turned = [(r := list(ring))[k:] + r[:k] for ring in rings if len(ring) for k in [min(range(len(ring)), key=ring.__getitem__)]]
    key = lambda r: (min(x for x, _ in r), min(y for _, y in r), max(x for x, _ in r), max(y for _, y in r), r)
    return sorted(turned, key=key)


def polygons(rings: Sequence[tuple[str, Ring]]) -> list[list[Ring]]:
    """Shapes (outer ring, holes) of rings with roles; an empty role follows from depth.

    Rings are unwrapped first.  Outer rings turn positive, holes negative; a hole
    goes to the smallest outer ring around it or around its copy a world away,
    and one without becomes an outer ring.
    """
    known = [(role, unwrapped(ring)) for role, ring in rings if len(ring) >= 3]
    size = [abs(area2(ring)) for _, ring in known]
    roles = []
    for k, (role, ring) in enumerate(known):
        if not role:
            depth = sum(size[j] > size[k] and held_at(other, ring) is not None for j, (_, other) in enumerate(known) if j != k)
            role = "inner" if depth % 2 else "outer"
        roles.append(role)
    turned = lambda ring, positive: ring if (area2(ring) > 0) == positive else ring[::-1]
    outer = in_order([ring for role, (_, ring) in zip(roles, known, strict=True) if role == "outer"])
    inner = in_order([ring for role, (_, ring) in zip(roles, known, strict=True) if role == "inner"])
    shapes = [[turned(ring, True)] for ring in outer]
    alone = []
    for ring in inner:
        around = [(abs(area2(s[0])), k, shift) for k, s in enumerate(shapes) if abs(area2(s[0])) > abs(area2(ring)) and (shift := held_at(s[0], ring)) is not None]
        if around:
            _, k, shift = min(around)
            shapes[k].append([(x + shift, y) for x, y in turned(ring, False)])
        else:
            alone.append([turned(ring, True)])
    return shapes + alone


def held_at(outer: Sequence[Point], ring: Sequence[Point]) -> float | None:
    """By how many worlds a ring is moved to be inside another; None: by none."""
    low, high = min(x for x, _ in outer), max(x for x, _ in outer)
    for shift in (0.0, 1.0, -1.0):
        if all(low <= x + shift <= high for x, _ in ring) and contains(outer, [(x + shift, y) for x, y in ring] if shift else ring):
            return shift
    return None


def clip_ring(ring: Sequence[Point], x0: float, y0: float, x1: float, y1: float, rounded: bool = False) -> Ring:
    """A ring cut to a rectangle by four half planes; a crossing is rounded from its smaller end."""

    def half(points: Ring, axis: int, limit: float, keep_low: bool) -> Ring:
        within = lambda p: p[axis] <= limit if keep_low else p[axis] >= limit
        out: Ring = []
        for p, q in zip(points, [*points[1:], *points[:1]], strict=True):
            if within(p):
                out.append(p)
            if within(p) != within(q):
                a, b = min(p, q), max(p, q)
                t = (limit - a[axis]) / (b[axis] - a[axis])
                other = a[1 - axis] + t * (b[1 - axis] - a[1 - axis])
                if rounded:
                    other = int(other + 0.5) if other >= 0 else -int(-other + 0.5)
                out.append((limit, other) if axis == 0 else (other, limit))
        return out

    points = list(ring)
    for axis, limit, low in ((0, x0, False), (0, x1, True), (1, y0, False), (1, y1, True)):
        if points:
            points = half(points, axis, limit, low)
    clean = [p for k, p in enumerate(points) if p != points[k - 1]]
    return clean if len(clean) >= 3 else []
