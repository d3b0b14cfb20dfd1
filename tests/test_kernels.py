import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tilewright.kernels import lines as L
from tilewright.kernels import overlay as O
from tilewright.kernels import polygons as P
from tilewright.kernels import rings as K

coordinate = st.integers(-50, 50)
path = st.lists(st.tuples(coordinate, coordinate), min_size=2, max_size=25)


def distance(p, a, b):
    d = b - a
    n = float(d @ d)
    t = min(1.0, max(0.0, float((p - a) @ d) / n)) if n else 0.0
    return float(np.hypot(*(p - a - t * d)))


@settings(max_examples=60, deadline=None)
@given(path, st.floats(0.5, 20))
def test_simplified_line_stays_within_tolerance(points, tolerance):
    p = np.array(points, dtype=float)
    kept = L.simplify(p, tolerance)
    assert kept[0] == 0 and kept[-1] == len(p) - 1
    for a, b in zip(kept[:-1], kept[1:], strict=True):
        assert all(distance(p[k], p[a], p[b]) <= tolerance + 1e-9 for k in range(a, b + 1))


def test_pinned_vertices_stay():
    p = np.array([[0, 0], [1, 0], [2, 0], [3, 0]], dtype=float)
    assert L.simplify(p, 1, np.array([False, False, True, False])).tolist() == [0, 2, 3]


@settings(max_examples=60, deadline=None)
@given(path)
def test_clipped_pieces_lie_inside_and_keep_length(points):
    pieces = L.clip_line(points, -20, -20, 20, 20)
    assert all(-20 - 1e-9 <= c <= 20 + 1e-9 for piece in pieces for p in piece for c in p)
    if all(-20 <= c <= 20 for p in points for c in p):
        length = lambda ps: sum(math.dist(a, b) for a, b in zip(ps[:-1], ps[1:], strict=True))
        assert math.isclose(sum(map(length, pieces)), length(points), abs_tol=1e-9)


def test_merge_chains_through_shared_ends_only():
    lines = [[(0, 0), (1, 0)], [(1, 0), (2, 0)], [(2, 0), (1, 0)], [(2, 0), (3, 1)], [(5, 5), (6, 6)]]
    merged = L.merge_lines(lines)
    assert sorted(map(len, merged)) == [2, 4]
    assert len(L.merge_lines(lines, on_edge=lambda p: p == (1, 0))) == 3


def test_area_and_inside():
    square = [(0, 0), (4, 0), (4, 4), (0, 4)]
    assert K.area2(square) == 32 and K.area2(square[::-1]) == -32
    assert K.inside((1, 1), square) and not K.inside((5, 1), square)
    assert K.centroid([square]) == (2, 2)
    hole = [(0, 0), (2, 0), (2, 4), (0, 4)]
    assert K.centroid([square, hole]) == (3, 2)


def test_simple_and_convex():
    assert K.is_simple([(0, 0), (4, 0), (4, 4), (0, 4)]) and not K.is_simple([(0, 0), (4, 4), (4, 0), (0, 4)])
    assert K.is_convex([(0, 0), (4, 0), (4, 4), (0, 4)]) and not K.is_convex([(0, 0), (4, 0), (1, 1), (0, 4)])


def test_surface_point_is_inside_a_concave_ring():
    c = [(0, 0), (10, 0), (10, 2), (2, 2), (2, 8), (10, 8), (10, 10), (0, 10)]
    assert K.inside(K.point_on_surface([c]), c)


def test_rings_are_assembled_from_pieces_in_any_order():
    pieces = [[(0, 0), (4, 0)], [(4, 4), (4, 0)], [(4, 4), (0, 4), (0, 0)], [(9, 9), (8, 8)]]
    for seed in range(6):
        shuffled = [p[:: random.Random(seed).choice([1, -1])] for p in pieces]
        random.Random(seed).shuffle(shuffled)
        rings, dropped = K.assemble(shuffled)
        assert len(rings) == 1 and abs(K.area2(rings[0])) == 32 and dropped == 1


def test_roles_follow_from_depth_and_holes_go_to_the_smallest_shell():
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    shapes = K.polygons([("", square(0, 100)), ("", square(10, 90)), ("", square(20, 80)), ("inner", square(30, 40)), ("inner", square(200, 210))])
    assert sorted(len(s) for s in shapes) == [1, 2, 2]
    assert all(K.area2(s[0]) > 0 and all(K.area2(h) < 0 for h in s[1:]) for s in shapes)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(coordinate, coordinate), min_size=3, max_size=8, unique=True))
def test_clipped_ring_area_never_grows(points):
    if not K.is_simple(points):
        return
    clipped = K.clip_ring(points, -20, -20, 20, 20)
    area = abs(K.area2(clipped)) if clipped else 0
    assert area <= abs(K.area2(points)) + 1e-6 and area <= 2 * 40 * 40 + 1e-6


def unbuffered(tiles, z):
    """Doubled area of what tiles of a zoom have inside their own cells."""
    total = 0
    for t in tiles:
        if t.z == z:
            total += sum(K.area2(r) for s in O.clipped(t.rings or P.full_tile(), 0, 0, 4096, 4096) for r in s)
    return total


def test_polygon_tiles_cover_the_area_at_the_top_zoom():
    n = 1 << 14
    ring = [(x / n, y / n) for x, y in ((8000.2, 6000.3), (8002.7, 6000.1), (8002.1, 6002.9), (8000.4, 6002.2))]
    shapes = P.shape_on_grid([ring])
    assert abs(unbuffered(P.tiles(shapes, 14), 14) - abs(K.area2(P.quantized(ring)))) < 4096 * 8
    [one, two] = P.shape_on_grid([[(0, 0), (0.5, 0.5), (0.5, 0), (0, 0.5)]])  # crosses itself
    assert K.area2(one[0]) == K.area2(two[0]) == 1 << 49


def test_tiles_of_a_shape_with_holes_that_crosses_itself():
    draw = random.Random(4)
    n = 1 << 14
    for _ in range(12):
        outer = [(8000 / n + draw.random() / 4000, 6000 / n + draw.random() / 4000) for _ in range(7)]
        hole = [(x, y) for x, y in ((8001.5 / n, 6001.5 / n), (8002.4 / n, 6001.5 / n), (8002.2 / n, 6002.3 / n))]
        shapes = P.shape_on_grid([outer, hole])
        whole = sum(K.area2(r) for s in shapes for r in s)
        assert abs(unbuffered(P.tiles(shapes, 10), 14) - whole) < 4096 * 60
        for t in P.tiles(shapes, 10):
            assert all(K.is_simple(r) for r in t.rings) and K.area2(t.rings[0]) > 0 and all(K.area2(h) < 0 for h in t.rings[1:])


def test_a_narrower_zoom_window_is_the_full_build_restricted():
    shapes = P.shape_on_grid([[(0.5, 0.3), (0.5002, 0.3), (0.5002, 0.3003), (0.5, 0.3002)]])
    full = [t for t in P.tiles(shapes, 8) if t.z >= 11]
    assert sorted(full) == sorted(P.tiles(shapes, 11))


def test_covered_cells_stand_for_all_tiles_below():
    n = 1 << 14
    ring = [(x / n, y / n) for x, y in ((8000.5, 6000.5), (8040.5, 6000.5), (8040.5, 6040.5), (8000.5, 6040.5))]
    made = list(P.tiles(P.shape_on_grid([ring]), 9))
    whole = [t for t in made if not t.rings]
    assert any(t.z < 14 for t in whole) and len(made) < 41 * 41 / 2
    ids = sorted([P.tile_number(t.z, t.x, t.y) for t in made if t.z == 14 and t.rings] + [first + k for t in whole for z, first, c in P.below(t.z, t.x, t.y) if z == 14 for k in range(c)])
    assert ids == sorted(P.tile_number(14, x, y) for x in range(8000, 8041) for y in range(6000, 6041))
    assert len(ids) == len(set(ids))


def test_a_frontier_gives_the_same_tiles():
    draw = random.Random(7)
    angle = sorted(draw.random() * 2 * math.pi for _ in range(60))
    shapes = P.shape_on_grid([[(0.4 + math.cos(t) * (0.001 + 0.0004 * draw.random()), 0.4 + math.sin(t) * (0.001 + 0.0004 * draw.random())) for t in angle]])
    done, cells = P.frontier(shapes, 6, 13, items=9)
    assert len(cells) >= 9
    assert sorted(done + list(P.tiles_below(cells, 13))) == sorted(P.tiles(shapes, 6, 13))


def test_many_rings_are_told_apart(monkeypatch):
    monkeypatch.setattr(P, "RING_CAP", 10)
    holes = [[(x, y), (x, y + 40), (x + 40, y + 40), (x + 40, y)] for x in range(100, 4000, 400) for y in range(100, 4000, 400)]
    parts = P.halved([[(0, 0), (4096, 0), (4096, 4096), (0, 4096)], *holes], (0, 0), (4096, 4096))
    assert len(parts) > 8 and all(len(p) <= 10 for p in parts)
    assert sum(K.area2(r) for p in parts for r in p) == 2 * 4096**2 - 2 * 1600 * len(holes)


grid = st.integers(0, 30)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(grid, grid), min_size=3, max_size=9), min_size=1, max_size=3), st.integers(0, 10**6))
def test_overlay_covers_what_winds(rings, seed):
    """Against winding numbers at points off the grid; the result's rings are simple and turn by their roles."""
    scale = 1000  # crossings fall between grid points and are rounded far below a probe's distance
    big = [[(x * scale, y * scale) for x, y in r] for r in rings]
    shapes = O.overlay(big)

    def winding(p, r):
        total = 0
        for (ax, ay), (bx, by) in zip(r, [*r[1:], *r[:1]], strict=True):
            side = (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)
            total += (ay <= p[1] < by and side > 0) - (by <= p[1] < ay and side < 0)
        return total

    def near(p):
        return any(distance(np.array(p, float), np.array(a, float), np.array(b, float)) < 4 for r in big for a, b in zip(r, [*r[1:], *r[:1]], strict=True))

    draw = random.Random(seed)
    for _ in range(40):
        p = (draw.uniform(0, 30 * scale), draw.uniform(0, 30 * scale))
        if not near(p):
            assert (sum(winding(p, r) for r in big) != 0) == any(K.in_shape(p, s) for s in shapes)
    for s in shapes:
        assert K.area2(s[0]) > 0 and all(K.area2(h) < 0 for h in s[1:])
        assert all(len(set(r)) == len(r) for r in s)
    again = O.overlay([r for s in shapes for r in s])
    assert K.in_order([r for s in again for r in s]) == K.in_order([r for s in shapes for r in s])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-60, 60), st.integers(-60, 60)), min_size=3, max_size=9))
def test_clipped_shapes_and_their_rest_make_the_whole(points):
    ring = [(x * 100, y * 100) for x, y in points]
    whole = sum(K.area2(r) for s in O.overlay([ring]) for r in s)
    quarters = [O.clipped([ring], a, b, a + 6000, b + 6000) for a in (-6000, 0) for b in (-6000, 0)]
    assert abs(sum(K.area2(r) for q in quarters for s in q for r in s) - whole) <= 12_000 * 40
    fast = [P.clip_shape(s, 0, 0, 6000, 6000) for s in O.overlay([ring])]
    assert abs(sum(K.area2(r) for f in fast for s in f for r in s) - sum(K.area2(r) for s in quarters[3] for r in s)) <= 6000 * 40


def test_overlapping_rings_unite_and_touching_ones_stay_simple():
    square = lambda a, b, c, d: [(a, b), (c, b), (c, d), (a, d)]
    assert [len(s) for s in O.overlay([square(0, 0, 10, 10), square(5, 5, 15, 15), square(15, 15, 20, 20)])] == [1, 1]
    [ring] = O.overlay([square(0, 0, 10, 10), square(10, 0, 20, 10)])  # cells that share an edge
    assert sorted(ring[0]) == [(0, 0), (0, 10), (20, 0), (20, 10)]
    assert [len(s) for s in O.overlay([square(0, 0, 10, 10), square(2, 2, 8, 8)[::-1]])] == [2]


def test_visvalingam_drops_small_triangles_only():
    ring = [(0, 0), (50, 1), (100, 0), (100, 100), (50, 300), (0, 100)]
    assert P.visvalingam(ring, 256) == [(0, 0), (100, 0), (100, 100), (50, 300), (0, 100)]
    assert (50, 1) in P.visvalingam(ring, 256, {(50, 1)})
    assert len(P.visvalingam([(0, 0), (1, 0), (1, 1), (0, 1)], 256)) == 3


def test_ring_simplification_keeps_pins_and_forgets_the_start():
    ring = [(0, 0), (40, 3), (80, 0), (80, 80), (40, 77), (0, 80)]
    want = {(0, 0), (80, 0), (80, 80), (0, 80)}
    for k in range(len(ring)):
        assert set(P.simplified(ring[k:] + ring[:k], 16)) == want
    assert (40, 3) in P.simplified(ring, 16, {(40, 3)}) and P.simplified([(0, 0), (5, 0), (9, 0), (3, 0)], 16) == []
    points = np.array([*ring, ring[0]], dtype=float)
    for k in range(len(ring)):
        turned = np.concatenate((points[k:-1], points[: k + 1]))
        kept = turned[L.simplify_closed(turned, 16.0)]
        assert {tuple(p) for p in kept} == want and (kept[0] == kept[-1]).all()
    assert not len(L.simplify_closed(np.zeros((4, 2)), 1.0))
    flat = np.array([[0, 0], [9, 0], [0, 0]], dtype=float)
    assert len(L.simplify_closed(flat, 100.0)) == 3  # there and back


def test_line_tiles_equal_a_clip_of_each_tile():
    draw = random.Random(2)
    for _ in range(30):
        points = [(draw.uniform(0, 16), draw.uniform(0, 16)) for _ in range(draw.randrange(2, 9))]
        found = {(x, y): pieces for x, y, pieces in L.line_tiles(points, 4, 1 / 32)}
        for x in range(16):
            for y in range(16):
                want = L.clip_line(points, x - 1 / 32, y - 1 / 32, x + 1 + 1 / 32, y + 1 + 1 / 32)
                got = found.get((x, y), [])
                assert len(got) == len(want)
                assert all(math.dist(p, q) < 1e-9 for a, b in zip(got, want, strict=True) for p, q in zip(a, b, strict=True))


def test_assembly_survives_junctions_and_near_ends():
    eight = [[(0, 0), (4, 0), (4, 4), (2, 2)], [(2, 2), (0, 4), (0, 0)], [(2, 2), (6, 6), (2, 6), (2, 2.0000000001)]]
    rings, dropped = K.assemble(eight)
    assert dropped == 0 and sorted(abs(K.area2(r)) for r in rings) == [16, 24]
    assert K.assemble([[(0, 0), (1, 1)], [(1, 1), (2, 0)], [(5, 5), (6, 6)]]) == ([], 2)


def test_holes_are_found_a_world_away_and_on_edges():
    shell = [(0.9, 0.1), (1.1, 0.1), (1.1, 0.3), (0.9, 0.3)]
    hole = [(0.02, 0.15), (0.05, 0.15), (0.05, 0.2)]
    [shape] = K.polygons([("outer", shell), ("inner", hole)])
    assert len(shape) == 2 and all(1 < x < 1.1 for x, _ in shape[1])
    assert K.contains([(0, 0), (10, 0), (10, 10), (0, 10)], [(5, 0), (7, 5), (3, 5)])  # a vertex on an edge
    rings = [[(1, 1), (0, 0), (1, 0)], [(5, 5), (6, 5), (6, 6)]]
    assert K.in_order(rings) == K.in_order([rings[1][1:] + rings[1][:1], rings[0][2:] + rings[0][:2]])


def test_label_points_follow_their_rule():
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    ring, hole = square(0, 10), square(4, 6)[::-1]
    assert K.label_point([[ring]], "centroid") == (5, 5) == K.label_point([[ring]], "convex")
    assert K.in_shape(K.label_point([[ring, hole]], "convex"), [ring, hole])
    assert K.area_and_centroid([[ring, hole], [square(20, 21)]])[0] == 97
    assert K.label_point([[[(0, 0), (5, 0), (9, 0)]]], "surface") is None
    bow = [(0.0, 0.0), (1.0, 1.0), (1.0, 0.0), (0.0, 1.0 + 1e-12)]  # its lobes cancel
    assert all(0 <= c <= 1.1 for c in K.label_point([[bow]], "centroid"))
    near = K.area_and_centroid([[[(0.9, 0.1), (1.1, 0.1), (1.1, 0.3)]], [[(0.01, 0.1), (0.02, 0.1), (0.02, 0.11)]]])[1]
    assert 0.95 < near[0] < 1.1


def test_square_metres_shrink_with_the_latitude():
    cell = lambda y: [(0.5, y), (0.501, y), (0.501, y + 0.001), (0.5, y + 0.001)]
    assert math.isclose(K.area_m2(cell(0.4995)), (40_075.016686) ** 2, rel_tol=1e-4)
    assert K.area_m2(cell(0.3)) < K.area_m2(cell(0.4)) < K.area_m2(cell(0.4995))


def test_hilbert_ranges_are_exactly_the_rectangle():
    found = {d for first, n in P.hilbert_ranges(5, 3, 4, 17, 11, P.curve_place) for d in range(first, first + n)}
    assert found == {P.curve_place(5, x, y) for x in range(3, 18) for y in range(4, 12)}
    places = sorted(P.curve_place(4, x, y) for x in range(16) for y in range(16))
    assert places == list(range(256))
