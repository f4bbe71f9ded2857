"""Distances, boxes and cell codes of points, as Column expressions, with planning helpers in plain Python.

Exact predicates are the contract; cell codes only help layouts and pruning.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.bindings import once

EARTH_RADIUS_M = 6_371_000.0

# ---- distances and boxes


def haversine(lat1: Column, lon1: Column, lat2: Column | float, lon2: Column | float) -> Column:
    """Metres along the sphere; degrees in."""
    p, q = F.radians(lat1), F.radians(F.lit(lat2))
    a = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(F.lit(lon2) - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def within_radius(lat: Column, lon: Column, center: tuple[float, float], meters: float) -> Column:
    """Exact distance test behind bands of latitude and, away from poles and antimeridian, longitude that reach the scan."""
    reach = math.degrees(meters / EARTH_RADIUS_M) * (1 + 1e-9) + 1e-9
    band = lat.between(center[0] - reach, center[0] + reach)
    if abs(center[0]) + reach < 90:
        wide = math.degrees(math.asin(min(1.0, math.sin(math.radians(reach)) / math.cos(math.radians(center[0]))))) + 1e-9
        if center[1] - wide >= -180 and center[1] + wide <= 180:
            band = band & lon.between(center[1] - wide, center[1] + wide)
    return band & (haversine(lat, lon, *center) <= meters)


def within_box(columns: list[Column], low: list[float], high: list[float]) -> Column:
    """Each coordinate between its bounds, ends included; works for any number of dimensions."""
    out = F.lit(True)
    for c, a, b in zip(columns, low, high, strict=True):
        if a > b:
            raise ValueError("a box's lower bound exceeds its upper bound")
        out = c.between(a, b) if out is None else out & c.between(a, b)
    return out


# ---- Morton codes


def _fold(x: Column, steps: list[tuple[int, int]], spread: bool) -> Column:
    for shift, mask in steps:
        x = (x.bitwiseOR(F.shiftleft(x, shift)) if spread else x.bitwiseOR(F.shiftright(x, shift))).bitwiseAND(F.lit(mask))
    return x


def _steps(bits: int, gap: int) -> list[tuple[int, int]]:
    """Shifts and masks that put ``gap`` zeros between bits, from wide moves to narrow ones."""
    width, out = 1 << max(0, (bits - 1).bit_length()), []
    while width > 1:
        half = width // 2
        mask = sum(1 << (i // half * half * (gap + 1) + i % half) for i in range(bits))
        out.append((half * gap, mask))
        width = half
    return out


def spread_bits(x: Column, bits: int, gap: int) -> Column:
    return _fold(x.cast("long").bitwiseAND(F.lit((1 << bits) - 1)), _steps(bits, gap), True)


def gather_bits(x: Column, bits: int, gap: int) -> Column:
    steps = _steps(bits, gap)
    full = (1 << bits) - 1
    masks = [m for _, m in steps][::-1]
    out = x.bitwiseAND(F.lit(masks[0]))
    for (shift, _), mask in zip(reversed(steps), [*masks[1:], full], strict=True):
        out = out.bitwiseOR(F.shiftright(out, shift)).bitwiseAND(F.lit(mask))
    return out


def grid(x: Column, bits: int) -> Column:
    """Coordinate in [0, 1] to a cell number."""
    return F.least(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) * (1 << bits)), F.lit((1 << bits) - 1)).cast("long")


def normalize(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low)))


def denormalize(x: Column, low: float, high: float) -> Column:
    return x * (high - low) + low


def morton(coordinates: list[Column], bits: int) -> Column:
    """Interleaved code of 2 (up to 30 bits) or 3 (up to 20 bits) coordinates in [0, 1]; the first has the lowest bits."""
    n = len(coordinates)
    out = F.lit(0).cast("long")
    for k, c in enumerate(coordinates):
        out = out.bitwiseOR(F.shiftleft(spread_bits(grid(c, bits), bits, n - 1), k))
    return out


def morton_decode(code: Column, n: int, bits: int) -> list[Column]:
    """Lower corners of the code's cell, in [0, 1]."""
    return [gather_bits(F.shiftright(code, k), bits, n - 1) / float(1 << bits) for k in range(n)]


def morton_value(coordinates: list[float], bits: int) -> int:
    """The code of one point, for bounds of a scan."""
    cells = [min(int(min(1.0, max(0.0, c)) * (1 << bits)), (1 << bits) - 1) for c in coordinates]
    return sum((cell >> b & 1) << (b * len(cells) + k) for k, cell in enumerate(cells) for b in range(bits))


def morton_bounds(low: list[float], high: list[float], bits: int) -> tuple[int, int]:
    """Least and greatest code of a box: codes rise with each coordinate, so those of its corners bound all inside."""
    return morton_value(low, bits), morton_value(high, bits)


# ---- geohash

#: Fixed value: the public geohash alphabet.
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def geohash(lat: Column, lon: Column, precision: int = 7) -> Column:
    """Characters of 5 bits, longitude first."""
    if not 1 <= precision <= 12:
        raise ValueError("precision is 1 to 12")
    total = 5 * precision
    lon_bits, lat_bits = (total + 1) // 2, total // 2
    x, y = spread_bits(grid((lon + 180) / 360, lon_bits), lon_bits, 1), spread_bits(grid((lat + 90) / 180, lat_bits), lat_bits, 1)
    code = F.shiftleft(x, 1).bitwiseOR(y) if total % 2 == 0 else x.bitwiseOR(F.shiftleft(y, 1))
    at = [F.shiftright(code, 5 * (precision - 1 - i)).bitwiseAND(F.lit(31)) for i in range(precision)]
    return F.concat(*[F.substring(F.lit(BASE32), (a + 1).cast("int"), F.lit(1)) for a in at])


def geohash_bounds(code: str) -> tuple[float, float, float, float]:
    """South, west, north, east of a cell."""
    bits = "".join(f"{BASE32.index(c):05b}" for c in code)
    lon, lat = bits[::2], bits[1::2]
    west, south = int(lon, 2) * 360 / 2 ** len(lon) - 180, int(lat or "0", 2) * 180 / 2 ** len(lat) - 90
    return south, west, south + 180 / 2 ** len(lat), west + 360 / 2 ** len(lon)


def geohash_of(lat: float, lon: float, precision: int) -> str:
    total = 5 * precision
    nx, ny = (total + 1) // 2, total // 2
    x, y = (min(int((v + h) / (2 * h) * (1 << n)), (1 << n) - 1) for v, h, n in ((lon, 180, nx), (lat, 90, ny)))
    bits = "".join(f"{(x if i % 2 == 0 else y) >> ((nx if i % 2 == 0 else ny) - 1 - i // 2) & 1}" for i in range(total))
    return "".join(BASE32[int(bits[i : i + 5], 2)] for i in range(0, total, 5))


def geohash_neighbors(code: str) -> dict[str, str]:
    """The cells around; rows end at the poles, columns go round."""
    south, west, north, east = geohash_bounds(code)
    height, width = north - south, east - west
    out = {}
    for dy, row in ((1, "n"), (0, ""), (-1, "s")):
        for dx, side in ((-1, "w"), (0, ""), (1, "e")):
            lat, lon = (south + north) / 2 + dy * height, ((west + east) / 2 + dx * width + 540) % 360 - 180
            if (dx or dy) and -90 < lat < 90:
                out[row + side] = geohash_of(lat, lon, len(code))
    return out


def geohash_size_km(precision: int, lat: float = 0.0) -> tuple[float, float]:
    """Height and width of a cell."""
    total = 5 * precision
    km = math.radians(1) * EARTH_RADIUS_M / 1000
    return 180 / 2 ** (total // 2) * km, 360 / 2 ** ((total + 1) // 2) * km * math.cos(math.radians(lat))


def geohash_precision(radius_km: float, lat: float = 0.0) -> int:
    """Finest precision whose cells are at least as large as the radius."""
    return next((p for p in range(12, 0, -1) if min(geohash_size_km(p, lat)) >= radius_km), 1)


def geohash_cover(south: float, west: float, north: float, east: float, precision: int) -> list[str]:
    """Cells that meet a box; west > east crosses the antimeridian."""
    if west > east:
        return sorted({*geohash_cover(south, west, north, 180.0, precision), *geohash_cover(south, -180.0, north, east, precision)})
    total = 5 * precision
    height, width = 180 / 2 ** (total // 2), 360 / 2 ** ((total + 1) // 2)
    rows = range(int((south + 90) // height), min(int((north + 90) // height), 2 ** (total // 2) - 1) + 1)
    columns = range(int((west + 180) // width), min(int((east + 180) // width), 2 ** ((total + 1) // 2) - 1) + 1)
    return sorted(geohash_of((r + 0.5) * height - 90, (c + 0.5) * width - 180, precision) for r in rows for c in columns)


# ---- cells of the sphere: cube faces, a quadratic projection and a curve over 30 levels

#: Fixed values of the public cell scheme: place on the curve by orientation and quadrant, and the turn by place.
CELL_PLACE = ((0, 1, 3, 2), (0, 3, 1, 2), (2, 3, 1, 0), (2, 1, 3, 0))
CELL_TURN = (1, 0, 0, 3)
CELL_LEVELS = 30


def cell_id(lat: Column, lon: Column) -> Column:
    """Leaf cell as a signed long; order holds within a face."""
    p, q = F.radians(lat), F.radians(lon)
    return cell_of_point(F.cos(p) * F.cos(q), F.cos(p) * F.sin(q), F.sin(p))


#: Levels of the curve that one look-up passes.
CELL_STRIDE = 3


def _walk(turn: int, i: int, j: int) -> tuple[int, int]:
    """Place on the curve and the turn after CELL_STRIDE levels."""
    place = 0
    for k in reversed(range(CELL_STRIDE)):
        at = CELL_PLACE[turn][2 * (i >> k & 1) + (j >> k & 1)]
        place, turn = place << 2 | at, turn ^ CELL_TURN[at]
    return place, turn


def _table(values: list[int]) -> Column:
    """An array that is folded to one constant, also inside a lambda."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _curve(start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """A long carried over the strides; step gets it and the number of levels below the stride."""
    return F.aggregate(_table(list(reversed(range(0, CELL_LEVELS, CELL_STRIDE)))), start.cast("long"), step)


def _bits(x: Column, n: int) -> Column:
    return x.bitwiseAND(F.lit((1 << n) - 1))


def cell_of_point(x: Column, y: Column, z: Column) -> Column:
    """Leaf cell of the direction (x, y, z), of any length."""
    return once(F.struct(x.alias("x"), y.alias("y"), z.alias("z")), lambda p: once(_face(p["x"], p["y"], p["z"]), _leaf))


def _face(x: Column, y: Column, z: Column) -> Column:
    """Struct of cube face, u and v."""
    ax, ay, az = F.abs(x), F.abs(y), F.abs(z)
    on = lambda face, u, v: F.struct(F.lit(face).cast("long").alias("face"), u.alias("u"), v.alias("v"))
    first = F.when(x < 0, on(3, z / x, y / x)).otherwise(on(0, y / x, z / x))
    second = F.when(y < 0, on(4, z / y, -x / y)).otherwise(on(1, -x / y, z / y))
    third = F.when(z < 0, on(5, -y / z, -x / z)).otherwise(on(2, -x / z, -y / z))
    return F.when((ax >= ay) & (ax >= az), first).when(ay >= az, second).otherwise(third)


def _leaf(at: Column) -> Column:
    """Leaf id of a place on a cube face."""
    square = lambda t: F.when(t >= 0, 0.5 * F.sqrt(1 + 3 * t)).otherwise(1 - 0.5 * F.sqrt(1 - 3 * t))
    spots = F.struct(grid(square(at["u"]), CELL_LEVELS).alias("i"), grid(square(at["v"]), CELL_LEVELS).alias("j"))
    n = 1 << CELL_STRIDE
    # carried: place on the curve, then two bits for the turn; by i, j and turn
    table = _table([place << 2 | turn for i in range(n) for j in range(n) for t in range(4) for place, turn in [_walk(t, i, j)]])

    def walk(spot: Column) -> Column:
        def step(acc: Column, below: Column) -> Column:
            k = below.cast("int")
            piece = lambda c: _bits(F.call_function("shiftright", c, k), CELL_STRIDE)
            key = F.shiftleft(piece(spot["i"]), CELL_STRIDE + 2) + F.shiftleft(piece(spot["j"]), 2) + _bits(acc, 2)
            return F.shiftleft(acc - _bits(acc, 2), 2 * CELL_STRIDE) + F.get(table, key.cast("int"))

        return _curve(_bits(at["face"], 1), step)

    return F.shiftleft(at["face"], 61).bitwiseOR(F.shiftleft(F.shiftright(once(spots, walk), 2), 1)).bitwiseOR(F.lit(1))


def _direction(face: Column, u: Column, v: Column) -> tuple[Column, Column, Column]:
    """Point of a cube face."""
    one = F.lit(1.0)
    rows = ((one, u, v), (-u, one, v), (-u, -v, one), (-one, -v, -u), (v, -one, -u), (v, u, -one))
    pick = lambda k: reduce(lambda out, f: F.when(face == f, rows[f][k]).otherwise(out), range(4, -1, -1), rows[5][k])
    return pick(0), pick(1), pick(2)


def _unsquared(s: Column) -> Column:
    """Place on a face's edge, 0 to 1 (and a little beyond), to the cube's coordinate."""
    return F.when(s >= 0.5, (4 * s * s - 1) / 3).otherwise((1 - 4 * (1 - s) * (1 - s)) / 3)


def cell_place(cell: Column, level: int) -> Column:
    """Struct of face, i and j (0 to 2**level - 1) of a cell's ancestor at ``level``, or of itself."""
    n, wide = 1 << CELL_STRIDE, 2 * CELL_STRIDE
    back = {(t, place): (i, j, turn) for i in range(n) for j in range(n) for t in range(4) for place, turn in [_walk(t, i, j)]}
    # carried: i, then 30 bits for j and two for the turn; by place and turn
    table = _table([i << CELL_LEVELS + 2 | j << 2 | turn for place in range(n * n) for t in range(4) for i, j, turn in [back[t, place]]])

    def walk(c: Column) -> Column:
        def step(acc: Column, below: Column) -> Column:
            place = _bits(F.call_function("shiftright", c, below.cast("int") * 2 + 1), wide)
            return F.shiftleft(acc - _bits(acc, 2), CELL_STRIDE) + F.get(table, (F.shiftleft(place, 2) + _bits(acc, 2)).cast("int"))

        # bits below the ancestor's level are walked too and fall away here
        out = lambda acc: F.struct(F.shiftrightunsigned(c, 61).cast("int").alias("face"), F.shiftright(acc, 2 * CELL_LEVELS + 2 - level).alias("i"), F.shiftright(_bits(acc, CELL_LEVELS + 2), CELL_LEVELS + 2 - level).alias("j"))
        return once(_curve(_bits(F.shiftrightunsigned(c, 61), 1), step), out)

    return once(cell, walk)


def cell_center(cell: Column, level: int = CELL_LEVELS) -> tuple[Column, Column]:
    """Latitude and longitude of the middle of a cell of that level."""
    n = float(1 << level)
    spot = once(cell_place(cell, level), lambda at: F.struct(at["face"].alias("face"), ((at["i"] + 0.5) / n).alias("i"), ((at["j"] + 0.5) / n).alias("j")))
    plane = once(spot, lambda s: F.struct(s["face"].alias("face"), _unsquared(s["i"]).alias("u"), _unsquared(s["j"]).alias("v")))
    point = once(plane, lambda p: F.struct(*[c.alias(k) for k, c in zip("xyz", _direction(p["face"], p["u"], p["v"]), strict=True)]))
    middle = once(point, lambda p: F.struct(F.degrees(F.atan2(p["z"], F.sqrt(p["x"] * p["x"] + p["y"] * p["y"]))).alias("lat"), F.degrees(F.atan2(p["y"], p["x"])).alias("lon")))
    return middle["lat"], middle["lon"]


def cell_children(cell: Column) -> Column:
    """The four cells below a cell, in the curve's order; null for a leaf."""
    low = cell.bitwiseAND(-cell)
    step = F.shiftright(low, 2)
    return F.when(low > 1, F.array(*[cell - low + step * (2 * k + 1) for k in range(4)]))


def cell_neighbors(cell: Column, level: int) -> Column:
    """The four cells of that level that share an edge, across faces too: below, right, above, left."""
    n, edge = float(1 << level), 1 + 1e-15
    beyond = lambda s: F.greatest(F.lit(-edge), F.least(F.lit(edge), _unsquared(s)))
    sides = lambda at: F.array(*[F.struct(at["face"].alias("face"), beyond((at["i"] + (0.5 + di)) / n).alias("u"), beyond((at["j"] + (0.5 + dj)) / n).alias("v")) for di, dj in ((0, -1), (1, 0), (0, 1), (-1, 0))])
    points = lambda p: F.struct(*[c.alias(k) for k, c in zip("xyz", _direction(p["face"], p["u"], p["v"]), strict=True)])
    # one transform after the other, so that each step is written out once
    four = F.transform(F.flatten(F.transform(F.array(cell_place(cell, level)), sides)), points)
    return F.transform(four, lambda q: cell_parent(cell_of_point(q["x"], q["y"], q["z"]), level))


class _Cell(NamedTuple):
    """A cell by face, level and place, for covers that are worked out where the query is written."""

    face: int
    level: int
    i: int
    j: int

    def point(self, di: float, dj: float) -> tuple[float, float, float]:
        n = 1 << self.level
        u, v = ((4 * s * s - 1) / 3 if s >= 0.5 else (1 - 4 * (1 - s) * (1 - s)) / 3 for s in ((self.i + di) / n, (self.j + dj) / n))
        p = ((1, u, v), (-u, 1, v), (-u, -v, 1), (-1, -v, -u), (v, -1, -u), (v, u, -1))[self.face]
        size = math.sqrt(sum(c * c for c in p))
        return tuple(c / size for c in p)

    def cap(self) -> tuple[tuple[float, float, float], float]:
        """Middle, and the angle to the furthest corner: a cap that holds the cell."""
        middle = self.point(0.5, 0.5)
        return middle, max(_angle(middle, self.point(a, b)) for a in (0, 1) for b in (0, 1)) + 1e-12

    def children(self) -> list[_Cell]:
        return [_Cell(self.face, self.level + 1, 2 * self.i + a, 2 * self.j + b) for a in (0, 1) for b in (0, 1)]

    def leaves(self) -> tuple[int, int]:
        """First and last leaf id, signed."""
        out, turn = self.face, self.face & 1
        for k in reversed(range(self.level)):
            at = CELL_PLACE[turn][2 * (self.i >> k & 1) + (self.j >> k & 1)]
            out, turn = out << 2 | at, turn ^ CELL_TURN[at]
        shift = 2 * (CELL_LEVELS - self.level) + 1
        low, high = (out << shift) + 1, ((out + 1) << shift) - 1
        return tuple(x - (1 << 64) if x >> 63 else x for x in (low, high))


def _angle(p: tuple, q: tuple) -> float:
    return 2 * math.asin(min(1.0, math.dist(p, q) / 2))


def _cover(meets: Callable[[_Cell], int], most: int, level: int) -> list[tuple[int, int]]:
    """Merged leaf ranges of at most about ``most`` cells that hold a region; meets: 0 outside, 1 partly, 2 inside."""
    open_ = [c for c in (_Cell(f, 0, 0, 0) for f in range(6)) if meets(c)]
    done: list[_Cell] = []
    while open_:
        open_.sort(key=lambda c: c.level)
        cell = open_.pop(0)
        if meets(cell) == 2 or cell.level >= level:
            done.append(cell)
            continue
        parts = [c for c in cell.children() if meets(c)]
        if len(parts) > 1 and len(done) + len(open_) + len(parts) > most:
            done.append(cell)
        else:
            open_ += parts
    out: list[tuple[int, int]] = []
    for low, high in sorted(c.leaves() for c in done):
        if out and low <= out[-1][1] + 2:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def cells_around(lat: float, lon: float, meters: float, most: int = 16, level: int = CELL_LEVELS) -> list[tuple[int, int]]:
    """Leaf ranges that hold all points within a distance."""
    p, q = math.radians(lat), math.radians(lon)
    center, reach = (math.cos(p) * math.cos(q), math.cos(p) * math.sin(q), math.sin(p)), meters / EARTH_RADIUS_M * (1 + 1e-9) + 1e-12

    def meets(cell: _Cell) -> int:
        middle, size = cell.cap()
        far = _angle(center, middle)
        return 0 if far > reach + size else 2 if far + size <= reach else 1

    return _cover(meets, most, level)


def cells_of_box(south: float, west: float, north: float, east: float, most: int = 16, level: int = CELL_LEVELS) -> list[tuple[int, int]]:
    """Leaf ranges that hold a box; west > east crosses the antimeridian."""

    def meets(cell: _Cell) -> int:
        (x, y, z), size = cell.cap()
        lat, lon, size = math.degrees(math.asin(max(-1.0, min(1.0, z)))), math.degrees(math.atan2(y, x)), math.degrees(size)
        if lat - size > north or lat + size < south:
            return 0
        if abs(lat) + size >= 90:
            return 1
        wide = math.degrees(math.asin(min(1.0, math.sin(math.radians(size)) / math.cos(math.radians(lat)))))
        span = (east - west) % 360 if east != west + 360 else 360.0
        off = (lon - wide - west) % 360  # where the cell begins, eastwards from the box's west side
        if off > span and off + 2 * wide < 360:
            return 0
        return 2 if lat - size >= south and lat + size <= north and off + 2 * wide <= span else 1

    return _cover(meets, most, level)


def in_ranges(cell: Column, ranges: list[tuple[int, int]]) -> Column:
    """Whether a stored leaf lies in one of the ranges: filters that reach the scan.

    ``cell`` is named twice for each range: one that the query works out itself belongs in ``once``.
    """
    return reduce(lambda out, r: out | cell.between(*r), ranges, F.lit(False))


def _low(level: int) -> int:
    return 1 << 2 * (CELL_LEVELS - level)


def cell_parent(cell: Column, level: int) -> Column:
    return cell.bitwiseAND(F.lit(-_low(level))).bitwiseOR(F.lit(_low(level)))


def cell_range(cell: Column) -> tuple[Column, Column]:
    """First and last leaf below a cell."""
    low = cell.bitwiseAND(-cell)
    return cell - low + 1, cell + low - 1


def cell_contains(cell: Column, other: Column) -> Column:
    a, b = cell_range(cell)
    return other.between(a, b)


def geo3d_code(lat: Column, lon: Column, altitude: Column, low: float, high: float) -> Column:
    """Altitude in the high 24 bits, the cell's top 40 bits below; signed, so that high altitudes are negative."""
    height = grid(normalize(altitude, low, high), 24)
    return F.shiftleft(height, 40).bitwiseOR(F.shiftrightunsigned(cell_id(lat, lon), 24))


def geo3d_decode(code: Column, low: float, high: float) -> tuple[Column, Column, Column]:
    """Latitude, longitude (of the cell of level 18 that the 40 bits name) and altitude (the lower bound of its step)."""
    cell = F.shiftleft(code.bitwiseAND(F.lit((1 << 40) - 1)), 24).bitwiseOR(F.lit(1 << 23))
    lat, lon = cell_center(cell, 18)
    return lat, lon, denormalize(F.shiftrightunsigned(code, 40) / float(1 << 24), low, high)
