"""Distances, boxes, tiles and line shapes. Points are degrees; lengths are metres."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

#: The Earth's radius and metres to a degree of longitude (at the equator) and latitude.
EARTH_M, LON_M, LAT_M = 6371000.0, 111320.0, 110540.0
#: Fixed value: points no farther apart count as one.
NEAR_M = 1.5
POINTS = "array<struct<lon:double,lat:double>>"


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_lat), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), F.lit(2))
    return F.asin(F.sqrt(a)) * (2 * EARTH_M)


def cells_within(lon: Column, lat: Column, size_m: float, reach_m: float = 0.0) -> Column:
    """array<struct<x, y, z>>: the cubes of `size_m` that a ball of `reach_m` around a point of the globe meets; by these, no pole or date line parts what is near."""
    a, b = F.radians(lon), F.radians(lat)
    axes = (EARTH_M * F.cos(b) * F.cos(a), EARTH_M * F.cos(b) * F.sin(a), EARTH_M * F.sin(b))
    more = reach_m + 0.01 if reach_m else 0.0
    xs, ys, zs = (F.sequence(F.floor((v - more) / size_m), F.floor((v + more) / size_m)) for v in axes)
    return F.flatten(F.transform(xs, lambda x: F.flatten(F.transform(ys, lambda y: F.transform(zs, lambda z: F.struct(x.alias("x"), y.alias("y"), z.alias("z")))))))


def _planar(lon: Column, lat: Column, lon0: Column, lat0: Column, scale: Column) -> tuple[Column, Column]:
    return (lon - lon0) * scale * LON_M, (lat - lat0) * LAT_M


def project_to_segment(lon: Column, lat: Column, lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """struct<distance_m, t>: distance to the segment, and where along it (not clamped) the foot is."""
    scale = F.cos(F.radians((lat1 + lat2) / 2))
    px, py = _planar(lon, lat, lon1, lat1, scale)
    dx, dy = _planar(lon2, lat2, lon1, lat1, scale)
    square = dx * dx + dy * dy
    t = F.when(square > 0, (px * dx + py * dy) / square).otherwise(F.lit(0.0))
    on = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.struct(F.sqrt(F.pow(px - on * dx, F.lit(2)) + F.pow(py - on * dy, F.lit(2))).alias("distance_m"), t.alias("t"))


def path_length_m(points: Column) -> Column:
    """Sum of the hops of an array of points."""
    hop = lambda a, b: F.when(b.isNull(), 0.0).otherwise(haversine_m(a["lon"], a["lat"], b["lon"], b["lat"]))
    return F.aggregate(F.zip_with(points, F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), hop), F.lit(0.0), lambda total, x: total + x)


def pad_bbox(west: Column, south: Column, east: Column, north: Column, metres: Column) -> Column:
    """The box grown on all sides, by LON_M to a degree both ways; at high latitudes the longitude scale stops at 0.2."""
    scale = F.greatest(F.cos(F.radians((south + north) / 2)), F.lit(0.2))
    x, y = metres / (LON_M * scale), metres / LON_M
    return F.struct((west - x).alias("west"), (south - y).alias("south"), (east + x).alias("east"), (north + y).alias("north"))


def quantize_bbox(west: Column, south: Column, east: Column, north: Column, step: float = 0.25) -> Column:
    """Indexes of the grid lines of `step` degrees around the box."""
    down, up = (lambda c: F.floor(c / step).cast("bigint")), (lambda c: F.ceil(c / step).cast("bigint"))
    return F.struct(down(west).alias("west"), down(south).alias("south"), up(east).alias("east"), up(north).alias("north"))


def diagonal_m(west: Column, south: Column, east: Column, north: Column) -> Column:
    """From the south-west corner of a box to the north-east one."""
    return haversine_m(west, south, east, north)


def same_point(a: Column, b: Column) -> Column:
    """Whether two points are the same, number by number."""
    return (a["lon"] == b["lon"]) & (a["lat"] == b["lat"])


def near_point(a: Column, b: Column, metres: float = NEAR_M) -> Column:
    """Whether two points are so near that they count as one."""
    return haversine_m(a["lon"], a["lat"], b["lon"], b["lat"]) <= metres


def bbox_intersects(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Whether two closed boxes (west, south, east, north) touch."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def touches_edge(points: Column, box: Column, margin: float = 0.02) -> Column:
    """Whether any point is within `margin` degrees of the rim of its region (or outside)."""
    return F.exists(points, lambda p: (p["lon"] <= box["west"] + margin) | (p["lon"] >= box["east"] - margin) | (p["lat"] <= box["south"] + margin) | (p["lat"] >= box["north"] - margin))


def detour_ok(straight_m: Column, physical_m: Column) -> Column:
    """False for a path far longer than its ends are apart; short hops may wind as they like."""
    return ~((straight_m > 1500) & (physical_m > F.greatest(straight_m * 3.8 + 6000, F.lit(12000.0))))


def tile_x(lon: Column, zoom: int) -> Column:
    return F.floor((lon + 180) / 360 * 2**zoom).cast("bigint")


def tile_y(lat: Column, zoom: int) -> Column:
    return F.floor((1 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2 * 2**zoom).cast("bigint")


def offset_degrees(pixels: Column, lat: Column, zoom: float) -> Column:
    """Degrees of longitude that so many screen pixels span at a zoom."""
    return pixels * 360.0 / (256 * 2.0**zoom) * F.cos(F.radians(lat))


def offset_path(points: Column, degrees: Column) -> Column:
    """The path moved sideways; the side is that of the undirected line, so both directions agree."""

    def moved(p: Column, k: Column) -> Column:
        a, b = F.try_element_at(points, F.greatest(k, F.lit(1))), F.try_element_at(points, F.least(k + 2, F.size(points)))
        dx, dy = b["lon"] - a["lon"], b["lat"] - a["lat"]
        flip = F.when((dx < 0) | ((dx == 0) & (dy < 0)), -1.0).otherwise(1.0)
        size = F.sqrt(dx * dx + dy * dy)
        return F.struct(F.when(size > 0, p["lon"] - flip * dy / size * degrees).otherwise(p["lon"]).alias("lon"), F.when(size > 0, p["lat"] + flip * dx / size * degrees).otherwise(p["lat"]).alias("lat"))

    return F.transform(points, moved)


def _simplified(xy: np.ndarray, tolerance: float) -> np.ndarray:
    """Mask of the points that stay: both ends, and the farthest of each stretch beyond the tolerance."""
    keep = np.zeros(len(xy), bool)
    keep[[0, -1]] = True
    scale = np.array([LON_M * math.cos(math.radians(xy[0, 1])), LAT_M])
    flat, todo = xy * scale, [(0, len(xy) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        along, off = flat[b] - flat[a], flat[a + 1 : b] - flat[a]
        square = along @ along
        t = np.clip(off @ along / square, 0, 1) if square else np.zeros(len(off))
        far = np.hypot(*(off - t[:, None] * along).T)
        at = int(far.argmax())
        if far[at] > tolerance:
            keep[a + 1 + at] = True
            todo += [(a, a + 1 + at), (a + 1 + at, b)]
    return keep


def simplify_path(points: Column, tolerance_m: float = 8.0) -> Column:
    """Douglas-Peucker: fewer points, none left out farther off than the tolerance. Short paths and tolerance 0 stay."""

    @F.arrow_udf(POINTS)
    def run(paths: pa.Array) -> pa.Array:
        out = []
        for path in paths.to_pylist():
            if path and len(path) > 2 and tolerance_m > 0:
                keep = _simplified(np.array([(p["lon"], p["lat"]) for p in path]), tolerance_m)
                path = [p for p, stays in zip(path, keep) if stays]
            out.append(path)
        return pa.array(out, pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())])))

    return run(points)


def _metres(a: tuple[float, float], b: tuple[float, float]) -> float:
    x, y = math.radians(b[0] - a[0]) / 2, math.radians(b[1] - a[1]) / 2
    return 2 * EARTH_M * math.asin(math.sqrt(math.sin(y) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(x) ** 2))


def fit_end(path: list[tuple[float, float]], shown: tuple[float, float], search: int = 12) -> list[tuple[float, float]]:
    """`path` with its first point brought to the point where the station is shown.

    Near enough (1.5 m): as it is. Else the nearest of the first segments within 45 m, where
    the foot lies on it, is cut there; else a point up to 500 m away is put in front.
    """
    if not path or _metres(path[0], shown) <= 1.5:
        return path
    best = None
    for k, (a, b) in enumerate(zip(path[:search], path[1 : search + 1])):
        scale = math.cos(math.radians((a[1] + b[1]) / 2)) * LON_M
        px, py, dx, dy = (shown[0] - a[0]) * scale, (shown[1] - a[1]) * LAT_M, (b[0] - a[0]) * scale, (b[1] - a[1]) * LAT_M
        square = dx * dx + dy * dy
        t = (px * dx + py * dy) / square if square else 0.0
        on = min(1.0, max(0.0, t))
        off = math.hypot(px - on * dx, py - on * dy)
        if -0.02 <= t <= 1.02 and off <= 45 and (best is None or off < best[0]):
            best = (off, k)
    if best:
        return [shown, *path[best[1] + 1 :]]
    return [shown, *path] if _metres(path[0], shown) <= 500 else path


def trim_path(points: Column, start: Column, end: Column) -> Column:
    """The path with both ends brought to where their stations are shown; a null station leaves its end."""

    @F.arrow_udf(POINTS)
    def run(paths: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        out = []
        for path, a, b in zip(paths.to_pylist(), starts.to_pylist(), ends.to_pylist()):
            if path:
                line = [(p["lon"], p["lat"]) for p in path]
                line = fit_end(line, (a["lon"], a["lat"])) if a else line
                line = fit_end(line[::-1], (b["lon"], b["lat"]))[::-1] if b else line
                path = [{"lon": x, "lat": y} for x, y in line]
            out.append(path)
        return pa.array(out, pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())])))

    return run(points, start, end)
