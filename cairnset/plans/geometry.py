"""Queries on geometry and spatial joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import cqr, graph, hierarchy, search, spatial
from ..sources.domain import Domain
from .registry import query

# the same formulas in SQL


def _hav(a: str, b: str, c: str, d: str) -> str:
    return f"(2 * 6371000e0 * asin(least(1e0, sqrt(pow(sin(radians(({c}) - ({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians(({d}) - ({b})) / 2), 2)))))"


def _brg(a: str, b: str, c: str, d: str) -> str:
    return f"fmod(degrees(atan2(sin(radians(({d}) - ({b}))) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians(({d}) - ({b}))))) + 360, 360)"


def _xt(a: str, b: str, c: str, d: str, e: str, f: str) -> str:
    return f"(asin(sin({_hav(a, b, e, f)} / 6371000e0) * sin(radians({_brg(a, b, e, f)}) - radians({_brg(a, b, c, d)}))) * 6371000e0)"


def _at(a: str, b: str, c: str, d: str, e: str, f: str) -> str:
    return f"(acos(least(1e0, cos({_hav(a, b, e, f)} / 6371000e0) / cos({_xt(a, b, c, d, e, f)} / 6371000e0))) * 6371000e0)"


def _seg(a: str, b: str, c: str, d: str, e: str, f: str) -> str:
    return f"CASE WHEN {_at(a, b, c, d, e, f)} > {_hav(a, b, c, d)} THEN {_hav(c, d, e, f)} ELSE abs({_xt(a, b, c, d, e, f)}) END"


#: An item with the centre of its cell.
_J = ", j AS (SELECT i.item_id, i.lat, i.lon, c.lat AS lat0, c.lon AS lon0 FROM items i JOIN cells c USING (cell_id)) "
_P = ("lat0", "lon0", "lat", "lon")

#: The rings (closed implicitly) and points of the truth tables.
RINGS = {
    "A": [(1, 1), (1.5, 3.5), (2.5, 2.5)],
    "B": [(2, 2.5), (4, 1), (7, 1.5), (7, 4.5), (6, 2), (3, 4)],
    "C": [(6, 2.5), (6, 4.5), (6.5, 4.5), (6.5, 6.5), (3.5, 5)],
    "D": [(10, 7), (11, 4), (12, 5), (13, 4.5), (12.5, 8), (11, 8.5)],
    "E": [(10.5, 6.5), (11.5, 5), (12, 6), (11.5, 7)],
    "F": [(8.5, 2.5), (10, 1), (10, 2.5)],
    "G": [(6, 8.5), (8, 8.5), (7, 9.5), (8, 10.5), (6.5, 10.5), (6.5, 9), (6, 9)],
    "H": [(7.5, 9.5), (8.5, 9), (9.5, 10)],
    "I": [(8, 2), (9, 2), (9, 5.5), (6.5, 7.5), (4, 6.5)],
    "J": [(7.5, 5), (9.5, 5), (9.5, 6.5), (8, 7), (8, 5.5)],
}
POINTS = [(3.5, 2.5), (4.5, 5), (7, 6), (7, 10), (12, 7.5), (11.5, 6), (9, 2), (7, 2.5), (6, 2), (4, 3.5)]
RECTS = [(0.5, 3, 0.5, 9), (0.5, 6.1, 3.75, 8), (5.5, 9, 8, 40), (3, 9.75, -20, 100), (2, 3, 1, 1.4)]


def _joined(d: Domain) -> DataFrame:
    c = d.cells().select("cell_id", F.col("lat").alias("lat0"), F.col("lon").alias("lon0"))
    return d.items().join(c, "cell_id").select("item_id", "lat", "lon", "lat0", "lon0")


def _cols(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def _ring(points: list[tuple[float, float]]) -> Column:
    return F.array(*[F.struct(F.lit(float(y)).alias("lat"), F.lit(float(x)).alias("lon")) for y, x in [*points, points[0]]])


def rings(d: Domain) -> DataFrame:
    return d.spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(k).alias("poly_id"), _ring(v).alias("ring")) for k, v in RINGS.items()])))


def points(d: Domain) -> DataFrame:
    return d.values("point_id int, lat double, lon double", *[(k, float(y), float(x)) for k, (y, x) in enumerate(POINTS)])


def rects(d: Domain) -> DataFrame:
    return d.spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(k).alias("rect_id"), spatial.rect(*r).alias("rect")) for k, r in enumerate(RECTS)])))


def _r(c: Column, n: int = 3) -> Column:
    return F.round(c, n)


@query(_J + f"SELECT item_id, round({_hav(*_P)}, 2) AS metres FROM j")
def ge1_distance(d: Domain) -> DataFrame:
    return _joined(d).select("item_id", _r(geo.distance(*_cols(*_P)), 2).alias("metres"))


@query(_J + f"SELECT item_id, round({_brg(*_P)}, 6) AS degrees FROM j")
def ge2_bearing(d: Domain) -> DataFrame:
    return _joined(d).select("item_id", _r(geo.bearing(*_cols(*_P)), 6).alias("degrees"))


@query(
    _J
    + """SELECT item_id, round(degrees(q), 6) AS lat, round(fmod(degrees(radians(lon) + atan2(sin(radians(45)) * sin(dd) * cos(radians(lat)), cos(dd) - sin(radians(lat)) * sin(q))) + 540, 360) - 180, 6) AS lon
FROM (SELECT *, 100000e0 / 6371000e0 AS dd, asin(sin(radians(lat)) * cos(100000e0 / 6371000e0) + cos(radians(lat)) * sin(100000e0 / 6371000e0) * cos(radians(45))) AS q FROM j)"""
)
def ge3_destination(d: Domain) -> DataFrame:
    y, x = geo.destination(F.col("lat"), F.col("lon"), F.lit(45.0), F.lit(100000.0))
    return _joined(d).select("item_id", _r(y, 6).alias("lat"), _r(x, 6).alias("lon"))


@query(
    _J
    + """SELECT item_id, round(degrees(atan2(sin(radians(lat0)) + sin(radians(lat)), sqrt(pow(cos(radians(lat0)) + dx, 2) + dy * dy))), 6) AS mid_lat, round((lat0 + lat) / 2, 6) AS rhumb_lat
FROM (SELECT *, cos(radians(lat)) * cos(radians(lon - lon0)) AS dx, cos(radians(lat)) * sin(radians(lon - lon0)) AS dy FROM j)"""
)
def ge4_midpoint(d: Domain) -> DataFrame:
    mid, rhumb = geo.midpoint(*_cols(*_P)), geo.rhumb_midpoint(*_cols(*_P))
    return _joined(d).select("item_id", _r(mid[0], 6).alias("mid_lat"), _r(rhumb[0], 6).alias("rhumb_lat"))


_Q = (*_P, "10e0", "20e0")


@query(_J + f"SELECT item_id, round({_xt(*_Q)}, 2) AS across, round({_at(*_Q)}, 1) AS along FROM j")
def ge5_track(d: Domain) -> DataFrame:
    p = [*_cols(*_P), F.lit(10.0), F.lit(20.0)]
    return _joined(d).select("item_id", _r(geo.cross_track(*p), 2).alias("across"), _r(geo.along_track(*p), 1).alias("along"))


@query(_J + f"SELECT item_id, round({_seg(*_Q)}, 1) AS metres FROM j")
def ge6_segment_distance(d: Domain) -> DataFrame:
    return _joined(d).select("item_id", _r(geo.segment_distance(*_cols(*_P), F.lit(10.0), F.lit(20.0)), 1).alias("metres"))


@query(_J + f"SELECT item_id, round(sqrt(pow(lat - lat0, 2) + pow(lon - lon0, 2)), 6) AS euclid, round({_hav(*_P)}, 2) AS haversine FROM j")
def ge7_distances(d: Domain) -> DataFrame:
    a, b, c, e = _cols(*_P)
    return _joined(d).select("item_id", _r(F.sqrt((c - a) * (c - a) + (e - b) * (e - b)), 6).alias("euclid"), _r(geo.distance(a, b, c, e), 2).alias("haversine"))


@query()
def ge7_geodesic(d: Domain) -> DataFrame:
    """On the ellipsoid; no SQL."""
    return _joined(d).select("item_id", _r(geo.geodesic(*_cols(*_P)), 3).alias("metres"))


@query(
    """SELECT item_id, abs(lat * 1.5e0) <= 90 AND abs(lon * 1.5e0) <= 180 AS valid, least(90e0, greatest(-90e0, lat * 1.5e0)) AS clip_lat, least(180e0, greatest(-180e0, lon * 1.5e0)) AS clip_lon,
  round(CASE WHEN abs(lat * 1.5e0) <= 90 THEN lat * 1.5e0 ELSE (lat * 1.5e0 + 90) - trunc((lat * 1.5e0 + 90) / 180) * 180 - 90 END, 6) AS wrap_lat, round(CASE WHEN abs(lon * 1.5e0) <= 180 THEN lon * 1.5e0 ELSE (lon * 1.5e0 + 180) - trunc((lon * 1.5e0 + 180) / 360) * 360 - 180 END, 6) AS wrap_lon FROM items"""
)
def ge8_normalize(d: Domain) -> DataFrame:
    y, x = F.col("lat") * 1.5, F.col("lon") * 1.5
    clip, wrap = geo.clip(y, x), geo.wrap(y, x)
    return d.items().select("item_id", geo.valid(y, x).alias("valid"), clip[0].alias("clip_lat"), clip[1].alias("clip_lon"), _r(wrap[0], 6).alias("wrap_lat"), _r(wrap[1], 6).alias("wrap_lon"))


@query("SELECT item_id, CAST(floor((lat + 90) * 16777216) AS BIGINT) AS fixed_lat, CAST(floor((lon + 180) * 8388608) AS BIGINT) AS fixed_lon, round(floor((lat + 90) * 16777216) / 16777216e0 - 90, 9) AS lat FROM items")
def ge9_snap(d: Domain) -> DataFrame:
    fixed, snap = geo.fixed(F.col("lat"), F.col("lon")), geo.snap(F.col("lat"), F.col("lon"))
    return d.items().select("item_id", fixed[0].alias("fixed_lat"), fixed[1].alias("fixed_lon"), _r(snap[0], 9).alias("lat"))


def _side(p: str, q: str, r: str) -> str:
    (a, b), (c, d), (e, f) = (x.split(",") for x in (p, q, r))
    return f"sign(({d} - {b}) * ({e} - {a}) - ({c} - {a}) * ({f} - {b}))"


@query(_J + f"SELECT item_id, {_side('lat0,lon0', 'lat,lon', '-30e0,-60.0003e0')} <> {_side('lat0,lon0', 'lat,lon', '40.0007e0,70e0')} AND {_side('-30e0,-60.0003e0', '40.0007e0,70e0', 'lat0,lon0')} <> {_side('-30e0,-60.0003e0', '40.0007e0,70e0', 'lat,lon')} AS meet FROM j")
def ge10_segments(d: Domain) -> DataFrame:
    at = lambda y, x: F.struct(y.alias("lat"), x.alias("lon"))
    a, b, c, e = _cols(*_P)
    return _joined(d).select("item_id", geo.segments_meet(at(a, b), at(c, e), at(F.lit(-30.0), F.lit(-60.0003)), at(F.lit(40.0007), F.lit(70.0))).alias("meet"))


def _box(y: Column, x: Column, h: float, w: float) -> Column:
    return geo.box(y - h, y + h, x - w, x + w)


@query(_J + "SELECT item_id, abs(lat - lat0) <= 25.0005e0 AND abs(lon - lon0) <= 50.0005e0 AS overlap, abs(lat - lat0) <= 20.0005e0 AND abs(lon - lon0) <= 40.0005e0 AS has_point, abs(lat - lat0) <= 15.0005e0 AND abs(lon - lon0) <= 30.0005e0 AS has_rect FROM j")
def ge11_rects(d: Domain) -> DataFrame:
    a, b, c, e = _cols(*_P)
    big, small = _box(a, b, 20.0005, 40.0005), _box(c, e, 5, 10)
    return _joined(d).select("item_id", geo.rects_overlap(big, small).alias("overlap"), geo.rect_has(big, c, e).alias("has_point"), geo.rect_encloses(big, small).alias("has_rect"))


@query(
    _J
    + """SELECT item_id, CASE WHEN ok THEN round(lo, 6) END AS min_lat, CASE WHEN ok THEN round(hi, 6) END AS max_lat FROM (SELECT item_id, greatest(lat - 5, lat0 - 20.0005e0) AS lo, least(lat + 5, lat0 + 20.0005e0) AS hi,
  greatest(lat - 5, lat0 - 20.0005e0) < least(lat + 5, lat0 + 20.0005e0) AND greatest(lon - 10, lon0 - 40.0005e0) < least(lon + 10, lon0 + 40.0005e0) AS ok FROM j)"""
)
def ge12_rect_intersect(d: Domain) -> DataFrame:
    a, b, c, e = _cols(*_P)
    got = geo.rect_common(_box(c, e, 5, 10), _box(a, b, 20.0005, 40.0005))
    return _joined(d).select("item_id", _r(got["min_lat"], 6).alias("min_lat"), _r(got["max_lat"], 6).alias("max_lat"))


@query("SELECT cell_id, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon FROM items GROUP BY 1")
def ge13_enlarge(d: Domain) -> DataFrame:
    """The box of each cell's items."""
    return d.items().groupBy("cell_id").agg(F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"))


@query("SELECT item_id, round(lat - 1, 3) AS min_lat, round(lon + 2, 3) AS max_lon FROM items")
def ge14_parse_rect(d: Domain) -> DataFrame:
    """Boxes written as ``minlat;maxlat;minlon;maxlon`` and read again."""
    made = d.items().select("item_id", F.concat_ws(";", *[F.round(c, 3).cast("string") for c in (F.col("lat") - 1, F.col("lat") + 1, F.col("lon") - 2, F.col("lon") + 2)]).alias("s"))
    f = F.split("s", ";")
    return made.select("item_id", f[0].cast("double").alias("min_lat"), f[3].cast("double").alias("max_lon"))


@query(_J + f"SELECT item_id, round(abs(lat - lat0) * abs(lon - lon0), 6) AS area, round(2 * (abs(lat - lat0) + abs(lon - lon0)), 6) AS length, round({_hav(*_P)}, 2) AS diagonal FROM j")
def ge15_measures(d: Domain) -> DataFrame:
    a, b, c, e = _cols(*_P)
    return _joined(d).select("item_id", _r(F.abs(c - a) * F.abs(e - b), 6).alias("area"), _r((F.abs(c - a) + F.abs(e - b)) * 2, 6).alias("length"), _r(geo.distance(a, b, c, e), 2).alias("diagonal"))


@query("SELECT * FROM (VALUES (0, 'B'), (1, 'C'), (2, 'I'), (3, 'G'), (4, 'D'), (5, 'D'), (5, 'E'), (6, 'F')) v(point_id, poly_id)")
def ge16_point_in_polygon(d: Domain) -> DataFrame:
    grid = (0.0, 16.0, 0.0, 16.0, 8, 8)
    return spatial.points_in_rings(points(d), rings(d), grid).select("point_id", "poly_id")


@query(
    """SELECT * FROM (VALUES ('A', 'B'), ('B', 'I'), ('C', 'I'), ('D', 'E'), ('F', 'I'), ('I', 'J'), ('A', 'A'), ('B', 'B'), ('C', 'C'), ('D', 'D'), ('E', 'E'), ('F', 'F'), ('G', 'G'), ('H', 'H'), ('I', 'I'), ('J', 'J')) v(one, two)"""
)
def ge17_polygons_meet(d: Domain) -> DataFrame:
    """Pairs come from boxes that share a tile."""
    grid = (0.0, 16.0, 0.0, 16.0, 8, 8)
    t = rings(d).select("poly_id", "ring", F.explode(geo.rect_tiles(geo.bounds(F.col("ring")), *grid)).alias("tile"))
    a, b = t.select(F.col("poly_id").alias("one"), F.col("ring").alias("r1"), "tile"), t.select(F.col("poly_id").alias("two"), F.col("ring").alias("r2"), "tile")
    pairs = a.join(b, "tile").where("one <= two").dropDuplicates(["one", "two"])
    return pairs.where((F.col("one") == F.col("two")) | geo.rings_meet(F.col("r1"), F.col("r2"))).select("one", "two")


@query("SELECT * FROM (VALUES (0, 'A'), (0, 'B'), (1, 'B'), (1, 'C'), (1, 'I'), (2, 'G'), (2, 'H'), (3, 'B'), (3, 'C'), (3, 'F'), (3, 'G'), (3, 'H'), (3, 'I'), (3, 'J')) v(rect_id, poly_id)")
def ge17_rects_hit(d: Domain) -> DataFrame:
    grid = (0.0, 16.0, 0.0, 16.0, 8, 8)
    r = rects(d).select("rect_id", "rect", F.explode(geo.rect_tiles(F.col("rect"), *grid)).alias("tile"))
    t = rings(d).select("poly_id", "ring", F.explode(geo.rect_tiles(geo.bounds(F.col("ring")), *grid)).alias("tile"))
    pairs = r.join(t, "tile").dropDuplicates(["rect_id", "poly_id"])
    return pairs.where(geo.rings_meet(F.col("ring"), geo.rect_ring(F.col("rect")))).select("rect_id", "poly_id")


@query("SELECT p AS poly_id, s AS scale, s < 1 AS enclosed FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E'), ('F'), ('G'), ('H'), ('I'), ('J')) a(p) CROSS JOIN (VALUES (0.1e0), (0.2e0), (0.4e0), (0.8e0), (1.6e0), (3.2e0)) b(s)")
def ge18_encloses(d: Domain) -> DataFrame:
    """Is a ring's box, scaled, inside the box."""
    box = geo.bounds(F.col("ring"))
    rows = rings(d).select("poly_id", box.alias("box"), F.explode(F.array(*[F.lit(s) for s in (0.1, 0.2, 0.4, 0.8, 1.6, 3.2)])).alias("scale"))
    return rows.select("poly_id", "scale", geo.encloses(geo.rect_ring(F.col("box")), geo.rect_ring(geo.scaled(F.col("box"), F.col("scale")))).alias("enclosed"))


_RING_ROWS = ", ".join(f"('{k}', {i}, {float(y)}e0, {float(x)}e0, {float(v[(i + 1) % len(v)][0])}e0, {float(v[(i + 1) % len(v)][1])}e0)" for k, v in RINGS.items() for i, (y, x) in enumerate(v))
_E = f", e(poly_id, i, y, x, y2, x2) AS (VALUES {_RING_ROWS})"


@query(_E + " SELECT poly_id, CAST(sign(sum(x * y2 - x2 * y)) AS INT) AS turn FROM e GROUP BY 1")
def ge19_orientation(d: Domain) -> DataFrame:
    return rings(d).select("poly_id", geo.orientation(F.col("ring")).alias("turn"))


_NEAR = "abs(i.lat - c.lat) + abs(i.lon - c.lon)"


@query(f"SELECT item_id, {_NEAR} < 20.0005e0 AND {_NEAR} > 10.0005e0 AS inside FROM items i JOIN cells c USING (cell_id)")
def ge20_multi_polygon(d: Domain) -> DataFrame:
    """A diamond with a smaller one cut out."""
    a, b, c, e = _cols(*_P)

    def ring(r: float) -> Column:
        at = lambda dy, dx: F.struct((a + dy).alias("lat"), (b + dx).alias("lon"))
        return F.array(at(-r, 0.0), at(0.0, r), at(r, 0.0), at(0.0, -r), at(-r, 0.0))

    return _joined(d).select("item_id", geo.in_multi(F.array(ring(20.0005)), F.array(ring(10.0005)), c, e).alias("inside"))


@query(_J + f"SELECT item_id, round({_hav(*_P)} + {_hav('lat', 'lon', '0e0', '0e0')}, 2) AS metres FROM j")
def ge21_way_length(d: Domain) -> DataFrame:
    a, b, c, e = _cols(*_P)
    at = lambda y, x: F.struct(y.alias("lat"), x.alias("lon"))
    return _joined(d).select("item_id", _r(geo.way_length(F.array(at(a, b), at(c, e), at(F.lit(0.0), F.lit(0.0)))), 2).alias("metres"))


@query(_J + f"SELECT item_id, round(least({_hav('lat0', 'lon0', '5e0', '5e0')}, {_hav('lat', 'lon', '5e0', '5e0')}), 2) AS metres, least(lat, lat0) AS min_lat, greatest(lat, lat0) AS max_lat FROM j")
def ge22_union_shape(d: Domain) -> DataFrame:
    """Two points as one shape: the nearer one counts, bounds hold both."""
    a, b, c, e = _cols(*_P)
    return _joined(d).select("item_id", _r(F.least(geo.distance(a, b, F.lit(5.0), F.lit(5.0)), geo.distance(c, e, F.lit(5.0), F.lit(5.0))), 2).alias("metres"), F.least(a, c).alias("min_lat"), F.greatest(a, c).alias("max_lat"))


@query(_E + f" SELECT p.poly_id AS one, q.poly_id AS two, round(min({_hav('p.y', 'p.x', 'q.y', 'q.x')}), 2) AS metres FROM e p JOIN e q ON p.poly_id < q.poly_id GROUP BY 1, 2")
def ge23_vertex_distance(d: Domain) -> DataFrame:
    """All pairs of the ten rings of the truth table."""
    names = sorted(RINGS)
    pairs = F.array(*[F.struct(F.lit(a).alias("one"), F.lit(b).alias("two"), _ring(RINGS[a]).alias("r1"), _ring(RINGS[b]).alias("r2")) for i, a in enumerate(names) for b in names[i + 1 :]])
    return d.spark.range(1).select(F.inline(pairs)).select("one", "two", _r(geo.vertex_distance(F.col("r1"), F.col("r2")), 2).alias("metres"))


@query("SELECT cell_id AS poly_id, round(lat - 20.0005, 6) AS min_lat, round(lat + 20.0005, 6) AS max_lat, round(lon - 20.0005, 6) AS min_lon, round(lon + 20.0005, 6) AS max_lon FROM cells")
def ge24_bounds(d: Domain) -> DataFrame:
    b = geo.bounds(F.col("ring"))
    return d.diamonds().select("poly_id", *[_r(b[n], 6).alias(n) for n in ("min_lat", "max_lat", "min_lon", "max_lon")])


# grids and spatial joins

_TILE = "CAST(least(floor((lon + 180) / 5e0), 71) AS BIGINT) * 36 + CAST(least(floor((lat + 90) / 5e0), 35) AS BIGINT)"
_TILES = ", tiles AS (SELECT range AS tile, (range % 36) * 5e0 - 90 AS lo, (range // 36) * 5e0 - 180 AS le FROM range(2592))"
_IN = f"{_NEAR} < 20.0005e0"


@query(f"SELECT item_id, {_TILE} AS tile FROM items")
def sp1_grid_bin(d: Domain) -> DataFrame:
    return d.items().select("item_id", geo.grid_bin(F.col("lat"), F.col("lon"), *spatial.WORLD).cast("long").alias("tile"))


@query(_TILES + f" SELECT item_id, lo AS min_lat, le AS min_lon, lo + 5 AS max_lat, le + 5 AS max_lon FROM (SELECT item_id, {_TILE} AS tile FROM items) JOIN tiles USING (tile)")
def sp2_tile_rect(d: Domain) -> DataFrame:
    tile = geo.grid_bin(F.col("lat"), F.col("lon"), *spatial.WORLD).cast("long")
    r = geo.tile_rect(tile, *spatial.WORLD)
    return d.items().select("item_id", *[r[n].alias(n) for n in ("min_lat", "min_lon", "max_lat", "max_lon")])


@query(_TILES + " SELECT cell_id, tile FROM cells JOIN tiles ON lo + 5 > lat - 20.0005e0 AND lo <= lat + 20.0005e0 AND le + 5 > lon - 20.0005e0 AND le <= lon + 20.0005e0")
def sp3_rect_bins(d: Domain) -> DataFrame:
    return d.cells().select("cell_id", F.explode(geo.rect_tiles(_box(F.col("lat"), F.col("lon"), 20.0005, 20.0005), *spatial.WORLD)).alias("tile"))


@query(
    _TILES
    + """ SELECT cell_id, tile, lo >= lat - 20.0005e0 AND lo + 5 <= lat + 20.0005e0 AND le >= lon - 20.0005e0 AND le + 5 <= lon + 20.0005e0 AS enclosed
FROM cells JOIN tiles ON lo + 5 > lat - 20.0005e0 AND lo <= lat + 20.0005e0 AND le + 5 > lon - 20.0005e0 AND le <= lon + 20.0005e0"""
)
def sp4_enclosed_bins(d: Domain) -> DataFrame:
    box = _box(F.col("lat"), F.col("lon"), 20.0005, 20.0005)
    rows = d.cells().select("cell_id", box.alias("box"), F.explode(geo.rect_tiles(box, *spatial.WORLD)).alias("tile"))
    return rows.select("cell_id", "tile", geo.rect_encloses(F.col("box"), geo.tile_rect(F.col("tile"), *spatial.WORLD)).alias("enclosed"))


#: A diamond meets a tile if the tile's point nearest to the centre is in it.
_MEETS = "abs(least(greatest(lat, lo), lo + 5) - lat) + abs(least(greatest(lon, le), le + 5) - lon) < 20.0005e0"


@query(_TILES + f" SELECT cell_id AS poly_id, tile FROM cells, tiles WHERE {_MEETS}")
def sp5_item_grid(d: Domain) -> DataFrame:
    return spatial.ring_tiles(d.diamonds()).select("poly_id", "tile")


_RECT = (-12.25, 33.4, -61.7, 48.3)
_RECT_MEETS = "abs(least(greatest(lat, -12.25e0), 33.4e0) - lat) + abs(least(greatest(lon, -61.7e0), 48.3e0) - lon) < 20.0005e0"


@query(_TILES + f" SELECT cell_id AS poly_id, bool_or({_RECT_MEETS}) AS exact FROM cells, tiles WHERE {_MEETS} AND lo + 5 > -12.25e0 AND lo <= 33.4e0 AND le + 5 > -61.7e0 AND le <= 48.3e0 GROUP BY 1")
def sp6_grid_complete(d: Domain) -> DataFrame:
    """Rings that share a tile with a rectangle, and whether they meet it."""
    r = spatial.rect(*_RECT)
    exact = spatial.rings_in_rect(d.diamonds(), r, True).withColumn("exact", F.lit(True))
    return spatial.rings_in_rect(d.diamonds(), r, False).join(exact, "poly_id", "left").select("poly_id", F.coalesce("exact", F.lit(False)).alias("exact"))


_INSIDE = "lat BETWEEN -12.25e0 AND 33.4e0 AND lon BETWEEN -61.7e0 AND 48.3e0"


@query(f"SELECT item_id FROM items WHERE {_INSIDE}")
def sp7_bulk_loaded(d: Domain) -> DataFrame:
    """As an index by tile would answer: tiles of the rectangle first, then the test."""
    tiled = d.items().withColumn("tile", geo.grid_bin(F.col("lat"), F.col("lon"), *spatial.WORLD).cast("long"))
    wanted = d.spark.range(1).select(F.explode(geo.rect_tiles(spatial.rect(*_RECT), *spatial.WORLD)).alias("tile"))
    return spatial.in_rect(tiled.join(wanted, "tile", "left_semi"), spatial.rect(*_RECT)).select("item_id")


@query(f"SELECT item_id FROM items WHERE {_INSIDE}")
def sp8_rect_query(d: Domain) -> DataFrame:
    return spatial.in_rect(d.items(), spatial.rect(*_RECT)).select("item_id")


@query(f"SELECT item_id FROM items WHERE {_INSIDE} AND segment = 'BUILDING'")
def sp9_geo_filter(d: Domain) -> DataFrame:
    """A set of ids, kept where the items lie in a rectangle."""
    return spatial.in_rect(d.items().join(d.set_a(), "item_id", "left_semi"), spatial.rect(*_RECT)).select("item_id")


@query(f"SELECT item_id FROM items WHERE ({_INSIDE} AND contains(lower(segment), 'build')) OR false")
def sp10_geo_function(d: Domain) -> DataFrame:
    """A rectangle as a function of the query language; the second argument is malformed and finds nothing."""
    items = d.items().select("item_id", F.array("name", "segment").alias("strs"), "lat", "lon")
    return search.ItemSet(items, "$GEO[-12.25;33.4;-61.7;48.3;0] build + $GEO[1;2]", "infix", {"GEO": spatial.geo_predicate}).ids()


@query(f"SELECT item_id FROM items WHERE {_INSIDE} AND bal >= 5000")
def sp11_geo_verified(d: Domain) -> DataFrame:
    return spatial.in_rect(d.items().join(d.set_b(), "item_id", "left_semi"), spatial.rect(*_RECT)).select("item_id")


@query(f"SELECT item_id, bal FROM items WHERE {_INSIDE}")
def sp12_geo_rows(d: Domain) -> DataFrame:
    return spatial.in_rect(d.items(), spatial.rect(*_RECT)).select("item_id", "bal")


@query(f"SELECT i.item_id, c.cell_id AS poly_id FROM items i JOIN cells c ON {_IN}")
def sp13_points_in_regions(d: Domain) -> DataFrame:
    return spatial.points_in_rings(d.items().select("item_id", "lat", "lon"), d.diamonds().select("poly_id", "ring")).select("item_id", "poly_id")


@query(f"SELECT DISTINCT c.cell_id AS poly_id FROM items i JOIN cells c ON {_IN} WHERE segment = 'BUILDING'")
def sp14_regions_of_points(d: Domain) -> DataFrame:
    return spatial.points_in_rings(d.items().where("segment = 'BUILDING'").select("item_id", "lat", "lon"), d.diamonds().select("poly_id", "ring")).select("poly_id").distinct()


@query("SELECT cell_id FROM cells WHERE lat + 20.0005e0 >= -12.25e0 AND lat - 20.0005e0 <= 33.4e0 AND lon + 20.0005e0 >= -61.7e0 AND lon - 20.0005e0 <= 48.3e0")
def sp15_cells_in_rect(d: Domain) -> DataFrame:
    """By boxes."""
    return d.diamonds().where(geo.rects_overlap(geo.bounds(F.col("ring")), spatial.rect(*_RECT))).select(F.col("poly_id").alias("cell_id"))


@query(f"SELECT item_id, {_TILE} AS cell FROM items")
def sp16_cell_of_point(d: Domain) -> DataFrame:
    """The grid's bins stand for the cells of a triangulation."""
    return d.items().select("item_id", geo.grid_bin(F.col("lat"), F.col("lon"), *spatial.WORLD).cast("long").alias("cell"))


def _flood(legs: list[tuple[str, str, str, str]], metres: float) -> str:
    near = " OR ".join(f"{_seg(*leg, 'lat', 'lon')} <= {metres}" for leg in legs)
    first = _hav(legs[0][0], legs[0][1], "lat", "lon")
    return f", near AS (SELECT cell_id, {first} AS d FROM cells WHERE {near}), w(cell_id) AS (SELECT cell_id FROM (SELECT cell_id FROM near ORDER BY d, cell_id LIMIT 1) UNION SELECT dst FROM w JOIN edges ON src = w.cell_id WHERE dst IN (SELECT cell_id FROM near)) SELECT cell_id FROM w"


@query(_flood([("-60e0", "-150e0", "60e0", "150e0")], 4e6))
def sp17_cells_between(d: Domain) -> DataFrame:
    return spatial.corridor(d.cells(), d.cell_edges(), [(-60.0, -150.0), (60.0, 150.0)], 4e6)


@query(_flood([("-60e0", "-150e0", "10e0", "0e0"), ("10e0", "0e0", "60e0", "150e0")], 4e6))
def sp18_cells_along_path(d: Domain) -> DataFrame:
    return spatial.corridor(d.cells(), d.cell_edges(), [(-60.0, -150.0), (10.0, 0.0), (60.0, 150.0)], 4e6)


@query(", w(cell_id) AS (SELECT CAST(0 AS BIGINT) UNION SELECT dst FROM w JOIN edges ON src = w.cell_id WHERE dst <> 12 AND dst <> 7) SELECT cell_id FROM w")
def sp19_explore(d: Domain) -> DataFrame:
    """Breadth first from a cell, around cells that stop it."""
    start = d.spark.range(1).select(F.lit(0).cast("long").alias("origin"), F.lit(0).cast("long").alias("cell_id"))
    allowed = d.cells().where("cell_id not in (12, 7)").select(F.lit(0).cast("long").alias("origin"), "cell_id")
    return graph.spread(start, d.cell_edges(), allowed).select("cell_id")


_D = f", dist AS (SELECT a.cell_id AS src, b.cell_id AS dst, {_hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS distance FROM cells a JOIN cells b ON a.cell_id <> b.cell_id), base(cell_id) AS (SELECT CAST(range AS BIGINT) FROM range(3))"
_DILATE = """, w(origin, cell_id) AS (SELECT cell_id, cell_id FROM base UNION SELECT w.origin, e.dst FROM w JOIN edges e ON e.src = w.cell_id JOIN dist ON dist.src = w.origin AND dist.dst = e.dst WHERE distance < 9e6 AND e.dst NOT IN (SELECT cell_id FROM base))
SELECT DISTINCT cell_id FROM w WHERE cell_id NOT IN (SELECT cell_id FROM base)"""


@query(_D + _DILATE)
def sp20_dilate(d: Domain) -> DataFrame:
    base = d.spark.range(3).toDF("cell_id")
    return hierarchy.dilate(base, d.cell_edges(), spatial.distances(d.cells(), 9e6, origins=base), 9e6)


@query(_D + _DILATE)
def sp21_dilate_cached(d: Domain) -> DataFrame:
    """As ``sp20``, with the neighbours' distances stored beforehand."""
    from ..sources.storage import cut

    return hierarchy.dilate(d.spark.range(3).toDF("cell_id"), d.cell_edges(), cut(spatial.distances(d.cells(), 1e7)), 9e6)


@query(_D + " SELECT src, dst, round(distance, 2) AS metres FROM dist WHERE distance < 9e6")
def sp22_cell_distance(d: Domain) -> DataFrame:
    return spatial.distances(d.cells(), 9e6).select("src", "dst", _r(F.col("distance"), 2).alias("metres"))


@query("SELECT cell_id, true AS full_match FROM cells WHERE lat + 20.0005e0 >= -12.25e0 AND lat - 20.0005e0 <= 33.4e0 AND lon + 20.0005e0 >= -61.7e0 AND lon - 20.0005e0 <= 48.3e0 UNION SELECT cell_id, true FROM cell_parents WHERE region_id = 31")
def sp23_cells_as_result(d: Domain) -> DataFrame:
    """Cells of a rectangle and of a region, in full."""
    boxed = d.diamonds().where(geo.rects_overlap(geo.bounds(F.col("ring")), spatial.rect(*_RECT))).select(F.col("poly_id").alias("cell_id"))
    return cqr.all_to_full(boxed.union(d.cell_parents().where("region_id = 31").select("cell_id"))).select("cell_id", "full_match")


@query("SELECT item_id FROM items WHERE lat BETWEEN 0 AND 45.5 AND lon BETWEEN -90 AND 0.25")
def sp24_range_query(d: Domain) -> DataFrame:
    return spatial.in_rect(d.items(), spatial.rect(0, 45.5, -90, 0.25)).select("item_id")
