"""Spatial joins and completion: rings and rectangles meet points over the tiles of a grid, an equi-join with the exact test behind it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from . import graph

#: A grid over the world: bounds and bins by latitude and longitude.
WORLD = (-90.0, 90.0, -180.0, 180.0, 36, 72)


def rect(min_lat: float, max_lat: float, min_lon: float, max_lon: float) -> Column:
    return F.struct(*[F.lit(float(v)).alias(n) for v, n in ((min_lat, "min_lat"), (max_lat, "max_lat"), (min_lon, "min_lon"), (max_lon, "max_lon"))])


def ring_tiles(rings: DataFrame, grid: tuple = WORLD) -> DataFrame:
    """``poly_id, ring, tile, inside``: tiles that a ring meets; ``inside`` if the whole tile is in it."""
    rows = rings.select("poly_id", "ring", F.explode(geo.rect_tiles(geo.bounds(F.col("ring")), *grid)).alias("tile"))
    corners = geo.rect_ring(geo.tile_rect(F.col("tile"), *grid))
    rows = rows.withColumn("corners", corners).where(geo.rings_meet(F.col("ring"), F.col("corners")))
    return rows.select("poly_id", "ring", "tile", geo.encloses(F.col("ring"), F.col("corners")).alias("inside"))


def points_in_rings(points: DataFrame, rings: DataFrame, grid: tuple = WORLD) -> DataFrame:
    """``points`` with the ``poly_id`` of each ring that holds them. In a tile that is whole inside the ring no test is needed."""
    tiles = ring_tiles(rings, grid)
    at = points.withColumn("tile", geo.grid_bin(F.col("lat"), F.col("lon"), *grid).cast("long"))
    return at.join(tiles, "tile").where(F.col("inside") | geo.in_ring(F.col("ring"), F.col("lat"), F.col("lon"))).select(*points.columns, "poly_id")


def rings_in_rect(rings: DataFrame, bounds: Column, exact: bool, grid: tuple = WORLD) -> DataFrame:
    """``poly_id`` of rings that share a tile with the rectangle; ``exact``: that meet it."""
    hit = ring_tiles(rings, grid).where(F.array_contains(geo.rect_tiles(bounds, *grid), F.col("tile")))
    if exact:
        hit = hit.where(geo.rings_meet(F.col("ring"), geo.rect_ring(bounds)))
    return hit.select("poly_id").distinct()


def in_rect(points: DataFrame, bounds: Column) -> DataFrame:
    return points.where(geo.rect_has(bounds, F.col("lat"), F.col("lon")))


def geo_predicate(argument: str) -> Column:
    """``latmin;latmax;lonmin;lonmax;deep`` over an item's ``lat`` and ``lon``; fewer than four fields find nothing."""
    fields = argument.split(";")
    try:
        a, b, c, d = map(float, fields[:4])
    except ValueError:
        return F.lit(False)
    return geo.rect_has(rect(a, b, c, d), F.col("lat"), F.col("lon"))


def distances(cells: DataFrame, metres: float, grid: tuple = WORLD, origins: DataFrame | None = None) -> DataFrame:
    """``src, dst, distance`` of cells whose centres are nearer than ``metres``, from the ``origins`` (``cell_id``; all cells) on: centres meet over the tiles that the
    circle's box touches."""
    reach = metres / geo.RADIUS * 57.29577951308232 + 1e-9
    wide = F.least(F.lit(180.0), F.lit(reach) / F.greatest(F.cos(F.radians(F.least(F.abs("lat") + reach, F.lit(90.0)))), F.lit(1e-9)))
    box = lambda shift: F.struct((F.col("lat") - reach).alias("min_lat"), (F.col("lat") + reach).alias("max_lat"), (F.col("lon") - wide + shift).alias("min_lon"), (F.col("lon") + wide + shift).alias("max_lon"))
    near = F.array_distinct(F.flatten(F.array(*[geo.rect_tiles(box(s), *grid) for s in (-360.0, 0.0, 360.0)])))
    some = cells if origins is None else cells.join(origins.select("cell_id").distinct(), "cell_id", "left_semi")
    a = some.select(F.col("cell_id").alias("src"), F.col("lat").alias("lat0"), F.col("lon").alias("lon0"), F.explode(near).alias("tile"))
    b = cells.select(F.col("cell_id").alias("dst"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), geo.grid_bin(F.col("lat"), F.col("lon"), *grid).cast("long").alias("tile"))
    d = geo.distance(F.col("lat0"), F.col("lon0"), F.col("lat1"), F.col("lon1"))
    return a.join(b, "tile").where("src <> dst").select("src", "dst", d.alias("distance")).where(F.col("distance") < metres)


def corridor(cells: DataFrame, edges: DataFrame, path: list[tuple[float, float]], metres: float) -> DataFrame:
    """Cells within ``metres`` of the path that are connected, over such cells, with one nearest to its start."""
    legs = [geo.segment_distance(F.lit(a), F.lit(b), F.lit(c), F.lit(d), F.col("lat"), F.col("lon")) for (a, b), (c, d) in zip(path, path[1:], strict=False)]
    near = cells.where(F.least(*legs, F.lit(float("inf"))) <= metres if len(legs) > 1 else legs[0] <= metres)
    begin = near.select("cell_id", geo.distance(F.lit(path[0][0]), F.lit(path[0][1]), F.col("lat"), F.col("lon")).alias("d")).orderBy("d", "cell_id").limit(1)
    start = begin.select(F.lit(0).cast("long").alias("origin"), "cell_id")
    return graph.spread(start, edges, near.select(F.lit(0).cast("long").alias("origin"), "cell_id")).select("cell_id")
