"""Queries on cell query results, flat and on the hierarchical grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import cqr, hcqr, textindex
from ..sources.domain import Domain
from ..sources.storage import cut
from .registry import query

_SIDES = """, u AS (SELECT cell_id, item_id FROM uni),
af AS (SELECT DISTINCT cell_id FROM cell_parents JOIN regions USING (region_id) WHERE contains(lower(name), 'st')),
ap AS (SELECT DISTINCT cell_id, item_id FROM strs JOIN uni USING (item_id) WHERE contains(lower(s), 'st') AND cell_id NOT IN (SELECT cell_id FROM af)),
bf AS (SELECT DISTINCT cell_id FROM cell_parents JOIN regions USING (region_id) WHERE contains(name, 'ME')),
bp AS (SELECT DISTINCT cell_id, item_id FROM strs JOIN uni USING (item_id) WHERE contains(s, 'ME') AND cell_id NOT IN (SELECT cell_id FROM bf))"""

_LEVEL = 4
_PIXELS = """, px AS (SELECT item_id, segment, bal, (CAST(least(floor((lon - -180e0) / (360e0 / 16)), 15) AS BIGINT) * 16 + CAST(least(floor((lat - -90e0) / (180e0 / 16)), 15) AS BIGINT)) * 256 + 4 AS cell_id FROM items),
u AS (SELECT cell_id, item_id FROM px), grid AS (SELECT range * 256 + 4 AS cell_id, range % 16 AS x, range // 16 AS y FROM range(256)),
af AS (SELECT cell_id FROM grid WHERE x >= 8), ap AS (SELECT cell_id, item_id FROM px WHERE segment = 'BUILDING' AND cell_id NOT IN (SELECT cell_id FROM af)),
bf AS (SELECT cell_id FROM grid WHERE y >= 8), bp AS (SELECT cell_id, item_id FROM px WHERE bal >= 5000 AND cell_id NOT IN (SELECT cell_id FROM bf))"""

_OPS = {
    "/": """, rf AS (SELECT cell_id FROM af INTERSECT SELECT cell_id FROM bf),
rp AS (SELECT * FROM ap WHERE cell_id IN (SELECT cell_id FROM bf) UNION SELECT * FROM bp WHERE cell_id IN (SELECT cell_id FROM af) UNION (SELECT * FROM ap INTERSECT SELECT * FROM bp))""",
    "+": """, pr AS (SELECT cell_id FROM (SELECT * FROM ap UNION SELECT * FROM bp) x WHERE cell_id IN (SELECT cell_id FROM ap) AND cell_id IN (SELECT cell_id FROM bp)
  GROUP BY cell_id HAVING count(*) = (SELECT count(*) FROM u WHERE u.cell_id = x.cell_id)),
rf AS (SELECT cell_id FROM af UNION SELECT cell_id FROM bf UNION SELECT cell_id FROM pr), rp AS (SELECT * FROM ap UNION SELECT * FROM bp)""",
    "-": """, rf AS (SELECT cell_id FROM af WHERE cell_id NOT IN (SELECT cell_id FROM bf UNION SELECT cell_id FROM bp)),
rp AS (SELECT * FROM (SELECT * FROM ap UNION SELECT * FROM u WHERE cell_id IN (SELECT cell_id FROM af)) WHERE cell_id NOT IN (SELECT cell_id FROM bf) EXCEPT SELECT * FROM bp)""",
    "^": """, ac AS (SELECT cell_id FROM af UNION SELECT cell_id FROM ap), bc AS (SELECT cell_id FROM bf UNION SELECT cell_id FROM bp),
rf AS (SELECT cell_id FROM af WHERE cell_id NOT IN (SELECT cell_id FROM bc) UNION SELECT cell_id FROM bf WHERE cell_id NOT IN (SELECT cell_id FROM ac)),
ax AS (SELECT * FROM ap UNION SELECT * FROM u WHERE cell_id IN (SELECT cell_id FROM af)), bx AS (SELECT * FROM bp UNION SELECT * FROM u WHERE cell_id IN (SELECT cell_id FROM bf)),
rp AS ((SELECT * FROM ax EXCEPT SELECT * FROM bx) UNION (SELECT * FROM bx EXCEPT SELECT * FROM ax))""",
}
_ROWS = " SELECT cell_id, true AS full_match, CAST(NULL AS BIGINT) AS item_id FROM rf UNION ALL SELECT cell_id, false, item_id FROM rp WHERE cell_id NOT IN (SELECT cell_id FROM rf)"
_A = ", rf AS (SELECT cell_id FROM af), rp AS (SELECT cell_id, item_id FROM ap)"
#: What four full children do, from level 4 up.
_COMPACT = "".join(
    f""", f{k} AS (SELECT DISTINCT (((cell_id >> 8) // {2 << k}) // 2 * {1 << k} + ((cell_id >> 8) % {2 << k}) // 2) * 256 + {k} AS cell_id, cell_id AS c FROM {"rf" if k == 3 else f"g{k + 1}"}),
g{k} AS (SELECT cell_id FROM f{k} GROUP BY 1 HAVING count(*) = 4), h{k + 1} AS (SELECT c AS cell_id FROM f{k} WHERE cell_id NOT IN (SELECT cell_id FROM g{k}))"""
    for k in (3, 2, 1, 0)
)
_LEAVES = ", lf AS (SELECT cell_id FROM g0 UNION ALL SELECT cell_id FROM h1 UNION ALL SELECT cell_id FROM h2 UNION ALL SELECT cell_id FROM h3 UNION ALL SELECT cell_id FROM h4)"
_COMPACTED = _COMPACT + _LEAVES + " SELECT cell_id, true AS full_match, CAST(NULL AS BIGINT) AS item_id FROM lf UNION ALL SELECT cell_id, false, item_id FROM rp WHERE cell_id NOT IN (SELECT cell_id FROM rf)"


def sides(d: Domain) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two results with full and partial cells, and the universe."""
    u = cut(d.universe())
    rest = (d.regions(), d.cell_parents())
    a = textindex.complete_cells(d.part_strs(), u, *rest, "st", text.SUBSTRING | text.NO_CASE)
    b = textindex.complete_cells(d.part_strs(), u, *rest, "ME", text.SUBSTRING)
    return cut(a), cut(b), u  # each is read several times


@query(_SIDES + _OPS["/"] + _ROWS)
def cq1_intersect(d: Domain) -> DataFrame:
    a, b, _ = sides(d)
    return cqr.intersect(a, b)


@query(_SIDES + _OPS["+"] + _ROWS)
def cq2_union(d: Domain) -> DataFrame:
    return cqr.union(*sides(d))


@query(_SIDES + _OPS["-"] + _ROWS)
def cq3_difference(d: Domain) -> DataFrame:
    return cqr.difference(*sides(d))


@query(_SIDES + _OPS["^"] + _ROWS)
def cq4_symmetric_difference(d: Domain) -> DataFrame:
    return cqr.symmetric_difference(*sides(d))


@query(_SIDES + " SELECT cell_id, true AS full_match, CAST(NULL AS BIGINT) AS item_id FROM (SELECT cell_id FROM af UNION SELECT cell_id FROM ap)")
def cq5_all_to_full(d: Domain) -> DataFrame:
    return cqr.all_to_full(sides(d)[0])


@query(_SIDES + _A + _ROWS)
def cq6_remove_empty(d: Domain) -> DataFrame:
    """Cells that a result lists without an item go."""
    a, _, _ = sides(d)
    empty = d.cells().select(F.col("cell_id") + 1000, F.lit(False), F.lit(None).cast("long"))
    return cqr.remove_empty(a.union(empty))


@query(_SIDES + " SELECT item_id FROM ap UNION SELECT item_id FROM u WHERE cell_id IN (SELECT cell_id FROM af)")
def cq7_flatten(d: Domain) -> DataFrame:
    a, _, u = sides(d)
    return cqr.flatten(a, u)


@query(_SIDES + " SELECT item_id FROM (SELECT item_id FROM ap UNION SELECT item_id FROM u WHERE cell_id IN (SELECT cell_id FROM af)) ORDER BY 1 LIMIT 20")
def cq8_top_k(d: Domain) -> DataFrame:
    a, _, u = sides(d)
    return cqr.top_k(a, u, 20)


@query(
    _SIDES
    + """ SELECT (SELECT count(*) FROM (SELECT cell_id FROM af UNION SELECT cell_id FROM ap)) AS n_cells,
  (SELECT count(*) FROM ap) + (SELECT count(*) FROM u WHERE cell_id IN (SELECT cell_id FROM af)) AS max_items, true AS has_hits"""
)
def cq9_counts(d: Domain) -> DataFrame:
    a, _, u = sides(d)
    cells = a.select("cell_id").distinct().agg(F.count(F.lit(1)).alias("n_cells"))
    items = cqr.expand(a, u).agg(F.count(F.lit(1)).alias("max_items"))
    return cells.join(items, F.lit(True)).select("n_cells", "max_items", (F.col("n_cells") > 0).alias("has_hits"))


@query(_SIDES + " SELECT cell_id FROM af UNION SELECT cell_id FROM ap")
def cq10_cells(d: Domain) -> DataFrame:
    return sides(d)[0].select("cell_id").distinct()


@query(_SIDES + ", x AS (SELECT cell_id FROM af UNION SELECT cell_id FROM ap) SELECT min(lat) - 20 AS min_lat, max(lat) + 20 AS max_lat, min(lon) - 20 AS min_lon, max(lon) + 20 AS max_lon FROM cells WHERE cell_id IN (SELECT cell_id FROM x)")
def cq11_boundary(d: Domain) -> DataFrame:
    a, _, _ = sides(d)
    hit = d.cells().join(a, "cell_id", "left_semi")
    return hit.agg((F.min("lat") - 20).alias("min_lat"), (F.max("lat") + 20).alias("max_lat"), (F.min("lon") - 20).alias("min_lon"), (F.max("lon") + 20).alias("max_lon"))


@query(_SIDES + ", k AS (SELECT cell_id, item_id, row_number() OVER (PARTITION BY cell_id ORDER BY item_id) - 1 AS local_id FROM u) SELECT cell_id, local_id, item_id FROM k JOIN ap USING (cell_id, item_id)")
def cq12_local_ids(d: Domain) -> DataFrame:
    """Ids as ranks within their cell, and back again."""
    a, _, u = sides(d)
    local = cqr.to_local(a, u)
    return cqr.to_global(local, u).select("cell_id", F.col("local_id").cast("long").alias("local_id"), "item_id")


@query("SELECT true AS same, false AS other")
def cq13_equality(d: Domain) -> DataFrame:
    a, b, u = sides(d)
    a, b = cut(a), cut(b)
    same = cqr.mismatches(cqr.union(a, a, u), a).agg((F.count(F.lit(1)) == 0).alias("same"))
    return same.join(cqr.mismatches(a, b).agg((F.count(F.lit(1)) == 0).alias("other")), F.lit(True))


@query("SELECT CAST(0 AS BIGINT) AS broken")
def cq14_self_check(d: Domain) -> DataFrame:
    a, b, u = sides(d)
    return cqr.self_check(cut(cqr.union(a, b, u)), u).agg(F.count(F.lit(1)).alias("broken"))


@query(_SIDES + _A + " SELECT cell_id, CASE WHEN full_match THEN cell_id || ':f' ELSE cell_id || ':' || n END AS line FROM (SELECT cell_id, true AS full_match, 0 AS n FROM rf UNION ALL SELECT cell_id, false, count(*) FROM rp GROUP BY 1)")
def cq15_dump(d: Domain) -> DataFrame:
    """A line per cell: full, or how many items."""
    rows = sides(d)[0].groupBy("cell_id").agg(F.bool_or("full_match").alias("f"), F.count("item_id").alias("n"))
    return rows.select("cell_id", F.concat_ws(":", F.col("cell_id"), F.when(F.col("f"), F.lit("f")).otherwise(F.col("n").cast("string"))).alias("line"))


@query(_SIDES + _OPS["^"] + ", z AS (SELECT cell_id, item_id FROM u WHERE cell_id IN (SELECT cell_id FROM rf) UNION SELECT cell_id, item_id FROM rp) SELECT cell_id, count(*) AS n FROM z WHERE cell_id IN (SELECT cell_id FROM bf UNION SELECT cell_id FROM bp) GROUP BY 1")
def cq16_delayed(d: Domain) -> DataFrame:
    """Several operations in a row: (a ^ b) / allToFull(b)."""
    a, b, u = sides(d)
    return cqr.sizes(cqr.intersect(cut(cqr.symmetric_difference(a, b, u)), cqr.all_to_full(b)), u).select("cell_id", "n")


@query(_SIDES + _OPS["/"] + " SELECT (SELECT count(*) FROM rf) + (SELECT count(*) FROM rp) > 0 AS has_hits")
def cq17_has_hits(d: Domain) -> DataFrame:
    """One hit is enough: the limit ends the work."""
    a, b, _ = sides(d)
    return cqr.intersect(a, b).limit(1).agg((F.count(F.lit(1)) > 0).alias("has_hits"))


@query(_SIDES + _OPS["+"] + _ROWS)
def cq18_materialized(d: Domain) -> DataFrame:
    return cut(cqr.union(*sides(d)))


@query(_SIDES + _A + ", n AS (SELECT (SELECT count(*) FROM rf) + (SELECT count(*) FROM rp) AS n) SELECT op, CASE op WHEN '/' THEN 0 ELSE n END AS n FROM n CROSS JOIN (VALUES ('/'), ('+'), ('-'), ('^')) v(op)")
def cq19_empty_operand(d: Domain) -> DataFrame:
    a, _, u = sides(d)
    a = cut(a)
    none = a.where("false")
    n = lambda op, r: r.agg(F.lit(op).alias("op"), F.count(F.lit(1)).alias("n"))
    return n("/", cqr.intersect(a, none)).union(n("+", cqr.union(a, none, u))).union(n("-", cqr.difference(a, none, u))).union(n("^", cqr.symmetric_difference(none, a, u)))


# on the grid


def _grid_sides(d: Domain) -> tuple[DataFrame, DataFrame, DataFrame]:
    items = d.items().withColumn("cell_id", hcqr.pixel(F.col("lat"), F.col("lon"), _LEVEL))
    root = d.spark.range(1).select(F.explode(hcqr.descendants(F.lit(0).cast("long"), _LEVEL)).alias("cell_id"))
    x, y = hcqr.place(F.col("cell_id"))
    a = cqr.build(root.where(x >= 8), items.where("segment = 'BUILDING'"))
    b = cqr.build(root.where(y >= 8), items.where("bal >= 5000"))
    return cut(a), cut(b), cut(items.select("item_id", "cell_id"))


@query(
    _PIXELS
    + _A
    + _COMPACT
    + _LEAVES
    + """, lv AS (SELECT cell_id, 'full' AS kind FROM lf UNION SELECT cell_id, 'partial' FROM rp),
above AS (SELECT DISTINCT (((cell_id >> 8) // (1 << CAST(cell_id & 255 AS INT))) // (1 << CAST((cell_id & 255) - k AS INT)) * (1 << CAST(k AS INT)) + ((cell_id >> 8) % (1 << CAST(cell_id & 255 AS INT))) // (1 << CAST((cell_id & 255) - k AS INT))) * 256 + k AS cell_id FROM lv, range(4) r(k) WHERE k < (cell_id & 255))
SELECT cell_id, CAST(cell_id & 255 AS INT) AS level, kind FROM (SELECT * FROM lv UNION ALL SELECT cell_id, 'inner' FROM above)"""
)
def hc1_tree(d: Domain) -> DataFrame:
    a, _, _ = _grid_sides(d)
    return hcqr.tree(hcqr.compactified(a, _LEVEL), _LEVEL)


@query(_PIXELS + " SELECT (SELECT count(*) FROM ap) + (SELECT count(*) FROM u WHERE cell_id IN (SELECT cell_id FROM af)) AS n_items, 4 AS depth, (SELECT count(*) FROM (SELECT cell_id FROM af UNION SELECT cell_id FROM ap)) AS n_leaves")
def hc2_measures(d: Domain) -> DataFrame:
    a, _, u = _grid_sides(d)
    one = a.agg(F.max(hcqr.level_of(F.col("cell_id"))).alias("depth"), F.countDistinct("cell_id").alias("n_leaves"))
    return one.join(cqr.expand(a, u).agg(F.count(F.lit(1)).alias("n_items")), F.lit(True))


def _combined(d: Domain, operation) -> DataFrame:
    a, b, u = _grid_sides(d)
    return hcqr.combine(operation, hcqr.compactified(a, _LEVEL), hcqr.compactified(b, _LEVEL), u, _LEVEL)


@query(_PIXELS + _OPS["/"] + _COMPACTED)
def hc3_intersect(d: Domain) -> DataFrame:
    return _combined(d, cqr.intersect)


@query(_PIXELS + _OPS["+"] + _COMPACTED)
def hc4_union(d: Domain) -> DataFrame:
    return _combined(d, cqr.union)


@query(_PIXELS + _OPS["-"] + _COMPACTED)
def hc5_difference(d: Domain) -> DataFrame:
    return _combined(d, cqr.difference)


@query(_PIXELS + _A + _COMPACTED)
def hc6_compactified(d: Domain) -> DataFrame:
    return hcqr.compactified(_grid_sides(d)[0], _LEVEL)


@query(_PIXELS + _A + _ROWS)
def hc7_expanded(d: Domain) -> DataFrame:
    """Compacted, and pushed down again to the level that it came from."""
    a, _, u = _grid_sides(d)
    return hcqr.expanded(hcqr.compactified(a, _LEVEL), u, _LEVEL)


@query(_PIXELS + " SELECT cell_id, true AS full_match FROM (SELECT cell_id FROM af UNION SELECT cell_id FROM ap)")
def hc8_all_to_full(d: Domain) -> DataFrame:
    return cqr.all_to_full(_grid_sides(d)[0]).select("cell_id", "full_match")


@query(_PIXELS + _A + _COMPACTED)
def hc9_stored_tree(d: Domain) -> DataFrame:
    """As ``hc6``, from a tree that was stored."""
    return hcqr.compactified(cut(_grid_sides(d)[0]), _LEVEL)


@query(_PIXELS + " SELECT cell_id, count(*) AS n FROM (SELECT cell_id, item_id FROM ap UNION SELECT cell_id, item_id FROM u WHERE cell_id IN (SELECT cell_id FROM af)) GROUP BY 1")
def hc10_cell_index(d: Domain) -> DataFrame:
    """From an index by cell: its pixels' sizes, stored for the next asker."""
    a, _, u = _grid_sides(d)
    return cut(cqr.sizes(a, u).select("cell_id", "n"))


@query(_PIXELS + " SELECT cell_id, item_id FROM px WHERE starts_with(segment, 'M')")
def hc11_text_on_grid(d: Domain) -> DataFrame:
    items = d.items()
    pixels = items.select("item_id", hcqr.pixel(F.col("lat"), F.col("lon"), _LEVEL).alias("cell_id"))
    return textindex.item_cells(items.select("item_id", F.col("segment").alias("s")), pixels, "M", text.PREFIX).select("cell_id", "item_id")


@query(
    _PIXELS
    + """ SELECT item_id, cell_id AS pixel, (((cell_id >> 8) // 16) // 2 * 8 + ((cell_id >> 8) % 16) // 2) * 256 + 3 AS parent,
  (((cell_id >> 8) // 16) * 2 * 32 + ((cell_id >> 8) % 16) * 2) * 256 + 5 AS first_child FROM px"""
)
def hc12_simple_grid(d: Domain) -> DataFrame:
    p = F.col("pixel")
    rows = d.items().select("item_id", hcqr.pixel(F.col("lat"), F.col("lon"), _LEVEL).alias("pixel"))
    return rows.select("item_id", "pixel", hcqr.ancestor(p, 3).alias("parent"), hcqr.children(p)[0].alias("first_child"))


@query(
    """ SELECT CAST(99 AS BIGINT) AS node, false AS is_cell, CAST(NULL AS BIGINT) AS parent, 0 AS depth
UNION ALL SELECT DISTINCT r_regionkey + 30, false, 99, 1 FROM region JOIN nation ON n_regionkey = r_regionkey
UNION ALL SELECT n_nationkey, false, n_regionkey + 30, 2 FROM nation UNION ALL SELECT n_nationkey, true, n_nationkey, 3 FROM nation"""
)
def hc13_cover_tree(d: Domain) -> DataFrame:
    """The region DAG as a tree: regions are smaller than halves, and so come first."""
    from ..operators import hierarchy

    return hierarchy.cover(d.cell_parents(), d.region_parents(), 99)


@query(_PIXELS + " SELECT 'simplegrid' AS grid, count(DISTINCT cell_id) AS n_pixels FROM px")
def hc14_grid_registry(d: Domain) -> DataFrame:
    out = None
    for name, grid in hcqr.GRIDS.items():
        got = d.items().agg(F.lit(name).alias("grid"), F.countDistinct(grid(F.col("lat"), F.col("lon"), _LEVEL)).alias("n_pixels"))
        out = got if out is None else out.union(got)
    return out

