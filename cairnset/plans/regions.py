"""Queries on the region DAG, key/value items and statistics, and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import cqr, hierarchy, idset, search, store, textindex
from ..sources import storage
from ..sources.domain import Domain
from .registry import query
from .results import _A, _SIDES, sides

_CLOSURE = ", anc(node, ancestor, depth) AS (SELECT child, parent, 1 FROM up UNION ALL SELECT a.node, u.parent, a.depth + 1 FROM anc a JOIN up u ON u.child = a.ancestor), cl AS (SELECT node, ancestor, max(depth) AS depth FROM anc GROUP BY 1, 2)"
_SIZES = _A + ", sz AS (SELECT cell_id, count(*) AS n FROM (SELECT cell_id, item_id FROM rp UNION SELECT cell_id, item_id FROM u WHERE cell_id IN (SELECT cell_id FROM rf)) GROUP BY 1)"


@query("SELECT region_id, (SELECT count(*) FROM cells) AS n_cells FROM regions WHERE region_id <> 99 AND region_id IN (SELECT child FROM up WHERE parent = 99)")
def hi1_root(d: Domain) -> DataFrame:
    """The root's children: regions with no parent among the others; it holds all cells."""
    below = d.region_parents().where("parent <> 99")
    top = hierarchy.without_parent(d.regions().where("region_id <> 99"), below).join(d.region_parents(), F.col("region_id") == F.col("child"), "left_semi").select("region_id")
    return top.join(d.cells().agg(F.count(F.lit(1)).alias("n_cells")), F.lit(True))


@query(_CLOSURE + " SELECT node, ancestor, depth FROM cl")
def hi2_ancestors(d: Domain) -> DataFrame:
    return hierarchy.ancestors(d.region_parents())


@query("SELECT cell_id, region_id FROM cell_parents WHERE region_id BETWEEN 30 AND 41")
def hi3_direct_parents(d: Domain) -> DataFrame:
    """Above a nation: its region and its half are direct, the root is an ancestor of both."""
    above = d.cell_parents().where("cell_id <> region_id")
    return hierarchy.direct_cell_parents(above, hierarchy.ancestors(d.region_parents()))


@query(_CLOSURE + " SELECT node AS region_id, depth AS level FROM cl WHERE ancestor = 99")
def hi4_levels(d: Domain) -> DataFrame:
    return hierarchy.ancestors(d.region_parents()).where("ancestor = 99").select(F.col("node").alias("region_id"), F.col("depth").alias("level"))


@query(
    """SELECT DISTINCT a.region_id, b.region_id AS neighbour FROM cell_parents a JOIN edges ON a.cell_id = src JOIN cell_parents b ON b.cell_id = dst
WHERE NOT EXISTS (SELECT 1 FROM cell_parents x JOIN cell_parents y ON x.cell_id = y.cell_id WHERE x.region_id = a.region_id AND y.region_id = b.region_id)"""
)
def hi5_neighbours(d: Domain) -> DataFrame:
    return hierarchy.neighbours(d.cell_parents(), d.cell_edges())


@query("SELECT DISTINCT region_id, item_id FROM cell_parents JOIN uni USING (cell_id)")
def hi6_region_items(d: Domain) -> DataFrame:
    return hierarchy.region_items(d.cell_parents(), d.universe())


@query("SELECT region_id, cell_id FROM cell_parents p WHERE NOT EXISTS (SELECT 1 FROM up JOIN cell_parents c ON c.region_id = up.child WHERE up.parent = p.region_id AND c.cell_id = p.cell_id)")
def hi7_exclusive_cells(d: Domain) -> DataFrame:
    return hierarchy.exclusive_cells(d.cell_parents(), d.region_parents()).select("region_id", "cell_id")


@query("SELECT region_id AS store_id, row_number() OVER (ORDER BY region_id) - 1 AS gh_id FROM regions")
def hi8_id_maps(d: Domain) -> DataFrame:
    return storage.positions(d.regions(), "region_id").select(F.col("region_id").alias("store_id"), F.col("position").cast("long").alias("gh_id"))


@query(_SIDES + _SIZES + " SELECT region_id, count(*) AS n_cells, CAST(sum(n) AS BIGINT) AS max_items FROM sz JOIN cell_parents USING (cell_id) GROUP BY 1")
def hi9_sub_set(d: Domain) -> DataFrame:
    a, _, u = sides(d)
    return hierarchy.sub_set(a, u, d.cell_parents())


@query(_SIDES + _SIZES + " SELECT region_id, count(*) AS n_cells, CAST(sum(n) AS BIGINT) AS max_items FROM sz JOIN cell_parents USING (cell_id) WHERE region_id BETWEEN 30 AND 39 GROUP BY 1")
def hi10_sub_graph(d: Domain) -> DataFrame:
    """Only the regions of a sub-graph, here those that aren't halves, and only direct parents."""
    a, _, u = sides(d)
    above = hierarchy.direct_cell_parents(d.cell_parents().where("cell_id <> region_id"), hierarchy.ancestors(d.region_parents()))
    return hierarchy.sub_set(a, u, above.where("region_id between 30 and 39"))


@query(_SIDES + _A + " SELECT item_id FROM (SELECT cell_id, item_id FROM rp UNION SELECT cell_id, item_id FROM u WHERE cell_id IN (SELECT cell_id FROM rf)) JOIN cell_parents USING (cell_id) WHERE region_id = 31 GROUP BY 1 ORDER BY 1 LIMIT 30")
def hi11_node_items(d: Domain) -> DataFrame:
    """Items of a result in one region, the first thirty."""
    a, _, u = sides(d)
    here = a.join(d.cell_parents().where("region_id = 31"), "cell_id", "left_semi")
    return cqr.top_k(here, u, 30)


@query(
    _SIDES
    + _SIZES
    + """, cn AS (SELECT region_id, CAST(sum(n) AS BIGINT) AS m FROM sz JOIN cell_parents USING (cell_id) GROUP BY 1),
best AS (SELECT parent, arg_min(child, (-m, child)) AS child, max(m) AS m FROM up JOIN cn ON region_id = child GROUP BY 1),
walk(step, region_id, m) AS (SELECT 0, CAST(99 AS BIGINT), (SELECT m FROM cn WHERE region_id = 99) UNION ALL SELECT step + 1, b.child, b.m FROM walk w JOIN best b ON b.parent = w.region_id WHERE b.m >= 0.2 * w.m)
SELECT step, region_id FROM walk"""
)
def hi12_path_to_branch(d: Domain) -> DataFrame:
    a, _, u = sides(d)
    counts = storage.cut(hierarchy.sub_set(a, u, d.cell_parents()))
    path = hierarchy.path_to_branch(counts, d.region_parents(), 99, 0.2)
    return d.values("step int, region_id long", *enumerate(path))


@query(", w(region_id) AS (SELECT CAST(99 AS BIGINT) UNION ALL SELECT child FROM w JOIN up ON parent = region_id) SELECT region_id, count(*) AS times FROM w GROUP BY 1")
def hi13_visit(d: Domain) -> DataFrame:
    return hierarchy.paths(d.region_parents(), 99)


@query("SELECT cell_id, count(*) AS n_direct FROM cell_parents WHERE region_id BETWEEN 30 AND 41 GROUP BY 1")
def hi14_compactify(d: Domain) -> DataFrame:
    above = d.cell_parents().where("cell_id <> region_id")
    return hierarchy.direct_cell_parents(above, hierarchy.ancestors(d.region_parents())).groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_direct"))


@query("SELECT v.c AS invariant, CAST(0 AS BIGINT) AS broken FROM (VALUES ('children first'), ('region cells'), ('direct parent')) v(c)")
def hi15_consistency(d: Domain) -> DataFrame:
    up, cp = d.region_parents(), d.cell_parents()
    n = lambda name, rows: rows.agg(F.lit(name).alias("invariant"), F.count(F.lit(1)).alias("broken"))
    of_children = up.join(cp, F.col("child") == F.col("region_id")).select(F.col("parent").alias("region_id"), "cell_id").distinct()
    orphan = d.cells().join(cp.where("cell_id <> region_id"), "cell_id", "left_anti")
    return n("children first", up.where("child >= parent")).union(n("region cells", of_children.join(cp, ["region_id", "cell_id"], "left_anti"))).union(n("direct parent", orphan))


@query(_CLOSURE + " SELECT region_id, count(DISTINCT cell_id) AS n_cells, coalesce(max(depth), 0) AS depth, count(DISTINCT ancestor) AS n_ancestors FROM cell_parents LEFT JOIN cl ON node = region_id GROUP BY 1")
def hi16_statistics(d: Domain) -> DataFrame:
    above = hierarchy.ancestors(d.region_parents()).groupBy(F.col("node").alias("region_id")).agg(F.max("depth").alias("depth"), F.count(F.lit(1)).alias("n_ancestors"))
    cells = d.cell_parents().groupBy("region_id").agg(F.count("cell_id").alias("n_cells"))
    return cells.join(above, "region_id", "left").select("region_id", "n_cells", F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("n_ancestors", F.lit(0)).cast("long").alias("n_ancestors"))


@query("SELECT DISTINCT item_id FROM strs JOIN uni USING (item_id) JOIN cell_parents USING (cell_id) WHERE starts_with(s, 'P') AND region_id = 31")
def hi18_hierarchy_completer(d: Domain) -> DataFrame:
    found = textindex.complete(d.part_strs(), "P", text.PREFIX)
    here = hierarchy.region_items(d.cell_parents().where("region_id = 31"), d.universe()).select("item_id")
    return idset.intersect(found, here)


_FLAG = """, hit AS (SELECT item_id, cell_id FROM items WHERE contains(segment, 'BUILD')),
fl AS (SELECT DISTINCT cell_id FROM cell_parents JOIN regions USING (region_id) WHERE starts_with(name, 'A')),
gone AS (SELECT item_id, cell_id FROM items WHERE segment = 'FURNITURE'),
res AS (SELECT item_id, cell_id FROM items WHERE cell_id IN (SELECT cell_id FROM fl) UNION SELECT item_id, cell_id FROM hit EXCEPT SELECT item_id, cell_id FROM gone)"""


@query(_FLAG + " SELECT region_id, name, count(DISTINCT cell_id) AS n_cells, count(*) AS max_items FROM res JOIN cell_parents USING (cell_id) JOIN regions USING (region_id) GROUP BY 1, 2")
def flagship(d: Domain) -> DataFrame:
    """Items with BUILD in a string or in a region whose name starts with A, but not of the segment FURNITURE, by region."""
    items = d.items()
    u = items.select("item_id", "cell_id")
    strs = items.select("item_id", F.col("segment").alias("s"))
    tree = search.parse_hinted('(?BUILD? + A?) - "FURNITURE"')
    wanted, unwanted = tree.left, tree.right
    by_item = cqr.build(u.where("false"), u.join(textindex.complete(strs, wanted.left.text, wanted.left.kind), "item_id", "left_semi"))
    by_region = textindex.region_cells(d.regions(), d.cell_parents(), wanted.right.text, wanted.right.kind)
    gone = cqr.build(u.where("false"), u.join(textindex.complete(strs, unwanted.text, unwanted.kind), "item_id", "left_semi"))
    found = storage.cut(cqr.union(storage.cut(by_item), storage.cut(by_region), u))
    found = storage.cut(cqr.difference(found, storage.cut(gone), u))  # each result is read several times
    return hierarchy.sub_set(found, u, d.cell_parents()).join(d.regions(), "region_id").select("region_id", "name", "n_cells", "max_items")


# key/value items


def _kv(d: Domain) -> DataFrame:
    c = F.col
    return d.table("part").select(c("p_partkey").alias("item_id"), store.pairs(name=c("p_name"), tag=(c("p_type"), c("p_brand")), size=c("p_size"), brand=c("p_brand")).alias("kv"))


@query("SELECT p_partkey AS item_id, 'brand=' || p_brand || ';name=' || p_name || ';size=' || p_size || ';' || CASE WHEN p_brand < p_type THEN 'tag=' || p_brand || ';tag=' || p_type ELSE 'tag=' || p_type || ';tag=' || p_brand END AS pairs FROM part")
def kv1_sorted_pairs(d: Domain) -> DataFrame:
    return _kv(d).select("item_id", F.array_join(F.transform(F.array_sort("kv"), lambda p: F.concat_ws("=", p["key"], p["value"])), ";").alias("pairs"))


@query("SELECT p_partkey AS item_id, p_type AS tag, '' AS none, 'tag' AS key1 FROM part")
def kv2_value(d: Domain) -> DataFrame:
    return _kv(d).select("item_id", store.value(F.col("kv"), "tag").alias("tag"), store.value(F.col("kv"), "colour").alias("none"), F.col("kv")[1]["key"].alias("key1"))


@query("SELECT p_partkey AS item_id, 1 AS first, 2 AS second, -1 AS none, 2 AS n, CASE WHEN p_brand = 'Brand#1' THEN 2 ELSE 0 END AS values FROM part")
def kv3_find_count(d: Domain) -> DataFrame:
    kv = F.col("kv")
    return _kv(d).select("item_id", store.find(kv, "key", "tag").alias("first"), store.find(kv, "key", "tag", 2).alias("second"), store.find(kv, "key", "colour").alias("none"), store.count(kv, "key", "tag").alias("n"), store.count(kv, "value", "Brand#1").alias("values"))


@query("SELECT p_partkey AS item_id FROM part WHERE contains(p_name, 'old') OR p_size = 7 OR contains(p_brand, 'old') OR contains(p_type, 'old')")
def kv4_match_values(d: Domain) -> DataFrame:
    kv = F.col("kv")
    return _kv(d).where(store.match_values(kv, "old", text.SUBSTRING) | store.match_values(kv, "7", text.EXACT)).select("item_id")


@query("SELECT key, count(*) AS n FROM (SELECT 'brand' AS key FROM part UNION ALL SELECT 'name' FROM part UNION ALL SELECT 'size' FROM part UNION ALL SELECT 'tag' FROM part UNION ALL SELECT 'tag' FROM part UNION ALL SELECT 'name' FROM supplier) GROUP BY 1")
def kv5_append(d: Domain) -> DataFrame:
    """A stored table, appended to after it was written."""
    path = storage.store(_kv(d))
    more = d.table("supplier").select((F.col("s_suppkey") + 1000000).alias("item_id"), store.pairs(name=F.col("s_name")).alias("kv"))
    storage.append(more, path)
    return d.spark.read.parquet(path).select(F.explode("kv").alias("p")).groupBy(F.col("p.key").alias("key")).agg(F.count(F.lit(1)).alias("n"))


# statistics


@query("SELECT segment, min(bal) AS least, max(bal) AS most, round(avg(bal), 4) AS mean, round(var_pop(bal), 2) AS variance, round(stddev_pop(bal), 4) AS deviation FROM items GROUP BY 1")
def mf1_moments(d: Domain) -> DataFrame:
    b = "bal"
    return d.items().groupBy("segment").agg(F.min(b).alias("least"), F.max(b).alias("most"), F.round(F.avg(b), 4).alias("mean"), F.round(F.var_pop(b), 2).alias("variance"), F.round(F.stddev_pop(b), 4).alias("deviation"))


@query("SELECT segment, bal AS median FROM (SELECT segment, bal, row_number() OVER (PARTITION BY segment ORDER BY bal, item_id) - 1 AS r, count(*) OVER (PARTITION BY segment) AS n FROM items) WHERE r = n // 2")
def mf2_upper_median(d: Domain) -> DataFrame:
    return store.upper_median(d.items(), "segment", "bal", "item_id")


@query("SELECT round(-sum(p * log2(p)), 6) AS entropy FROM (SELECT count(*) / (SELECT count(*) FROM events) AS p FROM events GROUP BY event_type)")
def mf3_entropy(d: Domain) -> DataFrame:
    return store.entropy(d.table("events"), "event_type").select(F.round("entropy", 6).alias("entropy"))


@query("SELECT round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 2) AS intercept FROM (SELECT o_totalprice AS y, row_number() OVER (ORDER BY o_orderkey) - 1 AS x FROM orders)")
def mf4_regression(d: Domain) -> DataFrame:
    return store.regression(d.table("orders"), "o_orderkey", "o_totalprice").select(F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"))


@query("SELECT CAST(l_quantity AS BIGINT) AS x, CAST(l_linenumber AS BIGINT) AS y, count(*) AS n FROM lineitem GROUP BY 1, 2")
def mf5_histogram(d: Domain) -> DataFrame:
    return d.table("lineitem").groupBy(F.col("l_quantity").cast("long").alias("x"), F.col("l_linenumber").cast("long").alias("y")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, min(value) AS least, max(value) AS most, round(avg(value), 5) AS mean, count(value) AS n FROM events GROUP BY 1")
def mf6_min_max_mean(d: Domain) -> DataFrame:
    return d.table("events").groupBy("event_type").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("value"), 5).alias("mean"), F.count("value").alias("n"))


@query(
    """SELECT o_orderkey AS k, CAST((CAST(o_orderkey AS HUGEINT) * 1000003) // 7 AS BIGINT) AS muldiv, CAST((CAST(o_orderkey AS HUGEINT) * 1000003) % 4093 AS BIGINT) AS mulmod, least(o_orderkey + 4294967000, 4294967295) AS sat,
  CAST(sign(o_totalprice - 100000) AS INT) AS sgn, CAST(bit_count(o_orderkey) AS INT) AS pop, CAST(CASE WHEN o_orderkey = 0 THEN -1 ELSE length(ltrim(bin(o_orderkey), '0')) - 1 END AS INT) AS msb FROM orders"""
)
def mf7_bits(d: Domain) -> DataFrame:
    k, wide = F.col("o_orderkey"), F.col("o_orderkey").cast("decimal(20,0)") * F.lit(1000003).cast("decimal(10,0)")
    return d.table("orders").select(
        k.alias("k"), F.floor(wide / 7).cast("long").alias("muldiv"), (wide % 4093).cast("long").alias("mulmod"), store.saturated_add(k, F.lit(4294967000)).alias("sat"),
        F.signum(F.col("o_totalprice") - 100000).cast("int").alias("sgn"), F.bit_count(k).alias("pop"), store.top_bit(k).alias("msb"),
    )


@query("SELECT l_orderkey, l_linenumber, abs(l_discount - 0.05e0) < 1e-7 AS equal FROM lineitem")
def mf8_epsilon_equal(d: Domain) -> DataFrame:
    return d.table("lineitem").select("l_orderkey", "l_linenumber", (F.abs(F.col("l_discount") - F.lit(0.05)) < 1e-7).alias("equal"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey > 700 THEN NULL ELSE o_orderkey + 9223372036854775107 END AS total, CASE WHEN o_orderkey BETWEEN -128 AND 127 THEN o_orderkey END AS small FROM orders")
def mf9_checked(d: Domain) -> DataFrame:
    """Sums and narrow values, null where they overflow."""
    k = F.col("o_orderkey")
    return d.table("orders").select(k.alias("k"), F.try_add(k, F.lit(9223372036854775107)).alias("total"), k.try_cast("tinyint").cast("long").alias("small"))


@query("SELECT p_partkey AS item_id, CAST(p_size // gcd(p_size, 60) AS BIGINT) AS num, CAST(60 // gcd(p_size, 60) AS BIGINT) AS den, p_size / 60 < 0.5 AS below FROM part")
def mf10_fraction(d: Domain) -> DataFrame:
    f = store.fraction(F.col("p_size"), F.lit(60))
    rows = d.table("part").select(F.col("p_partkey").alias("item_id"), f.alias("f"))
    return rows.select("item_id", "f.num", "f.den", (F.col("f.num") * 2 < F.col("f.den")).alias("below"))


@query("SELECT l_orderkey, l_linenumber, least(l_quantity, l_extendedprice, l_discount, l_tax) AS least FROM lineitem")
def mf11_tree_reduce(d: Domain) -> DataFrame:
    cols = [F.col(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    return d.table("lineitem").select("l_orderkey", "l_linenumber", store.tree_reduce(cols, F.least).alias("least"))
