"""Queries on text predicates, completion, text indexes and string functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import textindex
from ..sources.domain import Domain
from .registry import query

KINDS = (("exact", text.EXACT), ("prefix", text.PREFIX), ("suffix", text.SUFFIX), ("substring", text.SUBSTRING))
#: Query texts; the last two miss in most kinds.
TEXTS = ("PROMO", "Brand#1", "rod", "co", "old w", "brand#2", "ü", "A")
_VALUES = ", ".join(f"('{t}')" for t in TEXTS)
_T = f", t(q) AS (VALUES {_VALUES}) "


def _found(d: Domain, kinds: tuple[tuple[str, int], ...], s: Column, q: Callable[[str], Column]) -> DataFrame:
    """``item_id, q, kind``: which of ``TEXTS`` an item's strings match, and how. A string's hits are bits of a number, so each item is one row whatever it matches;
    items are dealt out before they are matched, as a small file is read by one task."""
    asked = [(t, name, kind) for t in TEXTS for name, kind in kinds]
    rows = d.parts().repartition("item_id").select("item_id", F.explode("strs").alias("s")).select("item_id", s.alias("s"))
    hits = [F.shiftleft(text.matches(F.col("s"), q(t), kind).cast("long"), k) for k, (t, _, kind) in enumerate(asked)]
    found = rows.groupBy("item_id").agg(F.bit_or(reduce(Column.bitwiseOR, hits)).alias("hits")).where("hits <> 0")
    names = F.array(*[F.struct(F.lit(1 << k).cast("long").alias("bit"), F.lit(t).alias("q"), F.lit(name).alias("kind")) for k, (t, name, _) in enumerate(asked)])
    return found.select("item_id", "hits", F.inline(names)).where(F.col("hits").bitwiseAND(F.col("bit")) != 0).select("item_id", "q", "kind")


def _pairs(d: Domain, kind: int) -> DataFrame:
    return _found(d, (("", kind),), F.col("s"), F.lit).select("item_id", "q")


@query(_T + "SELECT DISTINCT item_id, q FROM strs JOIN t ON s = q")
def tx1_exact(d: Domain) -> DataFrame:
    return _pairs(d, text.EXACT)


@query(_T + "SELECT DISTINCT item_id, q FROM strs JOIN t ON starts_with(s, q)")
def tx2_prefix(d: Domain) -> DataFrame:
    return _pairs(d, text.PREFIX)


@query(_T + "SELECT DISTINCT item_id, q FROM strs JOIN t ON suffix(s, q)")
def tx3_suffix(d: Domain) -> DataFrame:
    return _pairs(d, text.SUFFIX)


@query(_T + "SELECT DISTINCT item_id, q FROM strs JOIN t ON contains(s, q)")
def tx4_substring(d: Domain) -> DataFrame:
    return _pairs(d, text.SUBSTRING)


@query(
    _T
    + """SELECT DISTINCT item_id, q, kind FROM strs CROSS JOIN t CROSS JOIN (VALUES ('exact'), ('prefix'), ('suffix'), ('substring')) k(kind)
WHERE CASE kind WHEN 'exact' THEN lower(s) = lower(q) WHEN 'prefix' THEN starts_with(lower(s), lower(q)) WHEN 'suffix' THEN suffix(lower(s), lower(q)) ELSE contains(lower(s), lower(q)) END"""
)
def tx5_no_case(d: Domain) -> DataFrame:
    """Strings and texts are lowered once each, not once a test."""
    return _found(d, KINDS, F.lower("s"), lambda t: F.lower(F.lit(t)))


@query("SELECT DISTINCT item_id FROM strs WHERE starts_with(s, 'co') OR contains(s, '#2')")
def tx6_any_string(d: Domain) -> DataFrame:
    return d.parts().where(text.any_matches(F.col("strs"), "co", text.PREFIX) | text.any_matches(F.col("strs"), "#2", text.SUBSTRING)).select("item_id")


_RAW = """CASE p_size % 6 WHEN 0 THEN p_name WHEN 1 THEN '?' || p_name WHEN 2 THEN p_name || '?' WHEN 3 THEN '?' || p_name || '?' WHEN 4 THEN '"' || p_name || '"' ELSE '?"' || p_name || '"?' END"""


@query(f"SELECT p_partkey AS item_id, {_RAW} AS raw, p_name AS text, CASE p_size % 6 WHEN 0 THEN 8 WHEN 1 THEN 4 WHEN 2 THEN 2 WHEN 3 THEN 8 WHEN 4 THEN 1 ELSE 8 END AS kind FROM part")
def tx7_normalize(d: Domain) -> DataFrame:
    """Query texts in every decoration, stripped of it."""
    rows = d.table("part").select(F.col("p_partkey").alias("item_id"), F.expr(_RAW).alias("raw"))
    return rows.select("item_id", "raw", text.normalized(F.col("raw")).alias("n")).select("item_id", "raw", "n.text", "n.kind")


@query(
    """SELECT CAST(r AS INT) AS requested, CAST(v AS INT) AS available,
  CASE WHEN s >= 8 THEN 8 WHEN s >= 4 THEN 4 WHEN s >= 2 THEN 2 ELSE s END AS served FROM (
  SELECT r, v, CAST(CASE WHEN (r & v) <> 0 THEN r WHEN (r & 2) <> 0 THEN v & 1 WHEN (r & 8) <> 0 THEN v & 4 ELSE 0 END AS INT) AS s FROM range(16) a(r) CROSS JOIN range(16) b(v))"""
)
def tx8_to_available(d: Domain) -> DataFrame:
    masks = d.spark.range(256).select((F.col("id") / 16).cast("int").alias("requested"), (F.col("id") % 16).cast("int").alias("available"))
    return masks.withColumn("served", text.to_available(F.col("requested"), F.col("available")))


@query("SELECT DISTINCT item_id FROM strs WHERE starts_with(lower(s), 'sm')")
def tx9_complete(d: Domain) -> DataFrame:
    return textindex.complete(d.part_strs(), "SM", text.PREFIX | text.NO_CASE)


@query("SELECT DISTINCT item_id FROM strs WHERE suffix(s, 'rod')")
def tx10_partial_complete(d: Domain) -> DataFrame:
    return textindex.complete(d.part_strs(), "rod", text.SUFFIX)


@query("SELECT DISTINCT substr(s, 3, 1) AS c, item_id FROM strs WHERE starts_with(s, 'co') AND length(s) > 2")
def tx11_next_characters(d: Domain) -> DataFrame:
    return textindex.next_characters(d.part_strs(), "co")


@query("SELECT n AS step, substr(s, n + 1, 1) AS c, count(DISTINCT s) AS strings FROM strs CROSS JOIN (VALUES (0), (1), (2), (3)) v(n) WHERE starts_with(s, substr('cold', 1, n)) AND length(s) > n GROUP BY 1, 2")
def tx12_forward_iterator(d: Domain) -> DataFrame:
    """What follows each step of a walk down the trie; one pass for all steps."""
    s = d.part_strs().select("s").distinct()
    steps = F.array(*[F.struct(F.lit(n).alias("step"), text.next_char(F.col("s"), "cold"[:n]).alias("c")) for n in range(4)])
    return s.select("s", F.inline(steps)).where("c is not null").groupBy("step", "c").agg(F.count("s").alias("strings"))


@query("SELECT item_id FROM strs WHERE contains(s, 'A') UNION SELECT item_id FROM items WHERE contains(segment, 'A')")
def tx13_multi_completer(d: Domain) -> DataFrame:
    """One answer of two completers over one id space."""
    segments = d.items().select("item_id", F.col("segment").alias("s"))
    return textindex.complete(d.part_strs(), "A", text.SUBSTRING).union(textindex.complete(segments, "A", text.SUBSTRING)).distinct()


@query("SELECT DISTINCT i.item_id FROM items i JOIN cell_parents USING (cell_id) JOIN regions USING (region_id) WHERE starts_with(regions.name, 'A') OR starts_with(segment, 'A')")
def tx14_flattened(d: Domain) -> DataFrame:
    items = d.items()
    return textindex.flattened(items.select("item_id", F.col("segment").alias("s")), d.regions(), d.cell_parents(), items.select("item_id", "cell_id"), "A", text.PREFIX)


@query("SELECT DISTINCT item_id, 'd r' AS q FROM strs WHERE contains(s, 'd r') UNION SELECT item_id, '#2' FROM strs WHERE contains(s, '#2')")
def tx15_suffix_trie(d: Domain) -> DataFrame:
    """Substrings found as prefixes of suffixes, in a stored table of these."""
    index = textindex.Suffixes(d.part_strs())
    return index.items("d r", text.SUBSTRING).withColumn("q", F.lit("d r")).union(index.items("#2", text.SUBSTRING).withColumn("q", F.lit("#2")))


@query("SELECT s, count(*) AS n FROM strs WHERE s = 'cold rod' OR starts_with(s, 'Brand#1') GROUP BY 1")
def tx16_trie_find(d: Domain) -> DataFrame:
    """Exact and prefix lookup of a payload, here how many items have the string, in the stored table."""
    index = textindex.Suffixes(d.part_strs())
    return index.counts("cold rod", text.EXACT).union(index.counts("Brand#1", text.PREFIX))


@query("SELECT e, count(DISTINCT s) AS n FROM (SELECT s, substr(s, CAST(i AS INT)) AS e FROM (SELECT DISTINCT s FROM strs), generate_series(1, length(s)) g(i)) GROUP BY 1 ORDER BY e")
def tx17_trie_build(d: Domain) -> DataFrame:
    """Suffixes of all strings in order, with how many strings have them."""
    s = d.part_strs().select("s").distinct()
    return s.select("s", F.explode(text.suffixes(F.col("s"))).alias("e")).groupBy("e").agg(F.count("s").alias("n")).orderBy("e")


@query("SELECT p_partkey AS item_id, p_name AS word FROM part UNION ALL SELECT p_partkey, substr(p_name, strpos(p_name, ' ') + 1) FROM part WHERE strpos(p_name, ' ') > 0")
def tx18_suffix_strings(d: Domain) -> DataFrame:
    return d.table("part").select(F.col("p_partkey").alias("item_id"), F.explode(text.suffixes(F.col("p_name"), " ")).alias("word"))


_FULL = "f AS (SELECT DISTINCT cell_id FROM cell_parents JOIN regions USING (region_id) WHERE contains(lower(name), 'st')), h AS (SELECT DISTINCT cell_id, item_id FROM strs JOIN uni USING (item_id) WHERE contains(lower(s), 'st'))"
_ST = ("st", text.SUBSTRING | text.NO_CASE)


@query(", " + _FULL + " SELECT cell_id, true AS full_match, CAST(NULL AS BIGINT) AS item_id FROM f UNION ALL SELECT cell_id, false, item_id FROM h WHERE cell_id NOT IN (SELECT cell_id FROM f)")
def tx19_cell_complete(d: Domain) -> DataFrame:
    return textindex.complete_cells(d.part_strs(), d.universe(), d.regions(), d.cell_parents(), *_ST)


@query(", " + _FULL + " SELECT cell_id FROM f")
def tx20_cell_regions(d: Domain) -> DataFrame:
    return textindex.region_cells(d.regions(), d.cell_parents(), *_ST).select("cell_id")


@query(", " + _FULL + " SELECT cell_id, item_id FROM h")
def tx21_cell_items(d: Domain) -> DataFrame:
    return textindex.item_cells(d.part_strs(), d.universe(), *_ST).select("cell_id", "item_id")


@query(
    """, ds AS (SELECT DISTINCT s FROM strs), e AS (SELECT s, substr(s, CAST(i AS INT)) AS e FROM ds, generate_series(1, length(s)) g(i)),
n AS (SELECT s AS node, 1 AS kind, s FROM ds UNION SELECT substr(s, 1, CAST(i AS INT)), 2, s FROM ds, generate_series(1, length(s)) g(i)
  UNION SELECT e, 4, s FROM e UNION SELECT substr(e, 1, CAST(i AS INT)), 8, s FROM e, generate_series(1, length(e)) g(i)),
sc AS (SELECT DISTINCT s, cell_id FROM strs JOIN uni USING (item_id))
SELECT node, kind, count(DISTINCT cell_id) AS n_cells, count(DISTINCT s) AS n_strings FROM n JOIN sc USING (s) GROUP BY 1, 2"""
)
def tx22_text_index(d: Domain) -> DataFrame:
    """Every node of the text index with its cells: strings meet cells once, nodes are made of distinct strings."""
    cells = d.part_strs().join(d.universe(), "item_id").select("s", "cell_id").distinct()
    return textindex.index(d.part_strs()).join(cells, "s").groupBy("node", "kind").agg(F.countDistinct("cell_id").alias("n_cells"), F.countDistinct("s").alias("n_strings"))


@query("SELECT DISTINCT s_nationkey::BIGINT AS cell_id, l_partkey AS item_id FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE suffix(s_name, '3')")
def tx23_foreign_objects(d: Domain) -> DataFrame:
    """A supplier's name also finds the parts that it sells, in its own cell."""
    s = d.table("supplier").where(text.matches(F.col("s_name"), "3", text.SUFFIX))
    return s.join(d.table("lineitem"), F.col("s_suppkey") == F.col("l_suppkey")).select(F.col("s_nationkey").cast("long").alias("cell_id"), F.col("l_partkey").alias("item_id")).distinct()


@query("SELECT DISTINCT item_id FROM strs WHERE contains(s, 'old') AND item_id IN (SELECT item_id FROM uni WHERE cell_id < 10)")
def tx24_verified(d: Domain) -> DataFrame:
    """Candidates from an index, checked against the items' own strings."""
    found = d.universe().where("cell_id < 10").select("item_id").distinct()
    return d.parts().join(found, "item_id", "left_semi").where(text.any_matches(F.col("strs"), "old", text.SUBSTRING)).select("item_id")


@query("SELECT s, count(*) AS times, starts_with(lower(s), 'b') AS hit FROM strs GROUP BY 1")
def tx25_string_table(d: Domain) -> DataFrame:
    """The dictionary of strings with their frequency; a match is judged once a string."""
    return d.part_strs().groupBy("s").agg(F.count(F.lit(1)).alias("times")).withColumn("hit", text.matches(F.col("s"), "B", text.PREFIX | text.NO_CASE))


# string functions


@query(r"SELECT p_partkey AS item_id, CASE WHEN p_size % 2 = 0 THEN p_name || ';' || p_brand || '|' || p_type ELSE p_name || '||' || p_type END AS fields, CAST(3 AS BIGINT) - CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS n FROM part")
def sf1_split(d: Domain) -> DataFrame:
    raw = F.expr(r"case when p_size % 2 = 0 then concat(p_name, '\\;', p_brand, ';', p_type, ';') else concat(p_name, ';;', p_type) end")
    return d.table("part").select(F.col("p_partkey").alias("item_id"), text.split_escaped(raw, ";").alias("f")).select("item_id", F.array_join("f", "|").alias("fields"), F.size("f").cast("long").alias("n"))


@query("SELECT p_partkey AS item_id, starts_with(p_name, 'co') AS one, starts_with(p_type, 'PROMOTION') OR starts_with('PROMOTION', p_type) AS either FROM part")
def sf2_is_prefix(d: Domain) -> DataFrame:
    t, q = F.col("p_type"), F.lit("PROMOTION")
    return d.table("part").select(F.col("p_partkey").alias("item_id"), F.startswith("p_name", F.lit("co")).alias("one"), (F.startswith(t, q) | F.startswith(q, t)).alias("either"))


@query("SELECT p_partkey AS item_id, (SELECT max(i) FROM generate_series(0, least(length(p_name), length('cold röd'))) g(i) WHERE substr(p_name, 1, CAST(i AS INT)) = substr('cold röd', 1, CAST(i AS INT)))::INT AS lcp FROM part")
def sf3_common_prefix(d: Domain) -> DataFrame:
    return d.table("part").select(F.col("p_partkey").alias("item_id"), text.common_prefix_bytes(F.col("p_name"), F.lit("cold röd")).cast("int").alias("lcp"))


@query("SELECT p_partkey AS item_id, p_name < p_brand AS smaller, CASE WHEN p_name < 'cold rod' THEN -1 WHEN p_name = 'cold rod' THEN 0 ELSE 1 END AS cmp FROM part")
def sf4_compare(d: Domain) -> DataFrame:
    n = F.col("p_name")
    return d.table("part").select(F.col("p_partkey").alias("item_id"), (n < F.col("p_brand")).alias("smaller"), F.when(n < "cold rod", -1).when(n == "cold rod", 0).otherwise(1).alias("cmp"))


@query("SELECT doc_id, length(text) AS chars, strlen(text) AS bytes FROM documents")
def sf5_char_count(d: Domain) -> DataFrame:
    return d.table("documents").select("doc_id", F.char_length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes"))


@query("SELECT s, s <> lower(s) AS not_lower, regexp_matches(s, '[^A-Z]') AS has_lower, regexp_matches(s, '[^a-z]') AS has_upper FROM (SELECT DISTINCT s FROM strs)")
def sf6_case_tests(d: Domain) -> DataFrame:
    s = F.col("s")
    return d.part_strs().select("s").distinct().select("s", (F.lower(s) != s).alias("not_lower"), text.has_lower(s).alias("has_lower"), text.has_upper(s).alias("has_upper"))


@query("SELECT DISTINCT s, lower(s) AS low, upper(s) AS up FROM strs")
def sf7_case_maps(d: Domain) -> DataFrame:
    return d.part_strs().select("s").distinct().select("s", F.lower("s").alias("low"), F.upper("s").alias("up"))


@query("SELECT p_partkey AS item_id, p_name AS bare FROM part")
def sf8_diacritics(d: Domain) -> DataFrame:
    """Names with marks put on, taken off again."""
    marked = F.translate("p_name", "oeu", "öéü")
    return d.table("part").select(F.col("p_partkey").alias("item_id"), text.without_marks(marked).alias("bare"))


@query("SELECT event_id, coalesce(value > 50, false) AS flag FROM events")
def sf9_to_bool(d: Domain) -> DataFrame:
    return d.table("events").select("event_id", text.to_bool(F.when(F.col("value") > 50, F.lit("yes")).otherwise(F.lit("no"))).alias("flag"))


@query("SELECT p_partkey AS item_id, CAST(p_size AS DOUBLE) AS number, true AS missing FROM part")
def sf10_to_double(d: Domain) -> DataFrame:
    raw = F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit("mm"))
    return d.table("part").select(F.col("p_partkey").alias("item_id"), text.to_double(raw).alias("number"), F.isnan(text.to_double(F.col("p_name"))).alias("missing"))


@query(
    r"""SELECT event_id, replace(replace(props, '\', '\\'), '"', '\"') AS json, replace(props, '"', '\&quot;') AS xml,
  regexp_replace(props, '([\\^$.|?*+()\[\]{}-])', '\\\1', 'g') AS regex FROM events"""
)
def sf11_escapers(d: Domain) -> DataFrame:
    p = F.col("props")
    return d.table("events").select("event_id", text.escape_json(p).alias("json"), text.escape_xml(p).alias("xml"), text.escape_regex(p).alias("regex"))


@query("SELECT doc_id, true AS valid, length(text) AS n_points, md5(text) AS digest FROM documents")
def sf12_code_points(d: Domain) -> DataFrame:
    """UTF-8 is valid; the code points of a whole text make it again."""
    t = F.col("text")
    rows = d.table("documents").select("doc_id", F.is_valid_utf8(t).alias("valid"), text.packed_code_points(t).alias("p"))
    return rows.select("doc_id", "valid", (F.octet_length("p") / 4).cast("long").alias("n_points"), F.md5(text.from_packed(F.col("p")).cast("binary")).alias("digest"))
