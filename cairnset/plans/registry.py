"""Registry of the engine's queries and of the SQL that they are held against.

A query takes a ``Domain`` and returns a DataFrame. Its SQL may use the views of ``PRELUDE``, which
mirror the domain; it starts with SELECT, or with a comma and more common table expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.domain import Domain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PRELUDE = """WITH RECURSIVE items AS (
  SELECT c_custkey AS item_id, CAST(c_nationkey AS BIGINT) AS cell_id, c_name AS name, c_mktsegment AS segment, c_acctbal AS bal,
    -90e0 + ((c_custkey * 7919) % 180001) / 1000e0 AS lat, -180e0 + ((c_custkey * 104729) % 360001) / 1000e0 AS lon FROM customer
), cells AS (
  SELECT CAST(n_nationkey AS BIGINT) AS cell_id, -90e0 + ((n_nationkey * 7919) % 180001) / 1000e0 AS lat,
    -180e0 + ((n_nationkey * 104729) % 360001) / 1000e0 AS lon FROM nation
), regions AS (
  SELECT CAST(n_nationkey AS BIGINT) AS region_id, n_name AS name FROM nation
  UNION ALL SELECT r_regionkey + 30, r_name FROM region UNION ALL SELECT 40, 'EVEN' UNION ALL SELECT 41, 'ODD' UNION ALL SELECT 99, 'WORLD'
), up AS (
  SELECT CAST(n_nationkey AS BIGINT) AS child, CAST(n_regionkey + 30 AS BIGINT) AS parent FROM nation
  UNION SELECT n_nationkey, n_nationkey % 2 + 40 FROM nation
  UNION SELECT n_regionkey + 30, 99 FROM nation UNION SELECT n_nationkey % 2 + 40, 99 FROM nation
), cell_parents AS (
  SELECT cell_id, cell_id AS region_id FROM cells UNION SELECT cell_id, 99 FROM cells UNION SELECT child, parent FROM up WHERE child < 30
), edges AS (
  SELECT cell_id AS src, (cell_id + 1) % 25 AS dst FROM cells UNION SELECT cell_id, (cell_id + 5) % 25 FROM cells
  UNION SELECT (cell_id + 1) % 25, cell_id FROM cells UNION SELECT (cell_id + 5) % 25, cell_id FROM cells
), strs AS (
  SELECT p_partkey AS item_id, p_name AS s FROM part UNION ALL SELECT p_partkey, p_brand FROM part UNION ALL SELECT p_partkey, p_type FROM part
), uni AS (
  SELECT DISTINCT l_partkey AS item_id, CAST(s_nationkey AS BIGINT) AS cell_id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
), a AS (SELECT item_id FROM items WHERE segment = 'BUILDING'), b AS (SELECT item_id FROM items WHERE bal >= 5000), c AS (SELECT item_id FROM items WHERE cell_id < 10),
arrs AS (
  SELECT l_orderkey AS row_id, coalesce(list_sort(list(DISTINCT l_partkey) FILTER (l_quantity >= 25)), []) AS x,
    coalesce(list_sort(list(DISTINCT l_partkey) FILTER (l_discount >= 0.05)), []) AS y FROM lineitem GROUP BY 1
)"""


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[Domain], DataFrame]) -> Callable[[Domain], DataFrame]:
        name = f.__name__
        if name in QUERIES:
            raise ValueError(f"{name} is there already")
        QUERIES[name] = lambda spark, folder: f(Domain(spark, folder))
        if sql:
            ORACLES[name] = PRELUDE + (" " if sql.lstrip().startswith(",") else "\n") + sql
        return f

    return add
