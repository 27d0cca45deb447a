"""Queries by name, with the SQL that gives the same rows in DuckDB where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Common table expressions of the oracles: items and distinct items, as plans.views has them.
WITH_ITEMS = """
it AS (
  SELECT l_orderkey AS plan_id, l_linenumber::BIGINT AS line, l_partkey AS part, l_quantity AS w_ft, p_size::DOUBLE AS h_ft, floor(l_discount * 100 + 0.5)::BIGINT AS disc,
    floor(l_tax * 100 + 0.5)::BIGINT AS tax, l_returnflag AS flag, p_type AS ptype, 10 + l_orderkey % 11 AS ppf
  FROM lineitem JOIN part ON p_partkey = l_partkey
), di AS (
  SELECT plan_id, line, part, w_ft, min(h_ft) AS h_ft, min(ptype) AS ptype, min(disc) AS disc, min(tax) AS tax, min(flag) AS flag, min(ppf) AS ppf,
    line * 100000000 + part * 100 + w_ft::BIGINT AS room_id
  FROM it GROUP BY plan_id, line, part, w_ft
)"""
KIND = "CASE ptype WHEN 'PROMO' THEN 'below-grade' WHEN 'MEDIUM' THEN 'garage' WHEN 'ECONOMY' THEN 'porch' WHEN 'SMALL' THEN 'unfinished' ELSE 'gla' END"


def query(sql: str | None = None, items: bool = False):
    """Registers a query under its function's name. sql may start after the common table expressions if it uses items."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {WITH_ITEMS}{sql}" if items else sql
        return f

    return add
