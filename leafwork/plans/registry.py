"""All queries of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import arrange, assembly, documents, extraction, grid, layout, regionedits, spatial, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in (grid, tables, layout, documents, spatial, regionedits, assembly, arrange, extraction):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
