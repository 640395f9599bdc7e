"""Queries by name and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import nested, packed, references
from . import cases, problems_sql, queries, tools  # noqa: F401  cases and tools register their queries in those of queries

QUERIES = {
    "p1_found": packed.p1_found,
    "p2_found": references.p2_found,
    "p2_report": references.p2_report,
    "p4_found": nested.p4_found,
    "p4_objects": nested.p4_objects,
    "p4_bridge": nested.p4_bridge,
    "p4_rebuilt": nested.p4_rebuilt,
    **queries.QUERIES,
}
ORACLE: dict[str, str] = queries.ORACLE | {"p2_found": problems_sql.FOUND, "p2_report": problems_sql.REPORT, "p4_found": problems_sql.OBJECTS}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Hybrid search: text and vector ranks fused."""
    return queries.hybrid(spark, folder)
