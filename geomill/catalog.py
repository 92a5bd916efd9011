"""All registered queries that do not belong to the text subpackage."""

from __future__ import annotations

from geomill.plans import flows, queries, records, shapes, stored  # these add their queries to the same tables

FLAGSHIP = "label_to_geo_buckets"
QUERIES = queries.QUERIES
ORACLE_SQL = queries.ORACLE_SQL
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "flows", "records", "shapes", "stored"]
