"""Named queries over the given tables; importing this package registers all of them."""

from palimpsest.plans import claim_queries, job_queries, log_queries, map_queries, record_queries
from palimpsest.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "claim_queries", "job_queries", "log_queries", "map_queries", "record_queries"]
