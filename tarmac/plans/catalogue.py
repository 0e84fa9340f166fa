"""All registered queries of the road-safety operators."""

from tarmac.plans import analysis_queries, area_queries, file_queries, job_queries, more_queries, network_queries, record_queries, spatial_queries  # noqa: F401
from tarmac.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
