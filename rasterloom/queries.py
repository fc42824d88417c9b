"""The library's queries and their SQL for DuckDB."""

from rasterloom.plans import codec_queries, container_queries, frame_queries, image_queries, policy_queries, sample_queries, transform_queries  # noqa: F401
from rasterloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
