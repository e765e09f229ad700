"""The registered queries: log lines derived from the given tables, and every operator run on them."""

from logloom.workload import core_queries, curation_queries, report_queries, stream_queries  # noqa: F401
from logloom.workload.registry import QUERIES, SQL  # noqa: F401
