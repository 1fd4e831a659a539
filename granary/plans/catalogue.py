"""Every query by name, with its DuckDB oracle where SQL can express it."""

from granary.plans import contrast_queries, curation_queries, relational_queries, report_queries, study_queries, text_queries  # noqa: F401
from granary.plans.registry import ORACLES, QUERIES  # noqa: F401
