"""All registered queries and oracles."""

from palimp.plans import base

# Importing a plan module registers its queries.
from palimp.plans import (  # noqa: F401
    asset_queries, audit_queries, lang_queries, page_queries, redact_queries, sanitize_queries, source_queries,
)

QUERIES = base.QUERIES
ORACLES = base.ORACLES
