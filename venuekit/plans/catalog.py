"""All registered queries."""

from venuekit.plans import queries_cleaning, queries_profile, queries_relational, queries_text  # noqa: F401
from venuekit.plans import queries_features, queries_models, queries_search  # noqa: F401
from venuekit.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
