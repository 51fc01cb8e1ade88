"""All registered queries."""

from heatscape.plans import queries_input, queries_models, queries_space, queries_trend  # noqa: F401
from heatscape.plans.registry import QUERIES, SQL  # noqa: F401
