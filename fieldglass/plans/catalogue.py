"""All registered queries."""

from fieldglass.plans import loading, reporting, scoring  # noqa: F401
from fieldglass.plans.registry import REGISTRY, callables, oracles  # noqa: F401
