"""The operators as runnable queries over the given tables, each beside SQL that gives the same rows."""

from folioframe.registry import (  # noqa: F401
    analytics,
    holdings,
    ingest,
    merges,
    normalized,
    orders,
    reads,
    scalars,
    streams,
)
from folioframe.registry.core import ORACLES, QUERIES  # noqa: F401
