"""All registered queries."""

from checks import catalog, grids, matching, reports, streams, texts  # noqa: F401
from checks.common import ORACLES, QUERIES  # noqa: F401
