"""All registered queries."""

from tableprobe.queries import intake, models, readiness, relations, reports, service, statistics  # noqa: F401
from tableprobe.queries.registry import COVERS, QUERIES, SQL  # noqa: F401
