"""The engine's own queries; importing the modules registers them."""

from orrery.plans import contracts, corpus, diagnoses, evaluations, lookups, rows, signals  # noqa: F401
from orrery.plans.base import QUERIES, SQL  # noqa: F401
