"""The queries of the driver contract."""

from vaultspark.plans import bank, entities, profiles, star, vault  # noqa: F401  they register their queries
from vaultspark.plans.registry import QUERIES  # noqa: F401
