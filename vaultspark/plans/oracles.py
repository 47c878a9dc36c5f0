"""DuckDB SQL for the queries."""

from vaultspark.plans import bank, entities, profiles, star, vault  # noqa: F401
from vaultspark.plans.registry import ORACLES  # noqa: F401
