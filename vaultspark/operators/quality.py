"""Data-quality rules: SQL Booleans without subqueries. A rule that is null for a row is violated by it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from vaultspark.sources.scratch import stored


class QualityError(ValueError):
    """Rows violate a rule that has to hold."""


def broken(rule: str) -> Column:
    """Whether a row violates a rule, also by its being null."""
    return ~F.coalesce(F.expr(rule).cast("boolean"), F.lit(False))


def violations(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """One row with the number of violating rows per rule, from one pass."""
    return df.agg(*[F.count_if(broken(r)).alias(n) for n, r in rules.items()])


def warn(df: DataFrame, rules: dict[str, str], name: str = "quality") -> tuple[DataFrame, Observation]:
    """All rows; the observation has the counts once an action has run."""
    seen = Observation(name)
    return df.observe(seen, *[F.count_if(broken(r)).alias(n) for n, r in rules.items()]), seen


def drop(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """The rows that meet every rule."""
    for rule in rules.values():
        df = df.filter(~broken(rule))
    return df


def drop_counted(df: DataFrame, rules: dict[str, str], name: str = "dropped") -> tuple[DataFrame, Observation]:
    """As drop; the observation has the rows that each rule drops once an action has run."""
    watched, seen = warn(df, rules, name)
    return drop(watched, rules), seen


def enforce(df: DataFrame, rules: dict[str, str], entity: str = "") -> DataFrame:
    """df if every row meets every rule; else QualityError. df is computed once: into a scratch table, while its violations are
    counted; what is returned reads that table, so nothing that breaks a rule gets further."""
    watched, seen = warn(df, rules, f"enforced {entity}")
    rows = stored(watched, "enforced")
    if bad := {k: v for k, v in seen.get.items() if v}:
        raise QualityError(f"{entity}: rows that violate a rule: {bad}")
    return rows


def _settled(found: dict[str, int], rules: dict[str, dict[str, str]], entity: str) -> dict[str, dict[str, int]]:
    """The counts by action and name, unless a fail rule is broken."""
    counts = {action: {name: found[f"{action} {name}"] for name in some} for action, some in rules.items()}
    if bad := {name: n for name, n in counts.get("fail", {}).items() if n}:
        raise QualityError(f"{entity}: rows that violate a rule: {bad}")
    return counts


def _every(rules: dict[str, dict[str, str]]) -> dict[str, str]:
    return {f"{action} {name}": rule for action, some in rules.items() for name, rule in some.items()}


def watching(df: DataFrame, rules: dict[str, dict[str, str]], entity: str = "") -> tuple[DataFrame, Callable[[], dict[str, dict[str, int]]]]:
    """As governed(), without a copy of the rows: they are counted while an action takes them, all of them and once, and after it the function that comes
    with them gives the counts or raises QualityError. Whoever writes them asks it before what is written counts."""
    if not any(rules.values()):
        return df, lambda: {}
    watched, seen = warn(df, _every(rules), f"governed {entity}")
    return drop(watched, rules.get("drop", {})), lambda: _settled(seen.get, rules, entity)


def governed(df: DataFrame, rules: dict[str, dict[str, str]], entity: str = "", settled: bool = False) -> tuple[DataFrame, dict[str, dict[str, int]]]:
    """df under an entity's rules, {action: {name: rule}}: the rows that no drop rule drops, and by action and name how many rows of df
    break a rule. Computed once, as in enforce(); a broken fail rule raises QualityError. Without rules, df as it is. settled: df comes from a table and is
    cheap to compute again, so it is counted in a pass of its own and not copied."""
    if not any(rules.values()):
        return df, {}
    if settled:
        return drop(df, rules.get("drop", {})), _settled(violations(df, _every(rules)).first().asDict(), rules, entity)
    watched, settle = watching(df, rules, entity)
    rows = stored(watched, "governed")
    return rows, settle()


#: What holds where; actions: drop, fail, warn.
RULES = {
    "hub_customer": {"drop": {"positive_key": "IdentificadorCliente > 0"}, "fail": {"hash_set": "Hash_Cliente IS NOT NULL"}},
    "hub_operation": {"drop": {"positive_key": "IdentificadorCliente > 0"}, "fail": {"hash_set": "Hash_Operacion IS NOT NULL"}},
    "hub_transaction": {"fail": {"key_set": "IdentificadorTransaccion IS NOT NULL", "hash_set": "Hash_Transaccion IS NOT NULL"}},
    "satellite": {"fail": {"change_hash_set": "Hash_Diferenciador IS NOT NULL"}},
    "sat_customer_finance": {"warn": {"score_range": "score_cliente BETWEEN 300 AND 1150"}},
    "sat_transaction_amounts": {"drop": {"positive_amount": "monto_principal > 0"}, "warn": {"fraud_range": "riesgo_fraude BETWEEN 0 AND 100"}},
    "dim_customer": {"fail": {"id_set": "DimIdCliente IS NOT NULL", "hash_set": "Hash_Cliente IS NOT NULL"}},
    "dim_operation": {"fail": {"id_set": "DimIdOperacion IS NOT NULL", "hash_set": "Hash_Operacion IS NOT NULL"}},
    "dim_calendar": {"fail": {"date_set": "FechaClave IS NOT NULL", "month_range": "Mes BETWEEN 1 AND 12"}, "warn": {"year_range": "Anio BETWEEN 1900 AND 2100"}},
    "key_map": {"fail": {"customer_set": "Hash_Cliente IS NOT NULL", "operation_set": "Hash_Operacion IS NOT NULL", "id_set": "DimIdCliente IS NOT NULL"}},
    "enriched": {"fail": {"transaction_set": "Hash_Transaccion IS NOT NULL", "customer_set": "Hash_Cliente IS NOT NULL", "id_set": "DimIdCliente IS NOT NULL", "kind_known": "TipoTransaccion IN ('DATM', 'CATM')"}},
    "fact": {"fail": {"id_set": "DimIdCliente IS NOT NULL", "transaction_set": "IdentificadorTransaccion IS NOT NULL", "date_set": "FechaClave IS NOT NULL", "kind_known": "TipoTransaccion IN ('DATM', 'CATM')"}, "warn": {"operation_set": "DimIdOperacion IS NOT NULL"}, "drop": {"positive_amount": "MontoPrincipal > 0"}},
}
