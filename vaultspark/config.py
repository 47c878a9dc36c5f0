"""Settings and fixed classification tables."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

SEPARATOR = "|"
UNKNOWN = "DESCONOCIDO"

# Labels with closed ranges, checked in this order.
THRESHOLDS = {
    "RANGO_ETARIO": (("JOVEN_ADULTO", 18, 25), ("ADULTO", 26, 35), ("ADULTO_MEDIO", 36, 45), ("ADULTO_MAYOR", 46, 55), ("SENIOR", 56, 999)),
    "CATEGORIA_INGRESOS": (("BAJO", 0, 15000), ("MEDIO", 15001, 35000), ("ALTO", 35001, 65000), ("MUY_ALTO", 65001, 85000), ("PREMIUM", 85001, 999999999)),
    "CATEGORIA_SALDO": (("BAJO", 0, 10000), ("MEDIO", 10001, 30000), ("ALTO", 30001, 60000), ("MUY_ALTO", 60001, 90000), ("PREMIUM", 90001, 999999999)),
    "UTILIZACION_CREDITO": (("SIN_USO", 0, 0), ("USO_BAJO", 0.001, 0.05), ("USO_MODERADO", 0.051, 0.10), ("USO_ALTO", 0.101, 0.15), ("SOBRE_UTILIZADO", 0.151, 1.0)),
    "SOBREGIRO": (("SIN_SOBREGIRO", 0, 100), ("SOBREGIRO_LEVE", 101, 1000), ("SOBREGIRO_MODERADO", 1001, 3000), ("SOBREGIRO_CRITICO", 3001, 999999999)),
    "RANGO_MONTO": (("MICRO", 0, 1000), ("PEQUENA", 1001, 10000), ("MEDIANA", 10001, 50000), ("GRANDE", 50001, 90000), ("MUY_GRANDE", 90001, 999999999)),
    "RIESGO_FRAUDE": (("SIN_RIESGO", 0, 20), ("RIESGO_BAJO", 21, 40), ("RIESGO_MODERADO", 41, 60), ("RIESGO_ALTO", 61, 80), ("RIESGO_CRITICO", 81, 100)),
}


@dataclass(frozen=True)
class Settings:
    """Where the layers live and what they are fed from; every value has to be set as `vaultspark.<name>`. A layer is one folder, a
    table a folder in it; drops and remembered schemas of the three sources are folders of the landing area."""

    landing_dir: str
    bronze_dir: str
    silver_dir: str
    gold_dir: str
    checkpoint_dir: str
    cmstfl_path: str
    trxpfl_path: str
    blncfl_path: str
    cmstfl_schema: str
    trxpfl_schema: str
    blncfl_schema: str

    @classmethod
    def read(cls, spark: SparkSession) -> Settings:
        """From the session's configuration. No defaults: a missing value raises KeyError and names it."""
        found = {f.name: spark.conf.get(f"vaultspark.{f.name}", None) for f in fields(cls)}
        if missing := sorted(k for k, v in found.items() if not v):
            raise KeyError("not set: " + ", ".join(f"vaultspark.{k}" for k in missing))
        return cls(**found)

    def drops(self, source: str) -> str:
        return f"{self.landing_dir.rstrip('/')}/{getattr(self, f'{source.lower()}_path')}"

    def schema(self, source: str) -> str:
        return f"{self.landing_dir.rstrip('/')}/{getattr(self, f'{source.lower()}_schema')}"

    def table(self, layer: str, name: str) -> str:
        """layer: bronze, silver or gold."""
        return f"{getattr(self, f'{layer}_dir').rstrip('/')}/{name}"

    def checkpoint(self, name: str) -> str:
        return f"{self.checkpoint_dir.rstrip('/')}/{name}"
