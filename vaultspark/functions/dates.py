"""Partition dates and calendar attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values
MONTHS = ("Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio", "Julio", "Agosto", "Septiembre", "Octubre", "Noviembre", "Diciembre")
DAYS = ("Domingo", "Lunes", "Martes", "Miércoles", "Jueves", "Viernes", "Sábado")


def partition_date(year: str = "año", month: str = "mes", day: str = "dia") -> Column:
    return F.to_date(F.concat_ws("-", F.col(year).cast("string"), F.lpad(F.col(month).cast("string"), 2, "0"), F.lpad(F.col(day).cast("string"), 2, "0")))


def calendar(dates: DataFrame, column: str) -> DataFrame:
    """One row per distinct date (nulls left out) with its attributes; weeks are ISO weeks, days count from Sunday = 1."""
    d = F.col("FechaClave")
    name = lambda names, n: F.element_at(F.array(*map(F.lit, names)), n)
    return dates.select(F.col(column).cast("date").alias("FechaClave")).filter(d.isNotNull()).distinct().select(
        "FechaClave", F.year(d).alias("Anio"), F.month(d).alias("Mes"), F.dayofmonth(d).alias("Dia"), F.quarter(d).alias("Trimestre"),
        F.when(F.quarter(d) <= 2, 1).otherwise(2).alias("Semestre"), F.dayofweek(d).alias("DiaSemana"), name(DAYS, F.dayofweek(d)).alias("NombreDia"),
        name(MONTHS, F.month(d)).alias("NombreMes"), F.dayofweek(d).isin(1, 7).alias("EsFinSemana"), F.dayofyear(d).alias("DiaDelAnio"), F.weekofyear(d).alias("SemanaDelAnio"),
    )
