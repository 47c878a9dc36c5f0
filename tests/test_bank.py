"""The bank's vault from end to end on a few rows of the sources' schemas."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from vaultspark.functions.keys import surrogate_key
from vaultspark.operators import gold, quality
from vaultspark.operators.loaders import changed_rows, new_by_key
from vaultspark.specs.bank import DIMENSIONS, SATELLITES, dimension, hub, link

WIDTHS = {"Sat_Cliente_DatosEstables": 17, "Sat_Cliente_Contacto": 19, "Sat_Cliente_Clasificacion": 23, "Sat_Cliente_Financiero": 28, "Sat_Operacion_DatosEstables": 36, "Sat_Operacion_Montos": 38, "Sat_Operacion_FechasEvento": 23, "Sat_Transaccion_DatosEstables": 37, "Sat_Transaccion_Montos": 38}
LONGS = {"CUSTID", "CUSYR", "CUSAG2", "CUSDP2", "CUSAC2", "CUSTX", "CUSSC", "CUSLR", "CUSRC", "BLSQ", "TRXSQ"}


def frame(spark, kind, given):
    """Rows with every column that the satellites of a kind read; those not given are null."""
    columns = {c for s in SATELLITES.values() if s.name.startswith(kind) for c in s.names} | set(given[0])
    numbers = {"CUSIN", "CUSBL", "BLAV", "BLRT", "BLOV", "BLTB", "TRXAMT", "TRXFR"}
    types = {c: "long" if c in LONGS else "double" if c in numbers else "string" for c in sorted(columns)}
    return spark.createDataFrame([tuple(r.get(c) for c in types) for r in given], ", ".join(f"{c} {t}" for c, t in types.items()))


def test_satellites_have_their_widths_and_classes(spark):
    customer = frame(spark, "Sat_Cliente", [{"CUSTID": 1, "CUSAG2": 30, "CUSIN": 15000.5, "CUSNM": "Ana"}])
    balance = frame(spark, "Sat_Operacion", [{"CUSTID": 1, "BLSQ": 7, "BLAV": 20000.0, "BLRT": 0.04, "BLOV": 50.0}])
    trx = frame(spark, "Sat_Transaccion", [{"TRXID": "DATM1", "CUSTID": 1, "TRXTYP": "DATM", "TRXCH": "POS", "TRXAMT": 900.0, "TRXFR": 95.0}])
    trx = trx.withColumn("VersionCarga", F.lit(1)).withColumn("FechaCargaBronce", F.current_timestamp())
    for name, satellite in SATELLITES.items():
        source = customer if "Cliente" in name else balance if "Operacion" in name else trx
        assert len(satellite.rows(source).columns) == WIDTHS[name], name
    one = lambda name, source: SATELLITES[name].rows(source, "2026-04-03").first()
    assert one("Sat_Cliente_DatosEstables", customer)["RangoEtario"] == "ADULTO" and one("Sat_Cliente_DatosEstables", customer)["CategoriaIngresos"] == "DESCONOCIDO"
    row = one("Sat_Operacion_DatosEstables", balance)
    assert (row["CategoriaSaldo"], row["EstadoUtilizacionCredito"], row["IndicadorSobregiro"]) == ("MEDIO", "USO_BAJO", "SIN_SOBREGIRO")
    assert one("Sat_Transaccion_DatosEstables", trx)["ClasificacionCanalATM"] == "RETIRO_ATM" and one("Sat_Transaccion_Montos", trx)["NivelRiesgoFraude"] == "RIESGO_CRITICO"


def test_two_days_give_a_star(spark):
    day_1 = frame(spark, "Sat_Cliente", [{"CUSTID": 1, "CUSEM": "a@x", "CUSAG2": 30}, {"CUSTID": 2, "CUSEM": "b@x", "CUSAG2": 60}, {"CUSTID": -1}])
    day_2 = frame(spark, "Sat_Cliente", [{"CUSTID": 1, "CUSEM": "new@x", "CUSAG2": 30}, {"CUSTID": 2, "CUSEM": "b@x", "CUSAG2": 60}, {"CUSTID": 3}])
    names = {"CUSTID": "IdentificadorCliente", "BLSQ": "SecuenciaSaldo", "TRXID": "IdentificadorTransaccion"}
    customers = quality.drop(hub(day_1, "Sat_Cliente", names), quality.RULES["hub_customer"]["drop"])
    new = new_by_key(hub(day_2, "Sat_Cliente", names), customers, ["Hash_Cliente"])
    assert [r["IdentificadorCliente"] for r in new.collect()] == [3]
    contact, stable = SATELLITES["Sat_Cliente_Contacto"], SATELLITES["Sat_Cliente_DatosEstables"]
    first = changed_rows(contact.rows(day_1, "2026-04-01"), None, "Hash_Cliente")
    second = changed_rows(contact.rows(day_2, "2026-04-02"), first, "Hash_Cliente")
    assert sorted(r["correo_electronico"] or "" for r in second.collect()) == ["", "new@x"]
    assert {r["RangoEtario"] for r in changed_rows(stable.rows(day_2, "2026-04-02"), stable.rows(day_1, "2026-04-01"), "Hash_Cliente").collect()} == {"DESCONOCIDO"}
    history = first.unionByName(second)
    columns = ["Hash_Cliente", "DimIdCliente", "IdentificadorCliente", "correo_electronico"]
    dim = gold.type1_dimension(customers.unionByName(new), "Hash_Cliente", ["IdentificadorCliente"], [(history, ["correo_electronico"])], "DimIdCliente", columns, "Dim_Cliente")
    assert sorted((r["IdentificadorCliente"], r["correo_electronico"]) for r in dim.collect()) == [(1, "new@x"), (2, "b@x"), (3, None)]

    balances = frame(spark, "Sat_Operacion", [{"CUSTID": 1, "BLSQ": 1}, {"CUSTID": 1, "BLSQ": 2}, {"CUSTID": 2, "BLSQ": 3}])
    operations = hub(balances, "Sat_Operacion", names | {"CUSTID": "IdentificadorCliente"})
    dominant = gold.dominant_child(operations, link(balances, "Sat_Cliente", "Sat_Operacion"), "Hash_Cliente", "Hash_Operacion", "SecuenciaSaldo")
    mapping = gold.key_map(dominant, dim, operations.withColumn("DimIdOperacion", surrogate_key("Hash_Operacion")), "Hash_Cliente", "Hash_Operacion", "DimIdCliente", "DimIdOperacion")
    assert mapping.count() == 2
    trx = frame(spark, "Sat_Transaccion", [{"TRXID": "t1", "CUSTID": 1, "TRXTYP": "DATM", "TRXAMT": 5.0}, {"TRXID": "t2", "CUSTID": 2, "TRXTYP": "CATM", "TRXAMT": 7.0}, {"TRXID": "t3", "CUSTID": 1, "TRXTYP": "CMPR"}])
    rows = SATELLITES["Sat_Transaccion_DatosEstables"].rows(trx)
    enriched = gold.enriched(rows, F.col("tipo_transaccion").isin("DATM", "CATM"), link(trx, "Sat_Cliente", "Sat_Transaccion"), mapping, "Hash_Transaccion", "Hash_Cliente")
    fact = enriched.withColumn("TipoTransaccion", F.col("tipo_transaccion")).select("*", *gold.atm_flags("tipo_transaccion", "DATM", "CATM"))
    checked = quality.enforce(fact, quality.RULES["enriched"]["fail"], "fact")
    assert sorted((r["EsRetiro"], r["EsDeposito"]) for r in checked.collect()) == [(False, True), (True, False)]


def test_dimensions_have_their_closed_schemas(spark):
    names = {"CUSTID": "IdentificadorCliente", "BLSQ": "SecuenciaSaldo"}
    customer = frame(spark, "Sat_Cliente", [{"CUSTID": 1, "CUSAG2": 30, "CUSIN": 20000.0, "CUSEM": "a@x"}, {"CUSTID": 2}])
    balance = frame(spark, "Sat_Operacion", [{"CUSTID": 1, "BLSQ": 7, "BLAV": 20000.0, "BLACT": "AHRO"}])
    for name, source, width in (("Dim_Cliente", customer, 28), ("Dim_Operacion", balance, 24)):
        kind, id_column, own, chosen = DIMENSIONS[name]
        parts = {s: SATELLITES[s].rows(source.filter("CUSTID = 1"), "2026-04-01") for s in chosen}
        rows = dimension(name, hub(source, kind, names), parts)
        assert len(rows.columns) == width and rows.columns[0] == id_column and rows.count() == source.count()
        first = rows.filter("IdentificadorCliente = 1").first()
        assert (first["RangoEtario"], first["CorreoElectronico"]) == ("ADULTO", "a@x") if name == "Dim_Cliente" else (first["TipoCuenta"], first["CategoriaSaldo"]) == ("AHRO", "MEDIO")
        broken = parts | {next(iter(parts)): parts[next(iter(parts))].drop(next(iter(chosen[next(iter(chosen))])))}
        with pytest.raises(AnalysisException, match=next(iter(chosen[next(iter(chosen))]))):
            dimension(name, hub(source, kind, names), broken)
        unkeyed = hub(source, kind, names).withColumn(rows.columns[1], F.lit(None).cast("string"))
        with pytest.raises(quality.QualityError, match=name):
            dimension(name, unkeyed, parts)
