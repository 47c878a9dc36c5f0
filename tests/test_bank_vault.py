"""The vault's flows on a few landed rows: rules, replays, what comes back."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from vaultspark.config import Settings
from vaultspark.streaming import bank
from vaultspark.streaming.bank import BankVault, rules_of

from tests.test_bank import frame


def settings(root):
    layers = {f"{layer}_dir": f"{root}/{layer}" for layer in ("landing", "bronze", "silver", "gold", "checkpoint")}
    return Settings(**layers, **{f"{s}_{what}": f"{s}-{what}" for s in ("cmstfl", "trxpfl", "blncfl") for what in ("path", "schema")})


def landed(vault, source, rows, day):
    rows.write.parquet(f"{vault.settings.drops(source)}/año=2026/mes=01/dia={day:02}")
    vault.ingest(source, rows.schema)
    vault.load(source)


def test_every_entity_has_its_rules():
    assert rules_of("Sat_Transaccion_Montos") == {"fail": {"change_hash_set": "Hash_Diferenciador IS NOT NULL"}, "drop": {"positive_amount": "monto_principal > 0"}, "warn": {"fraud_range": "riesgo_fraude BETWEEN 0 AND 100"}}
    assert rules_of("Sat_Operacion_Montos") == {"fail": {"change_hash_set": "Hash_Diferenciador IS NOT NULL"}} and rules_of("Link_Cliente_Operacion") == {}


def test_values_that_come_back_are_versions_and_hubs_keep_the_last_day(spark, tmp_path):
    told = []
    for day, rows in enumerate(([{"CUSTID": 1, "CUSEM": "a", "CUSSC": 100}, {"CUSTID": -5, "CUSEM": "x"}], [{"CUSTID": 1, "CUSEM": "b", "CUSSC": 400}], [{"CUSTID": 1, "CUSEM": "a", "CUSSC": 400}] * 2, []), 1):
        vault = BankVault(spark, settings(tmp_path), f"2026-01-{day:02}", told=lambda e, b, c: told.append((e, b, c)))
        given = rows or [{"CUSTID": 1}]
        landed(vault, "CMSTFL", frame(spark, "Sat_Cliente", given).filter(F.lit(bool(rows))), day)
    hub = vault.table("Hub_Cliente").read()
    assert [(r["IdentificadorCliente"], str(r["FechaRegistro"])[:10]) for r in hub.collect()] == [(1, "2026-01-03")]
    contact = vault.table("Sat_Cliente_Contacto").read().filter(F.col("Hash_Cliente") == hub.first()["Hash_Cliente"])
    assert [r["correo_electronico"] for r in contact.orderBy("FechaRegistro").collect()] == ["a", "b", "a"]
    broken = {(e, b): c for e, b, c in told}
    assert broken["Hub_Cliente", 0]["drop"] == {"positive_key": 1} and broken["Sat_Cliente_Financiero", 0]["warn"] == {"score_range": 2} and broken["Sat_Cliente_Financiero", 1]["warn"] == {"score_range": 0}
    assert len(vault.table("Sat_Cliente_Contacto").read().columns) == 19


def test_a_broken_rule_stops_the_batch_and_its_replay_finishes_it(spark, tmp_path, monkeypatch):
    vault = BankVault(spark, settings(tmp_path), "2026-01-01")
    rows = frame(spark, "Sat_Transaccion", [{"TRXID": "t1", "CUSTID": 1, "TRXTYP": "DATM", "TRXAMT": 5.0}, {"TRXID": "t2", "CUSTID": 1, "TRXAMT": -1.0}, {"TRXID": "t3", "CUSTID": None, "TRXAMT": None}])
    with monkeypatch.context() as broken:
        broken.setitem(bank.quality.RULES, "hub_transaction", {"fail": {"known": "IdentificadorTransaccion = 't1'"}})
        with pytest.raises(StreamingQueryException, match="Hub_Transaccion"):
            landed(vault, "TRXPFL", rows, 1)
    assert not vault.table("Hub_Transaccion").exists()
    for _ in range(2):  # the replay writes what is missing, once; a run without news nothing
        vault.load("TRXPFL")
    counts = {e: vault.table(e).read().count() for e in ("Hub_Transaccion", "Link_Cliente_Transaccion", "Sat_Transaccion_DatosEstables", "Sat_Transaccion_Montos")}
    assert counts == {"Hub_Transaccion": 3, "Link_Cliente_Transaccion": 3, "Sat_Transaccion_DatosEstables": 3, "Sat_Transaccion_Montos": 1}
    amounts = vault.table("Sat_Transaccion_Montos").read()
    assert len(amounts.columns) == 38 and amounts.first()["VersionCarga"] == 0
