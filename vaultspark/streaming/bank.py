"""The bank's vault from landed files: three bronze tables, three hubs, two links and nine satellites.

A source's files are taken into its bronze table, each once, and a second stream over that table feeds everything that comes from the
source with each batch: every entity reads its own columns of the batch's files, and no row is copied on the way. Every entity is put
under its rules before its target shows a row. Customers and operations are
states: hubs and links are upserted, satellites keep versions. Transactions happen once: their entities are appended, satellites with the
batch that brought a row. Every target remembers the batch it took last, so a batch that stopped half way is finished by its replay.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vaultspark.config import Settings
from vaultspark.functions.keys import business_key
from vaultspark.operators import quality
from vaultspark.operators.loaders import load_time
from vaultspark.sources.ingest import file_stream, with_load_columns, with_parts
from vaultspark.sources.store import VersionedTable
from vaultspark.specs.bank import KEY_NAMES, KEYS, SATELLITES, hub, link
from vaultspark.streaming.flows import Governance, appending, detecting_changes, governing, run_available_files, sinking, upserting

#: Kind of satellite to hub; kind to the link that its source fills with customers.
HUBS = {"Sat_Cliente": "Hub_Cliente", "Sat_Operacion": "Hub_Operacion", "Sat_Transaccion": "Hub_Transaccion"}
LINKS = {"Sat_Operacion": "Link_Cliente_Operacion", "Sat_Transaccion": "Link_Cliente_Transaccion"}
KIND_OF = {source: kind for kind, (_, _, source) in KEYS.items()}
#: Names in quality.RULES of what holds for an entity, beside "satellite" for every satellite.
RULED = {"Hub_Cliente": "hub_customer", "Hub_Operacion": "hub_operation", "Hub_Transaccion": "hub_transaction", "Sat_Cliente_Financiero": "sat_customer_finance", "Sat_Transaccion_Montos": "sat_transaction_amounts"}
#: Commit columns, which only satellites of transactions keep.
COMMIT = ["VersionCarga", "FechaCargaBronce"]


def rules_of(entity: str) -> dict[str, dict[str, str]]:
    """{action: {name: rule}} of an entity."""
    out: dict[str, dict[str, str]] = {}
    for name in ["satellite"] * (entity in SATELLITES) + [r for e, r in RULED.items() if e == entity]:
        for action, rules in quality.RULES[name].items():
            out[action] = out.get(action, {}) | rules
    return out


@dataclass(frozen=True)
class BankVault:
    """The vault in the layers of the settings. time: a fixed load time, for reproducible runs. buckets: of tables that are merged, which should grow with them; told: gets
    (entity, batch, {action: {rule: broken rows}}) of each batch."""

    spark: SparkSession
    settings: Settings
    time: str | None = None
    buckets: int = 8
    told: Callable[[str, int, dict], None] = lambda entity, batch, counts: None

    def table(self, entity: str) -> VersionedTable:
        return VersionedTable(self.spark, self.settings.table("silver", entity))

    def ingest(self, source: str, schema: StructType) -> None:
        """Takes what has landed of a source into bronze, each file once, with its partition date and load time."""
        stream = with_load_columns(file_stream(self.spark, self.settings.drops(source), with_parts(schema)), load_time(self.time))
        sinking(stream, self.settings.table("bronze", source), self.settings.checkpoint(f"bronze-{source}"))

    def _flows(self, source: str) -> dict[str, tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame, int], None]]]:
        """By entity that the source fills: rows of a bronze batch, and what takes them under the entity's rules."""
        kind = KIND_OF[source]
        key, key_columns, _ = KEYS[kind]
        once, states = kind == "Sat_Transaccion", [KEY_NAMES[k] for k in key_columns]
        under = lambda entity: Governance(rules_of(entity), entity, lambda batch, counts: self.told(entity, batch, counts))

        def merged(entity: str, keys: list[str], derived: dict[str, Column], hashes: list[str]) -> Callable[[DataFrame, int], None]:
            if once:
                return appending(self.table(entity), under(entity))
            g = under(entity)
            return governing(upserting(self.table(entity), keys, ["FechaRegistro"], self.buckets, derived, hashes, unique=True), g.rules, entity, g.told, settled=True)

        flows = {HUBS[kind]: (lambda rows: hub(rows, kind, KEY_NAMES, self.time), merged(HUBS[kind], states, {key: business_key(*states)}, []))}
        if kind in LINKS:
            pair = ["Hash_Cliente", key]
            flows[LINKS[kind]] = (lambda rows: link(rows, "Sat_Cliente", kind, self.time), merged(LINKS[kind], pair, {"Hash_Link": business_key(*pair)}, pair))
        for name, satellite in SATELLITES.items():
            if name.startswith(f"{kind}_"):
                target = self.table(name)
                take = appending(target, under(name)) if once else detecting_changes(target, key, "Hash_Diferenciador", "FechaRegistro", buckets=self.buckets, settled=True, under=under(name))
                flows[name] = (lambda rows, s=satellite: s.rows(rows if once else rows.drop(*COMMIT), self.time), take)
        return flows

    def load(self, source: str) -> None:
        """Feeds the entities of a source with what has come into its bronze table since the last run."""
        flows = self._flows(source)

        def handle(rows: DataFrame, batch: int) -> None:
            rows = rows.withColumn("VersionCarga", F.lit(batch).cast("long"))

            def feed(entity: str) -> None:
                of, take = flows[entity]
                take(of(rows), batch)

            with ThreadPoolExecutor(len(flows)) as pool:  # entities don't depend on each other, so their jobs share the cluster
                done = [pool.submit(inheritable_thread_target(rows.sparkSession)(feed), entity) for entity in flows]
            for future in done:
                future.result()

        run_available_files(self.spark, self.settings.table("bronze", source), handle, self.settings.checkpoint(f"silver-{source}"))
