"""The bank's vault: which source columns each satellite holds, and how they are classified.

Sources: CMSTFL (customer master), BLNCFL (balances), TRXPFL (transactions).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultspark.config import THRESHOLDS
from vaultspark.functions.classify import channel_class, threshold_class
from vaultspark.functions.keys import business_key, change_hash
from vaultspark.operators import gold, quality
from vaultspark.operators.layout import renamed
from vaultspark.operators.loaders import load_time

# Source column and attribute, in the order in which they are hashed.
COLUMNS = {
    "Sat_Cliente_DatosEstables": {
        "CUSSX": "sexo_cliente", "CUSTT": "tratamiento_cliente", "CUSDB": "fecha_nacimiento", "CUSYR": "anio_nacimiento", "CUSAG2": "edad_cliente",
        "CUSCN": "pais_residencia", "CUSNA": "nacionalidad_cliente", "CUSDL": "numero_licencia_conducir", "CUSDP": "tipo_documento_pasaporte",
        "CUSDP2": "cantidad_pasaportes", "CUSLG": "idioma_preferido",
    },
    "Sat_Cliente_Contacto": {
        "CUSNM": "nombre_cliente", "CUSLN": "apellido_cliente", "CUSMD": "nombre_medio_cliente", "CUSFN": "nombre_completo_cliente", "CUSAD": "direccion_calle",
        "CUSA2": "direccion_apartamento", "CUSCT": "ciudad_residencia", "CUSST": "estado_provincia", "CUSZP": "codigo_postal", "CUSPH": "telefono_principal",
        "CUSMB": "telefono_movil", "CUSEM": "correo_electronico", "CUSMS": "estado_civil", "CUSOC": "ocupacion_cliente", "CUSED": "nivel_educativo",
    },
    "Sat_Cliente_Clasificacion": {
        "CUSTP": "tipo_cliente", "CUSSG": "segmento_cliente", "CUSRG": "region_geografica", "CUSBR": "sucursal_principal", "CUSMG": "gerente_asignado",
        "CUSRF": "referencia_interna", "CUSRS": "fuente_referencia", "CUSAG": "grupo_afinidad", "CUSPC": "preferencia_comunicacion", "CUSRK": "nivel_riesgo",
        "CUSVP": "indicador_vip", "CUSPF": "estado_perfil", "CUSKT": "estado_kyc", "CUSFM": "indicador_flags", "CUSLC": "ultimo_canal",
        "CUSCR": "calificacion_crediticia", "CUSAC": "cuenta_activa", "CUSCL": "clasificacion_interna", "CUSNT": "nota_cliente",
    },
    "Sat_Cliente_Financiero": {
        "CUSAC2": "cantidad_cuentas", "CUSTX": "cantidad_transacciones", "CUSSC": "score_cliente", "CUSLR": "ranking_prestamos", "CUSRC": "cantidad_registros",
        "CUSIN": "ingresos_cliente", "CUSBL": "saldo_disponible_maestro", "CUSOD": "fecha_apertura_relacion", "CUSCD": "fecha_cierre_relacion",
        "CUSLV": "fecha_ultima_visita", "CUSUD": "fecha_ultima_actualizacion", "CUSKD": "fecha_verificacion_kyc", "CUSRD": "fecha_renovacion",
        "CUSXD": "fecha_expiracion", "CUSFD": "fecha_primer_producto", "CUSLD": "fecha_ultimo_producto", "CUSMD2": "fecha_migracion",
        "CUSAD2": "fecha_activacion", "CUSBD": "fecha_bloqueo", "CUSVD": "fecha_verificacion", "CUSPD": "fecha_promocion", "CUSDD": "fecha_desactivacion",
        "CUSED2": "fecha_educacion_financiera", "CUSND": "fecha_notificacion",
    },
    "Sat_Operacion_DatosEstables": {
        "BLACT": "tipo_cuenta", "BLACN": "numero_cuenta", "BLCUR": "moneda_cuenta", "BLST": "estado_cuenta", "BLBR": "sucursal_cuenta",
        "BLPR": "producto_cuenta", "BLSP": "subproducto_cuenta", "BLNM": "nombre_cuenta", "BLCL": "clase_cuenta", "BLRK": "riesgo_cuenta",
        "BLTP": "tipo_producto_cuenta", "BLMG": "gerente_cuenta", "BLRF": "referencia_cuenta", "BLCC": "centro_costos_cuenta", "BLAG": "grupo_afinidad_cuenta",
        "BLPL": "plan_cuenta", "BLRG": "region_cuenta", "BLSF": "sufijo_cuenta", "BLNT": "nota_cuenta", "BLLC": "ultimo_canal_cuenta", "BLPF": "perfil_cuenta",
        "BLAU": "autorizado_cuenta", "BLTX": "texto_cuenta", "BLGR": "grupo_cuenta", "BLEM": "email_cuenta", "BLFR": "frecuencia_cuenta",
        "BLKY": "clave_cuenta", "BLVP": "vip_cuenta", "BLFC": "factor_cuenta",
    },
    "Sat_Operacion_Montos": {
        "BLAV": "saldo_disponible", "BLTB": "saldo_total", "BLRV": "saldo_reservado", "BLBK": "saldo_bloqueado", "BLCR": "limite_credito",
        "BLCU": "credito_utilizado", "BLCD": "credito_disponible", "BLOV": "valor_sobregiro", "BLOL": "limite_sobregiro", "BLPD": "depositos_pendientes",
        "BLPC": "cargos_pendientes", "BLPA": "ajustes_pendientes", "BLDI": "depositos_ingreso", "BLWI": "retenciones_cuenta", "BLTI": "transferencias_ingreso",
        "BLTC": "cargos_transferencia", "BLCA": "comisiones_anuales", "BLIM": "intereses_mensuales", "BLRF2": "reembolsos_cuenta", "BLPN": "penalidades_cuenta",
        "BLBN": "bonificaciones_cuenta", "BLAP": "ajustes_positivos", "BLAM": "ajustes_miscelaneos", "BLAY": "ajustes_anuales", "BLHI": "marca_alta_saldo",
        "BLLO": "marca_baja_saldo", "BLVR": "varianza_saldo", "BLRT": "ratio_cuenta", "BLCP": "porcentaje_aporte", "BLCI": "ingresos_aporte",
        "BLMN": "saldo_minimo", "BLMX": "saldo_maximo", "BLIR": "tasa_interes", "BLPM": "multiplicador_penalidad",
    },
    "Sat_Operacion_FechasEvento": {
        "BLOD": "fecha_apertura_cuenta", "BLXD": "fecha_expiracion_cuenta", "BLUD": "fecha_actualizacion_cuenta", "BLLD": "fecha_ultimo_movimiento",
        "BLSD": "fecha_estado_cuenta", "BLPD2": "fecha_penalidad", "BLRD": "fecha_renovacion_cuenta", "BLMD": "fecha_maduracion",
        "BLCD2": "fecha_cierre_cuenta", "BLBD": "fecha_bloqueo_cuenta", "BLFD": "fecha_fondeo", "BLGD": "fecha_gracia", "BLHD": "fecha_historica",
        "BLID": "fecha_interes", "BLJD": "fecha_ajuste", "BLKD": "fecha_kyc_cuenta", "BLND": "fecha_notificacion_cuenta", "BLTD": "fecha_transferencia",
        "BLVD": "fecha_verificacion_cuenta",
    },
    "Sat_Transaccion_DatosEstables": {
        "TRXDT": "fecha_transaccion", "TRXTYP": "tipo_transaccion", "TRXCUR": "moneda_transaccion", "TRXST": "estado_transaccion", "TRXCH": "canal_transaccion",
        "TRXDSC": "descripcion_transaccion", "TRXREF": "referencia_externa", "TRXSQ": "secuencia_transaccion", "TRXMX": "monto_maximo", "TRXMN": "monto_minimo",
        "TRXVD": "fecha_valor", "TRXPD": "fecha_procesamiento", "TRXSD": "fecha_liquidacion", "TRXCD": "fecha_compensacion", "TRXED": "fecha_efectiva",
        "TRXRD": "fecha_reverso", "TRXAD": "fecha_autorizacion", "TRXND": "fecha_notificacion_trx", "TRXXD": "fecha_expiracion_trx",
        "TRXFD": "fecha_fondeo_trx", "TRXGD": "fecha_gracia_trx", "TRXHD": "fecha_historica_trx", "TRXBD": "fecha_bloqueo_trx", "TRXMD": "fecha_maduracion_trx",
        "TRXLD": "fecha_limite_trx", "TRXUD": "fecha_actualizacion_trx", "TRXOD": "fecha_origen_trx", "TRXKD": "fecha_kyc_trx",
        "TRXTS": "timestamp_transaccion", "TRXUS": "timestamp_actualizacion",
    },
    "Sat_Transaccion_Montos": {
        "CUSTID": "identificador_cliente", "TRXDT": "fecha_transaccion", "TRXAMT": "monto_principal", "TRXCM": "comision_transaccion",
        "TRXBA": "saldo_posterior", "TRXBP": "saldo_anterior", "TRXTC": "cargo_fiscal", "TRXAL": "monto_local", "TRXPN": "monto_pago",
        "TRXBF": "beneficio_transaccion", "TRXRL": "perdida_tasa", "TRXAV": "monto_promedio", "TRXDV": "desviacion_monto", "TRXRK": "riesgo_transaccion",
        "TRXFR": "riesgo_fraude", "TRXLM": "limite_transaccion", "TRXLP": "porcentaje_limite", "TRXCP": "cargo_plataforma", "TRXCI": "cargo_institucion",
        "TRXCF": "cargo_extranjero", "TRXCV": "cargo_varianza", "TRXSB": "subtotal_transaccion", "TRXTL": "total_transaccion", "TRXRS": "residuo_transaccion",
        "TRXIM": "margen_interes", "TRXNT": "monto_neto", "TRXAO": "monto_original", "TRXIN": "monto_inversion", "TRXDS": "descuento_transaccion",
        "TRXPT": "monto_principal_prestamo",
    },
}

# Classified columns, the source column they come from and the table of ranges.
CLASSES = {
    "Sat_Cliente_DatosEstables": (("RangoEtario", "CUSAG2", "RANGO_ETARIO"), ("CategoriaIngresos", "CUSIN", "CATEGORIA_INGRESOS")),
    "Sat_Operacion_DatosEstables": (("CategoriaSaldo", "BLAV", "CATEGORIA_SALDO"), ("EstadoUtilizacionCredito", "BLRT", "UTILIZACION_CREDITO"), ("IndicadorSobregiro", "BLOV", "SOBREGIRO")),
    "Sat_Transaccion_Montos": (("RangoMontoTransaccion", "TRXAMT", "RANGO_MONTO"), ("NivelRiesgoFraude", "TRXFR", "RIESGO_FRAUDE")),
}

#: Hash column, business key columns and source of each kind of satellite.
KEYS = {
    "Sat_Cliente": ("Hash_Cliente", ("CUSTID",), "CMSTFL"),
    "Sat_Operacion": ("Hash_Operacion", ("CUSTID", "BLSQ"), "BLNCFL"),
    "Sat_Transaccion": ("Hash_Transaccion", ("TRXID",), "TRXPFL"),
}

# What hubs call their business keys.
KEY_NAMES = {"CUSTID": "IdentificadorCliente", "BLSQ": "SecuenciaSaldo", "TRXID": "IdentificadorTransaccion"}


@dataclass(frozen=True)
class Satellite:
    name: str

    @property
    def key(self) -> tuple[str, tuple[str, ...], str]:
        return KEYS[self.name.rsplit("_", 1)[0]]

    @property
    def names(self) -> dict[str, str]:
        return COLUMNS[self.name]

    @property
    def class_names(self) -> list[str]:
        return [target for target, _, _ in CLASSES.get(self.name, ())] + ["ClasificacionCanalATM"] * (self.name == "Sat_Transaccion_DatosEstables")

    @property
    def classified(self) -> dict[str, Column]:
        out = {target: threshold_class(F.col(source), THRESHOLDS[bands]) for target, source, bands in CLASSES.get(self.name, ())}
        if self.name == "Sat_Transaccion_DatosEstables":
            out["ClasificacionCanalATM"] = channel_class(F.col("TRXTYP"), F.col("TRXCH"))
        return out

    def rows(self, source: DataFrame, time=None) -> DataFrame:
        """Satellite rows of a bronze frame: attributes, classes, hub hash, change hash, load time and source name. The commit
        columns VersionCarga and FechaCargaBronce are kept where the frame has them and are not hashed."""
        hash_column, keys, table = self.key
        commit = [F.col(c) for c in ("VersionCarga", "FechaCargaBronce") if c in source.columns]
        classes = [c.alias(n) for n, c in self.classified.items()]
        out = renamed(source, self.names, *commit, *classes, business_key(*keys).alias(hash_column))
        hashed = change_hash(hash_column, *self.names.values(), *self.classified)
        return out.withColumn("Hash_Diferenciador", hashed).withColumn("FechaRegistro", load_time(time)).withColumn("FuenteDatos", F.lit(f"bronze.{table}"))


SATELLITES = {name: Satellite(name) for name in COLUMNS}


def hub(source: DataFrame, kind: str, names: dict[str, str], time=None) -> DataFrame:
    """Hub rows: hash, business keys under their target names, load time and source name."""
    hash_column, keys, table = KEYS[kind]
    return source.select(business_key(*keys).alias(hash_column), *[F.col(k).alias(names[k]) for k in keys], load_time(time).alias("FechaRegistro"), F.lit(f"bronze.{table}").alias("FuenteDatos"))


def link(source: DataFrame, one: str, other: str, time=None) -> DataFrame:
    """Link rows between the hubs of two kinds whose keys the source holds."""
    (a, a_keys, _), (b, b_keys, table) = KEYS[one], KEYS[other]
    pair = source.select(business_key(*a_keys).alias(a), business_key(*b_keys).alias(b))
    return pair.select(business_key(a, b).alias("Hash_Link"), a, b, load_time(time).alias("FechaRegistro"), F.lit(f"bronze.{table}").alias("FuenteDatos"))


# Columns of the dimensions, in order, by the satellite that they come from: attribute and published name.
DIMENSIONS = {
    "Dim_Cliente": ("Sat_Cliente", "DimIdCliente", ("IdentificadorCliente",), {
        "Sat_Cliente_DatosEstables": {
            "sexo_cliente": "SexoCliente", "edad_cliente": "EdadCliente", "fecha_nacimiento": "FechaNacimiento", "pais_residencia": "PaisResidencia",
            "RangoEtario": "RangoEtario", "CategoriaIngresos": "CategoriaIngresos",
        },
        "Sat_Cliente_Contacto": {
            "nombre_completo_cliente": "NombreCompletoCliente", "correo_electronico": "CorreoElectronico", "telefono_principal": "TelefonoPrincipal",
            "ciudad_residencia": "CiudadResidencia", "estado_civil": "EstadoCivil", "ocupacion_cliente": "OcupacionCliente",
        },
        "Sat_Cliente_Clasificacion": {
            "tipo_cliente": "TipoCliente", "segmento_cliente": "SegmentoCliente", "region_geografica": "RegionGeografica", "nivel_riesgo": "NivelRiesgo",
            "indicador_vip": "IndicadorVip", "estado_kyc": "EstadoKyc", "calificacion_crediticia": "CalificacionCrediticia",
        },
        "Sat_Cliente_Financiero": {
            "score_cliente": "ScoreCliente", "ingresos_cliente": "IngresosCliente", "cantidad_cuentas": "CantidadCuentas",
            "cantidad_transacciones": "CantidadTransacciones", "fecha_apertura_relacion": "FechaAperturaRelacion",
            "fecha_ultima_actualizacion": "FechaUltimaActualizacion",
        },
    }),
    "Dim_Operacion": ("Sat_Operacion", "DimIdOperacion", ("IdentificadorCliente", "SecuenciaSaldo"), {
        "Sat_Operacion_DatosEstables": {
            "tipo_cuenta": "TipoCuenta", "moneda_cuenta": "MonedaCuenta", "estado_cuenta": "EstadoCuenta", "producto_cuenta": "ProductoCuenta",
            "subproducto_cuenta": "SubproductoCuenta", "riesgo_cuenta": "RiesgoCuenta", "region_cuenta": "RegionCuenta", "CategoriaSaldo": "CategoriaSaldo",
            "EstadoUtilizacionCredito": "EstadoUtilizacionCredito", "IndicadorSobregiro": "IndicadorSobregiro",
        },
        "Sat_Operacion_Montos": {
            "saldo_disponible": "SaldoDisponible", "saldo_total": "SaldoTotal", "limite_credito": "LimiteCredito", "credito_utilizado": "CreditoUtilizado",
            "ratio_cuenta": "RatioCuenta", "tasa_interes": "TasaInteres",
        },
        "Sat_Operacion_FechasEvento": {
            "fecha_apertura_cuenta": "FechaAperturaCuenta", "fecha_ultimo_movimiento": "FechaUltimoMovimiento", "fecha_cierre_cuenta": "FechaCierreCuenta",
            "fecha_actualizacion_cuenta": "FechaActualizacionCuenta",
        },
    }),
}


def dimension(name: str, hub_rows: DataFrame, satellites: dict[str, DataFrame]) -> DataFrame:
    """A dimension in its closed schema: hub rows with the current attributes of its satellites, whose histories come by name. Rows
    without satellite rows stay; a missing column raises, and so does a row that breaks a rule of the dimension."""
    kind, id_column, own, chosen = DIMENSIONS[name]
    key = KEYS[kind][0]
    columns = [id_column, key, *own, *[target for names in chosen.values() for target in names.values()]]
    parts = [(satellites[s], [F.col(a).alias(b) for a, b in names.items()]) for s, names in chosen.items()]
    rules = quality.RULES["dim_customer" if kind == "Sat_Cliente" else "dim_operation"]["fail"]
    return quality.enforce(gold.type1_dimension(hub_rows, key, list(own), parts, id_column, columns, name), rules, name)
