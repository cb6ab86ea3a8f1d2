"""From the tables of a delivery to the linked ledger and the entity table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import dates, fixed_values as fixed, text, values
from ledgerline.operators import asof, link, rows
from ledgerline.operators.profile import Out, entity_profile
from ledgerline.operators.skew import oversized
from ledgerline.sources.shared import stored
from ledgerline.sources.tables import load_delivery, with_row_order

KEY, ROW = "entity_id", "row_no"

# Registry columns, the names they get in the ledger, and the entity
# table. Inputs and outputs keep the names of the delivered data.
REGISTRY_KEY = "cedula"
DEATH_COLUMNS = {
    "FECHA_DEFUNCION": "fecha_defuncion",
    "CAUSA_MUERTE": "causa_basica_muerte_valor",
    "DPTO_MUERTE": "departamento_ocurrencia",
    "EDAD_MUERTE": "edad_fallecimiento_digitada",
    "GRUPO_EDAD_MUERTE": "grupo edades_",
    "CAT_SUI_": "CAT_SUI_",
    "CAT_MCEXSUI_": "CAT_MCEXSUI_",
}
DEATH_COLUMNS_2 = {
    "CDE_lugar_ocurrencia": "lugar_ocurrencia",
    "CDE_departamento_ocurrencia": "departamento_ocurrencia",
    "CDE_estado_civil": "estado_civil",
    "CDE_etnia": "etnia",
    "CDE_mayor_nivel_educacion": "mayor_nivel_educacion",
    "MOTIVO_EXTERNO_": "motivo_externo",
    "ES_MOTIVO_EXTERNO_": "es_motivo_externo",
}
BIRTH_TIME, BIRTH_GROUP = "anio_mes_nacimiento_hijo", "nro_rese"
BIRTH_FIELDS = [
    "cedula", "anio_mes_nacimiento_hijo", "nro_rese", "estado_civil", "pais_nac", "pais_residencia", "mayor_nivel_estudio",
    "sexo", "peso", "semanas_gestacion", "orden", "certdatospartocodocurrencia", "apgar1", "apgar2", "tipo_gesta",
    "numero_embarazo_anteriores", "semana_embarazo_primer_consulta", "total_consultas", "mes_parto", "lugar_parto",
    "lugar_depto", "tipo_certificador", "tipo_parto", "tipo_cesarea", "forceps", "vaccum", "otra_maniobra",
]
STAY_TIME = "Fecha ingreso"
STAY_FIELDS = [
    "cedula", "Institución", "Sector", "Fecha ingreso", "Fecha Egreso", "Diagnostico principal según CIE-10",
    "Causa externa según CIE-10",
]
FOLLOWUP_COLUMNS = [
    "FECHA SEGUIMIENTO", "FECHA LLAMADA PRESTADOR", "AGENDO CONSULTA ESM 7DIAS SI/NO/INTERNADO", "FECHA DE CONSULTA",
    "CONCURRIO", "SE LLAMO A USUARIO Y/O REFERENTE", "AGENDO NUEVA CONSULTA", "FECHA DE NUEVA CONSULTA", "INTERNACION",
    "FECHA ALTA", "FECHA LLAMADA PRESTADOR.1", "MSP", "OBSERVACIONES", "UNNAMED: 26", "FECHA DE LLAMADA AL PRESTADOR",
    "MOTIVO",
]
AGENDA_COLUMN = "AGENDO CONSULTA ESM 7DIAS SI/NO/INTERNADO_"

# (output, ledger column, aggregate, n), in the order of the entity table; the
# number tells the first delivery that has the output.
ENTITY_OUTPUTS = [
    (1, "Sexo", "sex", "mode", 1),
    (1, "NACIMIENTO", "birth_date", "mode", 1),
    (1, "GRUPO_EDAD_", "GRUPO_EDAD_", "last_filled", 1),
    (1, "METODO_IAE_FRECUENTE_", "METODO_", "mode", 1),
    (1, "METODO_IAE_PREVIO_", "METODO_", "last_filled", 1),
    (1, "METODO_IAE_PREVIO_2_", "METODO_", "nth_last_filled", 2),
    (1, "METODO_IAE_PREVIO_3_", "METODO_", "nth_last_filled", 3),
    (1, "IAE_PREVIO", "previous_flag", "last_filled", 1),
    (1, "PRESTADOR_RECODIFICADO", "provider", "last_filled", 1),
    (1, "PRESTADOR_PUBLICO_", "PRESTADOR_PUBLICO_", "mode", 1),
    (1, "PRESTADOR_PRIVADO_", "PRESTADOR_PRIVADO_", "mode", 1),
    (1, "REGISTRO_ultimo_no_nulo", "recorded_time", "last_filled", 1),
    (1, "REGISTRO_ultimo", "recorded_time", "last", 1),
    (1, "REGISTRO_cantidad", "recorded_time", "count", 1),
    (1, "FECHA_IAE_ultimo_no_nulo", "event_time", "last_filled", 1),
    (1, "FECHA_IAE_ultimo", "event_time", "last", 1),
    (1, "FECHA_IAE_cantidad", "event_time", "count", 1),
    (1, "NUMERO_INTENTOS_", "event_time", "count", 1),
    (1, "DECISION_", "decision", "last_filled", 1),
    (2, "FECHA SEGUIMIENTO_", "FECHA SEGUIMIENTO_", "last", 1),
    (2, "FECHA LLAMADA PRESTADOR_", "FECHA LLAMADA PRESTADOR_", "last", 1),
    (2, AGENDA_COLUMN, AGENDA_COLUMN, "last", 1),
    (2, "FECHA DE CONSULTA_", "FECHA DE CONSULTA_", "last", 1),
    (2, "CONCURRIO_", "CONCURRIO_", "last", 1),
    (2, "SE LLAMO A USUARIO Y/O REFERENTE_", "SE LLAMO A USUARIO Y/O REFERENTE_", "last", 1),
    (2, "AGENDO NUEVA CONSULTA_", "AGENDO NUEVA CONSULTA_", "last", 1),
    (2, "FECHA DE NUEVA CONSULTA_", "FECHA DE NUEVA CONSULTA_", "last", 1),
    (2, "INTERNACION_", "INTERNACION_", "last", 1),
    (2, "FECHA ALTA_", "FECHA ALTA_", "last", 1),
    (2, "FECHA LLAMADA PRESTADOR.1_", "FECHA LLAMADA PRESTADOR.1_", "last", 1),
    (2, "MSP_", "MSP_", "last", 1),
    (2, "FECHA DE LLAMADA AL PRESTADOR_", "FECHA DE LLAMADA AL PRESTADOR_", "last", 1),
    (2, "CONCURRIO_binaria", "CONCURRIO_binaria", "last", 1),
    (2, "NO_CONCURRIO_CONSULTA_", "NO_CONCURRIO_CONSULTA_", "last", 1),
    (1, "ULTIMO_INTENTO_", "event_time", "largest_poisoned", 1),
    (1, "DIAS_PROMEDIO_INTENTOS_", "event_time", "mean_gap_days", 1),
    (1, "MIN_DIAS_IAE_MUERTE_", "DIAS_IAE_MUERTE_", "min", 1),
    (1, "IAE_en_CDE_", "IAE_en_CDE", "last_filled", 1),
    (1, "FECHA_DEFUNCION", "FECHA_DEFUNCION", "last_filled", 1),
    (1, "CAT_SUI_", "CAT_SUI_", "last_filled", 1),
    (1, "CAT_MCEXSUI_", "CAT_MCEXSUI_", "last_filled", 1),
    (2, "MOTIVO_EXT_SUI_", "MOTIVO_EXT_SUI_", "mode", 1),
    (2, "MOTIVO_EXTERNO_", "MOTIVO_EXTERNO_", "mode", 1),
    (2, "ES_MOTIVO_EXTERNO_", "ES_MOTIVO_EXTERNO_", "mode", 1),
    (1, "CNV_", "CNV_", "mode", 1),
    (1, "CNV_ultimo_cant_hijos_", "CNV_cant_hijos_cuando_IAE", "last_filled", 1),
    (1, "CNV_ultimo_edad_hijo_mayor_", "CNV_edad_hijo_mayor_cuando_IAE", "last_filled", 1),
    (1, "CNV_ultimo_edad_hijo_menor_", "CNV_edad_hijo_menor_cuando_IAE", "last_filled", 1),
    (2, "CNV_nro_rese_in_IAE_", "CNV_nro_rese_in_IAE_", "mode", 1),
    (2, "CNV_otro_progenitor_", "CNV_otro_progenitor_", "mode", 1),
    (2, "CNV_ultimo_estado_civil_", "CNV_ultimo_cuando_IAE_estado_civil", "last_filled", 1),
    (2, "CNV_ultimo_pais_nac_", "CNV_ultimo_cuando_IAE_pais_nac", "last_filled", 1),
    (2, "CNV_ultimo_pais_residencia_", "CNV_ultimo_cuando_IAE_pais_residencia", "last_filled", 1),
    (2, "CNV_ultimo_mayor_nivel_estudio_", "CNV_ultimo_cuando_IAE_mayor_nivel_estudio", "last_filled", 1),
    (2, "CNV_ultimo_sexo_", "CNV_ultimo_cuando_IAE_sexo", "last_filled", 1),
    (2, "CNV_ultimo_embarazo_anteriores_", "CNV_ultimo_cuando_IAE_numero_embarazo_anteriores", "last_filled", 1),
    (2, "CNV_ultimo_semana_embarazo_primer_consulta_", "CNV_ultimo_cuando_IAE_semana_embarazo_primer_consulta", "last_filled", 1),
    (2, "CNV_ultimo_total_consultas_", "CNV_ultimo_cuando_IAE_total_consultas", "last_filled", 1),
    (1, "RUCAF_prestador", "RUCAF_prestador", "last_filled", 1),
    (1, "RUCAF_PRESTADOR_PUBLICO_", "RUCAF_PRESTADOR_PUBLICO_", "last_filled", 1),
    (1, "RUCAF_PRESTADOR_PRIVADO_", "RUCAF_PRESTADOR_PRIVADO_", "last_filled", 1),
    (1, "RUCAF_pais", "RUCAF_pais", "last_filled", 1),
    (1, "RUCAF_departamento", "RUCAF_departamento", "last_filled", 1),
    (1, "RUCAF_localidad", "RUCAF_localidad", "last_filled", 1),
    (1, "RUCAF_cobertura", "RUCAF_cobertura", "last_filled", 1),
    (1, "SHARPS_", "SHARPS_", "last_filled", 1),
    (1, "SIV_", "SIV_", "last_filled", 1),
    (1, "ANTIPOLIOMELITICA", "ANTIPOLIOMELITICA", "last_filled", 1),
    (1, "COVID 19", "COVID 19", "last_filled", 1),
]


def entity_outputs(number: int) -> list[Out]:
    return [Out(name, column, how, n) for since, name, column, how, n in ENTITY_OUTPUTS if since <= number]


def clean_ledger(ledger: DataFrame, number: int) -> DataFrame:
    """Row filter, duplicates, text rules, provider classes, ages; and follow-up fields for delivery 2."""
    data = [c for c in ledger.columns if c != ROW]
    kept = rows.keep_filled(ledger.select(ROW, *[F.col(f"`{c}`") for c in data]), 4 + 1)  # the row number is always filled
    # Copies do not change the largest age, so it is found before they are folded.
    aged = kept.select(F.col("age") if number == 1 else dates.age_calendar_years("birth_date", "event_time").alias("EDAD_"))
    kept = rows.first_by(kept, data, ROW)
    kept = kept.withColumns({
        "tiene_registro_": values.not_null_flag("recorded_time"), "es_IAE_": values.not_null_flag("event_time"),
        "Tipo_prestador_IAE_": text.provider_list_class("provider"), "method": text.method_label("method"),
        "previous_flag": text.previous_flag("previous_flag"), "decision": text.decision_label("decision"),
        "EDAD_": dates.age_calendar_years("birth_date", "event_time"),
    }).withColumns({
        "METODO_": text.method_category("method"), "DECISION_": text.decision_category("decision"),
        "PRESTADOR_PUBLICO_": text.has_class("Tipo_prestador_IAE_", fixed.PUBLIC),
        "PRESTADOR_PRIVADO_": text.has_class("Tipo_prestador_IAE_", fixed.PRIVATE),
    })
    age = "age" if number == 1 else "EDAD_"
    kept = values.with_bin_midpoint(kept, age, "GRUPO_EDAD_", 5, basis=aged)
    return clean_followup(kept) if number == 2 else kept


def clean_followup(ledger: DataFrame) -> DataFrame:
    """Follow-up fields: day numbers become dates, text is trimmed and upper-cased, labels are derived."""
    fixed_cells = {f"{c}_": text.upper_trimmed(dates.repair_serial_text(F.col(f"`{c}`"))) for c in FOLLOWUP_COLUMNS}
    out = ledger.withColumns(fixed_cells)
    label = text.followup_label(f"`{AGENDA_COLUMN}`")
    return out.withColumns({
        "CONCURRIO_binaria": dates.date_means_yes("CONCURRIO_", formats=("dd/MM/yyyy",)),
        "NO_CONCURRIO_CONSULTA_": F.col("CONCURRIO_").eqNullSafe(F.lit(fixed.PREVIOUS_NO)),
        AGENDA_COLUMN: label, "DESCARTADA_POR_RASTREADOR": text.followup_discarded(label)})


def clean_deaths(deaths: DataFrame) -> DataFrame:
    coded = rows.keep_filled(deaths, 3).withColumns({
        "CAT_SUI_": text.code_in("causa_basica_muerte_valor", fixed.CODES_INTENTIONAL),
        "CAT_MCEXSUI_": text.code_in("causa_basica_muerte_valor", fixed.CODES_OTHER_EXTERNAL)})
    return values.with_bin_midpoint(coded, "edad_fallecimiento_calculada", "grupo edades_", 5)


def link_deaths(ledger: DataFrame, deaths: DataFrame, number: int, hot: link.Hot = None) -> DataFrame:
    columns = {**DEATH_COLUMNS, **(DEATH_COLUMNS_2 if number == 2 else {})}
    out = link.lookup_unique(ledger, deaths, KEY, REGISTRY_KEY, columns, hot)
    out = out.withColumn("DIAS_IAE_MUERTE_", dates.elapsed_days("event_time", "FECHA_DEFUNCION"))
    if number == 2:
        out = out.withColumn("MOTIVO_EXT_SUI_", F.col("MOTIVO_EXTERNO_").eqNullSafe(F.lit(fixed.EXTERNAL_MOTIVE)))
    return out


def link_births(ledger: DataFrame, births: DataFrame, number: int, hot: link.Hot = None) -> DataFrame:
    names = {"history_count": "CNV_cant_hijos_cuando_IAE", "history_oldest_years": "CNV_edad_hijo_mayor_cuando_IAE",
             "history_youngest_years": "CNV_edad_hijo_menor_cuando_IAE"}
    key = births.withColumnRenamed(REGISTRY_KEY, KEY).withColumn(REGISTRY_KEY, F.col(KEY))
    if number == 1:
        return asof.asof_history(ledger, key, KEY, "event_time", BIRTH_TIME).withColumnsRenamed(names)
    out = asof.asof_enrich(ledger, key, KEY, "event_time", BIRTH_TIME, BIRTH_FIELDS, ROW,
                           last_prefix="CNV_ultimo_cuando_IAE_").withColumnsRenamed(names)
    out = link.with_secondary_key_flag(out, births, KEY, REGISTRY_KEY, BIRTH_GROUP, "CNV_nro_rese_in_IAE_", hot)
    return link.attach_counterpart(out, births, KEY, REGISTRY_KEY, BIRTH_GROUP, ROW, "CNV_otro_progenitor_", hot)


def link_coverage(ledger: DataFrame, coverage: DataFrame, hot: link.Hot = None) -> DataFrame:
    """Latest coverage record per entity, with its provider classes."""
    labelled = coverage.withColumn("tipo_prestador_RUCAF", text.provider_list_class("prestador")).withColumns({
        "PRESTADOR_PUBLICO_": text.has_class("tipo_prestador_RUCAF", fixed.PUBLIC),
        "PRESTADOR_PRIVADO_": text.has_class("tipo_prestador_RUCAF", fixed.PRIVATE)})
    columns = [c for c in labelled.columns if c not in (REGISTRY_KEY, ROW)]
    return link.with_latest(ledger, labelled, KEY, REGISTRY_KEY, ROW, columns, "RUCAF_", hot)


def link_stays(ledger: DataFrame, stays: DataFrame) -> DataFrame:
    keyed = stays.withColumnRenamed(REGISTRY_KEY, KEY).withColumn(REGISTRY_KEY, F.col(KEY))
    return asof.nearest_within(ledger, keyed, KEY, "event_time", STAY_TIME, STAY_FIELDS, ROW, prefix="EH_cercano_a_IAE_")


# Tables of which no step takes a first or last row.
UNORDERED = ("deaths", "alerts")


def numbered(tables: Mapping[str, DataFrame | None]) -> dict[str, DataFrame | None]:
    """Write down the row order of every table whose order is used and that does not carry one yet."""
    return {n: t if t is None or n in UNORDERED or ROW in t.columns else with_row_order(t, ROW) for n, t in tables.items()}


def distinct_registry(df: DataFrame) -> DataFrame:
    """First copy of each row, with at least two filled cells beside the row number."""
    data = [c for c in df.columns if c != ROW]
    return rows.first_by(rows.keep_filled(df, 2 + 1), data, ROW)


def linked_ledger(tables: Mapping[str, DataFrame | None], number: int) -> DataFrame:
    """The cleaned ledger with everything the registries add to it.

    The cleaned ledger is stored, as all the links start from it, and its oversized
    keys are counted once. The lookups join on one key, so they share one exchange.
    """
    t = numbered(tables)
    ledger = stored(clean_ledger(t["ledger"], number))
    hot = oversized(ledger, [KEY])
    deaths = clean_deaths(t["deaths"].drop(ROW))
    births = rows.first_by(t["births"], [c for c in t["births"].columns if c != ROW], ROW)
    coverage, vaccination = distinct_registry(t["coverage"]), distinct_registry(t["vaccination"])
    alerts = rows.keep_filled(t["alerts"].drop(ROW), 2)
    out = link_births(ledger, births, number, hot)
    if t.get("stays") is not None:
        out = link_stays(out, t["stays"])
    out = link_deaths(out, deaths, number, hot)
    out = link.with_memberships(out, KEY, {
        "IAE_en_CDE": (deaths, REGISTRY_KEY), "CNV_": (births, REGISTRY_KEY), "SHARPS_": (alerts, REGISTRY_KEY),
        "SIV_": (vaccination, REGISTRY_KEY)}, hot)
    out = link_coverage(out, coverage, hot)
    return link.with_filtered_latest(out, vaccination, KEY, REGISTRY_KEY, "descripcion", "dosis", ROW, fixed.DOSE_PATTERNS, hot)


def entity_table(ledger: DataFrame, number: int) -> DataFrame:
    """One row per entity, with the corrected previous-event flag."""
    profile = entity_profile(ledger, KEY, ROW, entity_outputs(number))
    corrected = text.corrected_previous("IAE_PREVIO", "NUMERO_INTENTOS_")
    return profile.withColumn("IAE_PREVIO_CORREGIDO", corrected).withColumnRenamed(KEY, "CEDULA")


def coverage(entities: DataFrame, tables: Mapping[str, DataFrame | None]) -> DataFrame:
    """Entities with and without record in each registry, and registry rows without entity."""
    registries = {n: (t, REGISTRY_KEY) for n, t in tables.items() if n != "ledger" and t is not None}
    return link.coverage_report(entities, "CEDULA", registries)


def run(tables: Mapping[str, DataFrame], number: int) -> dict[str, DataFrame]:
    """Everything from the raw tables of a delivery: linked ledger, entity table, coverage.

    The linked ledger is stored, since each kind of profile column reads it again; so
    is the entity table, which every registry is compared with.
    """
    loaded = numbered(load_delivery(tables, number))
    ledger = stored(linked_ledger(loaded, number))
    entities = stored(entity_table(ledger, number))
    return {"ledger": ledger, "entities": entities, "coverage": coverage(entities, loaded)}
