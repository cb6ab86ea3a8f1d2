"""The whole linkage on a small delivery."""

import datetime as dt

import pytest

from ledgerline.plans import linkage
from ledgerline.sources.tables import load_delivery

D = dt.datetime


def _ledger(spark, number):
    base = [
        # row, key, event, recorded, sex, birth, method, previous, provider, decision
        (0, "a", D(2023, 1, 10), D(2023, 1, 11), "F", D(1990, 6, 1), "AHORCAMIENTO X", " SI ", "ASSE A|MUTUAL", "RESUELTO hoy"),
        (1, "a", D(2023, 1, 10), D(2023, 1, 11), "F", D(1990, 6, 1), "AHORCAMIENTO X", " SI ", "ASSE A|MUTUAL", "RESUELTO hoy"),
        (2, "a", D(2023, 3, 1), None, "F", D(1990, 6, 1), "CA�DA", "Sin dato", "MUTUAL", None),
        (3, "b", None, D(2023, 2, 1), "M", D(1980, 1, 1), None, None, None, "INTERNADA"),
        (4, None, None, None, None, None, None, None, "X", None),
        (5, "c", D(2023, 5, 5), D(2023, 5, 5), "M", D(2000, 12, 31), "otros", "NO", "No indicado", "SUICIDIO"),
    ]
    if number == 1:
        names = ["row_no", "CEDULA", "FECHA IAE", "REGISTRO", "PERSONA", "NACIMIENTO", "METODO", "IAE PREVIO",
                 "PRESTADOR RECODIFICADO", "DECISIÓN", "EDAD"]
        rows = [(*r, 30) for r in base]
        types = "long string timestamp_ntz timestamp_ntz string timestamp_ntz string string string string int".split()
    else:
        names = ["row_no", "CEDULA", "FECHA IAE", "REGISTRO", "PERSONA", "FECHA NACIMIENTO", "METODO", "IAE PREVIO",
                 "PRESTADOR", "DECISION", *linkage.FOLLOWUP_COLUMNS]
        follow = {"CONCURRIO": {0: "45000", 2: " no ", 5: "si"}, "AGENDO CONSULTA ESM 7DIAS SI/NO/INTERNADO": {2: "Decartada", 5: "seg particular"}}
        rows = [(*r, *[follow.get(c, {}).get(0 if r[0] == 1 else r[0]) for c in linkage.FOLLOWUP_COLUMNS]) for r in base]
        types = "long string timestamp_ntz timestamp_ntz string timestamp_ntz string string string string".split() + ["string"] * 16
    return spark.createDataFrame(rows, ", ".join(f"`{n}` {t}" for n, t in zip(names, types)))


def _tables(spark, number):
    births = {c: None for c in linkage.BIRTH_FIELDS}
    rows = [{**births, "row_no": i, "cedula": k, "anio_mes_nacimiento_hijo": t, "nro_rese": g, "estado_civil": s} for i, (k, t, g, s) in enumerate([
        ("a", D(2015, 1, 1), "g1", "late"), ("a", D(2010, 1, 1), "g2", "first"), ("z", D(2015, 1, 1), "g1", "other"), ("a", D(2024, 1, 1), "c", "after")])]
    btypes = ", ".join(f"`{c}` {'timestamp_ntz' if c == 'anio_mes_nacimiento_hijo' else 'string'}" for c in linkage.BIRTH_FIELDS)
    births_df = spark.createDataFrame([(r["row_no"], *[r[c] for c in linkage.BIRTH_FIELDS]) for r in rows], "row_no long, " + btypes)
    deaths = spark.createDataFrame(
        [("a", D(2023, 3, 31), "X70", "Salto", 32, 33, "SUICIDIO", "casa"), ("q", D(2023, 1, 1), "W10", "Rivera", 50, 51, "OTRO", None)],
        "cedula string, fecha_defuncion timestamp_ntz, causa_basica_muerte_valor string, departamento_ocurrencia string,"
        " edad_fallecimiento_digitada int, edad_fallecimiento_calculada int, motivo_externo string, lugar_ocurrencia string")
    for c in ("estado_civil", "etnia", "mayor_nivel_educacion", "es_motivo_externo"):
        deaths = deaths.withColumn(c, linkage.F.lit(None).cast("string"))
    coverage = spark.createDataFrame(
        [(0, "a", "MUTUAL", "UY", "Salto", None, "Fonasa"), (1, "a", None, "UY", "Rivera", None, None), (2, "b", "ASSE", "UY", "Salto", "L", "No")],
        "row_no long, cedula string, prestador string, pais string, departamento string, localidad string, cobertura string")
    alerts = spark.createDataFrame([("c", "t"), ("x", None)], "cedula string, titulo string")
    vaccination = spark.createDataFrame(
        [(0, "a", "VACUNA COVID 19", "1"), (1, "a", "COVID 19 refuerzo", "2"), (2, "a", "COVID 19", None), (3, "b", "OTRA", "9")],
        "row_no long, cedula string, descripcion string, dosis string")
    stays = spark.createDataFrame(
        [(0, "a", "H1", "pub", D(2023, 1, 12), D(2023, 1, 20), "F32", "X60"), (1, "a", "H2", "priv", D(2023, 3, 9), None, "F33", None)],
        "row_no long, cedula string, `Institución` string, Sector string, `Fecha ingreso` timestamp_ntz, `Fecha Egreso` timestamp_ntz,"
        " `Diagnostico principal según CIE-10` string, `Causa externa según CIE-10` string")
    tables = {"IAE": _ledger(spark, number), "CDE": deaths, "CNV": births_df, "IAE_RUCAF": coverage, "SHARPS": alerts, "SIV": vaccination}
    return {**tables, "EH": stays} if number == 2 else tables


@pytest.mark.parametrize("number, outputs", [(1, 41), (2, 69)])
def test_entity_table(spark, number, outputs):
    out = linkage.run(_tables(spark, number), number)
    entities = out["entities"]
    # The key, the declared outputs, and the corrected flag.
    assert len(entities.columns) == outputs + 2
    got = {r["CEDULA"]: r for r in entities.collect()}
    assert set(got) == {"a", "b", "c"}
    a = got["a"]
    assert (a["Sexo"], a["NUMERO_INTENTOS_"], a["METODO_IAE_PREVIO_"], a["METODO_IAE_PREVIO_2_"], a["METODO_IAE_PREVIO_3_"]) == (
        "F", 2, "Caída", "Ahorcamiento o asfixia", None)
    assert (a["IAE_PREVIO"], a["IAE_PREVIO_CORREGIDO"]) == ("NO SE INDICA", "SI")
    assert a["DIAS_PROMEDIO_INTENTOS_"] == 50.0 and a["MIN_DIAS_IAE_MUERTE_"] == 30.0
    assert (a["IAE_en_CDE_"], a["CAT_SUI_"], a["CAT_MCEXSUI_"]) == (1, 1, 0)
    assert (a["CNV_"], a["CNV_ultimo_cant_hijos_"]) == (1, 2)
    assert (a["RUCAF_prestador"], a["RUCAF_departamento"], a["RUCAF_PRESTADOR_PUBLICO_"]) == ("MUTUAL", "Rivera", False)
    assert (a["SHARPS_"], a["SIV_"], a["COVID 19"], a["ANTIPOLIOMELITICA"]) == (0, 1, "2", None)
    assert got["b"]["ULTIMO_INTENTO_"] is None and got["b"]["IAE_PREVIO_CORREGIDO"] == "NO SE INDICA"
    assert got["c"]["SHARPS_"] == 1 and got["c"]["CAT_SUI_"] is None
    if number == 2:
        assert a["CNV_otro_progenitor_"] == "z" and a["CNV_ultimo_estado_civil_"] == "first"
        # One of a's births names ledger entity c.
        assert (a["CNV_nro_rese_in_IAE_"], got["c"]["CNV_nro_rese_in_IAE_"]) == (1, 0)
        assert a["MOTIVO_EXT_SUI_"] is True and got["c"]["MOTIVO_EXT_SUI_"] is False
        assert (a["CONCURRIO_"], a["NO_CONCURRIO_CONSULTA_"]) == ("NO", True)
        assert a[linkage.AGENDA_COLUMN] == "DESCARTADA_POR_RASTREADOR"
        assert got["c"][linkage.AGENDA_COLUMN] == "SEGUIMIENTO PARTICULAR"
    coverage = {r.registry: r for r in out["coverage"].collect()}
    assert (coverage["deaths"].entities_present, coverage["deaths"].entities_absent, coverage["deaths"].orphan_rows) == (1, 2, 1)
    assert (coverage["births"].entities_present, coverage["births"].orphan_rows) == (1, 1)


def test_ledger_rows(spark):
    ledger = linkage.linked_ledger(load_delivery(_tables(spark, 2), 2), 2)
    got = {r.row_no: r for r in ledger.collect()}
    # The copy and the nearly empty row are gone.
    assert sorted(got) == [0, 2, 3, 5]
    assert got[0]["CONCURRIO_binaria"] == "SI" and got[0]["CONCURRIO_"] == "2023-03-15 00:00:00"
    assert got[0]["EH_cercano_a_IAE_Institución"] == "H1"
    assert got[2]["EH_cercano_a_IAE_Institución"] is None
    assert got[0]["Tipo_prestador_IAE_"] == "Pública|Privada"
    assert (got[3]["CNV_cant_hijos_cuando_IAE"], got[3]["METODO_"], got[3]["DECISION_"]) == (0, "Otros", "INTERNADO")
    assert got[5]["EDAD_"] == 23 and got[5]["PRESTADOR_PUBLICO_"] is False


def test_files_give_the_row_order(spark, tmp_path):
    expected, split = linkage.run(_tables(spark, 2), 2), {}
    for name, table in _tables(spark, 2).items():
        rows = table.orderBy("row_no").collect() if "row_no" in table.columns else table.collect()
        # The first file is the smaller one, so a scan starts with the second.
        for part, some in (("1", rows[:1]), ("2", rows[1:])):
            data = spark.createDataFrame(some, table.schema).drop("row_no")
            data.coalesce(1).write.mode("append").parquet(str(tmp_path / name / part))
        split[name] = spark.read.parquet(*[str(tmp_path / name / part) for part in "21"])
    found = linkage.run(split, 2)
    for kind in ("entities", "coverage"):
        names = expected[kind].columns
        assert found[kind].columns == names
        assert found[kind].exceptAll(expected[kind]).count() == expected[kind].exceptAll(found[kind]).count() == 0


def test_duplicate_death_record_is_an_error(spark):
    tables = load_delivery(_tables(spark, 1), 1)
    tables["deaths"] = tables["deaths"].unionByName(tables["deaths"])
    with pytest.raises(Exception, match="not unique"):
        linkage.linked_ledger(tables, 1).collect()


def test_delivery_names(spark):
    tables = _tables(spark, 2)
    del tables["EH"]
    assert load_delivery(tables, 2)["stays"] is None
    with pytest.raises(ValueError, match="unknown delivery"):
        load_delivery(tables, 3)
    del tables["CDE"]
    with pytest.raises(KeyError):
        load_delivery(tables, 1)
