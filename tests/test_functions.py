"""Column rules on hand-made edge values."""

import datetime as dt
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerline.functions import dates, fixed_values as fixed, text, values
from ledgerline.queries import QUERIES, SQL
from ledgerline.queries.registry import SCHEMAS

D = dt.datetime


def column(spark, data, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i int, c {kind}")
    return [r.x for r in df.select("i", expr.alias("x")).orderBy("i").collect()]


def test_method_labels(spark):
    cases = {
        "CA�DA DESDE ALTURA": "Caída", "AHORCAMIENTO Y FUEGO": "Ahorcamiento o asfixia", "ahorcamiento": "ahorcamiento",
        "ARMAS DE FUEGO": "Armas de fuego", "FUEGO": "Fuego", "EXPOSICI�N AL FR�O NATURAL": "Frío Natural", "otros": "Otros",
        "otros x": "otros x", "OBSTRUCCI�N DE LAS V�AS RESPIRATORIAS": "Ahorcamiento o asfixia", None: None, "": ""}
    assert column(spark, cases, text.method_label("c")) == list(cases.values())


def test_decisions_and_followups(spark):
    cases = {
        " RESUELTO ok": "RESUELTO", "PENDEINTE RESPUESTA": "PENDIENTE RESPUESTA", "PENDIENTE INTERNADO": "INTERNADO",
        "SIN RESPUESTA DEFINITIVA": "PENDIENTE RESPUESTA", "SIN RESPUESTA X": "SIN RESPUESTA X", " \t": "", None: None}
    assert column(spark, cases, text.decision_label("c")) == list(cases.values())
    follow = {"CASO DESCARTDO": "DESCARTADA_POR_RASTREADOR", "DECARTADA": "DESCARTADA_POR_RASTREADOR",
              "SEG PARTICULAR": "SEGUIMIENTO PARTICULAR", "SIN COBERTURA": "SIN COBERTURA ASISTENCIAL", None: None}
    assert column(spark, follow, text.followup_label("c")) == list(follow.values())
    assert column(spark, follow, text.followup_discarded(text.followup_label("c"))) == [True, True, False, False, False]
    assert column(spark, ["SUICIDIO", "otra", None], text.decision_category("c")) == ["SUICIDIO", "OTRA DECISION", "OTRA DECISION"]


def test_previous_flag(spark):
    cases = {" SI ": "SI", "En Tratamiento": "Tratamiento", "Sin dato": "NO SE INDICA", "  ": "NO SE INDICA", None: "NO SE INDICA"}
    assert column(spark, cases, text.previous_flag("c")) == list(cases.values())
    df = spark.createDataFrame([("NO SE INDICA", 1), ("NO SE INDICA", 2), ("NO", 5), (None, 3)], "f string, n int")
    assert [r[0] for r in df.select(text.corrected_previous("f", "n")).collect()] == ["NO SE INDICA", "SI", "NO", None]
    assert [r[0] for r in df.select(text.corrected_previous("f", "n", 0)).collect()] == ["SI", "SI", "NO", None]


def test_provider_classes(spark):
    cases = {"ASSE": "Pública", "FF.AA|X": "Pública|Privada", "FFXAA": "Privada", "No indicado": "No indicado", "NaN": "nan",
             "a|CLINICAS|": "Privada|Pública|Privada", None: None}
    assert column(spark, cases, text.provider_list_class("c")) == list(cases.values())
    labels = text.provider_list_class("c")
    assert column(spark, cases, text.has_class(labels, "Privada")) == [False, True, True, False, False, True, None]


def test_code_groups(spark):
    codes = ["X59", "X60", "X84", "X850", "Y39", "Y40", "Y87", "Y88", "V00", "W999", "x60", "X6A", "X6", None]
    assert column(spark, codes, text.code_in("c", fixed.CODES_INTENTIONAL)) == [0, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0]
    assert column(spark, codes, text.code_in("c", fixed.CODES_OTHER_EXTERNAL)) == [1, 0, 0, 1, 0, 1, 1, 0, 1, 1, 0, 0, 0, 0]
    assert column(spark, ["X809", "Z10", None], text.code_label("c")) == ["Salto", None, None]


def test_serial_dates(spark):
    data = ["45000", "45000.5", "19999", "20000", "SI", None, "2023-01-05", "1e5"]
    assert column(spark, data, dates.repair_serial_text("c")) == [
        "2023-03-15 00:00:00", "2023-03-15 12:00:00", "19999", "20000", "SI", None, "2023-01-05", "2173-10-14 00:00:00"]
    assert column(spark, ["2023-01-05", "05/01/2023", "x", None], dates.date_means_yes("c", "SI", ["dd/MM/yyyy"])) == ["SI", "SI", "x", None]
    assert column(spark, ["2023-01-05x", "31/02/2023"], dates.parse_date("c", ["dd/MM/yyyy"])) == [None, None]


def test_ages(spark):
    rows = [(D(2000, 2, 29), D(2001, 2, 28)), (D(2000, 2, 29), D(2001, 2, 27)), (D(1990, 12, 31), D(1991, 1, 1)), (None, D(2000, 1, 1))]
    df = spark.createDataFrame(rows, "b timestamp_ntz, a timestamp_ntz")
    got = df.select(dates.age_completed_years("b", "a"), dates.age_calendar_years("b", "a"), dates.elapsed_days("b", "a")).collect()
    assert [tuple(r) for r in got] == [(1, 1, 365.0), (0, 1, 364.0), (0, 1, 1.0), (None, None, None)]


def test_ages_before_birth_match_sql(spark, tmp_path):
    """Every pair of days around the ends of February over seven years, both ways round."""
    days = [D(y, m, d) for y in range(1995, 2002) for m, d in ((2, 27), (2, 28), (3, 1), (3, 31))] + [D(1996, 2, 29), D(2000, 2, 29)]
    orders = [(i, 1, "", 1.0, d, "") for i, d in enumerate(days)]
    lines = [(i, 1, 1, j, 1.0, 1.0, 1.0, 1.0, "", "", d) for i in range(len(days)) for j, d in enumerate(days)]
    spark.createDataFrame(orders, SCHEMAS["orders"]).write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(lines, SCHEMAS["lineitem"]).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    for name in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path / name}.parquet/*.parquet'")
    want = {(r[0], r[1]): r[2:] for r in con.execute(SQL["ages"]).fetchall()}
    got = {(r[0], r[1]): tuple(r[2:]) for r in QUERIES["ages"](spark, str(tmp_path)).collect()}
    assert got == want and len(got) == len(days) ** 2
    df = spark.createDataFrame([(D(1996, 2, 29), D(1995, 2, 28)), (D(1996, 2, 28), D(1995, 2, 28)), (D(1996, 3, 1), D(1996, 2, 29))], "b timestamp_ntz, a timestamp_ntz")
    assert [r[0] for r in df.select(dates.age_completed_years("b", "a")).collect()] == [-2, -1, -1]


def test_micros_match_python(spark):
    times = [D(1969, 12, 31, 23, 59, 59, 999999), D(1970, 1, 1), D(2024, 2, 29, 12, 30, 45, 123456), D(1899, 12, 30)]
    got = column(spark, times, dates.micros("c"), "timestamp_ntz")
    assert got == [int((t - D(1970, 1, 1)) / dt.timedelta(microseconds=1)) for t in times]


@pytest.mark.parametrize("top, want", [(100, None), (100.5, None), (103, 102.5), (104.5, 102.5)])
def test_bins(spark, top, want):
    df = spark.createDataFrame([(0.0,), (4.0,), (5.0,), (-1.0,), (None,), (float(top),)], "v double")
    got = [r.m for r in values.with_bin_midpoint(df, "v", "m", 5).collect()]
    assert got == [2.5, 2.5, 7.5, None, None, want]
    closed = [r.m for r in values.with_bin_midpoint(df, "v", "m", 5, closed_top=True).collect()]
    assert closed[-1] == 102.5


def test_bins_of_text(spark):
    df = spark.createDataFrame([("7",), ("sin dato",), (None,), ("11",)], "v string")
    assert [r.m for r in values.with_bin_midpoint(df, "v", "m", 5, coerce=True).collect()] == [7.5, None, None, 12.5]
    with pytest.raises(Exception):
        values.with_bin_midpoint(df, "v", "m", 5).collect()


def test_labels(spark):
    df = spark.createDataFrame([(29.5, 1), (30.0, 0), (None, None)], "MIN_DIAS_IAE_MUERTE_ double, CAT_SUI_ int")
    assert [r[0] for r in df.select(values.named_label("30dias")).collect()] == [True, False, False]
    assert [r[0] for r in df.select(values.named_label("CAT_SUI_")).collect()] == [True, False, False]
    with pytest.raises(ValueError, match="known"):
        values.named_label("otro")
    assert df.select(values.odds_ratio(F.lit(0.0))).first()[0] == math.exp(0)


def test_odd_cells_are_not_dates(spark):
    from pyspark.sql import functions as F

    from ledgerline.functions import dates

    cells = ["1e12", "45000d", "1e7", "19999", "1234", "15/03/2024", "45000", "99999999", " 45000.5 ", None]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    out = {r.c: r for r in df.select("c", dates.serial_to_date("c").cast("string").alias("serial"),
                                     dates.date_means_yes("c", formats=("dd/MM/yyyy",)).alias("yes")).collect()}
    assert {c for c in cells if out[c].serial} == {"45000", " 45000.5 "}
    assert {c for c in cells if out[c].yes == "SI"} == {"15/03/2024"}
    assert df.select(F.count("c")).first()[0] == 9
