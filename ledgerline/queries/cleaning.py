"""Text rules, code groups, dates, ages and bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import dates, fixed_values as fixed, text, values
from ledgerline.operators import rows, stats
from ledgerline.queries.registry import Tables, query


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def case_sql(column: str, rules, exact=()) -> str:
    """CASE expression for an ordered rule list."""
    tests = [f"WHEN contains({column}, {quoted(p)}) THEN {quoted(label)}" for p, label in rules]
    tests += [f"WHEN {column} = {quoted(v)} THEN {quoted(label)}" for v, label in exact]
    return f"CASE {' '.join(tests)} ELSE {column} END"


def replace_sql(column: str, pairs) -> str:
    for old, new in pairs:
        column = f"replace({column}, {quoted(old)}, {quoted(new)})"
    return column


def pick(phrases: list[str | None], index: Column) -> Column:
    """A phrase per row, chosen by a number of the row."""
    return F.element_at(F.array(*[F.lit(p).cast("string") for p in phrases]), (index % len(phrases)).cast("int") + 1)


def pick_sql(phrases: list[str | None], index: str) -> str:
    listed = ", ".join("NULL" if p is None else quoted(p) for p in phrases)
    return f"([{listed}]::VARCHAR[])[({index} % {len(phrases)})::INT + 1]"


METHODS = [broken for broken, _ in fixed.ENCODING_REPAIRS] + [
    "X: AHORCAMIENTO Y FUEGO", "ARMAS DE FUEGO LARGAS", "Arma de fuego", "LESION AUTOINFLIGIDA", "FACTORES NO ESPECIFICADOS",
    "OBSTRUCCI�N NO ESPECIFICADA DE LA RESPIRACI�N", "OBSTRUCCI�N DE LAS V�AS RESPIRATORIAS", "AHOGAMIENTO Y SUMERSION",
    "CA�DA DE ALTURA", "ENVENENAMIENTO AUTOINFLIGIDO INTENCIONALMENTE POR GAS", "ENVENENAMIENTO ACCIDENTAL", "envenenamiento",
    "EVENTO NO ESPECIFICADO", "INHALACI�N DE CONTENIDOS G�STRICOS", "CORRIENTE EL�CTRICA", "EXPOSICI�N AL FR�O NATURAL", "otros",
    "Ingesta de Medicamentos", None,
]
_REPAIRED = replace_sql("m", fixed.ENCODING_REPAIRS)
_METHOD = case_sql("r", fixed.METHOD_RULES, fixed.METHOD_EXACT)


def parts_with(t: Tables, phrases: list[str | None], name: str) -> DataFrame:
    return t.part.select("p_partkey", "p_name", pick(phrases, F.col("p_partkey") + F.col("p_size")).alias(name))


def parts_sql(phrases: list[str | None], name: str) -> str:
    return f"SELECT p_partkey, p_name, {pick_sql(phrases, '(p_partkey + p_size)')} AS {name} FROM part"


@query(f"SELECT p_partkey, {_REPAIRED} AS repaired FROM ({parts_sql(METHODS, 'm')})")
def encoding_repair(t):
    return parts_with(t, METHODS, "m").select("p_partkey", text.replace_pairs("m", fixed.ENCODING_REPAIRS).alias("repaired"))


@query(f"""WITH l AS (SELECT p_partkey, {_METHOD} AS label FROM (SELECT p_partkey, {_REPAIRED} AS r FROM ({parts_sql(METHODS, 'm')})))
SELECT p_partkey, label, CASE WHEN label IN ({", ".join(map(quoted, fixed.METHOD_CATEGORIES))}) THEN label ELSE 'Otros' END AS category FROM l""")
def method_labels(t):
    labelled = parts_with(t, METHODS, "m").select("p_partkey", text.method_label("m").alias("label"))
    return labelled.withColumn("category", text.method_category("label"))


NAME_RULES = [("red", "Red part"), ("ring", "Any ring"), ("small", "Small part")]
NAME_EXACT = [("blue bolt", "Blue bolt")]


@query(f"SELECT p_partkey, {case_sql('p_name', NAME_RULES, NAME_EXACT)} AS label FROM part")
def rule_labels(t):
    return t.part.select("p_partkey", text.first_rule("p_name", NAME_RULES, NAME_EXACT).alias("label"))


DECISIONS = [
    " RESUELTO EN EL DIA ", "NO CUMPLE CON EL PROTOCOLO", "SUICIDIO ", "INTERNADA", "PENDIENTE INTERNADO", "PENDIENTE RESPUESTA X",
    "PENDEINTE RESPUESTA", "SIN RESPUESTA DEFINITIVA", " SIN RESPUESTA", "DESCARTDO", "DECARTADA POR X", "SIN COBERTURA MEDICA",
    "SEG PARTICULAR", "sin dato", None,
]
_DECISION = case_sql("trim(d)", fixed.DECISION_RULES, fixed.DECISION_EXACT)
_FOLLOWUP = case_sql("f", fixed.FOLLOWUP_RULES, fixed.FOLLOWUP_EXACT)


@query(f"""SELECT p_partkey, {_DECISION} AS label, CASE WHEN {_DECISION} IN ({", ".join(map(quoted, fixed.DECISION_CATEGORIES))})
 THEN {_DECISION} ELSE 'OTRA DECISION' END AS category FROM ({parts_sql(DECISIONS, 'd')})""")
def decision_labels(t):
    labelled = parts_with(t, DECISIONS, "d").select("p_partkey", text.decision_label("d").alias("label"))
    return labelled.withColumn("category", text.decision_category("label"))


@query(f"""WITH f AS (SELECT p_partkey, {replace_sql(_DECISION, fixed.FOLLOWUP_TYPOS)} AS f FROM ({parts_sql(DECISIONS, 'd')}))
SELECT p_partkey, {_FOLLOWUP} AS label, coalesce({_FOLLOWUP} = 'DESCARTADA_POR_RASTREADOR', false) AS discarded FROM f""")
def followup_labels(t):
    labelled = parts_with(t, DECISIONS, "d").select("p_partkey", text.followup_label("d").alias("label"))
    return labelled.withColumn("discarded", text.followup_discarded("label"))


PREVIOUS = ["SI", " NO ", "En Tratamiento psicologico", "Sin dato", "  ", "NO SE INDICA", None]


@query(f"""WITH p AS (SELECT p_partkey, trim(v) AS v FROM ({parts_sql(PREVIOUS, 'v')}))
SELECT p_partkey, CASE WHEN contains(v, 'Tratamiento') THEN 'Tratamiento' WHEN v IS NULL OR v IN ('Sin dato', '') THEN 'NO SE INDICA'
 ELSE v END AS flag FROM p""")
def previous_flags(t):
    return parts_with(t, PREVIOUS, "v").select("p_partkey", text.previous_flag("v").alias("flag"))


@query("SELECT DISTINCT p_name FROM part WHERE contains(p_name, 'ring')")
def matching_values(t):
    return stats.values_containing(t.part, "p_name", "ring")


@query("SELECT p_partkey, upper(trim(p_name)) AS p_name, upper(trim(' ' || p_type || ' ')) AS p_type FROM part")
def trim_upper(t):
    padded = t.part.select("p_partkey", "p_name", F.concat(F.lit(" "), "p_type", F.lit(" ")).alias("p_type"))
    return padded.withColumns({c: text.upper_trimmed(c) for c in ("p_name", "p_type")})


PROVIDERS = ["ASSE MONTEVIDEO", "SANIDAD POLICIAL|MUTUALISTA A", "MUTUALISTA B", "FF.AA", "FFXAA|HOSPITAL DE CLINICAS|MUTUALISTA C",
             "No indicado", "FUERZAS ARMADAS", None]


def class_sql(c: str) -> str:
    marks = " OR ".join(f"contains({c}, {quoted(m)})" for m in fixed.PUBLIC_MARKS)
    return f"CASE WHEN {marks} THEN 'Pública' ELSE 'Privada' END"


_LIST_CLASS = f"""CASE WHEN v IS NULL OR v = 'No indicado' THEN v ELSE
 array_to_string(list_transform(string_split(v, '|'), lambda x: {class_sql('x')}), '|') END"""


@query(f"""WITH c AS (SELECT p_partkey, {_LIST_CLASS} AS label FROM ({parts_sql(PROVIDERS, 'v')}))
SELECT p_partkey, label, contains(label, 'Pública') AS has_public, contains(label, 'Privada') AS has_private FROM c""")
def multivalue_class(t):
    labelled = parts_with(t, PROVIDERS, "v").select("p_partkey", text.provider_list_class("v").alias("label"))
    return labelled.withColumns({"has_public": text.has_class("label", "Pública"), "has_private": text.has_class("label", "Privada")})


@query("""SELECT p_partkey, CASE WHEN p_brand IN ('Brand#1') THEN 'Otro' WHEN p_brand IN ('Brand#2', 'Brand#3') THEN 'Publica'
 ELSE 'Privada' END AS by_name, CASE WHEN p_name = 'No indicado' THEN p_name WHEN contains(p_name, 'red') THEN 'Publica' ELSE 'Privada' END
 AS by_mark FROM part""")
def exact_class(t):
    return t.part.select("p_partkey", text.provider_class_by_name("p_brand", ["Brand#2", "Brand#3"], ["Brand#1"]).alias("by_name"),
                         text.provider_class_by_mark("p_name", "red").alias("by_mark"))


_CODE = "([ 'V', 'W', 'X', 'Y', 'x', NULL ])[(p_partkey % 6)::INT + 1] || lpad((p_partkey % 101)::VARCHAR, 2, '0') || p_size::VARCHAR"


def code_sql(ranges) -> str:
    tests = " OR ".join(f"(letter = '{a}' AND number BETWEEN {lo} AND {hi})" for a, lo, hi in ranges)
    return f"coalesce({tests}, false)::INT"


@query(f"""WITH c AS (SELECT p_partkey, {_CODE} AS code FROM part),
 d AS (SELECT *, substr(code, 1, 1) AS letter, substr(code, 2, 2)::INT AS number FROM c),
 l(k, label) AS (VALUES {", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in fixed.CODE_LABELS.items())})
SELECT p_partkey, code, {code_sql(fixed.CODES_INTENTIONAL)} AS intentional, {code_sql(fixed.CODES_OTHER_EXTERNAL)} AS other_external, label
FROM d LEFT JOIN l ON k = substr(code, 1, 3)""")
def code_category(t):
    letter = pick(["V", "W", "X", "Y", "x", None], F.col("p_partkey"))
    number = (F.col("p_partkey") % 101).cast("string")
    # Numbers of three digits are cut to two, as lpad does.
    code = F.concat(letter, F.lpad(number, 2, "0"), F.col("p_size").cast("string"))
    coded = t.part.select("p_partkey", code.alias("code"))
    return coded.select("p_partkey", "code", text.code_in("code", fixed.CODES_INTENTIONAL).alias("intentional"),
                        text.code_in("code", fixed.CODES_OTHER_EXTERNAL).alias("other_external"), text.code_label("code").alias("label"))


def mixed_dates(t: Tables) -> DataFrame:
    """Order dates as day numbers, ISO text, slashed text, other text or missing, by priority."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date"))
    p, price = F.substring("o_orderpriority", 1, 1), F.col("o_totalprice")
    return t.orders.select(
        "o_orderkey",
        F.when(p == "1", day.cast("string")).when(p == "2", F.concat(day.cast("string"), F.lit(".5")))
        .when(p == "3", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
        .when((p == "4") & (price < 250000), F.date_format("o_orderdate", "dd/MM/yyyy"))
        .when(p == "4", F.lit("NO")).when(price < 250000, F.lit("19999")).alias("raw"))


MIXED_SQL = """SELECT o_orderkey, CASE WHEN o_orderpriority[1] = '1' THEN (o_orderdate::DATE - DATE '1899-12-30')::VARCHAR
 WHEN o_orderpriority[1] = '2' THEN (o_orderdate::DATE - DATE '1899-12-30')::VARCHAR || '.5'
 WHEN o_orderpriority[1] = '3' THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
 WHEN o_orderpriority[1] = '4' AND o_totalprice < 250000 THEN strftime(o_orderdate, '%d/%m/%Y')
 WHEN o_orderpriority[1] = '4' THEN 'NO' WHEN o_totalprice < 250000 THEN '19999' END AS raw FROM orders"""
REPAIR_SQL = f"""SELECT o_orderkey, raw, CASE WHEN try_cast(raw AS DOUBLE) > 20000 THEN
 strftime(make_timestamp(epoch_us(TIMESTAMP '1899-12-30') + (try_cast(raw AS DOUBLE) * 86400)::BIGINT * 1000000), '%Y-%m-%d %H:%M:%S') ELSE raw END AS repaired
 FROM ({MIXED_SQL})"""


@query(REPAIR_SQL)
def date_repair(t):
    return mixed_dates(t).withColumn("repaired", dates.repair_serial_text("raw"))


@query(f"SELECT count(*) FILTER (raw IS DISTINCT FROM repaired) AS changed FROM ({REPAIR_SQL})")
def date_repair_report(t):
    repaired = mixed_dates(t).withColumn("repaired", dates.repair_serial_text("raw"))
    return repaired.agg(rows.changed_cells("raw", "repaired").alias("changed"))


_PARSED = "coalesce(try_strptime(repaired, '%d/%m/%Y'), try_strptime(repaired, '%Y-%m-%d %H:%M:%S'))"


@query(f"""SELECT o_orderkey, strftime({_PARSED}, '%Y-%m-%d %H:%M:%S') AS parsed,
 CASE WHEN {_PARSED} IS NOT NULL THEN 'SI' ELSE repaired END AS attended, coalesce(repaired = 'NO', false) AS refused FROM ({REPAIR_SQL})""")
def date_or_text(t):
    formats = ["dd/MM/yyyy", "yyyy-MM-dd HH:mm:ss"]
    repaired = mixed_dates(t).select("o_orderkey", dates.repair_serial_text("raw").alias("r"))
    return repaired.select(
        "o_orderkey", F.date_format(dates.parse_date("r", formats), "yyyy-MM-dd HH:mm:ss").alias("parsed"),
        dates.date_means_yes("r", "SI", formats).alias("attended"),
        F.col("r").eqNullSafe("NO").alias("refused"))


@query("""SELECT l_orderkey, l_linenumber, year(l_shipdate)::INT - year(o_orderdate)::INT AS by_year,
 (CASE WHEN l_shipdate >= o_orderdate THEN datesub('year', o_orderdate, l_shipdate)
  ELSE -CASE WHEN o_orderdate > l_shipdate + to_years(datesub('year', l_shipdate, o_orderdate)::INT) THEN datesub('year', l_shipdate, o_orderdate) + 1
   ELSE datesub('year', l_shipdate, o_orderdate) END END)::INT AS completed,
 round(date_diff('day', o_orderdate, l_shipdate) / 365.0, 9) AS over_365
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def ages(t):
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("l_orderkey", "l_linenumber", dates.age_calendar_years("o_orderdate", "l_shipdate").alias("by_year"),
                         dates.age_completed_years("o_orderdate", "l_shipdate").alias("completed"),
                         F.round(dates.age_days_over_365("o_orderdate", "l_shipdate"), 9).alias("over_365"))


@query("""WITH m AS (SELECT max(p_size) AS hi FROM part), e AS (SELECT ceil((hi + 5) / 5.0) * 5 - 5 AS edge FROM m)
SELECT p_partkey, CASE WHEN p_size < edge THEN floor(p_size / 5.0)::DOUBLE * 5 + 2.5 END AS size_group FROM part, e""")
def bin_midpoint(t):
    return values.with_bin_midpoint(t.part, "p_size", "size_group", 5).select("p_partkey", "size_group")
