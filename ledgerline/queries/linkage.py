"""The whole linkage, on a delivery made of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.plans import linkage
from ledgerline.queries.cleaning import DECISIONS, METHODS, PREVIOUS, PROVIDERS, _METHOD, _REPAIRED, pick, pick_sql
from ledgerline.queries.registry import Tables, query


def delivery(t: Tables) -> dict[str, DataFrame]:
    """Orders as the ledger, customers and suppliers as registries, with the names of the first delivery."""
    o, c = t.orders, t.customer
    n, key = F.col("o_orderkey"), F.col("o_custkey").cast("string").alias("CEDULA")
    row, cedula = n.alias("row_no"), F.col("o_custkey").cast("string").alias("cedula")
    ledger = o.select(
        row, n.alias("ID"), key, F.col("o_orderdate").alias("FECHA IAE"), F.col("o_orderdate").alias("REGISTRO"),
        F.col("o_orderstatus").alias("PERSONA"), F.lit("1970-01-01").cast("timestamp_ntz").alias("NACIMIENTO"),
        pick(METHODS, n).alias("METODO"), pick(PREVIOUS, n).alias("IAE PREVIO"), pick(PROVIDERS, n).alias("PRESTADOR RECODIFICADO"),
        pick(DECISIONS, n).alias("DECISIÓN"), (F.year("o_orderdate") - 1970).alias("EDAD"))
    ck = F.col("c_custkey").cast("string").alias("cedula")
    code = F.concat(F.lit("X"), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"))
    deaths = c.filter(F.col("c_acctbal") < 1000).select(
        ck, F.lit("2002-01-01").cast("timestamp_ntz").alias("fecha_defuncion"), code.alias("causa_basica_muerte_valor"),
        F.col("c_mktsegment").alias("departamento_ocurrencia"), F.lit(40).alias("edad_fallecimiento_digitada"),
        (F.col("c_custkey") % 90).cast("int").alias("edad_fallecimiento_calculada"))
    births = o.filter(F.col("o_orderpriority") == "2-HIGH").select(
        row, cedula, F.col("o_orderdate").alias("anio_mes_nacimiento_hijo"), n.cast("string").alias("nro_rese"))
    coverage = c.filter(F.col("c_acctbal") > 3000).select(
        F.col("c_custkey").alias("row_no"), ck, pick(PROVIDERS, F.col("c_custkey")).alias("prestador"), F.lit("UY").alias("pais"),
        F.col("c_mktsegment").alias("departamento"), F.lit(None).cast("string").alias("localidad"),
        F.lit(None).cast("string").alias("cobertura"))
    alerts = t.supplier.select(F.col("s_suppkey").cast("string").alias("cedula"), F.col("s_name").alias("titulo"))
    vaccination = o.select(row, cedula, F.when(F.col("o_orderstatus") == "F", F.lit("VACUNA COVID 19")).otherwise(F.lit("OTRA"))
                           .alias("descripcion"), F.col("o_orderpriority").alias("dosis"))
    return {"IAE": ledger, "CDE": deaths, "CNV": births, "IAE_RUCAF": coverage, "SHARPS": alerts, "SIV": vaccination}


@query(f"""WITH m AS (SELECT o_orderkey, o_custkey, o_orderdate, {pick_sql(METHODS, "o_orderkey")} AS m, trim({pick_sql(PREVIOUS, "o_orderkey")}) AS v FROM orders),
 r AS (SELECT *, {_REPAIRED} AS r FROM m),
 l AS (SELECT *, {_METHOD} AS label, CASE WHEN contains(v, 'Tratamiento') THEN 'Tratamiento' WHEN v IS NULL OR v IN ('Sin dato', '')
   THEN 'NO SE INDICA' ELSE v END AS flag, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM r),
 c AS (SELECT *, CASE WHEN label IN ('Ingesta de Medicamentos', 'Ahorcamiento o asfixia', 'Lesiones autoinfligidas', 'Armas de fuego', 'Caída')
   THEN label ELSE 'Otros' END AS category FROM l),
 b AS (SELECT o_custkey, o_orderdate FROM orders WHERE o_orderpriority = '2-HIGH'),
 d AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL),
 f AS (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o DESC) AS rn FROM d),
 n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey),
 x AS (SELECT c_custkey, c_acctbal, c_mktsegment, (c_custkey % 100 BETWEEN 60 AND 84)::INT AS code FROM customer)
SELECT n.o_custkey::VARCHAR AS "CEDULA", n AS "NUMERO_INTENTOS_", c1.category AS "METODO_IAE_PREVIO_", c2.category AS "METODO_IAE_PREVIO_2_",
 CASE WHEN c1.flag = 'NO SE INDICA' AND n > 1 THEN 'SI' ELSE c1.flag END AS "IAE_PREVIO_CORREGIDO",
 (c_acctbal < 1000)::INT AS "IAE_en_CDE_", CASE WHEN c_acctbal < 1000 THEN code END AS "CAT_SUI_",
 (n.o_custkey IN (SELECT o_custkey FROM b))::INT AS "CNV_",
 (SELECT count(*) FROM b WHERE b.o_custkey = n.o_custkey AND b.o_orderdate < c1.o_orderdate) AS "CNV_ultimo_cant_hijos_",
 CASE WHEN c_acctbal > 3000 THEN c_mktsegment END AS "RUCAF_departamento",
 (n.o_custkey IN (SELECT s_suppkey FROM supplier))::INT AS "SHARPS_", 1 AS "SIV_", f.o_orderpriority AS "COVID 19"
FROM n JOIN c c1 ON c1.o_custkey = n.o_custkey AND c1.rn = 1 LEFT JOIN c c2 ON c2.o_custkey = n.o_custkey AND c2.rn = 2
JOIN x ON c_custkey = n.o_custkey LEFT JOIN f ON f.o_custkey = n.o_custkey AND f.rn = 1""")
def entity_table(t):
    out = linkage.run(delivery(t), 1)["entities"]
    return out.select("CEDULA", "NUMERO_INTENTOS_", "METODO_IAE_PREVIO_", "METODO_IAE_PREVIO_2_", "IAE_PREVIO_CORREGIDO", "IAE_en_CDE_",
                      "CAT_SUI_", "CNV_", "CNV_ultimo_cant_hijos_", "RUCAF_departamento", "SHARPS_", "SIV_", "`COVID 19`")
