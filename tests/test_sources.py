"""Tables, sinks and specifications."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerline.sources import spec
from ledgerline.sources.shared import stored
from ledgerline.sources.tables import provider_table, read_table, read_tables, stamped_name, with_row_order, write_table


def test_directory_of_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", text\nwith lines'), (2, None)], "i int, t string")
    write_table(df, str(tmp_path / "one.csv"), "csv")
    write_table(df, str(tmp_path / "two.parquet"))
    tables = read_tables(spark, str(tmp_path), {"one": "i int, t string"}, multiline=True)
    assert set(tables) == {"one", "two"}
    for t in tables.values():
        assert sorted(map(tuple, t.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(Exception):
        write_table(df, str(tmp_path / "two.parquet"))
    with pytest.raises(ValueError, match="unsupported format"):
        write_table(df, str(tmp_path / "x"), "xlsx")
    assert read_table(spark, str(tmp_path / "two.parquet")).count() == 2


def test_arrays_need_parquet(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0])], "i int, v array<double>")
    with pytest.raises(Exception):
        write_table(df, str(tmp_path / "a"), "csv")
    assert stored(df).first().v == [1.0]


def test_names_and_order(spark):
    assert stamped_name("IAE_agregada", 2, dt.datetime(2026, 4, 23, 6, 15, 49)) == "IAE_agregada_entrega2_2026-04-23_06-15-49"
    df = with_row_order(spark.createDataFrame([(c,) for c in "xyz"], "c string").coalesce(1))
    assert [r.c for r in df.orderBy("row_no").collect()] == list("xyz")


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_row_order_is_file_order(spark, tmp_path, fmt):
    for name, start, end in (("a", 0, 5), ("b", 5, 20_000), ("c", 20_000, 20_003)):
        spark.range(start, end, 1, 1).write.format(fmt).option("header", True).save(str(tmp_path / name))
    files = [next((tmp_path / name).glob(f"part-*.{fmt}")) for name in "abc"]
    for name, f in zip("abc", files):
        f.rename(tmp_path / f"{name}.{fmt}")
    paths = [str(tmp_path / f"{name}.{fmt}") for name in "cba"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = spark.read.schema("id long").option("header", True).format(fmt).load(paths)
        got = [r.key for r in stored(with_row_order(df.withColumnRenamed("id", "key"))).orderBy("row_no").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == list(range(20_003))


def test_provider_table(spark):
    df = spark.createDataFrame([("ASSE",), ("ASSE",), ("No indicado",), (None,), ("B|ASSE",)], "p string")
    got = {r.p: r.provider_class for r in provider_table(df, "p").collect()}
    assert got == {"ASSE": "Pública", "No indicado": "No indicado", None: "nan", "B|ASSE": "Privada|Pública"}


def test_spec_round_trip(tmp_path):
    e = spec.from_dict({"data": {"entrega": 2, "filepath": "x.csv", "num_features": ["a"], "cat_features": None, "target": "y"},
                        "experiment": {"seed": 7}, "filtros": ["f"]})
    spec.save_spec(e, str(tmp_path / "s.yaml"))
    assert spec.load_spec(str(tmp_path / "s.yaml")) == e and e.seed == 7 and e.filters == ["f"]
