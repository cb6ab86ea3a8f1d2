"""The streamed weekly counts and last records equal the batch ones."""

import datetime as dt
import random

from ledgerline.operators.asof import asof_last
from ledgerline.operators.stats import weekly_counts
from ledgerline.streaming.asof import asof_last_stream
from ledgerline.streaming.weekly import weekly_counts_stream


def test_weeks_of_a_stream(spark, tmp_path):
    days = [0, 0, 1, 6, 7, 8, 20, 21, 21, 60]
    df = spark.createDataFrame([(dt.datetime(2023, 1, 1) + dt.timedelta(days=d),) for d in days], "t timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = weekly_counts_stream(spark.readStream.schema("t timestamp").parquet(str(tmp_path / "in")), "t", "1 day")
    run = (stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
           .trigger(availableNow=True).start(str(tmp_path / "out")))
    run.awaitTermination(120)
    got = {r.week_end: r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.week_end: r.n for r in weekly_counts(df, "t").collect() if r.n}
    # The last week stays open: nothing later has moved the watermark past it.
    del want[max(want)]
    assert got == want


def test_last_records_of_two_streams_equal_the_batch_after_a_restart(spark, tmp_path):
    rng = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    at = lambda low, high: start + dt.timedelta(seconds=rng.randrange(low, high), microseconds=rng.randrange(3))
    keys = ["a", "b", "c", None]
    schemas = {"events": "e long, k string, t timestamp, v double", "records": "n long, k string, t timestamp, w double, s string"}
    events, records, late = [], [], []
    sides = {}
    for part in range(4):  # each part covers its day and a little of the day before
        low, high = part * 86400 - (3000 if part else 0), (part + 1) * 86400
        es = [(part * 1000 + i, rng.choice(keys), at(low, high) if rng.random() > 0.05 else None, rng.random()) for i in range(60)]
        rs = [(part * 1000 + i, rng.choice(keys), at(low, high), rng.random(), rng.choice(["x", None])) for i in range(60)]
        rs += [(part * 1000 + 900, "a", es[0][2] or start, 0.5, "tie")]
        if part == 3:  # far later than the watermark
            late += [(99999, "a", start, 0.0, "late")]
        events, records = events + es, records + rs
        sides[part] = (es, rs + (late if part == 3 else []))

    def read(name):
        return spark.readStream.schema(schemas[name]).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))

    def run():
        found = asof_last_stream(read("events"), read("records"), "k", "t", "t", ["w", "s"], "n", "2 hours")
        query = (found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp2"))
                 .trigger(availableNow=True).start(str(tmp_path / "out2")))
        query.awaitTermination(240)
        assert query.exception() is None

    for part in range(4):
        for name, rows in zip(("events", "records"), sides[part]):
            spark.createDataFrame(rows, schemas[name]).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        run()  # each part after a stop and a start from the checkpoint
    end = [(10 ** 6, "zzz", start + dt.timedelta(days=9), 0.0)]
    spark.createDataFrame(end, schemas["events"]).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    spark.createDataFrame([(10 ** 6, "zzz", start + dt.timedelta(days=9), 0.0, None)], schemas["records"]).coalesce(1).write.mode("append").parquet(str(tmp_path / "records"))
    run()
    got = sorted((r.e, r.k, r.t, r.v, r.last_w, r.last_s) for r in spark.read.parquet(str(tmp_path / "out2")).collect())
    batch = asof_last(spark.createDataFrame(events, schemas["events"]), spark.createDataFrame(records, schemas["records"]), "k", "t", "t", ["w", "s"], "n")
    want = sorted((r.e, r.k, r.t, r.v, r.last_w, r.last_s) for r in batch.collect() if r.k is not None and r.t is not None)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert got == want
