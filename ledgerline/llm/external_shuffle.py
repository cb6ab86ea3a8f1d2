"""Sharding by a two-pass external shuffle, in DataFrame operations only.

The first pass scatters whole records uniformly into memory-sized buckets by a seeded
hash: one exchange, whose files are the external store. The second pass puts each bucket
in the order of a Fisher-Yates permutation of its own (the built-in ``shuffle`` of an
array of places) and cuts the sequence of buckets into shards whose row counts differ by
one at most. ``write_shards`` then writes a bucket's records from the task that holds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import shuffle_partitions

BUCKET_BYTES = 16 * 1024 * 1024
#: Buckets per partition at least: many small buckets fill the partitions evenly.
BUCKETS_PER_PARTITION = 8


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def _record_hash(docs: DataFrame, seed: int) -> Column:
    """Seeded hash of every column that can be hashed, so that rows of one id or one text scatter too."""
    return F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"])


def external_shuffle(docs: DataFrame, shards: int, seed: int = 0, text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Every row of ``docs`` with shard (0 to ``shards`` - 1) and slot (gapless from 0 in its shard).

    Columns of the input that are named shard or slot are replaced. A null text counts
    as empty; an empty table gives no rows; with fewer rows than shards the last shards
    are empty. Rows that are equal in every column share a bucket and may change places
    with each other; such a bucket is streamed through a sort that spills, and only its
    permutation (4 bytes a row) is held. The order depends on the rows, the seed and the
    number of buckets, not on how the input is stored.
    """
    spark = docs.sparkSession
    rows = docs.drop("shard", "slot")
    size = rows.agg(F.sum(record_size(F.col(f"`{text}`"))).alias("bytes")).first().bytes or 0
    parts = max(shuffle_partitions(spark), int(size // (bucket_bytes * BUCKETS_PER_PARTITION)) + 1)
    buckets = parts * BUCKETS_PER_PARTITION
    key, bucket = _record_hash(rows, seed), F.pmod(F.col("__key"), F.lit(buckets)).cast("int")

    counts = rows.select(key.alias("__key")).groupBy(bucket.alias("__bucket")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    placed = counts.withColumns({"__first": F.coalesce(F.sum("__n").over(before), F.lit(0)), "__total": F.sum("__n").over(Window.partitionBy())})
    orders = (placed.repartition(parts, "__bucket").sortWithinPartitions("__bucket")
              .withColumn("__order", F.shuffle(F.sequence(F.lit(0), (F.col("__n") - 1).cast("int")), seed)))

    scattered = rows.withColumn("__key", key).withColumn("__bucket", bucket).repartition(parts, "__bucket")
    tie = [F.col(f"`{c}`") for c in ("doc_id",) if c in rows.columns]
    drawn = scattered.withColumn("__row", F.row_number().over(Window.partitionBy("__bucket").orderBy("__key", *tie)))
    rank = F.col("__first") + F.element_at("__order", F.col("__row"))
    ranked = drawn.join(orders, "__bucket").withColumn("__rank", rank)
    shard, slot = _cut(F.col("__rank"), F.col("__total"), shards)
    return ranked.select(*[F.col(f"`{c}`") for c in rows.columns], shard.cast("int").alias("shard"), slot.alias("slot"))


def _cut(rank: Column, total: Column, shards: int) -> tuple[Column, Column]:
    """Shard and slot of a rank: the first shards have one row more where the rows do not divide evenly."""
    low, more = F.floor(total / shards), total % shards
    big = more * (low + 1)
    small = F.greatest(low, F.lit(1))
    shard = F.when(rank < big, F.floor(rank / (low + 1))).otherwise(more + F.floor((rank - big) / small))
    slot = F.when(rank < big, rank % (low + 1)).otherwise((rank - big) % small)
    return shard, slot.cast("long")


def write_shards(docs: DataFrame, path: str, shards: int, seed: int = 0, fmt: str = "parquet") -> None:
    """Write the shuffled records, a folder per shard, in the order of their slots within each file."""
    shuffled = external_shuffle(docs, shards, seed)
    shuffled.sortWithinPartitions("shard", "slot").write.partitionBy("shard").format(fmt).save(path)
