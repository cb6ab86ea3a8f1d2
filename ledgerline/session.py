"""Session settings the operators are designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Ledger-to-registry joins keep their skewed ledger side splittable even when
    # the split costs an extra exchange for the aggregate that follows.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# A group with more rows than this is split before a window runs over it.
HOT_GROUP_ROWS = "spark.ledgerline.hotGroupRows"
HOT_GROUP_ROWS_DEFAULT = 5_000_000


def build_session(app: str = "ledgerline", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the recommended settings; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def hot_group_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(HOT_GROUP_ROWS, str(HOT_GROUP_ROWS_DEFAULT)))
