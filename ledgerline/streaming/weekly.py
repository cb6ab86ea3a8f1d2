"""Weekly counts of an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weekly_counts_stream(events: DataFrame, time: str, delay: str = "7 days", label: str = "week_end") -> DataFrame:
    """Rows per week labelled by its Sunday, emitted once the watermark has passed the week.

    Windows start on Mondays: 1970-01-01 was a Thursday, hence the four days. State is
    one count per open week.
    """
    late = events.filter(F.col(time).isNotNull()).withWatermark(time, delay)
    weeks = late.groupBy(F.window(time, "7 days", startTime="4 days")).agg(F.count(F.lit(1)).alias("n"))
    return weeks.select(F.date_sub(F.col("window.end").cast("date"), 1).alias(label), "n")
