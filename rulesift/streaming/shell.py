"""Validation as a stream. Judging an entry is local to its row, so the batch plan runs unchanged; what rolls up is keyed by batch.

``windowed_statuses`` on event times is an extension: the reference has no streams.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rulesift import schemas as S
from rulesift.operators import findings
from rulesift.plans.rulepack import RulePack


def validate_stream(entries: DataFrame, pack: RulePack) -> DataFrame:
    """Stateless: a streaming DataFrame of entries to one with findings and statuses."""
    return findings.validate(entries, pack)


def batches_to(entries: DataFrame, pack: RulePack, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Roll up each micro-batch's batches with ``foreachBatch``; the sink is called once for each epoch and must be idempotent by epoch."""

    def each(df: DataFrame, epoch: int) -> None:
        sink(findings.batch_status(findings.validate(df, pack)), epoch)

    return entries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def windowed_statuses(validated: DataFrame, time: str = "ts", late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """window, status, n: counts of statuses in event-time windows, with a watermark that bounds the state."""
    counted = validated.withWatermark(time, late).groupBy(F.window(time, size), "status").agg(F.count("*").alias("n"))
    return counted.select("window", "status", "n")


def severest_by_window(validated: DataFrame, time: str = "ts", late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    rolled = validated.withWatermark(time, late).groupBy(F.window(time, size)).agg(F.max(findings.severity(F.col("status"), S.OVERALL_STATUS)).alias("place"))
    return rolled.select("window", findings.by_severity(F.col("place"), S.OVERALL_STATUS).alias("status"))
