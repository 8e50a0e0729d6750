"""Restoration of a stream of lines, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def restore_stream(lines: DataFrame, restorer, path: str, checkpoint: str, *, text_col: str = "value") -> StreamingQuery:
    """Writes (text, restored) Parquet for every micro-batch; batch numbers in the path make a retried batch overwrite itself."""

    def each(batch: DataFrame, number: int) -> None:
        rows = batch.where(F.trim(F.col(text_col)) != "").select(F.monotonically_increasing_id().alias("id"), F.col(text_col).alias("text"))
        restorer.transform(rows).select("text", "restored").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
