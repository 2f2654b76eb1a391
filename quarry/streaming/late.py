"""Late rows of a stream, kept apart from those in time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split(path: str, ts: str, closes: Column, delay_seconds: float) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch that writes each batch's rows to `path`/rows/epoch=n with a column late, and its greatest time to
    `path`/marks/epoch=n. The watermark of a batch is the greatest time of all batches before it, less
    the delay; a row is late if what it belongs to (a window) closes at or before it: `closes` is a
    timestamp of the row. Times count in milliseconds, as watermarks do. Rows without a time are in
    time. A batch that is run again replaces what it wrote, so each row is written once."""

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        marks = f"{path}/marks"
        own = batch.agg(F.max(F.unix_millis(ts)).alias("mark"))
        own.write.mode("overwrite").parquet(f"{marks}/epoch={epoch}")
        before = spark.read.schema("mark long, epoch int").parquet(marks).where(F.col("epoch") < epoch).agg(F.max("mark")).first()[0]
        late = F.lit(False) if before is None else F.coalesce(F.unix_millis(closes) <= before - int(delay_seconds * 1000), F.lit(False))
        batch.withColumn("late", late).write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}")

    return run
