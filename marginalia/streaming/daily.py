"""Pick up what arrived since the last run and insert it if absent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marginalia.sources.tables import append_new


def poll_new_records(
    spark: SparkSession, inbox: str, schema: str, table: str, checkpoint: str, order: str, key: str = "key"
) -> StreamingQuery:
    """Read the Parquet files that are new in `inbox` and append unseen keys to `table`.

    The query takes everything available and stops, so that a daily job can start it; the
    checkpoint remembers which files were read. Of several rows of a key the first by `order` is kept. A batch that is replayed after a failure finds
    its keys in the table and adds nothing.
    """

    def insert(batch: DataFrame, _batch_id: int) -> None:
        append_new(spark, table, batch, key, F.col(order))

    return (
        spark.readStream.schema(schema)
        .parquet(inbox)
        .writeStream.foreachBatch(insert)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def poll_with_state(
    spark: SparkSession, inbox: str, schema: str, table: str, checkpoint: str, time: str, delay: str, key: str = "key"
) -> StreamingQuery:
    """The same for long-lived tables: keys are remembered as state that expires, and the table is not read.

    `time` is the event time of a row. A key is known for `delay` after its first row, by the watermark; rows that
    come later than that are too late and are left out, as are rows without a key. Files that were read and keys that
    are known are in the checkpoint, and the table's files are committed with it, so a replay adds nothing.
    """
    rows = spark.readStream.schema(schema).parquet(inbox).where(F.col(key).isNotNull())
    return (
        rows.withWatermark(time, delay)
        .dropDuplicatesWithinWatermark([key])
        .writeStream.format("parquet")
        .option("path", table)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
