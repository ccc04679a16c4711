"""The text operators on streams.

The Arrow passes and column expressions hold no state, so they run on a stream
as they are (append mode). Plans with regrouping run on each micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pagelight.session import shared_dir


def stream_table(spark: SparkSession, folder: str, schema, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def run_available(stream: DataFrame, out: str, name: str) -> StreamingQuery:
    """Writes a stateless stream's rows as Parquet until what is there is done."""
    state = f"{shared_dir(stream.sparkSession)}/streams/{name}"
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()


def run_batches(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, name: str) -> StreamingQuery:
    """Runs a batch plan on each micro-batch. A batch that is run again replaces what it wrote before."""
    state = f"{shared_dir(stream.sparkSession)}/streams/{name}"

    def write(rows: DataFrame, number: int) -> None:
        transform(rows).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
