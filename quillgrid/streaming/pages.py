"""New pages are analysed as they arrive; a micro-batch goes through the same plan as a table."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Engine
from ..schemas import PAGES


def analyze_stream(spark: SparkSession, folder: str, engine: Engine, framework: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Parquet files of pages that arrive in folder; results are upserted by key, so a batch that runs again changes nothing."""
    pages = spark.readStream.schema(PAGES).parquet(folder)

    def take(batch, _number: int) -> None:
        if batch.take(1):
            engine.analyze(batch, framework)

    writer = pages.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
