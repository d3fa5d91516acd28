"""An incremental audit as an extra: new documents are probed as they arrive, counts kept per detector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from overlapse.functions.text_keys import long_keys, with_keys


def watch(spark: SparkSession, folder: str, schema: str, queries: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Probes each batch of new rows of a folder against the queries' keys; hits are appended to `out`."""
    keys = long_keys(with_keys(queries.select("item_id", "text")), ["item_id"])

    def probe(batch: DataFrame, number: int) -> None:
        seen = long_keys(with_keys(batch.select("doc_id", "text")), ["doc_id"])
        seen.join(keys, ["detector", "key"]).select("doc_id", "item_id", "detector", F.lit(number).alias("batch")).write.mode("append").parquet(out)

    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(probe).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by event type in tumbling windows with a watermark; the same on a table and on a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
