"""An extension: the species profile over files of reads as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from helixmill.operators.classify import classify_by_range
from helixmill.operators.species import species_bases


def stream_reads(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def stream_species_bases(reads: DataFrame, ranges: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Each batch is classified and summed; sums of batches are appended under ``out``."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        found = species_bases(classify_by_range(rows, ranges), filtered=False).withColumn("batch", F.lit(batch_id))
        found.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return reads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
