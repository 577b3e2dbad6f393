"""An extension: the census of records that arrive as files, one micro-batch at a time.

Documents arrive whole, so each micro-batch is complete for its documents and needs no state.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscope.operators import records as R


def watch(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = "doc_id bigint, pos int, kind string, text string, level int, media string") -> StreamingQuery:
    """Append the manifest of every document in Parquet files that arrive in ``source`` to ``target``, then stop."""

    def batch(df, epoch: int) -> None:
        classified = R.classify(df)
        found = R.census(classified).withColumn("problems", R.problems(F.col("captions"), F.col("referenced")))
        found.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    arriving = spark.readStream.schema(schema).parquet(source)
    return arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
