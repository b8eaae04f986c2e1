"""Epidemic curves over a stream of events: counts by window and kind, with a watermark for late records."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.sources.scratch import shared_folder


def curve(events: DataFrame, when: str = "ts", step: str = "1 day", late: str = "1 day", status: str = "event_type") -> DataFrame:
    """Works on streams and on tables alike."""
    stamped = events.withColumn(when, F.col(when).cast("timestamp")).withWatermark(when, late)
    counts = stamped.groupBy(F.window(when, step).alias("w"), status).agg(F.count("*").alias("cases"))
    return counts.select(F.col("w.start").alias("bin"), F.col(status).alias("status"), "cases")


def run_to_end(spark: SparkSession, path: str, **options) -> DataFrame:
    """Reads what there is, a file or a folder of files, as a stream, and writes complete counts batch by batch to the shared folder; the last
    batch's are the result."""
    schema = spark.read.parquet(path).schema
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    # A stream watches a folder; of the folder of a single file it takes that file.
    reader = spark.readStream.schema(schema)
    stream = reader.parquet(path) if whole else reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    out = f"{shared_folder(spark)}/curve-{uuid.uuid4().hex}"
    last: list[int] = []

    def keep(counts: DataFrame, batch: int) -> None:
        counts.write.mode("overwrite").parquet(f"{out}/{batch}")
        last[:] = [batch]

    result = curve(stream, **options)
    query = result.writeStream.outputMode("complete").option("checkpointLocation", f"{out}/state").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/{last[0]}") if last else spark.createDataFrame([], result.schema)
