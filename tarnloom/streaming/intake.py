"""Structured Streaming intake of annotation rows.

Deliveries are files that appear in a folder. Each micro-batch is cleaned and
appended under its batch number, so a batch that is run again after a failure
replaces its own files: every row arrives exactly once. Rows whose id an
earlier batch appended are dropped, however late they come; a row that is late
but new is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.catalog import SCHEMAS


def follow(spark: SparkSession, folder: str, target: str, checkpoint: str, table: str = "cls_annotations", once: bool = False):
    """Starts the query; ``once`` takes what is there and ends."""
    rows = spark.readStream.schema(SCHEMAS[table] + ", delivered_at timestamp").option("recursiveFileLookup", "true").parquet(folder)
    fresh = rows.where("id is not null")

    def append(batch: DataFrame, number: int) -> None:
        new, path = batch.dropDuplicates(["id"]), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            taken = batch.sparkSession.read.schema("id long, intake long").parquet(target).where(F.col("intake") < number)
            new = new.join(taken.select("id"), "id", "left_anti").select(batch.columns)
        score = F.when(~F.isnan("score"), F.col("score"))
        # a box without a score has none; a classification without one says nothing for its category
        clean = new.withColumn("score", score if table == "det_annotations" else F.coalesce(score, F.lit(0.0)))
        clean.write.mode("overwrite").parquet(f"{target}/intake={number}")

    writer = fresh.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
