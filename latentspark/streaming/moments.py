"""Moment blocks of a stream: additive, so each micro-batch adds its own block.

Sums are taken around the means of the first batch that has rows, so large means cost no digits. Blocks are written once for each batch id; a batch that is
run again after a failure replaces its own block. When the stream's available rows are done, their blocks are added to the sum of all before, so each call reads one
sum and the blocks of its own batches, however long the stream has run.
"""

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latentspark.errors import DimensionMismatch
from latentspark.operators.moments import Moments, adding, set_blocks
from latentspark.operators.rowwise import column_means, merged
from latentspark.sources.frame import Frame


def _rows(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """What was written to the folder; None where nothing was, or the writing was broken off."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    there = done.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(done)
    return spark.read.schema(schema).parquet(path) if there else None


def _latest(spark: SparkSession, blocks: str) -> tuple[int, DataFrame | None]:
    """The last batch in the newest sum of batches, and that sum."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{blocks}/sums")
    files = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    ends = [int(f.getPath().getName()) for f in files.listStatus(root)] if files.exists(root) else []
    for end in sorted(ends, reverse=True):
        rows = _rows(spark, f"{blocks}/sums/{end}", "block array<double>")
        if rows is not None:
            return end, rows
    return -1, None


def stream_totals(frame: Frame, blocks: str, checkpoint: str) -> tuple[np.ndarray, Moments]:
    """Runs the stream's available rows and returns the centre of the sums (x, then y) and the moments, around it, of all rows seen so far.

    frame: as `feature_frame` makes it from a streaming DataFrame. blocks: a folder for the centre, a block a batch and their sums."""
    spark, size = frame.rows.sparkSession, frame.d + frame.q

    def centre() -> np.ndarray | None:
        rows = _rows(spark, f"{blocks}/centre", "centre array<double>")
        return None if rows is None else np.array(rows.first()["centre"])

    def keep(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        mine, around = frame.with_rows(batch), centre()
        if around is None:
            around = column_means(mine)
            spark.createDataFrame([(around.tolist(),)], "centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{blocks}/centre")
        set_blocks(mine, None, around).write.mode("overwrite").parquet(f"{blocks}/batches/batch={batch_id}")

    query = frame.rows.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    around = centre()
    if around is None:
        raise DimensionMismatch("no rows")
    end, total = _latest(spark, blocks)
    new = spark.read.schema("label int, block array<double>, batch long").parquet(f"{blocks}/batches").filter(F.col("batch") > end)
    last = new.agg(F.max("batch")).first()[0]
    if last is not None:
        parts = new.select("label", "block")
        if total is not None:
            parts = parts.unionByName(total.select(F.lit(0).alias("label"), "block"))
        merged(parts, adding(size)).select("block").write.mode("overwrite").parquet(f"{blocks}/sums/{last}")
        total = _latest(spark, blocks)[1]
    return around, Moments.unflat(np.array(total.first()["block"]), frame.d, frame.q, frame.weighted)
