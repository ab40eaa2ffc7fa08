"""Running a stream to its end and reading what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.storage import temporary


def sliced(df: DataFrame, by: str, slices: int = 6) -> DataFrame:
    """A stream over ``df``, written as files in the order of ``by``, two files a batch."""
    spark = df.sparkSession
    path = temporary(spark, "stream")
    df.repartitionByRange(slices, by).sortWithinPartitions(by).write.parquet(path)
    # a file source takes files by age; the slices must age in their order
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = sorted((p.getPath() for p in fs.listStatus(root) if p.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    first = min((fs.getFileStatus(p).getModificationTime() for p in parts), default=0)
    for i, p in enumerate(parts):
        fs.setTimes(p, first - 1000 * (len(parts) - i), -1)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).option("latestFirst", "false").parquet(path)


def finished(stream: DataFrame, mode: str = "append", last_of: list[str] | None = None, transform=None) -> DataFrame:
    """All rows of a stream that is run until its source is exhausted.

    Every batch goes to a folder of its own that a repeated batch overwrites,
    so a restart writes nothing twice. In ``complete`` mode the last batch is
    the result, in ``update`` mode the last version of each key ``last_of``.
    """
    spark: SparkSession = stream.sparkSession
    base = temporary(spark, "sink")
    schemas: list = []

    def sink(batch: DataFrame, number: int) -> None:
        out = transform(batch) if transform else batch
        schemas[:] = [out.schema]
        out.write.mode("overwrite").parquet(f"{base}/out/batch={number:09d}")

    q = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/state").foreachBatch(sink).start()
    q.awaitTermination()
    rows = spark.read.schema(schemas[0].add("batch", "integer") if schemas else stream.schema).parquet(f"{base}/out")
    if mode == "complete":
        last = rows.agg(F.max("batch").alias("batch"))
        rows = rows.join(F.broadcast(last), "batch")
    if last_of:
        w = Window.partitionBy(*last_of).orderBy(F.col("batch").desc())
        rows = rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return rows.drop("batch")
