"""Tier stores over folders of Parquet: the store interfaces as DataFrames.

A store keeps one row per id. Writes append versions; a read takes the newest
version of each id and leaves out deleted ones, so writers never block readers.
``compact`` rewrites the folder to what a read returns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class TierStore:
    """Rows of one tier (hot, warm or cold), by ``id`` and ``namespace``."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _write(self, df: DataFrame, deleted: bool) -> None:
        rows = df.withColumn("_deleted", F.lit(deleted)).withColumn("_version", F.unix_micros(F.current_timestamp()))
        rows.write.mode("append").parquet(f"{self.path}/v={uuid.uuid4().hex}")

    def put(self, df: DataFrame) -> None:
        """Adds or replaces rows; of rows with one id in a call, any one stays."""
        self._write(df.dropDuplicates(["id"]), False)

    def delete(self, ids: DataFrame) -> None:
        fields = self.spark.createDataFrame([], self.schema).schema
        self._write(ids.select("id").distinct().select("id", *(F.lit(None).cast(f.dataType).alias(f.name) for f in fields if f.name != "id")), True)

    def all(self) -> DataFrame:
        kind = f"{self.schema}, _deleted boolean, _version bigint"
        try:
            rows = self.spark.read.schema(kind).option("recursiveFileLookup", True).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.schema)
        fields = [c for c in rows.columns if c != "id"]
        newest = rows.groupBy("id").agg(F.max_by(F.struct(*fields), F.struct("_version", "_deleted")).alias("r")).where("not r._deleted")
        return newest.select("id", *(F.col(f"r.{c}").alias(c) for c in fields if not c.startswith("_")))

    def get(self, ids: DataFrame) -> DataFrame:
        return self.all().join(ids.select("id"), "id", "left_semi")

    def scan(self, namespace: str) -> DataFrame:
        return self.all().where(F.col("namespace") == namespace)

    def clear(self, namespace: str) -> None:
        self.delete(self.scan(namespace))

    def usage(self) -> DataFrame:
        return self.all().groupBy("namespace").agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"))

    def compact(self, path: str) -> TierStore:
        """A store in another folder with the present rows only."""
        self.all().withColumn("_deleted", F.lit(False)).withColumn("_version", F.lit(0).cast("bigint")).write.parquet(f"{path.rstrip('/')}/v=0")
        return TierStore(self.spark, path, self.schema)
