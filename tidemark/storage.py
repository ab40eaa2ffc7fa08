"""Tables in the folder all executors share.

Lineage is cut by writing a table and reading it again. The folder is the one
the cluster names in ``spark.checkpoint.dir``; only a local master without the
setting gets a temporary one.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables, from the session when it names one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="tidemark-")
    return _local[app]


def temporary(spark: SparkSession, name: str) -> str:
    """Path of a new folder in the shared one, removed with the intermediate tables."""
    path = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it as read from there."""
    spark = df.sparkSession
    path = temporary(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def clear() -> None:
    """Remove all intermediate tables; results that still read them must be written before."""
    while _made:
        spark, path = _made.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:
            return
