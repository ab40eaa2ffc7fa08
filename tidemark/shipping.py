"""Making the package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
_done: set[str] = set()


def ensure_shipped(spark: SparkSession) -> None:
    """Send the package to the workers, once per application.

    A local master whose ``PYTHONPATH`` names the package's folder needs nothing.
    """
    sc = spark.sparkContext
    if sc.applicationId in _done:
        return
    _done.add(sc.applicationId)
    on_path = str(ROOT.parent) in [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if on_path and sc.master.startswith("local"):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), "tidemark.zip")  # read by the driver's file server only
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(ROOT.rglob("*.py")):
            z.write(f, str(f.relative_to(ROOT.parent)))
    sc.addPyFile(path)
