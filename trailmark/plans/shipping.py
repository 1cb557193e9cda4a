"""The package itself for the executors' Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import trailmark

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once per application.

    Functions that run in Python workers are pickled by name, so the executors
    need the package; they fetch the archive from the driver.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(trailmark.__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="trailmark-ship-")) / "trailmark.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path("trailmark") / p.relative_to(root))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)
