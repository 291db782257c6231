"""Session helpers: shipping this package to executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers once a Spark application, so that they can import it wherever
    they run; a cluster's own installation of it isn't needed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="tabulon-ship-")) / "tabulon.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    spark.sparkContext.addPyFile(str(at))
    _shipped.add(app)
