"""Sessions, and the package on the executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings the engine expects: UTC, adaptive execution, Arrow."""
    b = SparkSession.builder.master(master).appName("folio").config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true").config("spark.ui.enabled", "false")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per application; they need not find it on a path of their own."""
    sc = spark.sparkContext
    if getattr(sc, "_folio_shipped", False):
        return spark
    home = Path(__file__).resolve().parent
    tmp = tempfile.mkdtemp(prefix="folio-")  # the driver serves it to the executors until it ends
    atexit.register(shutil.rmtree, tmp, ignore_errors=True)
    archive = Path(tmp) / "folio.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    sc.addPyFile(str(archive))
    sc._folio_shipped = True
    return spark
