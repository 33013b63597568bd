"""Makes the package importable in Python workers, wherever the driver was started."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Adds the package as a ZIP file to the session's context, once, unless PYTHONPATH names its folder already."""
    context = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_gneiss_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="gneiss-")) / "gneiss_package.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted((ROOT / "gneiss").rglob("*.py")):
            out.write(source, source.relative_to(ROOT))
    context.addPyFile(str(path))
    context._gneiss_shipped = True
