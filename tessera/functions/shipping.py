"""Make this package importable in Python workers that don't have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors once per application, unless PYTHONPATH already leads to it."""
    sc = spark.sparkContext
    on_path = any(p and os.path.realpath(p) == str(_ROOT.parent) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep))
    if sc.applicationId in _shipped or on_path or not _ROOT.is_dir():
        return
    target = Path(tempfile.mkdtemp(prefix="tessera-")) / "tessera.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(_ROOT.rglob("*.py")):
            z.write(f, f.relative_to(_ROOT.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)
