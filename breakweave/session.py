"""Make this package importable on every executor."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors as a zip, once an application.

    Python workers can then unpickle functions of its modules without an installed copy.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    path = Path(tempfile.mkdtemp(prefix="breakweave-")) / f"{top.name}.zip"
    path.write_bytes(data.getvalue())
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)
