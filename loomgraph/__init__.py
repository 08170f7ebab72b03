"""Code-graph analytics on Spark: property graphs, policies, text operators."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent).as_posix())
    path = Path(tempfile.mkdtemp(prefix="loomgraph-")) / "loomgraph.zip"
    path.write_bytes(data.getvalue())
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)
