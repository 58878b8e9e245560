"""Session settings that results depend on."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: UTC, ANSI arithmetic and adaptive execution; sizes (memory, partitions) are the cluster's to set.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "ordina", **settings: str) -> SparkSession:
    """The session with :data:`SETTINGS`; ``settings`` have underscores for dots."""
    builder = SparkSession.builder.appName(name)
    for key, value in {**SETTINGS, **{k.replace("_", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_shipped: set[str] = set()
#: Arrow batches are bounded by bytes, as rows may be long; a session that sets this itself keeps its value.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python, wherever the driver runs from; once an application."""
    if BATCH_BYTES[0] not in spark.conf.getAll:
        spark.conf.set(*BATCH_BYTES)
    context, folder = spark.sparkContext, Path(__file__).parent
    if context.applicationId in _shipped or not folder.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="ordina-")) / "ordina.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(folder.rglob("*.py")):
            out.write(file, file.relative_to(folder.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
