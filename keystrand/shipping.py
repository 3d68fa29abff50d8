"""Send the package's code to the executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()
#: Spark fills an Arrow batch up to 64 MB, in memory outside the heap, for each task and direction.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``; only a local master may leave that setting out, as tests do."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="keystrand-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Once for each application: add the package as a zip file, so that Python workers can import it.

    Spark's file server hands the file to executors, new ones included. The
    session's Arrow batches are bounded by 8 MB, unless it has a bound of its own.
    """
    if spark.conf.get(BATCH, None) in (None, "67108864b", "64MB", "9223372036854775807b"):
        spark.conf.set(BATCH, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    root = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="keystrand-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _sent.add(app)
