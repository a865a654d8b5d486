"""Makes the package importable in Python workers that don't share the driver's path."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import SparkSession

_done: set[str] = set()


#: Rows that go to a Python worker at once, where the session has Spark's own 10,000: texts and pages are long.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ensure(spark: SparkSession) -> None:
    """Ships the package's source once for each application, and bounds the memory of batches."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, BATCH_ROWS)
    app = spark.sparkContext.applicationId
    if app in _done:
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    shared = urlparse(spark.conf.get("spark.checkpoint.dir", None) or "")
    folder = Path(shared.path) if shared.path and shared.scheme in ("", "file") else Path(tempfile.mkdtemp(prefix="quillet-"))
    folder.mkdir(parents=True, exist_ok=True)
    at = folder / f"quillet-{app}.zip"
    at.write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(str(at))
    _done.add(app)


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder that all executors see: under spark.checkpoint.dir, or a temporary one where that is unset on one machine."""
    import uuid

    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        parts = urlparse(configured)
        if parts.scheme not in ("", "file"):
            raise ValueError(f"a mounted shared folder is needed, not {parts.scheme}:")
        root = parts.path
    elif spark.sparkContext.master.startswith("local"):
        root = tempfile.mkdtemp(prefix="quillet-")
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = Path(root) / f"{tag}-{uuid.uuid4().hex}"
    path.mkdir(parents=True)
    return str(path)
