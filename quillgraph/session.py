"""Sessions, and the package's code on the workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, wherever they run; once an application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="quillgraph-code-")) / "quillgraph.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, os.path.join(root.name, file.relative_to(root)))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)


def session(name: str = "quillgraph", cpus: str = "*", partitions: int = 8) -> SparkSession:
    """A local session as tests and the benchmark use it."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(name)
        .config("spark.sql.shuffle.partitions", partitions).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
