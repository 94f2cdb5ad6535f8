"""The package on the workers: nothing has to be installed there."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the session's workers, once; a package that came in an archive is there already."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parent
    if sc.applicationId in _DONE or not root.is_dir():
        return
    _DONE.add(sc.applicationId)
    path = os.path.join(tempfile.mkdtemp(prefix="papyra-"), "papyra.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)
