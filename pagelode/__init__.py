"""pagelode: a web-search and corpus engine on PySpark DataFrames."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

__version__ = "0.2.0"

_shipped: set[str] = set()


def ship(spark) -> None:
    """Make this package importable on executors, once per application, whatever their PYTHONPATH is."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="pagelode-zip-"), "pagelode_src.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*")):
            if p.suffix in (".py", ".txt") and "__pycache__" not in p.parts:
                z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)
