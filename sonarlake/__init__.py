"""sonarlake: speech-data preparation and training-corpus analytics on Spark DataFrames."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

__version__ = "0.1.0"


def ship(spark) -> None:
    """Hands the package to the session's workers, once, so that they can import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_sonarlake_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if not root.is_dir():  # already imported from an archive, which Spark has
        return
    archive = Path(tempfile.mkdtemp(prefix="sonarlake-")) / "sonarlake.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._sonarlake_shipped = True
