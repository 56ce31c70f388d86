"""Entity resolution and record linkage as Spark DataFrames."""

from __future__ import annotations

import os
import tempfile
import zipfile

_ROOT = os.path.dirname(os.path.abspath(__file__))


def ship(spark) -> None:
    """Send this package to the executors of a session, once per context.

    Executors that already have it on their path use that copy; others import it
    from the archive, which Spark serves from the driver.
    """
    context = spark.sparkContext
    if getattr(context, "_tessera_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(_ROOT):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(_ROOT)))
    context.addPyFile(archive)
    context._tessera_shipped = True
