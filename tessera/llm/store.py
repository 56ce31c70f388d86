"""Intermediate tables in the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder on a cluster; a temporary folder is
used only where the setting is empty and the master is local (tests), for on a
cluster the executors could not see it.  A table written here cuts lineage and
survives the loss of any executor.  Workspaces are removed by ``clear``, by ``clear_since``
once a later table holds what they led to, and else when the driver's Python ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera import ship

_LOCAL: dict[str, str] = {}
#: Rows of a file of a kept table whose size has a known bound.
ROWS_PER_FILE = 50_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; if unset a temporary one, on a local master only."""
    configured = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _LOCAL["dir"]


class Workspace:
    """A folder of one operator run: ``keep`` writes a table, ``drop`` removes it."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        # Rows of documents are wide: a tenth of the usual number makes a batch.
        if spark.conf.get(_BATCH) == "10000":
            spark.conf.set(_BATCH, "1000")
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
        self._serial = 0
        _OPEN.append(self)

    def keep(self, df: DataFrame, name: str, within: int | None = None, per_file: int = ROWS_PER_FILE, **options) -> DataFrame:
        """Write ``df`` as Parquet and read it back with its own schema.

        ``within`` is a bound of its rows, from tables kept before (``rows``): there are
        then no more tasks and files than one per ``per_file`` rows, and 4 at least.
        """
        self._serial += 1
        path = f"{self.root}/{self._serial:03d}-{name}"
        schema = df.schema
        if within is not None:
            df = self.sized(df, within, per_file)
        counted = Observation()
        df = df.observe(counted, F.count(F.lit(1)).alias("rows"))
        df.write.mode("overwrite").options(**{"compression": "zstd"} | options).parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._tessera_path = path
        out._tessera_rows = counted.get["rows"]
        return out

    def sized(self, df: DataFrame, rows: int, per_file: int = ROWS_PER_FILE) -> DataFrame:
        """``df`` of at most so many rows in no more tasks than one per ``per_file`` rows, and 4."""
        return df.coalesce(max(4, -(-rows // per_file)))

    def drop(self, *tables: DataFrame) -> None:
        """Delete kept tables whose rows no later step reads."""
        jvm = self.spark._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table._tessera_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self) -> None:
        """Delete the folder, once the operator's result has been consumed."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        if self in _OPEN:
            _OPEN.remove(self)


def rows_of(*tables: DataFrame) -> int:
    """Rows of kept tables together, as counted when they were written."""
    return sum(table._tessera_rows for table in tables)


_OPEN: list[Workspace] = []


def opened() -> list[Workspace]:
    """The workspaces that have not been cleared."""
    return list(_OPEN)


def clear_since(before: list[Workspace]) -> None:
    """Clear all workspaces but those of an earlier ``opened``."""
    for work in opened():
        if work not in before:
            work.clear()


@atexit.register
def _clear_rest() -> None:
    for work in opened():
        if work.spark.sparkContext._jsc is not None:  # else the session has been stopped
            work.clear()
