"""The folder that driver and executors share: intermediate tables, and when they go.

Every intermediate folder belongs to the innermost `scratch` that is open when it is made, and is removed when this ends;
outside of any, when the Python process of the driver ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders by owner: those of the process first, then those of each open scratch.
_owned: list[list[str]] = [[]]
_sessions: list[SparkSession] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; on one machine (tests) a new one where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own for an intermediate table."""
    folder = f"{shared_dir(spark)}/fleetlens-{uuid.uuid4().hex}"
    _owned[-1].append(folder)
    if not _sessions:
        atexit.register(_at_end)
    _sessions[:] = [spark]
    return f"{folder}/{name}"


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and survives the loss of executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folders: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def scratch(spark: SparkSession):
    """Intermediate tables that are made inside are removed on leaving; write results that read them before that."""
    _owned.append([])
    try:
        yield
    finally:
        remove(spark, _owned.pop())


def _at_end() -> None:
    try:
        remove(_sessions[0], [f for folders in _owned for f in folders])
    except Exception:  # noqa: BLE001  the session is gone
        pass
