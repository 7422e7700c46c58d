"""Session helpers shared by the library."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.util import InheritableThread

_shipped: set[str] = set()
#: Input up to this size may come in fewer splits than there are cores; larger input doesn't.
SMALL_BYTES = 64 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; where that is unset and all is one process, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def prepare(spark: SparkSession) -> None:
    """Give the executors this package, once an application; on a cluster they don't have the driver's working folder.

    Arrow batches are held to 1,000 rows where the session has the default of 10,000: texts may be long, and a Python
    worker holds a batch whole.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="ship-")) / root.name
        shutil.copytree(root, target / root.name, ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(str(target), "zip", target))
        shutil.rmtree(target)
        _shipped.add(app)


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores if they are small, as a small file is one task's work, however long that takes a row; else as they are."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism) if size <= SMALL_BYTES else rows


def aside(work: Callable) -> Callable:
    """Start work in a thread of its own; the result when it is called for."""
    out: dict = {}

    def run() -> None:
        try:
            out["value"] = work()
        except Exception as e:  # raised where the result is called for
            out["error"] = e

    thread = InheritableThread(target=run)
    thread.start()

    def result():
        thread.join()
        if "error" in out:
            raise out["error"]
        return out["value"]

    return result
