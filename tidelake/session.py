"""Session settings, table access and the shared folder of a cluster."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings that results depend on, or that every job wants. Cluster settings (memory, cores, partition sizes) are left to the submitter.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "tidelake", **conf: str) -> SparkSession:
    """A session with DEFAULTS; keyword arguments (dots as double underscores) win."""
    builder = SparkSession.builder.appName(app)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One Parquet table of a data directory; nothing is inferred beyond the footer."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session's ``spark.checkpoint.dir`` names it.

    Only where that is unset and the master is local (tests, a laptop) is a local folder made and set; on a cluster
    executors would each write to a disk of their own, so there it must be set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = current.get() if current.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidelake-shared-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a session: executors need not have it, nor its folder as theirs."""
    sc = spark.sparkContext
    if getattr(sc, "_tidelake_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tidelake-code-")) / f"tidelake-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(archive))
    sc._tidelake_shipped = True


_made: list[str] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder. What is written there serves one result; ``clear_scratch`` removes it."""
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    _made.append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Removes what this process wrote under scratch paths: call it once results are safe. Gives the number of paths."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    n = len(_made)
    while _made:
        path = hadoop(_made.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


@atexit.register
def _forget_local() -> None:
    for path in _made:
        if path.startswith(("file:", "/")):
            shutil.rmtree(path.removeprefix("file:").replace("//", "/", 1), ignore_errors=True)
