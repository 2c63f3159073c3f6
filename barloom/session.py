"""Session helpers: a tuned builder and fault-tolerant materialisation."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_written: list[str] = []


def local_session(app: str = "barloom", cores: str = "8", partitions: int = 8) -> SparkSession:
    """Session for tests and the local bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster.

    A machine-local folder is only ever used when the master itself is local.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a shared folder before running on a cluster")
    made = tempfile.mkdtemp(prefix="barloom-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    Cuts the lineage with a real table: column pruning, filter pushdown and file
    statistics keep working on it, and losing an executor costs nothing.
    """
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def send_package(spark: SparkSession) -> None:
    """Give the workers this package once a session, wherever the driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_barloom_sent", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    # The driver serves the file as long as the session lives.
    path = os.path.join(tempfile.mkdtemp(prefix="barloom-sent-"), "barloom-models.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(top):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    sc._barloom_sent = True


@contextmanager
def scratch(spark: SparkSession):
    """Tables that ``materialize`` writes inside are deleted at the end, so results have to be
    collected or written by then."""
    before = len(_written)
    try:
        yield
    finally:
        for path in _written[before:]:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        del _written[before:]
