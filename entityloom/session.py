"""Session helpers: a tuned builder for local runs and the shared scratch folder."""

from __future__ import annotations

import atexit
import contextlib
import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])

_own_folders: set[str] = set()


def local_session(
    cores: int | str = 8, memory: str = "8g", app: str = "entityloom", folder: str | None = None
) -> SparkSession:
    """A session for tests and benches; on a cluster use the session the cluster gives.

    ``folder`` takes written intermediates where no default names one.
    """
    builder = SparkSession.builder
    if folder:
        builder = builder.config("spark.checkpoint.dir", folder)
    return (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Each application writes below a folder of its own there, which goes when
    the application's Python ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    own = f"{folder.rstrip('/')}/entityloom-{spark.sparkContext.applicationId}"
    if own not in _own_folders:
        _own_folders.add(own)
        atexit.register(remove, spark, own)
    return own


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written folder; nothing happens when it, or the session, is gone."""
    if spark.sparkContext._jsc is None:
        return
    with contextlib.suppress(Exception):
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def share_package(spark: SparkSession) -> None:
    """Let Python workers find this package where it is not installed.

    On a cluster it is installed or sent along; the extra entry of the workers'
    path is then a folder that does not exist there, which Python ignores.
    """
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *(p for p in known if p)])


def materialise(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written files survive lost executors, so values that depend on the
    physical layout (such as row positions) are fixed once and for all. They
    last as long as the application, or until ``release``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._entityloom_path = path
    return written


def release(written: DataFrame) -> None:
    """Delete the files of a ``materialise`` result that nothing reads any more."""
    remove(written.sparkSession, written._entityloom_path)
