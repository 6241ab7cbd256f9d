"""Session construction and the shared work folder.

Tables that jobs write for themselves (snapshots, replicas, run logs,
lineage cuts) live under the cluster's shared ``spark.checkpoint.dir``.
A folder is created only when the session has none configured, which is
the case in local tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.parquet.aggregatePushdown": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "sensorframe", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; create a local one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="sensorframe-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one job's tables, under the shared checkpoint folder."""
    root = ensure_checkpoint_dir(spark)
    return root.rstrip("/") + f"/sensorframe-work/{name}-{uuid.uuid4().hex[:12]}"


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme for python-side existence checks in tests."""
    return path[5:] if path.startswith("file:") else path


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system of the session."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def delete_path(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.delete(hpath, True))


def list_dirs(spark: SparkSession, path: str) -> list[str]:
    """Names of sub-folders (e.g. ``date=2024-01-01``) of a table folder."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        return []
    return [s.getPath().getName() for s in fs.listStatus(hpath) if s.isDirectory()]


__all__ = ["build_session", "ensure_checkpoint_dir", "work_dir", "path_exists",
           "delete_path", "list_dirs", "local_path"]


def observed(obs, names) -> dict:
    """Metrics of an ``Observation`` after its action.

    When the optimizer proves the observed plan empty (AQE replaces it with an
    empty relation) the metrics node is gone and Spark hands back an empty
    row; the metrics are then NULL (callers read NULL counts as 0).
    """
    try:
        return obs.get
    except Exception as exc:  # noqa: BLE001
        if "toPyRow" not in str(exc):
            raise
        return {n: None for n in names}


def touch(spark: SparkSession, path: str) -> None:
    """Create an empty marker file."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.create(hpath, True).close()


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def create_file(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small new file; False, and nothing written, when it exists. The file system decides
    who is first, so of several drivers creating one path exactly one gets True."""
    fs, hpath = _fs(spark, path)
    fs.mkdirs(hpath.getParent())
    if fs.getUri().getScheme() == "file":
        # Hadoop's local file system looks and then creates; a hard link is one step.
        local = hpath.toUri().getPath()
        draft = f"{os.path.dirname(local)}/.{uuid.uuid4().hex}"
        with open(draft, "w", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(draft, local)
            return True
        except FileExistsError:
            return False
        finally:
            os.remove(draft)
    try:
        out = fs.create(hpath, False)
    except Exception as exc:  # noqa: BLE001
        if "AlreadyExists" in str(exc) or "already exists" in str(exc):
            return False
        raise
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    return True


def read_text(spark: SparkSession, path: str) -> str:
    fs, hpath = _fs(spark, path)
    stream = fs.open(hpath)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def list_files(spark: SparkSession, path: str) -> dict[str, int]:
    """Names of the files in a folder (none if it is missing) with their time of change in milliseconds."""
    fs, hpath = _fs(spark, path)
    if not fs.exists(hpath):
        return {}
    return {s.getPath().getName(): s.getModificationTime() for s in fs.listStatus(hpath) if s.isFile()}
