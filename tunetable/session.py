"""Session construction and shared-storage helpers.

Everything a job persists (tensor tables, lineage cuts, stream checkpoints)
goes under ``spark.checkpoint.dir`` as named by the cluster. Only when that
setting is absent (local tests) do we create a private scratch folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "tunetable",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Only in local mode, when the setting is absent (tests), is a private
    folder created; on a cluster a missing setting is an error, never a
    machine-local folder.
    """
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...) for this cluster")
        d = tempfile.mkdtemp(prefix="tunetable-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-path of the shared folder for one write."""
    base = shared_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def local_path(path: str) -> str:
    """Strip a file: scheme so local tests can use os.path on it."""
    return path[len("file:"):] if path.startswith("file:") else path


def open_input(path: str):
    """Open a small file for reading: a local path, or any URI pyarrow's
    filesystems understand (hdfs://, s3://, gs://, file://)."""
    if "://" in path and not path.startswith("file:"):
        from pyarrow import fs as pafs
        filesystem, inner = pafs.FileSystem.from_uri(path)
        return filesystem.open_input_file(inner)
    return open(local_path(path), "rb")


def exists_local(path: str) -> bool:
    return os.path.exists(local_path(path))


#: Limits of an Arrow batch between the JVM and Python workers, set where the session has none: texts may be long, and both sides hold a batch.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def small_batches(spark: SparkSession) -> None:
    for key, limit in BATCH.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, limit)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tunetable`` importable in the executors' Python workers.

    The package is zipped in memory once per session, written into the
    shared folder (through the Hadoop FileSystem API when that folder is not
    local) and added with ``addPyFile``, which distributes it to every
    executor, including ones that replace lost executors.
    """
    import io
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg_dir):
            if "__pycache__" in root:
                continue
            for f in files:
                if f.endswith((".py", ".json")):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    target = shared_dir(spark).rstrip("/") + f"/tunetable-{uuid.uuid4().hex[:8]}.zip"
    if "://" not in target or target.startswith("file:"):
        path = local_path(target)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(buf.getvalue())
    else:
        jvm = sc._jvm
        hpath = jvm.org.apache.hadoop.fs.Path(target)
        out = hpath.getFileSystem(sc._jsc.hadoopConfiguration()).create(hpath, True)
        out.write(bytearray(buf.getvalue()))
        out.close()
    sc.addPyFile(target)
    _SHIPPED.add(key)
