"""Session helpers: a local session for tests/bench, and shared scratch paths.

Scratch data (round-trip tables, materialised sorts) always lives under the
folder the cluster names in ``spark.checkpoint.dir``; a private temporary
folder is only used when the session is local and no folder was configured.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "samplecraft") -> SparkSession:
    """Session used by tests and the bench (UI off, AQE on, Arrow on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only where unset.

    On a cluster the folder must come from ``spark.checkpoint.dir`` (a shared
    file system); a machine-local temporary folder is allowed for local
    sessions only.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; a shared folder is required on a cluster")
    folder = tempfile.mkdtemp(prefix="samplecraft-ckpt-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # our own local folder goes with the process
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/scratch/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def clear_scratch(spark: SparkSession, keep: int = 0) -> None:
    """Remove this driver process's scratch tables but the first ``keep``; nothing that reads them may be in use any more."""
    while len(_SCRATCH) > keep:
        path = spark._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_count() -> int:
    """How many scratch tables there are: what ``clear_scratch`` is to keep after the next job."""
    return len(_SCRATCH)


_SCRATCH: list[str] = []


def ship_package(spark: SparkSession) -> None:
    """Make ``samplecraft`` importable in every Python worker (``--py-files`` style).

    Called by each operator that runs a Python stage; the zip of the package
    source is built once per driver process and added once per context.
    """
    global _SHIPPED_ZIP
    sc = spark.sparkContext
    ident = id(sc._jsc)
    if ident in _SHIPPED_TO:
        return
    if _SHIPPED_ZIP is None:
        import os
        import zipfile
        pkg = os.path.dirname(os.path.abspath(__file__))
        out = os.path.join(tempfile.mkdtemp(prefix="samplecraft-code-"), "samplecraft.zip")
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for root, _dirs, files in os.walk(pkg):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(root, f)
                        z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
        _SHIPPED_ZIP = out
    sc.addPyFile(_SHIPPED_ZIP)
    _SHIPPED_TO.add(ident)


_SHIPPED_ZIP: str | None = None
_SHIPPED_TO: set[int] = set()
