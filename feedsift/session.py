"""Session helpers: local sessions for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


#: State store of streaming/stateful.py (timers and typed state need it).
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(cpus: int | str = 8, app: str = "feedsift", tz: str | None = None,
                  conf: dict[str, str] | None = None) -> SparkSession:
    """A local session with the settings the test and bench harnesses use.

    On a cluster the session comes from the launcher; nothing here is required
    by the library code itself.
    """
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", tz or os.environ.get("FEEDSIFT_SESSION_TZ", "UTC"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in (conf or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ensure_importable(spark)
    bound_batches(spark)
    return spark


#: Bytes of an Arrow batch at most (its rows are bounded too), so that a Python worker holds a few megabytes of long texts at a time.
ARROW_BATCH, _ARROW_BYTES = "8m", "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches, unless the session's configuration does."""
    if spark.sparkContext.getConf().get(_ARROW_BYTES) is None:
        spark.conf.set(_ARROW_BYTES, ARROW_BATCH)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster names this folder; we only pick one ourselves when it is unset,
    for a local master (as in tests): on a cluster a folder of this machine
    would be invisible to the others.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="feedsift-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        if path.startswith("/") and not os.path.exists(path):
            os.makedirs(path, exist_ok=True)
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set[str] = set()


def ensure_importable(spark: SparkSession) -> None:
    """Make ``feedsift`` importable by the Python workers that run its pandas UDFs.

    Workers unpickle UDFs by module reference, so the package must be on their
    path.  Locally the package root is added to the workers' ``PYTHONPATH``
    (``SparkContext.environment`` is passed to every Python worker); on a
    cluster master the package is also zipped once and shipped with
    ``addPyFile`` (the usual ``--py-files`` route).
    """
    sc = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    key = f"{sc.applicationId}:{root}"
    if key in _SHIPPED:
        return
    paths = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    if not sc.master.startswith("local"):
        sc.addPyFile(package_zip())
    _SHIPPED.add(key)


def package_zip() -> str:
    """Zip the ``feedsift`` package (sources only) for ``addPyFile`` / ``--py-files``; returns the archive path."""
    import zipfile

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="feedsift-pkg-"), "feedsift.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _dirs, files in os.walk(os.path.join(root, "feedsift")):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, root))
    return path
