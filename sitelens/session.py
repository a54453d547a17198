"""Session settings shared by every job.

``prepare_session`` only sets runtime SQL options that are safe to change
on a live session (time zone, AQE, Arrow batch size).  It never overrides a
checkpoint directory that the cluster already names.
"""

from __future__ import annotations

import os
import sys
import tempfile
import time
import zipfile

from pyspark.sql import SparkSession

# Bodies of web pages are large: keep Arrow batches small so a Python
# worker never holds more than a few MB of HTML at once.
ARROW_BATCH_ROWS = 256

_RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": str(ARROW_BATCH_ROWS),
    # ...and by bytes, so a run of very large pages cannot blow up a batch.
    "spark.sql.execution.arrow.maxBytesPerBatch": "67108864b",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # JSON objects that repeat a key are read, the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``sitelens`` importable in the Python workers of this session.

    Arrow UDFs and ``mapInArrow`` functions are pickled by reference, so the
    executors need the package: it is zipped once and added with
    ``addPyFile`` (what ``--py-files`` does at submit time).
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out_dir = tempfile.mkdtemp(prefix="sitelens-pkg-")
    archive = os.path.join(out_dir, "sitelens.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(archive)
    _SHIPPED.add(app)


def prepare_session(spark: SparkSession) -> SparkSession:
    """Apply the runtime options the library relies on (idempotent) and
    ship the package to the Python workers."""
    for key, value in _RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    ship_package(spark)
    return spark


def build_session(
    master: str | None = None,
    app_name: str = "sitelens",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Build a session for tests, the bench and local runs.

    On a cluster the session comes from the platform; call
    ``prepare_session`` on it instead.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SITELENS_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in {**_RUNTIME_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare_session(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory of the session.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that is
    used as is.  Only a local-mode session without one (tests, the bench)
    gets a fresh scratch folder.  A cluster session without a shared folder
    is a configuration error: a machine-local folder would not survive the
    loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; iterative jobs need a shared "
            "checkpoint folder on a cluster"
        )
    path = tempfile.mkdtemp(prefix="sitelens-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def stage_folder(spark: SparkSession) -> str:
    """Folder of this application's stage tables."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/sitelens/{spark.sparkContext.applicationId}"


def clear_stages(spark: SparkSession) -> None:
    """Delete this application's stage tables; for the end of a job, when no
    DataFrame that reads them is used any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(stage_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def spread(df, *cols: str):
    """``df`` dealt over all cores by a hash of ``cols``: for few bytes that
    take much work a row, which adaptive execution would leave in one task."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, *cols)


def materialize(df, name: str = "stage"):
    """Cut lineage by writing ``df`` once as Parquet under the session's
    reliable checkpoint folder and reading it back.

    Unlike ``Dataset.checkpoint()`` the plan runs a single time, and the
    read-back gets column pruning and filter pushdown.
    """
    import uuid

    spark = df.sparkSession
    path = f"{stage_folder(spark)}/{name}-{uuid.uuid4().hex}"
    t0 = time.time()
    df.write.mode("overwrite").parquet(path)
    if os.environ.get("SITELENS_TRACE"):  # stage timing on stderr, opt-in
        sys.stderr.write(f"[materialize] {name}: {time.time() - t0:.2f}s\n")
    return spark.read.parquet(path)


def discard(df) -> None:
    """Delete the files of a stage table (from ``materialize``) that no
    DataFrame reads any more."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
        if folder.getParent().getName() == spark.sparkContext.applicationId:
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
