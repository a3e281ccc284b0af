"""Session construction and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "larder",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Session with the settings every operator assumes.

    AQE re-plans joins at runtime (broadcast only when the measured shuffle
    output is below ``spark.sql.adaptive.autoBroadcastJoinThreshold``),
    coalesces small partitions and splits skewed join partitions.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if master and master.startswith("local"):
        conf["spark.driver.memory"] = "16g"     # local mode: the driver JVM is the executor
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set (a shared file system); a machine-local
    temporary folder is only used for local-mode sessions (tests), and only
    when nothing is configured.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not _is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        root = tempfile.mkdtemp(prefix="larder-ckpt-")
        spark.sparkContext.setCheckpointDir(root)   # core setting: not changeable via spark.conf
        return spark.sparkContext.getCheckpointDir()
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


SCRATCH = "larder"   # folder of intermediate tables under the checkpoint folder


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A fresh, never-reused path under the shared checkpoint folder."""
    root = checkpoint_root(spark).rstrip("/")
    return "/".join([root, SCRATCH, *parts, uuid.uuid4().hex])


def materialize(df, *tag: str):
    """Write ``df`` as parquet under the shared checkpoint folder and read it back.

    Cuts lineage like ``checkpoint()`` but the result's plan is a plain file
    scan, carrying none of the original plan's constraints or statistics -
    which matters in iterative plans, where those would grow every round.
    The files survive executor loss.
    """
    spark = df.sparkSession
    path = scratch_path(spark, *(tag or ("materialized",)))
    df.write.parquet(path)
    return spark.read.parquet(path)


def discard(df) -> None:
    """Remove the files of a ``materialize`` result that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if f"/{SCRATCH}/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``larder`` importable in Python workers (needed by the pandas state functions).

    Zips the package once per SparkContext and registers it with
    ``SparkContext.addPyFile``; Spark serves the file to every executor.
    (With ``spark-submit --py-files`` this is already done and is harmless.)
    """
    import os
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    zpath = os.path.join(tempfile.mkdtemp(prefix="larder-pyfiles-"), "larder.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, names in os.walk(pkg):
            if "__pycache__" in base:
                continue
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(base, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(zpath)
    _SHIPPED.add(sc.applicationId)
