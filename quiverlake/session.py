"""Session settings, the shared folder, and cutting of lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_own_dir: str | None = None


def local_session(app: str = "quiverlake", cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for one machine; a cluster brings its own session and settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, read from the session's ``spark.checkpoint.dir``.

    Only where that setting is missing (tests, one machine) a temporary folder of our own is used;
    on a cluster without the setting this raises, as a machine-local folder would lose data there.
    """
    global _own_dir
    conf = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="quiverlake-")
        atexit.register(shutil.rmtree, _own_dir, True)
    return f"file://{_own_dir}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The lineage ends at the written files, which survive the loss of any executor. The files go with
    the shared folder, or earlier by ``drop_cut``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ql-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._ql_path = path
    return out


def drop_cut(df: DataFrame | None) -> None:
    """Delete the files of a table written by ``cut`` that nothing reads any more."""
    path = getattr(df, "_ql_path", None)
    if path is None:
        return
    url = urlparse(path)
    if url.scheme in ("", "file") and os.path.isdir(url.path):
        shutil.rmtree(url.path, ignore_errors=True)
        return
    jvm, jsc = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(jsc.hadoopConfiguration()).delete(at, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a context: they need not have it installed or on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_ql_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="quiverlake-code-")
    atexit.register(shutil.rmtree, folder, True)
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "quiverlake"), "zip", os.path.dirname(root), os.path.basename(root)))
    sc._ql_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """One input table of a data folder. With ``spread``, a table of fewer splits than cores is dealt out to all cores first.

    That is for work that costs far more than moving its rows; a table of many splits is never moved.
    """
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return scan.repartition(cores) if spread and scan.rdd.getNumPartitions() < cores else scan
