"""Session construction, table loading and lineage cuts in the cluster's shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tarnfield", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; any setting can be overridden through ``conf``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def make_importable(spark: SparkSession) -> None:
    """Let Python workers find this package where it was not shipped with the job (runs from another folder)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One Parquet table of a data folder (a file or a directory of part files)."""
    return spark.read.parquet(f"{folder}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where the cluster names one, else a temporary one (local runs)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="tarnfield-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: folders handed out by this process, for :func:`clear_stored`
_WRITTEN: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path for a table in the shared folder; :func:`clear_stored` removes it."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _WRITTEN.append(path)
    return path


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Remove the files behind a frame made by :func:`stored` once nothing reads them any more."""
    spark = df.sparkSession
    base = shared_folder(spark)
    roots = {f.rsplit("/", 1)[0] for f in df.inputFiles() if base.split("://")[-1] in f}
    jvm = spark.sparkContext._jvm
    for root in roots:
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_stored(spark: SparkSession) -> None:
    """Remove every table this process wrote to the shared folder; results that still read them must be done."""
    jvm = spark.sparkContext._jvm
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
