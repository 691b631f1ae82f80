"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset (tests, a local session) a local folder is made and set, so that
    ``checkpoint()`` works there too.  A cluster has to name its own folder.
    """
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="loomwright-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below this application's part of the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/loomwright-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Deletes what this application wrote to the shared folder; results that still read from it must be written first."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/loomwright-{spark.sparkContext.applicationId}")
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back.

    The files are replicated by the shared file system, so a lost executor loses nothing.
    """
    path = scratch(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def session(cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings the engine is meant to run under."""
    cpus = cpus or os.cpu_count() or 4
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("loomwright")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


#: The characters with Unicode's property White_Space, as a Java character class.
WHITE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def no_white(col):
    """The text without any Unicode white space."""
    return F.regexp_replace(col, WHITE + "+", "")


def stripped(col):
    """The text without Unicode white space at its ends."""
    return F.regexp_replace(col, f"^{WHITE}+|{WHITE}+$", "")


def instant(col):
    """An ISO 8601 string with an offset as a timestamp; null where it is none."""
    return F.try_to_timestamp(col)
