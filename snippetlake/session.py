"""Session helpers: the shared work folder and lineage cuts."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only when neither the session nor the context names one and the master is local (unit
    tests, a laptop) is a temporary folder made and set; a cluster has to name one.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current is None:
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="snippetlake-"))
        current = sc.getCheckpointDir()
    return named or current


def _cut_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/snippetlake-{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return it with its lineage cut there.

    The copy is Parquet, so later readers still prune columns, and lost executors
    lose nothing.
    """
    spark = df.sparkSession
    target = f"{_cut_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(target)
    return spark.read.schema(df.schema).parquet(target)


def spread(scan: DataFrame) -> DataFrame:
    """Repartition a plain scan that has fewer splits than there are cores, before work
    that costs much more than reading. A large table has enough splits and is left alone."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def drop_cuts(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application from the shared folder."""
    jvm, target = spark.sparkContext._jvm, _cut_folder(spark)
    path = jvm.org.apache.hadoop.fs.Path(target)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application. Not needed where
    it is installed on the cluster or passed with ``--py-files``."""
    sc = spark.sparkContext
    if _shipped.get("application") == sc.applicationId:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="snippetlake-package-")
    archive = shutil.make_archive(f"{folder}/snippetlake", "zip", package.parent, package.name)
    sc.addPyFile(archive)
    _shipped["application"] = sc.applicationId
