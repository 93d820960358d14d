"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder in which lineage is cut.

    ``spark.checkpoint.dir`` of the session wins. Only a session without one (a
    local test) gets a folder of its own, because a machine-local folder is of
    no use to the executors of a cluster.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if conf is None and current.isDefined():
        conf = current.get()
    if conf is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        conf = tempfile.mkdtemp(prefix="lexmill-")
    if current.isEmpty():
        sc.setCheckpointDir(conf)
    return conf


def run_folder(spark: SparkSession) -> str:
    """The folder of this application below the shared one; all it writes in between lies there."""
    return os.path.join(checkpoint_dir(spark), "lexmill", spark.sparkContext.applicationId)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table written below the shared folder."""
    return os.path.join(run_folder(spark), f"{name}-{uuid.uuid4().hex}")


def clear_shared(spark: SparkSession) -> None:
    """Remove what this application wrote in between. Frames that read it must have been written or collected before; call it when a job's results are stored."""
    delete(spark, run_folder(spark))


def write_shared(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` below the shared folder, in a folder per value of ``by``, and read it back, cutting its lineage."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Rows over as many tasks as shuffles have, also where few bytes make much work and would be coalesced."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def let_workers_import(spark: SparkSession) -> None:
    """Python workers find this package wherever the driver was started: on this machine by its folder, elsewhere by a zip sent to them once."""
    sc = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if sc.master.startswith("local[") or sc.master == "local":
        known = sc.environment.get("PYTHONPATH", "")
        if root not in known.split(os.pathsep):
            sc.environment["PYTHONPATH"] = os.pathsep.join(p for p in (root, known) if p)
    elif not getattr(sc, "_lexmill_sent", False):
        sc.addPyFile(package_zip(tempfile.mkdtemp(prefix="lexmill-")))
        sc._lexmill_sent = True


def package_zip(folder: str) -> str:
    """The package's modules as a zip in a folder of the driver, which Spark's own file server hands out."""
    package = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(folder, "lexmill.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(package):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    return path


# ---- paths of any file system Spark reaches
def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, p = _path(spark, old)
    if not fs.rename(p, _path(spark, new)[1]):
        raise OSError(f"{old} could not be renamed to {new}")
