"""Session settings and reliable checkpointing."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "oddsgraph.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def build_session(app: str = "oddsgraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; extra settings override."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({k: str(v) for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local one only in local mode where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def drop_folder(path: str) -> None:
    """Delete a folder of intermediate rows."""
    store, inner = fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))
    if store.get_file_info(inner).type == fs.FileType.Directory:
        store.delete_dir(inner)


def drop_at_end(path: str) -> None:
    """Delete a folder once the driver ends."""
    _WRITTEN.append(path)


@atexit.register
def _drop_written() -> None:
    """What ``cut`` wrote is of no use once the driver ends."""
    for path in _WRITTEN:
        try:
            drop_folder(path)
        except (OSError, ValueError):  # a store that only Spark reaches; its own rules clean it
            return


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iterative plan: write the rows to the shared folder, read them back.

    One execution (a checkpoint computes its plan twice), survives lost executors, and
    leaves neither growing constraints nor unknown sizes in the next plan.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/cut-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
