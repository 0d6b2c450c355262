"""What jobs with Python in their tasks need of the session."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shipped(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors once a session, so that their Python finds it."""
    context = spark.sparkContext
    if not getattr(context, "_tidewire_shipped", False):
        root = Path(__file__).resolve().parent.parent
        to = Path(tempfile.mkdtemp(prefix="spark-")) / "tidewire.zip"
        with zipfile.ZipFile(to, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        context.addPyFile(str(to))
        context._tidewire_shipped = True
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Where that is unset and Spark runs on one machine
    (tests), it is a new local folder, kept for the session; a cluster must name one."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        known = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", known)
    return known


def kept(rows: DataFrame) -> DataFrame:
    """The rows, computed once and read from the shared folder by all jobs that follow."""
    to = f"{shared_folder(rows.sparkSession)}/kept-{uuid.uuid4().hex}"
    rows.write.parquet(to)
    return rows.sparkSession.read.schema(rows.schema).parquet(to)
