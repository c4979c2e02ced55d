"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "loofold", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library is tested with.

    On a cluster, leave ``master`` unset: whatever ``spark-submit`` configured wins.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    ship(session)
    return session


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers of all executors, once per session.

    Functions that run in workers import it there. ``spark-submit --py-files`` or an installed
    wheel does the same; then, or where PYTHONPATH already leads here, nothing is sent.
    """
    context = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if getattr(context, "_loofold_shipped", False) or (context.master.startswith("local") and root in map(os.path.abspath, filter(None, known))):
        return
    folder = tempfile.mkdtemp(prefix="loofold-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = shutil.make_archive(os.path.join(folder, "loofold-package"), "zip", root, "loofold")
    context.addPyFile(archive)  # Spark serves it to executors from the driver
    context._loofold_shipped = True


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for intermediate tables.

    It lies under ``spark.checkpoint.dir``, which every executor can reach. Only a
    local session may go without the setting; it then gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="loofold-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    return os.path.join(root, f"{purpose}-{uuid.uuid4().hex}")


def written_table(df: DataFrame, purpose: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """The frame as a table in the shared folder.

    For narrow results of costly work, such as a few numbers per long text: every later
    pass, also after a lost executor, reads the numbers and not the text.
    """
    folder = scratch_folder(df.sparkSession, purpose)
    df.write.partitionBy(*partition_by).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
