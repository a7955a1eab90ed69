"""Session builder and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, app: str = "fieldcast", **conf: str) -> SparkSession:
    """A session with the settings the operators expect. On a cluster leave ``master`` unset and pass the
    sizes that belong to it, e.g. ``{"spark.sql.shuffle.partitions": "4000"}``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def path_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files of a table."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


#: Bytes of a given table behind one initial shuffle partition. Adaptive execution merges those that turn out small.
SHUFFLE_SHARE = 4 * 1024 * 1024
_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def share_shuffles(spark: SparkSession, path: str) -> None:
    """Raises the number of initial shuffle partitions with the bytes of a table that is about to be read, so that a
    task's share of a sort or an aggregate does not grow with the table. It is never lowered, and streams with state keep
    ``spark.sql.shuffle.partitions``."""
    wanted = -(-path_bytes(spark, path) // SHUFFLE_SHARE)
    if wanted > int(spark.conf.get(_INITIAL, None) or spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(_INITIAL, str(wanted))


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``. Only a local session without that setting
    falls back to a temporary folder; a cluster has to name a shared one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the scratch folder and read again: evaluated once, and lost executors cost nothing
    that came before. ``clear_scratch`` removes them."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    _SCRATCH.append((spark.sparkContext.applicationId, path))
    return spark.read.schema(df.schema).parquet(path)


_SCRATCH: list[tuple[str, str]] = []


def scratch_mark() -> int:
    """A place in the list of stored tables, for ``clear_scratch``."""
    return len(_SCRATCH)


def clear_scratch(spark: SparkSession, mark: int = 0) -> None:
    """Deletes the tables that this application has stored since ``mark``. Call it when no frame that reads them is
    needed any more, as streaming jobs do after each micro-batch."""
    own = spark.sparkContext.applicationId
    for app, path in _SCRATCH[mark:]:
        if app == own:
            remove_path(spark, path)
    _SCRATCH[mark:] = [x for x in _SCRATCH[mark:] if x[0] != own]


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library wrote."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application, so that operators with Python steps run
    from any working folder. Spark distributes the archive to executors that join later as well."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(package)
    archive = os.path.join(tempfile.mkdtemp(prefix="run-"), f"{name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, files in os.walk(package):
            for file in files:
                if file.endswith(".py"):
                    full = os.path.join(folder, file)
                    out.write(full, os.path.join(name, os.path.relpath(full, package)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
