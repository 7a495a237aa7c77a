"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Without them Spark decodes only a few charsets, and stops at a byte that does not decode.
KOREAN_CONF = ("spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction")

# Read by every job built with `build_session`. None of the operators depends on them for right results.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # The JVM does not compile methods beyond this size: wide projections run faster split than fused.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.sources.partitionOverwriteMode": "static",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    **dict.fromkeys(KOREAN_CONF, "true"),
}


# Temporary folders of local sessions, by application, and applications whose scratch folder is made.
_LOCAL_ROOTS: dict[str, str] = {}
_SCRATCH: set[str] = set()


def build_session(app_name: str = "folioframe", **conf: str) -> SparkSession:
    """A session with the library's settings; `conf` entries (dots as `__`) win."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in `spark.checkpoint.dir`.

    Only a local session without the setting gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    application = spark.conf.get("spark.app.id")
    if application not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[application] = tempfile.mkdtemp(prefix="folioframe-")
    return _LOCAL_ROOTS[application]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; nothing is ever written to the same one twice.

    An application's scratch lies in one folder that goes when its driver ends."""
    application = spark.conf.get("spark.app.id")
    folder = f"{shared_root(spark)}/folioframe-{application}"
    if application not in _SCRATCH:
        _SCRATCH.add(application)
        files, target = _located(spark, folder)
        files.mkdirs(target)
        files.deleteOnExit(target)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, path: str, compression: str | None = None) -> DataFrame:
    """Write `df` to a scratch path and read it back: reuse without recomputing, and a cut lineage that
    survives lost executors. Without a `compression` the session's own is taken."""
    df.write.mode("errorifexists").parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a scratch path that is no longer needed; anything outside the shared folder is refused."""
    if not path.startswith(shared_root(spark) + "/"):
        raise ValueError(f"{path} is not under the shared folder")
    delete_path(spark, path)


def _located(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of a table, wherever it is stored."""
    files, target = _located(spark, path)
    files.delete(target, True)


def delete_if_bare(spark: SparkSession, path: str) -> None:
    """Delete a folder that holds nothing but the mark of a finished write. One that anything else lies in, or that a
    job is writing into, stays."""
    files, target = _located(spark, path)
    if not files.exists(target):
        return
    inside = [status.getPath() for status in files.listStatus(target)]
    if all(name.getName() == "_SUCCESS" for name in inside):
        for name in inside:
            files.delete(name, False)
        if not files.listStatus(target):
            files.delete(target, False)


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a write to the path ended well."""
    files, target = _located(spark, f"{path}/_SUCCESS")
    return files.exists(target)
