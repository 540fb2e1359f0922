"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}
#: The folders of the stage tables written inside each :func:`passing` that is open.
_PASSING: ContextVar[tuple[list[str], ...]] = ContextVar("passing", default=())


def build_session(app_name: str = "ratelark", master: str | None = None,
                  **conf: str) -> SparkSession:
    """A session with adaptive execution on and dynamic partition overwrite."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    Only a local-mode session may fall back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="ratelark-")
    return _LOCAL_ROOTS[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/ratelark/{name}-{uuid.uuid4().hex[:12]}"


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder; frames built on its tables can no longer be read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_stages(spark: SparkSession) -> None:
    """Delete the intermediate tables; frames built on them can no longer be read."""
    delete(spark, f"{shared_root(spark)}/ratelark")


def stage(df: DataFrame, name: str = "stage", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and later readers prune columns
    and partitions.  Partition columns keep the type they had in ``df``.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    for made in _PASSING.get()[-1:]:
        made.append(path)
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Stage tables written inside are deleted at the end, and shuffle files behind them let go.

    What is read later must be stored, or staged inside :func:`outer`.  Tables of other threads stay.
    """
    made: list[str] = []
    token = _PASSING.set((*_PASSING.get(), made))
    try:
        yield
    finally:
        _PASSING.reset(token)
        for folder in made:
            delete(spark, folder)
        if made:
            spark._jvm.System.gc()       # Spark deletes files of collected shuffles


@contextmanager
def outer() -> Iterator[None]:
    """Stage tables written inside outlive the innermost :func:`passing`."""
    token = _PASSING.set(_PASSING.get()[:-1])
    try:
        yield
    finally:
        _PASSING.reset(token)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings changed for a while; for what doesn't touch results."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
