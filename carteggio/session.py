"""Session factory and lineage cuts that survive the loss of executors."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "carteggio", cpus: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and benches; on a cluster pass your own session."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("CARTEGGIO_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder; a cluster without it is an error, since a folder of
    one machine would be lost to the others.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="carteggio-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_made = threading.local()


def cut(df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Unlike a persisted frame the result does not need its lineage when an
    executor is lost. Returns the frame and its path, for :func:`discard`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if getattr(_made, "scopes", None):
        _made.scopes[-1].append((spark, path))
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table made by :func:`cut` that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _frames(x) -> list[DataFrame]:
    return [x] if isinstance(x, DataFrame) else [f for y in x for f in _frames(y)] if isinstance(x, (tuple, list)) else []


def tidy(f: Callable) -> Callable:
    """``f``, which deletes the tables cut while it runs except those that the frames it returns still read.

    What they read is handed to the enclosing tidy call, if there is one, and else stays as long as the session.
    """

    @wraps(f)
    def run(*args, **kwargs):
        scopes = _made.scopes = getattr(_made, "scopes", [])
        scopes.append([])
        try:
            out = f(*args, **kwargs)
        finally:
            made = scopes.pop()
        read = {p.rsplit("/", 2)[-2] for frame in _frames(out) for p in frame.inputFiles()} if made else set()
        for spark, path in made:
            if path.rsplit("/", 1)[-1] not in read:
                discard(spark, path)
            elif scopes:
                scopes[-1].append((spark, path))
        return out

    return run
