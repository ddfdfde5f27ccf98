"""Cutting lineage and keeping artefacts on storage every executor can reach."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``.

    A folder of its own is made only in local mode, where the setting may be absent.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
            folder = tempfile.mkdtemp(prefix="textlab-checkpoint-")
        sc.setCheckpointDir(folder)
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


_RUN: ContextVar[list[str] | None] = ContextVar("scratch_run", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; inside ``scratch_run`` it is removed when the run ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if (run := _RUN.get()) is not None:
        run.append(path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch_run(spark: SparkSession) -> Iterator[None]:
    """Remove the scratch folders that were named inside, also after an error.

    Operators are lazy and read their folders when their result is: write the result inside the run, to a
    path that was named before it. A run covers the thread that opened it.
    """
    mine: list[str] = []
    outer = _RUN.set(mine)
    try:
        yield
    finally:
        _RUN.reset(outer)
        for path in mine:
            remove_path(spark, path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back. Survives the loss of executors like a checkpoint, which makes the rows twice."""
    path = scratch_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


BUILD_VERSION = 2


def content_digest(source: DataFrame) -> list[str]:
    """Rows and two sums of row hashes: changes with the content, not with the order or the files. One distributed pass."""
    columns = [F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in source.schema.fields]
    sums = [F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)")).alias(f"s{seed}") for seed in (1, 2)]
    return [str(v) for v in source.agg(F.count(F.lit(1)).alias("n"), *sums).first()]


def artefact_path(root: str, name: str, source: DataFrame, params: Mapping) -> str:
    """Folder of an artefact: changes with the input's schema and content, the parameters and the version of the layout."""
    identity = json.dumps(
        [BUILD_VERSION, source.schema.json(), content_digest(source), {k: str(v) for k, v in sorted(params.items())}]
    )
    return f"{root.rstrip('/')}/{name}-{hashlib.md5(identity.encode()).hexdigest()}"


def materialize(
    source: DataFrame,
    root: str,
    name: str,
    build: Callable[[DataFrame], DataFrame],
    params: Mapping | None = None,
    override: bool = False,
) -> DataFrame:
    """Load the stored artefact, or build it from ``source``, store and load it.

    Only a finished write counts (its success marker exists), so a job that died
    half-way is built again.
    """
    spark = source.sparkSession
    path = artefact_path(root, name, source, params or {})
    if override or not path_exists(spark, path + "/_SUCCESS"):
        build(source).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
