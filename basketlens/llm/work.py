"""Intermediate tables in the folder all executors share, and a run's own cleanup."""

import atexit
import shutil
import tempfile
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_written: list[str] = []


def shared(spark: SparkSession) -> str:
    """The folder `spark.checkpoint.dir` names; a local session without it gets its own, removed at exit."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="basketlens-llm-")
        atexit.register(shutil.rmtree, _own[app], True)
    return _own[app]


def fresh(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no run has used."""
    return f"{shared(spark)}/basketlens-llm/{spark.sparkContext.applicationId}/{name}-{uuid4().hex[:12]}"


def kept(frame: DataFrame, name: str) -> DataFrame:
    """The frame written once to the shared folder and read from there.

    It cuts lineage: after the loss of an executor later steps read files
    again instead of running the plan above them once more.
    """
    path = fresh(frame.sparkSession, name)
    _written.append(path)
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What `make` returns, written once; the tables that it wrote on its way are deleted."""
    before = len(_written)
    frame = kept(make(), name)
    for path in _written[before:-1]:
        delete(frame.sparkSession, path)
    _written[before:-1] = []
    return frame


def clean(spark: SparkSession) -> None:
    """Delete all tables this process wrote by `kept`; frames that read them can't be used any more."""
    while _written:
        delete(spark, _written.pop())


def delete(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(text: Column) -> Column:
    """Lower-case A to Z only; null text is empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
