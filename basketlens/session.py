"""Session settings the plans assume, and the shared folder they may write to."""

import atexit
import shutil
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", partitions: int = 8, name: str = "basketlens") -> SparkSession:
    """A single-machine session for tests and the benchmark.

    A cluster session is made by whoever submits the job; nothing below is
    needed for right results except the UTC time zone.
    """
    return guarded(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def guarded(spark: SparkSession) -> SparkSession:
    """A session whose unions do not claim their children's partitioning.

    Spark 4.1 lets an aggregation above a union of equally partitioned children
    skip its shuffle. Adaptive execution may then coalesce the children
    differently, and equal keys miss each other: rows come out wrong, with no
    error. Plans here union and aggregate, so the claim is switched off.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    A session on this machine alone gets a folder of its own, removed when Python
    ends. Any other session has to name one: plans would otherwise be run again
    from the start for each of their readers.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="basketlens-")
        atexit.register(shutil.rmtree, _LOCAL_DIRS[app], True)
    return _LOCAL_DIRS[app]


def run_dir(spark: SparkSession) -> str:
    """Where this application keeps its intermediate tables."""
    return f"{shared_dir(spark)}/basketlens/{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, at the end of a run."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, never one that was written before."""
    return f"{run_dir(spark)}/{name}-{uuid4().hex[:12]}"


def settled(frame: DataFrame, name: str) -> DataFrame:
    """A small result several later steps read, written once and served from there.

    Lost executors then re-read files instead of re-running the plan above them.
    """
    return written(frame, fresh_path(frame.sparkSession, name))


def written(frame: DataFrame, path: str) -> DataFrame:
    """A frame written to a path and read from it; its schema is known already."""
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
