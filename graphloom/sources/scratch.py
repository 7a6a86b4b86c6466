"""Tables and checkpoints in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ours: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Without that setting, one of our own where the session runs in one process (tests); on a cluster an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_graphloom_dir", None)
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = sc._graphloom_dir = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    return found


def new_dir(spark: SparkSession, kind: str) -> str:
    """A fresh folder under the shared one, removed at the end of the process."""
    path = f"{shared_dir(spark)}/graphloom/{kind}-{uuid.uuid4().hex}"
    if not _ours:
        atexit.register(_clean)
    _ours.append((spark, path))
    return path


def _clean() -> None:
    for spark, path in _ours:
        with contextlib.suppress(Exception):  # the session may be gone by now; the next folder may still go
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def settle(df: DataFrame) -> DataFrame:
    """A checkpoint of df in the shared folder. Its files go when nothing refers to it any more, if spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, *keys: str) -> DataFrame:
    """df as Parquet files in the shared folder: packed by column, where a checkpoint holds plain rows. With keys, dealt by them for good: joins on all of them leave it where it is."""
    spark = df.sparkSession
    out = df.write.format("parquet").option("path", new_dir(spark, "table"))
    name = f"graphloom_{uuid.uuid4().hex}"
    if keys:
        out = out.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)
    out.saveAsTable(name)
    found = spark.table(name)
    found.schema  # resolved, so that the name can go; the files stay
    spark.sql(f"DROP TABLE {name}")
    return found


#: Rows (a node name or a small vector each) that every executor may hold.
FEW_ROWS = 200_000


def hinted(df: DataFrame) -> DataFrame:
    """A settled df, to be broadcast if it has few rows. It is counted first, so a large one is never broadcast."""
    return F.broadcast(df) if df.count() <= FEW_ROWS else df
